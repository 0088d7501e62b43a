"""Splits and draws, all decided by hashes of keys, so that neither partitioning nor reruns change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.config import PIXELS_PER_ROW, SUBUNITS
from acrelens.functions.scalar import hash_int
from acrelens.sources.tables import scratch


def sweep_split(year: Column) -> Column:
    """train before 2013; then test in even years and valid in odd ones."""
    return F.when(year < 2013, "train").when(year % 2 == 0, "test").otherwise("valid")


def temporal_split(year: Column, first: int = 2014) -> Column:
    return F.when(year < first, "train").otherwise("test")


def year_split(year: Column, test_years: tuple) -> Column:
    return F.when(year.isin(*test_years), "test").otherwise("train")


def random_split(*keys: Column, salt: str = "row") -> Column:
    """A quarter of keys is test. By region: pass the prefix of the cell."""
    return F.when(hash_int(F.lit(salt), *keys) % 4 == 0, "test").otherwise("train")


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by key to as many partitions as a shuffle has, for what makes many rows of each or groups by these keys more than once.
    Small partitions aren't put together, as their rows multiply. Floating keys are left out if there are others, as Spark groups by a
    normalised form of them, for which it would shuffle again."""
    kinds = dict(df.dtypes)
    whole = [k for k in keys if kinds[k] not in ("double", "float")] or keys
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *whole)


def numbered_rows(df: DataFrame, keys: list[str], order: list[str], at: str = "at", parts: int = 64) -> DataFrame:
    """Add the number (from 1) of each row within its key. No key is sorted in one task: its rows are parted by a hash of
    the first column of `order`, numbered within the parts, and the parts' sizes give each its first number."""
    rows = df.withColumn("_part", (hash_int(F.lit("part"), F.col(order[0])) % parts).cast("int"))
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return rows.withColumn("_own", own).join(sizes, [*keys, "_part"]).withColumn(at, (F.col("_before") + F.col("_own")).cast("int")).drop("_part", "_own", "_before")


def placed_rows(df: DataFrame, order: list[str], at: str = "at") -> DataFrame:
    """A written table of `df`'s rows with the place (from 0) of each in the order of `order`, whatever their number.

    The rows are sorted by ranges and written with their number within a range; how many the ranges before hold, a figure for
    each range, gives the rest. Writing fixes the ranges, so that both see the same ones.
    """
    path = scratch(df.sparkSession, "placed")
    numbered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    numbered.select("*", F.shiftright("_id", 33).alias("_range")).write.parquet(path)
    rows = df.sparkSession.read.schema(numbered.schema.add("_range", "long")).parquet(path)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n")).collect()  # as many as there are shuffle partitions
    before, begin = 0, []
    for r in sorted(sizes, key=lambda r: r["_range"]):
        begin.append((r["_range"], before))
        before += r["_n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(begin, "_range long, _before long"))
    own = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, "_range").withColumn(at, F.col("_before") + own).drop("_range", "_before", "_id")


def draw_values(df: DataFrame, keys: list[str], value: str, order: list[str], draws: int = 1000, salt: str = "draw") -> DataFrame:
    """`draws` values of each group, with replacement: keys, draw (from 1), value.

    Long form, without gathering a group: each row has its number within the group, each draw an index from a hash, and
    they meet in a join, all draws of a number as one row. `order` has to order a group's rows.
    """
    numbered = numbered_rows(df, keys, order).select(*keys, F.col(value).alias("value"), "at")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    wanted = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    wanted = wanted.withColumn("at", (hash_int(F.lit(salt), *[F.col(k) for k in keys], F.col("draw")) % F.col("n") + 1).cast("int"))
    drawn = wanted.groupBy(*keys, "at").agg(F.collect_list("draw").alias("_draws"))  # at most `draws`
    return drawn.join(numbered, [*keys, "at"]).select(*keys, F.explode("_draws").alias("draw"), "value")


def merge_samples(a: Column, b: Column, n_a: Column, n_b: Column, key: Column, draws: int = 1000) -> Column:
    """A sample of both arrays, each draw from one of them in proportion to its count."""
    share = F.try_divide(n_a.cast("double"), n_a + n_b)

    def one(i: Column) -> Column:
        from_a = hash_int(F.lit("side"), key, i) / F.lit(float(1 << 32)) < share
        pick = lambda arr: F.get(arr, (hash_int(F.lit("at"), key, i) % F.size(arr)).cast("int"))
        return F.when(from_a, pick(a)).otherwise(pick(b))

    return F.transform(F.sequence(F.lit(1), F.lit(draws)), one)


def cell_observations(observations: Column, cell_size: Column) -> Column:
    """Observations of a cell, or of one of its subunits for the longer geohash."""
    return F.when(cell_size == 5, F.bround(observations / SUBUNITS)).otherwise(observations).cast("long")


def draw_units(tasks: DataFrame, keys: list[str], observations: str, sizes: list[float], salt: str = "unit") -> DataFrame:
    """Insured units of each task until its observations are used up: keys, unit (from 1), unitSize.

    Enough units are drawn for the least size, the running sum keeps those that begin before the observations end. `sizes` is
    the published list of unit sizes, which is short.
    """
    arr = F.array(*[F.lit(float(s)) for s in sizes])
    return _until_used(tasks, keys, F.col(observations), arr, F.lit(float(min(sizes))), lambda size: size, salt).select(*keys, "unit", "unitSize")


def draw_scaled_units(tasks: DataFrame, keys: list[str], observations: str, sizes: DataFrame, scaler: float = PIXELS_PER_ROW, cell_size: str = "geohashSimSize", salt: str = "unit") -> DataFrame:
    """Units as trials draw them: all columns of the task, unit, unitSize, pixels (a scaled size, rounded up) and num.

    num is the task's observations over the scaler; for the longer geohash it is that of one subunit, rounded half to even, and unit
    sizes are divided as well. Tasks without num have no units. `sizes` is one row with the array unitSizes, the published list.
    """
    sub = F.col(cell_size) == 5
    scaled = F.col(observations) / F.lit(float(scaler))
    rows = tasks.withColumn("num", F.when(sub, F.bround(scaled / SUBUNITS)).otherwise(scaled)).crossJoin(F.broadcast(sizes))
    pixels = lambda size: F.ceil(size * F.when(sub, F.lit(1.0 / SUBUNITS)).otherwise(F.lit(1.0)) / F.lit(float(scaler)))
    out = _until_used(rows, keys, F.col("num"), F.col("unitSizes"), F.lit(1.0), pixels, salt)
    return out.withColumn("unitSize", F.when(sub, F.col("unitSize") / SUBUNITS).otherwise(F.col("unitSize"))).withColumnRenamed("taken", "pixels").drop("unitSizes")


def _until_used(tasks: DataFrame, keys: list[str], budget: Column, sizes: Column, least: Column, taken, salt: str) -> DataFrame:
    """The tasks' rows with unit, unitSize and what it takes of the budget, while the budget lasts. Tasks are dealt by key before
    their units are made, which then stay there."""
    drawn = dealt(tasks.where(budget > 0), keys).withColumn("unit", F.explode(F.sequence(F.lit(1), F.ceil(budget / least).cast("int"))))
    size = F.get(sizes, (hash_int(F.lit(salt), *[F.col(k) for k in keys], F.col("unit")) % F.size(sizes)).cast("int"))
    drawn = drawn.withColumn("unitSize", size).withColumn("taken", taken(F.col("unitSize")))
    before = F.coalesce(F.sum("taken").over(Window.partitionBy(*keys).orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return drawn.withColumn("_before", before).where(F.col("_before") < budget).drop("_before")


def apply_offset(policy: Column, value: Column, offset: Column) -> Column:
    """always, never, or negative: only where the value is below zero."""
    return F.when((policy == "always") | ((policy == "negative") & (value < 0)), value - offset).otherwise(value)
