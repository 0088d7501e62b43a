"""The training frame: long first, pivoted last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.config import ATTRIBUTES, MONTHS
from acrelens.functions.scalar import delta, finite, z_score
from acrelens.operators.distributions import with_baseline

STATS = ("mean", "std", "min", "max", "count")


def restrict(df: DataFrame, cells: DataFrame, key: str = "geohash", region: str | None = None) -> DataFrame:
    """Rows of the wanted cells. How the list travels is left to adaptive execution, which knows its size.

    `region` is the column by which `df`'s table is stored in parts, the cell's prefix (tables.write_by_region()): then a short list prunes
    the scan to the parts of its cells while the job runs.
    """
    if region is None:
        return df.join(cells.select(key).distinct(), key, "left_semi")
    return df.join(cells.select(key, region).distinct(), [region, key], "left_semi")


def combine(yields: DataFrame, climate: DataFrame) -> DataFrame:
    """Long frame: every yield cell-year with its monthly climate rows (of one condition), its baseline and climateCounts.

    Years without climate stay, with nulls and a count of 0; climate of years without yields is left out.
    """
    counted = with_baseline(yields).select("geohash", "year", "baselineYieldMean", "baselineYieldStd", F.col("mean").alias("yieldMean"), F.col("std").alias("yieldStd"), F.bround("count").cast("long").alias("yieldObservations"))
    months = climate.select("geohash", "year", "month", "attr", *[F.col(c).alias(f"c_{c}") for c in STATS])
    own = Window.partitionBy("geohash", "year")
    return counted.join(months, ["geohash", "year"], "left").withColumn("climateCounts", F.count("attr").over(own))


def strays(yields: DataFrame, climate: DataFrame) -> DataFrame:
    """Cells that have climate but no yield at all: an error of the inputs."""
    return climate.select("geohash").distinct().join(yields.select("geohash").distinct(), "geohash", "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def widen(long: DataFrame, attrs: tuple = tuple(ATTRIBUTES.values()), months=MONTHS, ids: tuple = ("geohash", "year", "baselineYieldMean", "baselineYieldStd", "yieldMean", "yieldStd", "yieldObservations", "climateCounts")) -> DataFrame:
    """attr + Stat + month columns for all given attributes and months, named beforehand so that no job looks for them."""
    names = [f"{a}|{m}" for a in attrs for m in months]
    keyed = long.withColumn("_c", F.concat_ws("|", "attr", F.col("month").cast("string")))
    wide = keyed.groupBy(*ids).pivot("_c", names).agg(*[F.first(f"c_{s}").alias(s) for s in STATS])
    return wide.select(*ids, *[F.col(f"`{a}|{m}_{s}`").alias(f"{a}{s.capitalize()}{m}") for a in attrs for m in months for s in STATS])


def future_frame(climate: DataFrame, **kwargs) -> DataFrame:
    """Frame of a future condition: climate alone, with -1 for the unknown response."""
    unknown = [F.lit(-1.0).alias(c) for c in ("baselineYieldMean", "baselineYieldStd", "yieldMean", "yieldStd")]
    months = climate.select("geohash", "year", *unknown, F.lit(-1).cast("long").alias("yieldObservations"), "month", "attr", *[F.col(c).alias(f"c_{c}") for c in STATS])
    own = Window.partitionBy("geohash", "year")
    return widen(months.withColumn("climateCounts", F.count("attr").over(own)), **kwargs)


def lengthen(wide: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Columns as rows (field, value)."""
    return wide.unpivot(ids, [F.col(c).cast("double").alias(c) for c in columns], "field", "value")


def averages(long: DataFrame) -> DataFrame:
    """Historic mean of each cell's field over years, of finite values."""
    return long.select("geohash", "field", finite(F.col("value")).alias("v")).where("v is not null").groupBy("geohash", "field").agg(F.avg("v").alias("mean"))


def field_distributions(long: DataFrame) -> DataFrame:
    """mean and std of each field over all rows."""
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("field").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def field_deltas(long: DataFrame, means: DataFrame) -> DataFrame:
    """Values less their cell's average, and whether the row (geohash, year) has all averages."""
    joined = long.join(means, ["geohash", "field"], "left")
    own = Window.partitionBy("geohash", "year")
    return joined.select("geohash", "year", "field", (F.col("value") - F.col("mean")).alias("value"), F.min(F.col("mean").isNotNull()).over(own).alias("valid"))


def own_deltas(long: DataFrame) -> DataFrame:
    """field_deltas() against the averages of the same rows: one exchange by cell and field, whose rows are a cell's years."""
    mean = F.avg(finite(F.col("value"))).over(Window.partitionBy("geohash", "field"))
    rows = long.select("geohash", "year", "field", "value", mean.alias("mean"))
    own = Window.partitionBy("geohash", "year")
    return rows.select("geohash", "year", "field", (F.col("value") - F.col("mean")).alias("value"), F.min(F.col("mean").isNotNull()).over(own).alias("valid"))


def z_scores(long: DataFrame, distributions: DataFrame) -> DataFrame:
    """Each value as a z-score of its field. A field list is as long as the frame is wide, so its join broadcasts a bounded table."""
    return long.join(F.broadcast(distributions), "field", "left").select("geohash", "year", "field", z_score(F.col("value"), F.col("mean"), F.col("std")).alias("z"))


def _bound(x: Column, f) -> Column:
    """f of x, which is worked out once."""
    return F.transform(F.array(x), f)[0]


def response(sample: Column, base: Column) -> Column:
    """Struct mean, std, skew, kurtosis, complete of a sample's deltas against a baseline; no row is multiplied.

    For samples of a bounded size, as draws are; values still in rows are summarised after scalar.delta()."""

    def moments(d: Column) -> Column:
        n = F.size(d).cast("double")
        mean = F.try_divide(F.aggregate(d, F.lit(0.0), lambda a, x: a + x), n)
        return _bound(mean, lambda m: _bound(F.aggregate(d, F.struct(*[F.lit(0.0).alias(f"p{k}") for k in (2, 3, 4)]), lambda a, x: powers(a, x - m)), lambda p: figures(m, p, n)))

    def powers(a: Column, x: Column) -> Column:
        return F.struct(*[(a[f"p{k}"] + F.pow(x, F.lit(float(k)))).alias(f"p{k}") for k in (2, 3, 4)])

    def figures(mean: Column, p: Column, n: Column) -> Column:
        var = F.try_divide(p["p2"], n)
        skew = F.try_divide(F.try_divide(p["p3"], n), F.pow(var, F.lit(1.5)))
        kurtosis = F.try_divide(F.try_divide(p["p4"], n), var * var) - 3
        return F.struct(mean.alias("mean"), F.sqrt(var).alias("std"), skew.alias("skew"), kurtosis.alias("kurtosis"), (mean.isNotNull() & skew.isNotNull()).alias("complete"))

    return _bound(F.transform(F.filter(sample, lambda x: finite(x).isNotNull()), lambda x: delta(x, base)), moments)
