"""Projections, thresholds and simulation tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.operators.distributions import pool


def effective_year(year: Column, mode: str = "train") -> Column:
    """Years as models see them: from 2007 in training, from 1998 in projecting, held at 0."""
    return {"train": year - 2007, "project": year - 1998, "hold": F.lit(0)}[mode]


def join_years(df: DataFrame, late: bool = False, shift: int = 10) -> DataFrame:
    """simYear and the joinYear that it meets its baseline by."""
    return df.withColumn("simYear", F.col("year")).withColumn("joinYear", F.col("year") - shift if late else F.col("year"))


def copy_projection(df: DataFrame, late: bool = False, shift: int = 10) -> DataFrame:
    """The historic projection without a model: predictions are the yields themselves."""
    out = join_years(df, late, shift)
    return out.select("geohash", "simYear", "joinYear", F.col("yieldMean").alias("predictedMean"), F.col("yieldStd").alias("predictedStd"), "yieldObservations")


def observation_counts(df: DataFrame) -> DataFrame:
    return df.select("geohash", "year", F.bround("yieldObservations").cast("long").alias("yieldObservations"))


def std_equivalents(df: DataFrame, levels: list[float]) -> DataFrame:
    """For each loss level of the mean the level in standard deviations, weighted by observations."""
    each = F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level")
    rows = df.where("yieldStd > 0").select("yieldStd", F.bround("yieldObservations").alias("n"), each)
    return rows.groupBy("level").agg(F.try_divide(F.sum(F.col("n") * F.col("level") / F.col("yieldStd")), F.sum("n")).alias("thresholdStd"))


def build_tasks(baseline: DataFrame, projection: DataFrame, counts: DataFrame, condition: str) -> DataFrame:
    """Simulation tasks: baseline and projection of a cell and joinYear, with observations above 0."""
    base = baseline.select("geohash", "joinYear", F.col("predictedMean").alias("originalYieldMean"), F.col("predictedStd").alias("originalYieldStd"))
    future = projection.select("geohash", "joinYear", F.col("simYear").alias("year"), F.col("predictedMean").alias("projectedYieldMean"), F.col("predictedStd").alias("projectedYieldStd"))
    seen = counts.where("yieldObservations > 0").select("geohash", F.col("year").alias("joinYear"), F.col("yieldObservations").alias("numObservations"))
    out = base.join(future, ["geohash", "joinYear"]).join(seen, ["geohash", "joinYear"])
    return out.select("geohash", "year", F.lit(condition).alias("condition"), "originalYieldMean", "originalYieldStd", "projectedYieldMean", "projectedYieldStd", "numObservations")


def pooled_baseline(projection: DataFrame, years: DataFrame) -> DataFrame:
    """A cell's projections pooled over years, for each of the years (joinYear, simYear) to simulate. `years` is a short list."""
    rows = projection.select("geohash", F.col("predictedMean").alias("mean"), F.col("predictedStd").alias("std"), F.col("yieldObservations").alias("count"))
    pooled = pool(rows, ["geohash"], with_range=False, shape=False)
    return pooled.crossJoin(F.broadcast(years.select("joinYear", "simYear").distinct())).select("geohash", "simYear", "joinYear", F.col("mean").alias("predictedMean"), F.col("std").alias("predictedStd"), F.col("count").alias("yieldObservations"))


def grid(spark, **choices) -> DataFrame:
    """All combinations of a few settings: one column for each. One row is exploded, so the grid stays in one partition."""
    out = spark.range(1, numPartitions=1)
    for name, values in choices.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out.drop("id")


def with_variants(tasks: DataFrame, thresholds: tuple, std_multipliers: tuple, cell_sizes: tuple, offsets: tuple) -> DataFrame:
    """Each task under all settings. The settings are an array of literals, so nothing is joined."""
    settings = [F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("stdMult"), F.lit(c).alias("geohashSimSize"), F.lit(o).alias("offsetBaseline")) for t in thresholds for m in std_multipliers for c in cell_sizes for o in offsets]
    return tasks.select("*", F.explode(F.array(*settings)).alias("_v")).select(*tasks.columns, "_v.*")


def with_std_threshold(df: DataFrame, equivalents: DataFrame) -> DataFrame:
    """Attach thresholdStd, matching thresholds to two decimals. `equivalents` has a row for each level."""
    short = equivalents.select(F.format_string("%.2f", "level").alias("_k"), "thresholdStd")
    return df.withColumn("_k", F.format_string("%.2f", "threshold")).join(F.broadcast(short), "_k", "left").drop("_k")


def pick_one(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key, by an explicit order: one grouped minimum, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*[c if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])
