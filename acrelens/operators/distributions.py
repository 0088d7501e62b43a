"""Distribution summaries of cells, and pooling of summaries in closed form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.functions.scalar import finite


def summarize(df: DataFrame, keys: list[str], value: str = "value", with_range: bool = True) -> DataFrame:
    """mean, std (population), [min, max,] count, skew, kurtosis (excess) by key; groups without a value are absent.

    Spark combines these aggregates before the shuffle, so a hot cell costs one row per task.
    """
    v = F.col(value)
    ends = [F.min(v).alias("min"), F.max(v).alias("max")] if with_range else []
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), *ends, F.count(v).alias("count"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"))


def _weighted(x: Column, n: Column) -> Column:
    ok = finite(x).isNotNull()
    return F.try_divide(F.sum(F.when(ok, x * n)), F.sum(F.when(ok, n)))


def pool(df: DataFrame, keys: list[str], with_range: bool = True, shape: bool = True, total_variance: bool = False, legacy_max: bool = False) -> DataFrame:
    """Pool summaries by key: weighted mean, pooled std, min, max, summed count, weighted skew and kurtosis.

    The std is sqrt(sum((n - 1) s^2) / (N - k)), whatever the order of the k summaries; two single values
    give the sample std of both. With `total_variance` it is that of all values taken together. Summaries of count 0 are left
    out. `legacy_max` gives the largest minimum in place of the maximum.
    """
    n, m, s = F.col("count"), F.col("mean"), F.col("std")
    total, k = F.sum(n), F.count("*")
    mean = F.sum(m * n) / total
    within = F.when((k == 2) & (total == 2), F.stddev_samp(m)).otherwise(F.sqrt(F.try_divide(F.sum((n - 1) * s * s), total - k)))
    whole = F.sqrt(F.greatest(F.sum(n * (s * s + m * m)) / total - mean * mean, F.lit(0.0)))
    ends = [F.min("min").alias("min"), F.max("min" if legacy_max else "max").alias("max")] if with_range else []
    moments = [_weighted(F.col(c), n).alias(c) for c in ("skew", "kurtosis")] if shape else []
    return df.where(n > 0).groupBy(*keys).agg(mean.alias("mean"), (whole if total_variance else within).alias("std"), *ends, total.alias("count"), *moments)


def beta_shape(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """a, b, loc, scale of a beta distribution with the values' range, mean and variance; null for under two values or none that differ."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v"), F.min(v).alias("loc"), (F.max(v) - F.min(v)).alias("scale"))
    mean, var = F.try_divide(F.col("_m") - F.col("loc"), F.col("scale")), F.try_divide(F.col("_v"), F.col("scale") * F.col("scale"))
    nu = F.try_divide(mean * (1 - mean), var) - 1
    ok = (F.col("count") >= 2) & (F.col("scale") > 0)
    return base.select(*keys, "count", F.when(ok, mean * nu).alias("a"), F.when(ok, (1 - mean) * nu).alias("b"), F.when(ok, F.col("loc")).alias("loc"), F.when(ok, F.col("scale")).alias("scale"))


def with_baseline(yields: DataFrame, cell: str = "geohash") -> DataFrame:
    """Add baselineYieldMean and baselineYieldStd: of the cell's years, weighted by their counts. One exchange, on the cell."""
    w = Window.partitionBy(cell)
    n = F.sum("count").over(w)
    return yields.withColumn("baselineYieldMean", F.try_divide(F.sum(F.col("mean") * F.col("count")).over(w), n)).withColumn("baselineYieldStd", F.try_divide(F.sum(F.col("std") * F.col("count")).over(w), n))


STATE = ("n", "mean", "m2", "m3", "m4", "min", "max")


def state(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """A summary that can be merged exactly: n, mean, the sums m2, m3, m4 of the powers of what the values differ from it, min and max.

    Nulls and NaN are left out, groups without a value are absent.
    """
    v = F.col(value)
    base = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("_v"), F.skewness(v).alias("_s"), F.kurtosis(v).alias("_k"), F.min(v).alias("min"), F.max(v).alias("max"))
    var, n = F.col("_v"), F.col("n")
    spread = lambda x: F.when(var > 0, x).otherwise(F.lit(0.0))
    return base.select(*keys, "n", "mean", (var * n).alias("m2"), spread(F.col("_s") * F.pow(var, F.lit(1.5)) * n).alias("m3"), spread((F.col("_k") + 3) * var * var * n).alias("m4"), "min", "max")


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """The state of all values together from states of parts of them, by key; merged states merge again, in any grouping.

    Two aggregates that combine before their shuffles: the common mean, then each part's sums moved to it. States of
    n = 0 or null are left out; a hot key is one row a task.
    """
    parts = states.where("n > 0").select(*keys, *STATE)
    means = parts.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    same = [F.col(f"p.`{k}`").eqNullSafe(F.col(f"q.`{k}`")) for k in keys]
    moved = parts.alias("p").join(means.alias("q"), reduce(Column.__and__, same)) if keys else parts.alias("p").crossJoin(F.broadcast(means.alias("q")))  # one row
    n, m2, m3, m4, d = F.col("n"), F.col("m2"), F.col("m3"), F.col("m4"), F.col("mean") - F.col("_mean")
    out = moved.groupBy(*[F.col(f"p.`{k}`").alias(k) for k in keys]).agg(
        F.sum(n).alias("n"), F.first("_mean").alias("mean"), F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"), F.min("min").alias("min"), F.max("max").alias("max"),
    )
    return out.select(*keys, *STATE)


def finish_state(states: DataFrame, keys: list[str], with_range: bool = True) -> DataFrame:
    """The columns of summarize() from states: mean, std (population), [min, max,] count, skew, kurtosis (excess); null shape where all values are equal."""
    n, m2 = F.col("n"), F.col("m2")
    varied = lambda x: F.when(m2 > 0, x)
    ends = ["min", "max"] if with_range else []
    skew, kurtosis = varied(F.sqrt(n) * F.col("m3") / F.pow(m2, F.lit(1.5))), varied(n * F.col("m4") / (m2 * m2) - 3)
    return states.select(*keys, "mean", F.sqrt(m2 / n).alias("std"), *ends, n.alias("count"), skew.alias("skew"), kurtosis.alias("kurtosis"))
