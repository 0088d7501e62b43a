"""What explorers of the results show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.functions.scalar import change_category, finite, is_loss, series_year


def select_records(df: DataFrame, scenario: str, threshold_label: str, year: int | None = None) -> DataFrame:
    out = df.where(F.col("condition").startswith(scenario) & (F.col("loss") == threshold_label))
    return out if year is None else out.where(F.col("year") == year)


def pool_records(df: DataFrame, keys: tuple = ("geohash", "condition", "lossThreshold")) -> DataFrame:
    """Records over years: num summed, risks and means weighted by it, std pooled, the least p."""
    n = F.col("num")
    avg = lambda c: F.try_divide(F.sum(F.col(c) * n), F.sum(F.when(F.col(c).isNotNull(), n))).alias(c)
    std = F.sqrt(F.try_divide(F.sum((n - 1) * F.col("std") * F.col("std")), F.sum(n) - F.count("*"))).alias("std")
    more = [std] if "std" in df.columns else []
    return df.groupBy(*keys).agg(F.sum(n).alias("num"), avg("predictedRisk"), avg("counterfactualRisk"), avg("predictedMean"), avg("counterfactualMean"), *more, F.min("p").alias("p"))


def categorise(df: DataFrame, change: Column, alpha: float = 0.05, years_per_record: int = 5) -> DataFrame:
    """Add category: by sign and by p under the Bonferroni rule with records x years tests. The number of records comes
    from an aggregate of one row, not from a window over the whole table."""
    total = df.agg(F.count("*").alias("_records"))
    limit = F.lit(alpha) / (F.col("_records") * years_per_record)
    return df.crossJoin(F.broadcast(total)).withColumn("category", change_category(change, F.col("p"), limit)).drop("_records")


def shares(df: DataFrame, key: str, weight: str, within: tuple = ()) -> DataFrame:
    """Weight and percent of each key, largest first."""
    sums = df.groupBy(*within, key).agg(F.sum(weight).alias("weight"))
    # after the aggregate only a row for each key is left
    return sums.withColumn("percent", F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))))).orderBy(F.desc("percent"), key)


def axis_shares(df: DataFrame, value: str, weight: str, step: float) -> DataFrame:
    """Share of weight at each rounded step of an axis."""
    return shares(df.withColumn("at", F.bround(F.col(value) / step) * step), "at", weight)


def histogram_percents(rows: DataFrame, claims: str = "claimsMpci") -> DataFrame:
    """Of exported histogram rows: percent of each bin, and the series' claims rate of the chosen coverage."""
    keys = ["set", "series"]
    summary = rows.groupBy(*keys).agg(F.sum(F.when(F.col("bin") == claims, F.col("val"))).alias("_c"), F.sum(F.when(F.col("bin") == "cnt", F.col("val"))).alias("_n"))
    bins = rows.where(F.col("bin").try_cast("int").isNotNull()).groupBy(*keys, F.col("bin").cast("int").alias("bin")).agg(F.sum("val").alias("val"))
    share = F.try_divide(F.col("val"), F.sum("val").over(Window.partitionBy(*keys)))
    return bins.withColumn("percent", share).join(F.broadcast(summary), keys).select(*keys, "bin", "percent", F.try_divide("_c", "_n").alias("claimsRate"))


def edge_histogram(df: DataFrame, keys: list[str], value: str, low: float = 10.0, high: float = 20.0, bins: int = 19) -> DataFrame:
    """Counts in equal bins (from 1) from low to high; the last one holds high too, what lies outside is dropped."""
    v = F.col(value)
    at = F.when(v == high, F.lit(bins)).otherwise(F.width_bucket(v, F.lit(low), F.lit(high), F.lit(bins)))
    return df.where((v >= low) & (v <= high)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def loss_events(df: DataFrame, cell: str, value: str, share: float = 0.25, stds: float = 1.5) -> DataFrame:
    """Years of each cell below the mean by a share of it, or by a number of sample stds."""
    sums = df.groupBy(cell).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    rows = df.select(cell, value).join(sums, cell)
    return rows.groupBy(cell).agg(F.count_if(F.col(value) < F.col("_m") * (1 - share)).alias("belowMean"), F.count_if(F.col(value) < F.col("_m") - stds * F.col("_s")).alias("belowStd"), F.count("*").alias("years"))


def expected_yields(df: DataFrame, cell: str, year: str, value: str, back: int = 10) -> DataFrame:
    """Add expected: the mean of up to `back` years before (null for the first), and isLoss at 75 % coverage."""
    before = Window.partitionBy(cell).orderBy(year).rowsBetween(-back, -1)
    out = df.withColumn("expected", F.avg(value).over(before))
    return out.withColumn("isLoss", is_loss(F.col(value), F.col("expected"), F.lit(0.75)))


def year_pairs(df: DataFrame, cell: str, year: str, columns: list[str]) -> DataFrame:
    """Rows of a cell with the columns of its row before: sequences of two."""
    own = Window.partitionBy(cell).orderBy(year)
    return df.select("*", F.lag(year).over(own).alias(f"{year}Before"), *[F.lag(c).over(own).alias(f"{c}Before") for c in columns]).where(F.col(f"{year}Before").isNotNull())


def with_climate(points: DataFrame, changes: DataFrame) -> DataFrame:
    """Points with the climate change of their cell, year and month, and whether it is missing (an error of the inputs)."""
    keys = ["geohash", "year", "month"]
    return points.join(changes.withColumn("_found", F.lit(True)), keys, "left").withColumn("climateMissing", F.col("_found").isNull()).drop("_found")


def scheme_claims(rates: DataFrame, using_std: bool, threshold: float = 0.25) -> DataFrame:
    """System-wide claims of one scheme: offset always, four-letter cells."""
    rows = rates.where((F.col("offsetBaseline") == "always") & (F.col("geohashSimSize") == 4) & (F.abs(F.col("threshold") - threshold) < 1e-4))
    return rows.select("year", "condition", F.col("claimsRateStd" if using_std else "claimsRate").alias("claims"), F.col("thresholdStd" if using_std else "threshold").alias("level"))


def valid_points(df: DataFrame, columns: list[str], significant_only: bool = False) -> DataFrame:
    """Points with all of the columns finite; with `significant_only` none whose category says that nothing is known or changes."""
    out = df.where(reduce(Column.__and__, [finite(F.col(c)).isNotNull() for c in columns]))
    return out.where(~F.col("category").isin("no significant change", "unknown")) if significant_only else out


def relabel_historic(df: DataFrame) -> DataFrame:
    return df.withColumn("set", series_year(F.col("series")))
