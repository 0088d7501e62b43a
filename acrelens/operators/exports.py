"""Exports: scope, families, pairs, claims rates, histograms, climate change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.config import BINS
from acrelens.functions.geo import center
from acrelens.functions.scalar import finite, is_counterfactual, near, quantised, series_condition, series_year


def in_scope(threshold: float | None = None, cell_size: int = 4, historic: bool = False, unit_column: str = "unitSize") -> Column:
    """Rows that an export of a series takes: plain comparisons, so a scan can skip by them."""
    out = near(F.col("stdMult"), 1.0) & (F.col("geohashSimSize") == cell_size) & (F.abs(unit_column) > 1.0001) & (F.col("offsetBaseline") == "always")
    out = out & ((F.col("series") == "2010") if historic else (F.col("series") != "2010"))
    return out if threshold is None else near(F.col("threshold"), threshold) & out


def family_sizes(outcomes: DataFrame, threshold: float = 0.25, cell_size: int = 4) -> DataFrame:
    """Number of tests of each series."""
    return outcomes.where(in_scope(threshold, cell_size)).groupBy("series").agg(F.count("*").alias("familySize"))


def pair(outcomes: DataFrame, families: DataFrame, check: bool = True) -> DataFrame:
    """One row for each cell, year, condition and threshold: predicted and counterfactual figures side by side.

    A grouped conditional maximum pairs them in one exchange; what has no partner keeps nulls. Two rows of one kind
    are an error, which the job raises with `check`. `families` has a row for each series.
    """
    other = is_counterfactual(F.col("series"))
    rows = outcomes.join(F.broadcast(families), "series").withColumn("condition", series_condition(F.col("series"))).withColumn("_cf", other)
    keys = ["geohash", "year", "condition", "threshold"]
    ours = lambda c: F.max(F.when(~F.col("_cf"), c))
    theirs = lambda c: F.max(F.when(F.col("_cf"), c))
    out = rows.groupBy(*keys).agg(
        F.count_if(~F.col("_cf")).alias("_n"), F.count_if(F.col("_cf")).alias("_m"),
        F.coalesce(ours(F.col("num")), theirs(F.col("num"))).alias("num"), ours(F.col("predictedClaims")).alias("predictedRisk"), theirs(F.col("predictedClaims")).alias("counterfactualRisk"),
        ours(F.col("p")).alias("p"), ours(F.col("p") < 0.05 / F.col("familySize")).alias("pMeets0.05n"), ours(F.col("p") < 0.10 / F.col("familySize")).alias("pMeets0.10n"),
        ours(F.col("predictedChange")).alias("predictedMean"), theirs(F.col("predictedChange")).alias("counterfactualMean"),
    )
    if check:
        bad = F.raise_error(F.concat(F.lit("more than one row of a kind: "), F.to_json(F.struct(*keys))))
        out = out.withColumn("num", F.when((F.col("_n") > 1) | (F.col("_m") > 1), bad).otherwise(F.col("num")))
    return out.drop("_n", "_m").withColumnRenamed("threshold", "lossThreshold")


def with_location(df: DataFrame, precision: int = 4) -> DataFrame:
    """Add lat and lng of the cell's middle."""
    c = center(F.col("geohash"), precision)
    return df.withColumn("lat", c["lat"]).withColumn("lng", c["lng"])


CLAIMS_KEYS = ("offsetBaseline", "year", "condition", "threshold", "thresholdStd", "stdMult", "geohashSimSize")


def claims_rates(outcomes: DataFrame, by_series: bool = False, keys: tuple = CLAIMS_KEYS) -> DataFrame:
    """num and the num-weighted claims rates by settings; numbers are matched to four decimals."""
    keys = [*keys, "series"] if by_series else list(keys)
    exact = [c for c in keys if outcomes.schema[c].dataType.typeName() in ("double", "float")]
    grouped = outcomes.groupBy(*[quantised(F.col(c)).alias(f"_{c}") if c in exact else F.col(c) for c in keys])
    n = F.sum("num")
    out = grouped.agg(*[F.min(c).alias(c) for c in exact], F.try_divide(F.sum(F.col("predictedClaims") * F.col("num")), n).alias("claimsRate"), F.try_divide(F.sum(F.col("predictedClaimsStd") * F.col("num")), n).alias("claimsRateStd"), n.alias("num"))
    return out.select(*keys, "claimsRate", "claimsRateStd", "num")


def histogram_export(outcomes: DataFrame, cell_size: int = 4) -> DataFrame:
    """geohashSize, set, series, bin, val: each series' bins, mean, cnt and claimsMpci (threshold .25), and claimsSco (.15).

    Both thresholds are pooled in one pass; bins may be wide columns bin-100 to bin100 that `outcomes` has.
    """
    bins = [f"bin{b}" for b in BINS if f"bin{b}" in outcomes.columns]
    scoped = outcomes.where(in_scope(None, cell_size) & (near(F.col("threshold"), 0.25) | near(F.col("threshold"), 0.15)))
    scoped = scoped.withColumn("_sco", near(F.col("threshold"), 0.15))
    pooled = scoped.groupBy("series", "_sco").agg(F.sum("num").cast("double").alias("cnt"), F.sum(F.col("num") * F.col("predictedClaims")).alias("claims"), F.try_divide(F.sum(F.col("num") * F.col("predictedChange")), F.sum("num")).alias("mean"), *[F.sum(f"`{b}`").cast("double").alias(b) for b in bins])
    rows = pooled.unpivot(["series", "_sco"], [*bins, "claims", "mean", "cnt"], "bin", "val")
    rows = rows.where(~F.col("_sco") | (F.col("bin") == "claims"))
    label = F.when(F.col("bin") == "claims", F.when(F.col("_sco"), "claimsSco").otherwise("claimsMpci")).otherwise(F.regexp_replace("bin", "^bin", ""))
    kind = F.when(is_counterfactual(F.col("series")), "counterfactual").otherwise("predicted")
    return rows.select(F.lit(cell_size).alias("geohashSize"), series_year(F.col("series")).alias("set"), kind.alias("series"), label.alias("bin"), "val")


def union_series(series: dict[str, DataFrame]) -> DataFrame:
    """All series one below the other, each with its label."""
    return reduce(DataFrame.unionByName, [df.withColumn("series", F.lit(name)) for name, df in series.items()])


def clean_sweep(df: DataFrame) -> DataFrame:
    """A sweep's columns as text made numbers; allowCount becomes 1 or 0."""
    numbers = [F.col(c).try_cast("int" if c == "layers" else "double").alias(c) for c in df.columns if c not in ("block", "allowCount")]
    return df.select("block", (F.lower("allowCount") == "true").cast("int").alias("allowCount"), *numbers)


def climate_change(history: DataFrame, future: DataFrame) -> DataFrame:
    """Change of each future monthly mean as a z-score against the historic mean and std of the attribute over all months,
    averaged over conditions' years: year, geohash, month and a column <attr>MeanChange each. Rows with a part missing go."""
    stats = history.where(finite(F.col("mean")).isNotNull()).groupBy("attr").agg(F.avg("mean").alias("_m"), F.stddev_samp("mean").alias("_s"))
    attrs = ("rhn", "rhx", "tmax", "tmin", "chirps", "svp", "vpd", "wbgtmax")
    z = future.join(F.broadcast(stats), "attr").where(finite(F.col("mean")).isNotNull() & (F.col("_s") > 0)).select("year", "geohash", "month", "attr", ((F.col("mean") - F.col("_m")) / F.col("_s")).alias("z"))
    return z.groupBy("year", "geohash", "month").pivot("attr", list(attrs)).agg(F.avg("z")).select("year", "geohash", "month", *[F.col(a).alias(f"{a}MeanChange") for a in attrs])


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all of the columns are finite."""
    return df.where(reduce(Column.__and__, [finite(F.col(c)).isNotNull() for c in columns]))


def significant_share(paired: DataFrame, flag: str = "pMeets0.05n", weight: str = "num") -> DataFrame:
    """Weight of rows of cells that are significant in any year, over all weight. One exchange, on the cell."""
    ever = F.max(F.coalesce(F.col(f"`{flag}`"), F.lit(False))).over(Window.partitionBy("geohash"))
    return paired.withColumn("_e", ever).agg(F.try_divide(F.sum(F.when(F.col("_e"), F.col(weight)).otherwise(0)), F.sum(weight)).alias("percentSignificant"))
