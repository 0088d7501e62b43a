"""System-wide statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelens.functions.scalar import is_counterfactual, percent, series_year, severity_percent


def series_stats(outcomes: DataFrame) -> DataFrame:
    """kind, year, num, mean, probability, severity of (scoped) outcomes; severity is of rows that have any."""
    kind = F.when(F.contains("series", F.lit("historic")), "historic").when(is_counterfactual(F.col("series")), "counterfactual").otherwise("experimental")
    n, lost = F.sum("num"), F.col("predictedLoss") != 0
    return outcomes.groupBy(kind.alias("kind"), series_year(F.col("series")).alias("year")).agg(
        n.alias("num"), F.try_divide(F.sum(F.col("predictedChange") * F.col("num")), n).alias("mean"), F.try_divide(F.sum(F.col("predictedClaims") * F.col("num")), n).alias("probability"),
        F.coalesce(F.try_divide(F.sum(F.when(lost, F.col("predictedLoss") * F.col("num"))), F.sum(F.when(lost, F.col("num")))), F.lit(0.0)).alias("severity"),
    )


def record(stats: DataFrame) -> DataFrame:
    """One row with a text for each figure: <kind>{Mean,Probability,Severity}<year>."""
    cols = []
    for kind, years in (("counterfactual", (2030, 2050)), ("experimental", (2030, 2050)), ("historic", (2010,))):
        for year in years:
            own = lambda c, kind=kind, year=year: F.max(F.when((F.col("kind") == kind) & (F.col("year") == year), F.col(c)))
            cols += [percent(own("mean")).alias(f"{kind}Mean{year}"), percent(own("probability")).alias(f"{kind}Probability{year}"), severity_percent(own("severity")).alias(f"{kind}Severity{year}")]
    return stats.agg(*cols)


def combine_records(*records: tuple[DataFrame, str]) -> DataFrame:
    """One row of several one-row tables; (table, suffix) renames its columns."""
    named = [df.select(*[F.col(f"`{c}`").alias(f"{c}{suffix}") for c in df.columns]) for df, suffix in records]
    return reduce(DataFrame.crossJoin, named)


def dual_increase(paired: DataFrame) -> DataFrame:
    """Of cells with a higher predicted than counterfactual risk in any row, the share whose pooled change isn't negative."""
    cells = paired.groupBy("geohash").agg(F.max(F.coalesce(F.col("predictedRisk") > F.col("counterfactualRisk"), F.lit(False))).alias("risk"), F.try_divide(F.sum(F.col("predictedMean") * F.col("num")), F.sum(F.when(F.col("predictedMean").isNotNull(), F.col("num")))).alias("change"))
    return cells.agg(F.count_if("risk").alias("riskCells"), F.count_if(F.col("risk") & (F.col("change") >= 0)).alias("dualCells"), F.try_divide(F.count_if(F.col("risk") & (F.col("change") >= 0)), F.count_if("risk")).alias("dualIncrease"))
