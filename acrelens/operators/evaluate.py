"""Errors of predictions, selection among configurations, and scoring."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.config import MEAN_WEIGHT, PIXELS_PER_ROW, STD_WEIGHT
from acrelens.sources.tables import scratch


def feature_columns(columns: list[str], blocked: tuple = (), words: tuple = (), exclude_counts: bool = False) -> list[str]:
    """Sorted inputs of a model: without blocked names, names with a blocked word and, if asked, counts."""
    out = [c for c in columns if c not in blocked and not any(w.lower() in c.lower() for w in words)]
    return sorted(c for c in out if not (exclude_counts and "count" in c.lower()))


def weighted_errors(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]], weight: str) -> DataFrame:
    """Weighted mean absolute error of each pair (predicted, actual), by key."""
    return df.groupBy(*keys).agg(*[F.try_divide(F.sum(F.abs(F.col(p) - F.col(a)) * F.col(weight)), F.sum(weight)).alias(n) for n, (p, a) in pairs.items()])


def errors_by_split(df: DataFrame, keys: list[str], predicted: str, actual: str, weight: str, splits: tuple = ("train", "valid", "test"), suffix: str = "Mean") -> DataFrame:
    """The same with a column for each split (column setAssign), in one pass."""
    out = []
    for s in splits:
        own = F.col("setAssign") == s
        out.append(F.try_divide(F.sum(F.when(own, F.abs(F.col(predicted) - F.col(actual)) * F.col(weight))), F.sum(F.when(own, F.col(weight)))).alias(f"{s}{suffix}"))
    return df.groupBy(*keys).agg(*out)


def plain_errors(df: DataFrame, keys: list[str], predicted: str, actual: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae"))


def order_bits(value: Column) -> Column:
    """64 bits of a double as a long that sorts as the doubles do; both zeros are one."""
    raw = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(raw < 0, raw.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(raw)


def _from_order_bits(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n if n >= 0 else n ^ ((1 << 63) - 1)))[0]


def exact_medians(df: DataFrame, values: list[str], step: int = 13) -> dict[str, float | None]:
    """The exact median of each column, nulls and NaN left out; None where nothing is left.

    Found by selection without ordering rows: a histogram of the leading bits tells in which range the middle ranks lie, the next
    `step` bits of that range are counted, and so on until a range holds one value. So at most 2 x 2^step counts of a column
    reach the driver in each of at most 64 / step rounds, whatever the rows hold. The bits are written once and read each round.
    """
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)])
    rows = df.select(F.explode(each).alias("x")).select("x.c", "x.v").where("v is not null and not isnan(v)")
    path = scratch(df.sparkSession, "bits")
    rows.select("c", order_bits(F.col("v")).alias("bits")).write.parquet(path)
    rows = df.sparkSession.read.schema("c int, bits long").parquet(path)
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count("*").alias("n")).collect()}
    # open ranges: (column, leading bits) -> ranks within that are sought, from 0
    open_ = {(c, 0): sorted({(n - 1) // 2, n // 2}) for c, n in sizes.items()}
    found: dict[int, list[float]] = {c: [] for c in sizes}
    known, total = 0, {c: len(ranks) for (c, _), ranks in open_.items()}
    while open_:
        left = max(0, 64 - known - step)
        lead = (lambda at: F.shiftright("bits", at) + F.lit(1 << (63 - at))) if known else None
        within = reduce(Column.__or__, [(F.col("c") == c) & (lead(64 - known) == p) for c, p in open_]) if lead else F.lit(True)
        place = F.shiftright("bits", left) + F.lit(1 << (63 - left)) if left else F.col("bits")
        counts = rows.where(within).groupBy("c", place.alias("p")).agg(F.count("*").alias("n"), F.min("bits").alias("lo"), F.max("bits").alias("hi")).collect()
        following: dict = {}
        for (c, prefix), ranks in open_.items():
            inside = lambda r: not known or ((r["lo"] >> (64 - known)) + (1 << (known - 1)) == prefix)
            before = 0
            for r in sorted((r for r in counts if r["c"] == c and inside(r)), key=lambda r: r["p"]):
                for rank in ranks:
                    if before <= rank < before + r["n"]:
                        if r["lo"] == r["hi"]:
                            found[c].append(_from_order_bits(r["lo"]))
                        else:
                            following.setdefault((c, r["p"]), []).append(rank - before)
                before += r["n"]
        open_, known = following, min(64, known + step)
    assert all(len(found[c]) == total[c] for c in found)
    return {v: sum(found[i]) / len(found[i]) if found.get(i) else None for i, v in enumerate(values)}


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row, median: that of exact_medians()."""
    return df.sparkSession.createDataFrame([(exact_medians(df, [value])[value],)], "median double")


def post_hoc(residuals: DataFrame, approximate: bool = False) -> DataFrame:
    """Weighted mean and plain median absolute residuals of the test rows, and their weight and share."""
    w, test, names = F.col("yieldObservations") / PIXELS_PER_ROW, F.col("setAssign") == "test", ("meanResidual", "stdResidual")
    size = lambda c: F.when(test, F.abs(c))
    each = [F.try_divide(F.sum(size(c) * w), F.sum(F.when(test, w))).alias(f"{c}Mae") for c in names]
    if approximate:
        each += [F.percentile_approx(size(c), 0.5).alias(f"{c}Mdae") for c in names]
    else:
        medians = exact_medians(residuals.select(*[size(c).alias(c) for c in names]), list(names))
        each += [F.max(F.lit(medians[c]).cast("double")).alias(f"{c}Mdae") for c in names]
    return residuals.agg(*each, F.sum(F.when(test, w)).alias("testWeight"), F.try_divide(F.sum(F.when(test, w)), F.sum(w)).alias("testShare"))


def selection_score() -> Column:
    return F.col("validMean") * MEAN_WEIGHT + F.col("validStd") * STD_WEIGHT


def best(sweep: DataFrame, ties: list[str]) -> DataFrame:
    """The configuration with the least score; `ties` decides between equals. A top-1, not a sort of all."""
    return sweep.withColumn("score", selection_score()).orderBy("score", *ties).limit(1)


def constrained(sweep: DataFrame) -> DataFrame:
    """Configurations of 3 to 6 layers with all attributes, some regularisation, and counts allowed."""
    return sweep.where(F.col("layers").between(3, 6) & (F.col("block") == "all attrs") & ((F.col("l2Reg") > 0) | (F.col("dropout") > 0)) & (F.col("allowCount") == 1))


def matching(sweep: DataFrame, block: str, layers: int, l2: float, dropout: float) -> DataFrame:
    near = lambda c, v: F.abs(F.col(c) - v) < 1e-4
    return sweep.where((F.col("allowCount") == 1) & (F.col("block") == block) & (F.col("layers") == layers) & near("l2Reg", l2) & near("dropout", dropout))


def fit_linear(df: DataFrame, features: list[str], targets: dict[str, str], weight: str, ridge: float = 0.0) -> dict[str, tuple[list[float], float]]:
    """A weighted linear model for each output: name -> (coefficients, intercept). Fitted by Spark."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.dropna(subset=[*features, *targets.values(), weight]))
    out = {}
    for name, target in targets.items():
        model = LinearRegression(featuresCol="_x", labelCol=target, weightCol=weight, regParam=ridge, solver="normal").fit(rows)
        out[name] = (model.coefficients.toArray().tolist(), float(model.intercept))
    return out


def linear_scores(models: dict[str, tuple[list[float], float]], features: list[str]) -> dict[str, Column]:
    """Predictions of fit_linear() as column expressions."""
    return {name: sum((F.col(f) * w for f, w in zip(features, coefficients)), F.lit(intercept)) for name, (coefficients, intercept) in models.items()}


def score(df: DataFrame, features: list[str], scorer: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Add predictedMean and predictedStd from any model object: `scorer` takes a batch of features and returns both columns."""

    @F.pandas_udf("predictedMean double, predictedStd double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield scorer(pdf)[["predictedMean", "predictedStd"]]

    return df.withColumn("_s", run(F.struct(*features))).select(*df.columns, "_s.*")


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("meanResidual", F.col("predictedMean") - F.col("yieldMean")).withColumn("stdResidual", F.col("predictedStd") - F.col("yieldStd"))
