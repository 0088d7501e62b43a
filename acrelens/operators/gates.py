"""Quality gates: one-row reports that can raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from acrelens.sources.tables import remove


class GateError(ValueError):
    pass


def is_normal(skew: F.Column, kurtosis: F.Column) -> F.Column:
    """Close enough to a normal distribution."""
    return (F.abs(skew) <= 2) & (F.abs(kurtosis) <= 7)


def share_report(df: DataFrame, condition: F.Column, name: str = "share") -> DataFrame:
    return df.agg(F.avg(F.when(condition, 1.0).otherwise(0.0)).alias(name))


def require(report: DataFrame, at_most: dict | None = None, at_least: dict | None = None, below: dict | None = None) -> DataFrame:
    """Raise GateError unless the one row's figures hold their limits. An empty input (null figures) passes."""
    check(report.first().asDict(), at_most, at_least, below)
    return report


def check(row: dict, at_most: dict | None = None, at_least: dict | None = None, below: dict | None = None) -> None:
    for limits, bad in ((at_most, lambda x, y: x > y), (at_least, lambda x, y: x < y), (below, lambda x, y: x >= y)):
        for k, limit in (limits or {}).items():
            if row[k] is not None and bad(row[k], limit):
                raise GateError(f"{k} is {row[k]}, the limit {limit}")


def delta_gate(df: DataFrame) -> DataFrame:
    """invalid (5 % at most), complete and normal (95 % at least) shares of rows with valid, complete, skew and kurtosis."""
    return df.agg(
        F.avg((~F.col("valid")).cast("double")).alias("invalid"),
        F.avg(F.col("complete").cast("double")).alias("complete"),
        F.avg(F.coalesce(is_normal(F.col("skew"), F.col("kurtosis")), F.lit(False)).cast("double")).alias("normal"),
    )


DELTA_LIMITS = {"at_most": {"invalid": 0.05}, "at_least": {"complete": 0.95, "normal": 0.95}}


def missing_gate(df: DataFrame, column: str) -> DataFrame:
    """Share of rows without `column`, which has to stay below 5 %."""
    return share_report(df, F.col(column).isNull() | F.isnan(F.col(column).cast("double")), "missing")


MISSING_LIMITS = {"below": {"missing": 0.05}}


def unique_gate(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur more than once, which has to be none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("repeated"))


def enforce(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """`df`, in whose plan a row that isn't `ok` (null included) raises: a filter, which no later step can prune."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text)))


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, with the largest of each other column; a key that occurs twice raises in the plan."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest], F.count("*").alias("_n"))
    return enforce(rows, F.col("_n") == 1, F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys)))).drop("_n").select(*df.columns)


def delta_figures() -> dict[str, Column]:
    """The shares of delta_gate() as aggregates, to be observed while rows with valid, complete, skew and kurtosis go by."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return {"invalid": share(~F.col("valid")), "complete": share(F.col("complete")), "normal": share(is_normal(F.col("skew"), F.col("kurtosis")))}


def write_gated(df: DataFrame, path: str, figures: dict[str, Column], at_most: dict | None = None, at_least: dict | None = None, below: dict | None = None) -> tuple[DataFrame, dict]:
    """Write `df` and take `figures` in the same pass; (the table read again, the figures).

    Where a figure breaks its limit the table is removed and GateError raised. Null figures, of an empty input, pass.
    """
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in figures.items()]).write.parquet(path)
    found = dict(seen.get)
    try:
        check(found, at_most, at_least, below)
    except GateError:
        remove(df.sparkSession, path)
        raise
    return df.sparkSession.read.schema(df.schema).parquet(path), found


def report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, invalid, complete and normal shares, missing (no skew) and how many keys repeat; one chain of two aggregates."""
    whole = {n: F.sum(F.coalesce(c, F.lit(False)).cast("long")) for n, c in (("invalid", ~F.col("valid")), ("complete", F.col("complete")), ("normal", is_normal(F.col("skew"), F.col("kurtosis"))), ("missing", F.col("skew").isNull() | F.isnan("skew")))}
    each = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in whole.items()])
    share = lambda n: F.try_divide(F.sum(n).cast("double"), F.sum("rows")).alias(n)
    return each.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[share(n) for n in whole], F.count_if(F.col("rows") > 1).alias("repeated"))
