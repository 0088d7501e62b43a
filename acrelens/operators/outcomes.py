"""Outcomes of simulated units: change, claims, loss, histograms and rank tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.config import BINS
from acrelens.functions.scalar import bin_of
from acrelens.operators.sampling import dealt

KINDS = ("predicted", "baseline", "adapted")
#: Coefficients, from the constant on, of a published rational form of the complementary error function.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def claim_metrics(df: DataFrame, keys: list[str], columns: dict[str, str], level: Column, std_level: Column) -> DataFrame:
    """For each kind of delta (name -> column): mean change, claims rate and mean loss at the loss level and at the one in
    standard deviations. A delta is a claim at or below -level; without claims the loss is 0."""
    out = []
    for name, c in columns.items():
        d = F.col(c)
        out.append(F.avg(d).alias(f"{name}Change"))
        for suffix, at in (("", level), ("Std", std_level)):
            hit = d <= -at
            out.append(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias(f"{name}Claims{suffix}"))
            out.append(F.coalesce(F.avg(F.when(hit, d)), F.lit(0.0)).alias(f"{name}Loss{suffix}"))
    return df.groupBy(*keys).agg(*out, F.count("*").alias("num"))


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bin, n: deltas by 5 % bins from -100 to 100, bins without deltas as 0."""
    found = df.groupBy(*keys, bin_of(F.col(value)).alias("bin")).agg(F.count("*").alias("n"))
    every = found.select(*keys).distinct().withColumn("bin", F.explode(F.array(*[F.lit(b) for b in BINS])))
    return every.join(found, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def wide_histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One column for each bin, bin-100 to bin100."""
    return df.withColumn("_b", bin_of(F.col(value))).groupBy(*keys).pivot("_b", list(BINS)).count().na.fill(0).select(*keys, *[F.col(f"`{b}`").alias(f"bin{b}") for b in BINS])


def mann_whitney(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """U of the sample `first` (a condition) against the other, z with tie and continuity correction, and whether values tie.

    Equal values are summed up before they are ranked, so the ranks' window sees each value once; mid-ranks follow
    from running counts. Null for an empty sample; z is 0 if all values are equal.
    """
    counts = df.groupBy(*keys, value).agg(F.count_if(first).alias("a"), F.count("*").alias("t"))
    before = F.sum("t").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.withColumn("rank", F.coalesce(before, F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum("a").cast("double").alias("n1"), F.sum("t").cast("double").alias("n"), F.sum(t * t * t - t).alias("ties"))
    n1, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    off = u - n1 * n2 / 2
    z = F.when(sd > 0, (off - F.signum(off) * F.least(F.abs(off), F.lit(0.5))) / sd).otherwise(F.lit(0.0))
    ok = (n1 > 0) & (n2 > 0)
    return sums.select(*keys, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), F.when(ok, u).alias("u"), F.when(ok, z).alias("z"), (F.col("ties") > 0).alias("tied"))


def two_sided_p(z: Column | str) -> Column:
    """Two-sided p of a z value: the complementary error function by its rational Chebyshev form, to 1.2e-7 of itself."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = poly * t + c
    return t * F.exp(poly - x * x)


EXACT = 8  # size of the smaller sample up to which p is exact, if no values tie


def u_counts(m: int, n: int) -> np.ndarray:
    """In how many of the orders of m and n distinct values each U from 0 to its middle, m n / 2, occurs, as doubles.

    They are the coefficients of a product of (1 - q^(n + i)) / (1 - q^i) over i up to m, one factor after the other.
    """
    out = np.zeros(m * n // 2 + 1)
    out[0] = 1
    for i in range(1, m + 1):
        out[n + i :] -= out[: max(len(out) - n - i, 0)].copy()
        for r in range(min(i, len(out))):
            out[r::i] = np.cumsum(out[r::i])
    return out


def exact_p(n1: Column | str, n2: Column | str, u: Column | str, ties: Column, z: Column | str | None = None) -> Column:
    """Exact two-sided p of U. Where the samples tie (`ties`) or both are larger than EXACT: that of `z` by two_sided_p()'s form, null without it.
    Null if a sample is empty.

    One number for each pair of sizes and U, worked out in vectors; rows of other sizes cost nothing.
    """

    @F.pandas_udf("double")
    def run(rows: pd.DataFrame) -> pd.Series:
        x = np.abs(rows["z"].to_numpy(float)) / math.sqrt(2)
        t = 1 / (1 + x / 2)
        out = t * np.exp(np.polynomial.polynomial.polyval(t, ERFC) - x * x)
        low, high = rows[["a", "b"]].min(axis=1).to_numpy(), rows[["a", "b"]].max(axis=1).to_numpy()
        ok = rows["open"].to_numpy(bool) & (low >= 1) & (low <= EXACT)
        for m, n in set(zip(low[ok].tolist(), high[ok].tolist())):
            mine = np.flatnonzero(ok & (low == m) & (high == n))
            tail = np.cumsum(u_counts(int(m), int(n))) / math.comb(int(m + n), int(m))
            x = rows["u"].to_numpy()[mine]
            out[mine] = np.minimum(1.0, 2 * tail[np.minimum(x, m * n - x).astype(int)])
        return pd.Series(out).where((low >= 1) & ~np.isnan(rows["u"].to_numpy()))

    number = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(float("nan")))
    open_ = F.coalesce(~ties, F.lit(False)) & ~F.isnan(number(u))
    found = run(F.struct(number(n1).alias("a"), number(n2).alias("b"), number(u).alias("u"), number(F.lit(None) if z is None else z).alias("z"), open_.alias("open")))
    return F.nanvl(found, F.lit(None).cast("double"))


def trial_outcomes(units: DataFrame, keys: list[str], level: str, std_level: str, carry: tuple = ()) -> DataFrame:
    """Of simulated units (predicted, baseline, adapted): each kind's Change, Claims and Loss at the loss level, the same at
    std_level (ClaimsStd, LossStd), p of predicted against baseline and pAdapted against adapted, and units, their number. p is exact for
    up to EXACT units without ties, else from the normal approximation.

    A delta is a claim at or below -level; without claims the loss is 0. The units are dealt by key, one row each, and go through once: their deltas
    are counted by value, ranked by running counts, and everything is summed by key. `carry` are columns that a key fixes.
    """
    own = list(dict.fromkeys([*keys, level, std_level, *carry]))
    units = dealt(units.select(*own, *KINDS), keys)
    each = F.explode(F.array(*[F.struct(F.round(k, 9).alias("d"), F.lit(k).alias("kind")) for k in KINDS])).alias("x")
    counts = units.select(*own, each).groupBy(*own, F.col("x.d").alias("d")).agg(*[F.count_if(F.col("x.kind") == k).alias(k) for k in KINDS])
    window = Window.partitionBy(*own).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts
    for other in KINDS[1:]:
        t = F.col("predicted") + F.col(other)
        ranked = ranked.withColumn(f"_{other}", F.coalesce(F.sum(t).over(window), F.lit(0)) + (t + 1) / 2)
    d, out = F.col("d"), [F.sum("predicted").alias("units")]
    for k in KINDS:
        n = F.col(k)
        out.append((F.sum(d * n) / F.sum(n)).alias(f"{k}Change"))
        for suffix, at in (("", level), ("Std", std_level)):
            claims = F.when(d <= -F.col(at), n).otherwise(0)
            out += [(F.sum(claims) / F.sum(n)).alias(f"{k}Claims{suffix}"), F.coalesce(F.try_divide(F.sum(d * claims), F.sum(claims)), F.lit(0.0)).alias(f"{k}Loss{suffix}")]
    for other, name in (("baseline", "p"), ("adapted", "pAdapted")):
        t, n1, n2 = (F.col("predicted") + F.col(other)).cast("double"), F.sum("predicted").cast("double"), F.sum(other).cast("double")
        off = F.sum(F.col(f"_{other}") * F.col("predicted")) - n1 * (n1 + 1) / 2 - n1 * n2 / 2
        spread = F.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - F.sum(t * t * t - t) / ((n1 + n2) * (n1 + n2 - 1))))
        z = F.when(spread > 0, (off - F.signum(off) * F.least(F.abs(off), F.lit(0.5))) / spread).otherwise(F.lit(0.0))
        tied = F.max(t) > 1
        out += [z.alias(f"_{name}"), (off + n1 * n2 / 2).alias(f"_{name}U"), tied.alias(f"_{name}Tied")]
    sums, tests = ranked.groupBy(*own).agg(*out), ("p", "pAdapted")
    exact = [exact_p("units", "units", f"_{n}U", F.col(f"_{n}Tied"), f"_{n}").alias(n) for n in tests]
    return sums.select(*[c for c in sums.columns if not c.startswith(tuple(f"_{n}" for n in tests))], *exact)
