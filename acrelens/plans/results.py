"""Queries from projections to outcomes, exports and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from acrelens.config import BINS, CELL_SIZES, LEVELS, OFFSETS, STD_MULTIPLIERS, THRESHOLDS
from acrelens.functions import geo, scalar
from acrelens.operators import actuals, distributions, evaluate, explore, exports, outcomes, sampling, stats, tasks, trials
from acrelens.plans.standins import BUSINESS, DELTAS, OUTCOMES, PIXELS, POINTS, PREDICTIONS, SWEEP, UNITS, YIELD_PIXELS, duck, given, view
from acrelens.plans.training import _CTE, _DAILY, _MONTHLY, _cell_sql, monthly
from acrelens.sources import tables
from acrelens.sources.tables import as_record

Q: dict = {}


def query(columns: str, sql: str | None):
    def register(f):
        Q[f.__name__] = (f, columns, sql)
        return f

    return register


# tasks

_REL = f"WITH yp AS ({duck(YIELD_PIXELS)}), b AS (SELECT geohash, avg(value) AS base FROM yp GROUP BY geohash), rel AS (SELECT yp.geohash, year, (value - base) / base AS x FROM yp JOIN b ON yp.geohash = b.geohash), fr AS (SELECT geohash, year, avg(x) AS ym, stddev_pop(x) AS ys, count(*) AS obs FROM rel GROUP BY ALL)"


def relative(spark, d):
    """Yearly mean and std of yields relative to their cell's mean. Both follow from the years' own summaries, so yields are summed up before any shuffle."""
    years = distributions.summarize(view(spark, d, YIELD_PIXELS), ["geohash", "year"], with_range=False).where("geohash is not null")
    cell = Window.partitionBy("geohash")  # a row for each year
    base = F.sum(F.col("mean") * F.col("count")).over(cell) / F.sum("count").over(cell)
    years = years.select("geohash", "year", "mean", "std", "count", base.alias("base"))
    return years.select("geohash", "year", ((F.col("mean") - F.col("base")) / F.col("base")).alias("yieldMean"), (F.col("std") / F.abs("base")).alias("yieldStd"), F.col("count").alias("yieldObservations"))


def early_and_late(spark, d, rel=None):
    rel = relative(spark, d) if rel is None else rel
    return tasks.copy_projection(rel.where("year <= 1998")), tasks.copy_projection(rel.where("year > 1998"), late=True, shift=4), tasks.observation_counts(rel)


_TASKS = _REL + ", ta AS (SELECT e.geohash, l.year, '2030_SSP245' AS condition, e.ym AS om, e.ys AS os, l.ym AS pm, l.ys AS ps, e.obs AS n FROM fr e JOIN fr l ON e.geohash = l.geohash AND e.year = l.year - 4 WHERE e.year <= 1998 AND l.year > 1998 AND e.obs > 0)"


def built(spark, d, rel=None):
    early, late, counts = early_and_late(spark, d, rel)
    return tasks.build_tasks(early, late, counts, "2030_SSP245")


@query("geohash year condition originalYieldMean! originalYieldStd! projectedYieldMean! projectedYieldStd! numObservations", _TASKS + '\n--\nSELECT geohash, year, condition, om AS "originalYieldMean", os AS "originalYieldStd", pm AS "projectedYieldMean", ps AS "projectedYieldStd", n AS "numObservations" FROM ta')
def simulation_tasks(spark, d):
    """B6, B11-B13, J6, J7, U4."""
    return built(spark, d)


@query(
    "geohash simYear joinYear predictedMean! predictedStd! yieldObservations",
    _REL + """, p AS (SELECT geohash, sum(ym * obs) / sum(obs) AS m, CASE WHEN count(*) = 2 AND sum(obs) = 2 THEN stddev_samp(ym) WHEN sum(obs) > count(*) THEN sqrt(sum((obs - 1) * ys * ys) / (sum(obs) - count(*))) END AS s, CAST(sum(obs) AS BIGINT) AS n FROM fr WHERE year <= 1998 GROUP BY geohash), y AS (SELECT DISTINCT year AS s, year - 4 AS j FROM fr WHERE year > 1998)
--
SELECT geohash, y.s AS "simYear", y.j AS "joinYear", m AS "predictedMean", p.s AS "predictedStd", n AS "yieldObservations" FROM p, y""",
)
def pooled_tasks(spark, d):
    """D16, J8."""
    early, late, _ = early_and_late(spark, d)
    return tasks.pooled_baseline(early, late.select("joinYear", "simYear"))


_LEVELS = ", ".join(f"({v})" for v in sorted({*LEVELS, 0.25, 0.15}))
_EQUIVALENT = f"eq AS (SELECT CAST(level AS DOUBLE) AS level, sum(obs * level / ys) / sum(obs) AS std FROM fr, (VALUES {_LEVELS}) l(level) WHERE ys > 0 GROUP BY level)"


@query('level! thresholdStd!', f'{_REL}, {_EQUIVALENT}\n--\nSELECT level, std AS "thresholdStd" FROM eq')
def std_thresholds(spark, d):
    """D17."""
    return tasks.std_equivalents(relative(spark, d), sorted({*LEVELS, 0.25, 0.15}))


@query(
    "geohash year threshold stdMult geohashSimSize offsetBaseline thresholdStd! observations",
    f"""{_TASKS}, {_EQUIVALENT}
--
SELECT geohash, year, t AS threshold, CAST(1 AS DOUBLE) AS "stdMult", c AS "geohashSimSize", o AS "offsetBaseline", std AS "thresholdStd", CAST(CASE WHEN c = 5 THEN round_even(n / 32e0, 0) ELSE n END AS BIGINT) AS observations
FROM ta, (VALUES (25e-2), (15e-2)) v(t), (VALUES (CAST(4 AS INT)), (5)) w(c), (VALUES ('always'), ('never')) x(o) JOIN eq ON round(level, 2) = round(t, 2)""",
)
def task_variants(spark, d):
    """J9, J17, R8."""
    out = tasks.with_variants(built(spark, d), THRESHOLDS, STD_MULTIPLIERS, CELL_SIZES, OFFSETS)
    return tasks.with_std_threshold(out, tasks.std_equivalents(relative(spark, d), [0.25, 0.15])).withColumn("observations", sampling.cell_observations(F.col("numObservations"), F.col("geohashSimSize")))


_SIZES = (3.0, 7.0, 12.0, 30.0)


@query(
    "geohash year unit unitSize",
    f"""{_TASKS}, u AS (SELECT geohash, year, n, CAST(unit AS INT) AS unit, [3e0, 7e0, 12e0, 30e0][('0x' || substr(md5('unit|' || geohash || '|' || year || '|' || unit), 1, 8))::BIGINT % 4 + 1] AS size FROM ta, range(1, 2000) r(unit) WHERE unit <= ceil(n / 3e0)),
    s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY geohash, year ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
--
SELECT geohash, year, unit, size AS "unitSize" FROM s WHERE before < n""",
)
def unit_draws(spark, d):
    """Unit sizes until a task's observations are used up."""
    return sampling.draw_units(built(spark, d), ["geohash", "year"], "numObservations", list(_SIZES))


_POLICIES, _SCALER = ("always", "never", "negative"), 4.0
_TRIAL = ["geohash", "year", "threshold", "geohashSimSize", "offsetBaseline"]


def unit_size_list(spark, d):
    """The list of unit sizes that trials draw from: the distinct cleaned sizes."""
    return actuals.unit_sizes(view(spark, d, UNITS)).agg(F.sort_array(F.collect_set("coveragePixels")).alias("unitSizes"))


def test_residuals(rel):
    """Residuals of the later years of relative(), where a cell's year is predicted by the mean of the year."""
    year = rel.groupBy("year").agg(F.avg("yieldMean").alias("predictedMean"), F.avg("yieldStd").alias("predictedStd"))
    return evaluate.residuals(rel.join(year, "year")).withColumn("setAssign", sampling.temporal_split(F.col("year") + 15)).where("setAssign = 'test'")


def simulated(spark, d):
    rel = tables.stored(relative(spark, d), "relative")
    variants = tasks.with_variants(built(spark, d, rel), THRESHOLDS, STD_MULTIPLIERS, CELL_SIZES, _POLICIES)
    variants = tasks.with_std_threshold(variants, tasks.std_equivalents(rel, [0.25, 0.15]))
    units = sampling.draw_scaled_units(variants, _TRIAL, "numObservations", unit_size_list(spark, d), _SCALER)
    return trials.simulate_units(units, _TRIAL, trials.residual_pool(test_residuals(rel)))


#: how often each U occurs for samples of up to 8 and up to so many distinct values, by recurrence, and its two-sided p
U_TABLE = """uf AS (SELECT 0 AS s, 0 AS m, 0 AS n, 0 AS u, 1::DOUBLE AS c UNION ALL SELECT s + 1, m + a, n + b, u + a * n, sum(c) FROM uf, (VALUES (1, 0), (0, 1)) d(a, b) WHERE m + a <= 8 AND n + b <= {0} GROUP BY ALL),
    ut AS (SELECT m, n, u, least(1, 2 * sum(c) OVER (PARTITION BY m, n ORDER BY u) / sum(c) OVER (PARTITION BY m, n)) AS p FROM uf)"""


def _md5_sql(k: int) -> str:
    return f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"


_Z1, _Z2 = (f"sqrt(-2 * ln(({_md5_sql(0)} + 0.5::DOUBLE) / 4294967296e0)) * {f}(({_md5_sql(1)} + 0.5::DOUBLE) / 4294967296e0 * (2 * pi()))" for f in ("cos", "sin"))
_KEY = "geohash || '|' || year || '|' || threshold || '|' || size || '|' || policy || '|' || unit || '|' || "
_MOVED = f"rm[{_md5_sql(2)} % len(rm) + 1] AS dm, rs[{_md5_sql(3)} % len(rs) + 1] AS ds"
_ERFC = lambda z: "(SELECT t * exp(-x * x + " + " + t * (".join(f"({c})" for c in outcomes.ERFC) + ")" * (len(outcomes.ERFC) - 1) + f") FROM (SELECT abs({z}) / sqrt(2e0) AS x, 1 / (1 + abs({z}) / sqrt(2e0) / 2) AS t))"
_UNIT_SQL = "sz AS (SELECT list_sort(list(DISTINCT px)) AS l FROM (" + "SELECT acres * (17564481 / 3906250e0) AS px FROM units WHERE crop = 'Corn' AND \"policyType\" IN ('YP', 'RP') AND acres > 0))"
_SIMULATED = f"""{_TASKS.replace("WITH yp", "WITH RECURSIVE yp", 1)}, {_EQUIVALENT}, {U_TABLE.format(8)}, units AS ({duck(UNITS)}), {_UNIT_SQL},
    yr AS (SELECT year, avg(ym) AS m, avg(ys) AS s FROM fr GROUP BY year), pool AS (SELECT list_sort(list(round(yr.m - ym, 9))) AS rm, list_sort(list(round(yr.s - ys, 9))) AS rs FROM fr JOIN yr USING (year) WHERE fr.year + 15 >= 2014),
    v AS (SELECT ta.*, t AS threshold, c AS size, o AS policy, std, CASE WHEN c = 5 THEN round_even(n / 4e0 / 32, 0) ELSE n / 4e0 END AS num FROM ta, (VALUES (25e-2), (15e-2)) v(t), (VALUES (CAST(4 AS INT)), (5)) w(c), (VALUES ('always'), ('never'), ('negative')) x(o) JOIN eq ON round(level, 2) = round(t, 2)),
    u AS (SELECT v.*, unit, ceil(l[('0x' || substr(md5('unit|' || geohash || '|' || year || '|' || threshold || '|' || size || '|' || policy || '|' || unit), 1, 8))::BIGINT % len(l) + 1] * CASE WHEN size = 5 THEN 1 / 32e0 ELSE 1e0 END / 4e0)::BIGINT AS px FROM v, sz, LATERAL (SELECT unnest(range(1, CAST(ceil(num) AS BIGINT) + 1)) AS unit) WHERE num > 0),
    s AS (SELECT * FROM (SELECT *, coalesce(sum(px) OVER (PARTITION BY geohash, year, threshold, size, policy ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u) WHERE before < num),
    dr AS (SELECT s.*, kind, md5('trial|' || {_KEY} kind || '|' || i) AS h FROM s, (VALUES ('pixel'), ('history'), ('adaptedHistory')) k(kind), LATERAL (SELECT unnest(range(1, CASE WHEN kind = 'pixel' THEN px ELSE 10 END + 1)) AS i)),
    mo AS (SELECT dr.*, {_Z1} AS z1, {_Z2} AS z2, {_MOVED} FROM dr, pool),
    g AS (SELECT geohash, year, threshold, size, policy, unit, any_value(om) AS om, any_value(os * std) AS level, avg(pm - dm + (ps - ds) * z1) FILTER (kind = 'pixel') AS p, avg(pm - dm + (ps - ds) + (ps - ds) * z2) FILTER (kind = 'pixel') AS a, avg(om - dm + (os - ds) * z1) FILTER (kind = 'history') AS ep, avg(om - dm + (os - ds) * z1) FILTER (kind = 'adaptedHistory') AS ea FROM mo GROUP BY ALL),
    de AS (SELECT *, round(greatest(-1e0, p - CASE WHEN policy = 'always' OR (policy = 'negative' AND om < 0) THEN ep ELSE 0 END), 9) AS dp, round(greatest(-1e0, om), 9) AS db, round(greatest(-1e0, a - CASE WHEN policy = 'always' OR (policy = 'negative' AND om < 0) THEN ea ELSE 0 END), 9) AS da FROM g),
    lo AS (SELECT geohash, year, threshold, size, policy, d, count(*) FILTER (k = 'p') AS np, count(*) FILTER (k = 'b') AS nb, count(*) FILTER (k = 'a') AS na FROM (SELECT *, unnest([dp, db, da]) AS d, unnest(['p', 'b', 'a']) AS k FROM de) GROUP BY ALL),
    rk AS (SELECT *, coalesce(sum(np + nb) OVER w, 0) + (np + nb + 1) / 2e0 AS rb, coalesce(sum(np + na) OVER w, 0) + (np + na + 1) / 2e0 AS ra FROM lo WINDOW w AS (PARTITION BY geohash, year, threshold, size, policy ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    uu AS (SELECT geohash, year, threshold, size, policy, CAST(sum(np) AS DOUBLE) AS n, sum(rb * np) - sum(np) * (sum(np) + 1) / 2 - sum(np) * sum(np) / 2 AS ob, sum(ra * np) - sum(np) * (sum(np) + 1) / 2 - sum(np) * sum(np) / 2 AS oa, CAST(sum(CAST(np + nb AS DOUBLE) ** 3 - (np + nb)) AS DOUBLE) AS tb, CAST(sum(CAST(np + na AS DOUBLE) ** 3 - (np + na)) AS DOUBLE) AS ties FROM rk GROUP BY ALL),
    zz AS (SELECT *, sqrt(n * n / 12 * (2 * n + 1 - tb / (2 * n * (2 * n - 1)))) AS sb, sqrt(n * n / 12 * (2 * n + 1 - ties / (2 * n * (2 * n - 1)))) AS sa FROM uu),
    pn AS (SELECT *, {_ERFC("CASE WHEN sb > 0 THEN (ob - sign(ob) * least(abs(ob), 0.5::DOUBLE)) / sb ELSE 0 END")} AS p, {_ERFC("CASE WHEN sa > 0 THEN (oa - sign(oa) * least(abs(oa), 0.5::DOUBLE)) / sa ELSE 0 END")} AS pa FROM zz),
    pv AS (SELECT pn.* EXCLUDE (p, pa), coalesce(CASE WHEN tb = 0 THEN e1.p END, pn.p) AS p, coalesce(CASE WHEN ties = 0 THEN e2.p END, pa) AS pa FROM pn
      LEFT JOIN ut e1 ON e1.m = pn.n AND e1.n = pn.n AND e1.u = pn.n * pn.n / 2 - abs(ob) LEFT JOIN ut e2 ON e2.m = pn.n AND e2.n = pn.n AND e2.u = pn.n * pn.n / 2 - abs(oa))
"""
_METRICS = ", ".join(
    f'avg({c}) AS "{k}Change"' + "".join(f', avg(CASE WHEN {c} <= -{at} THEN 1e0 ELSE 0e0 END) AS "{k}Claims{x}", coalesce(avg({c}) FILTER ({c} <= -{at}), 0e0) AS "{k}Loss{x}"' for x, at in (("", "threshold"), ("Std", "level")))
    for k, c in (("predicted", "dp"), ("baseline", "db"), ("adapted", "da"))
)
_TRIAL_COLUMNS = " ".join(f"{k}{c}!" for k in ("predicted", "baseline", "adapted") for c in ("Change", "Claims", "Loss", "ClaimsStd", "LossStd"))


@query(
    f"geohash year threshold geohashSimSize offsetBaseline units {_TRIAL_COLUMNS} p! pAdapted!",
    _SIMULATED + f"""
--
SELECT o.*, pv.p, pv.pa AS "pAdapted" FROM (SELECT geohash, year, threshold, size AS "geohashSimSize", policy AS "offsetBaseline", count(*) AS units, {_METRICS} FROM de GROUP BY ALL) o
JOIN pv ON o.geohash = pv.geohash AND o.year = pv.year AND o.threshold = pv.threshold AND o."geohashSimSize" = pv.size AND o."offsetBaseline" = pv.policy""",
)
def simulated_outcomes(spark, d):
    """Trials of each task under all variants, and their outcomes."""
    units = simulated(spark, d).withColumn("stdLevel", F.col("originalYieldStd") * F.col("thresholdStd"))
    return outcomes.trial_outcomes(units, _TRIAL, "threshold", "stdLevel")


@query(
    "geohash year draw value!",
    f"""{_REL}, w AS (SELECT *, CAST(floor(obs * 0.2::DOUBLE + (('0x' || substr(md5('one|' || geohash || '|' || year || '|n'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296e0) AS BIGINT) AS k FROM fr),
    x AS (SELECT geohash, year, ym, ys, draw, md5('one|' || geohash || '|' || year || '|' || draw) AS h FROM w, LATERAL (SELECT unnest(range(1, k + 1)) AS draw))
--
SELECT geohash, year, CAST(draw AS INT) AS draw, ym + ys * {_Z1} AS value FROM x""",
)
def single_observations(spark, d):
    """A thinned sample of single observations."""
    return trials.individualise(relative(spark, d), ["geohash", "year"], "yieldMean", "yieldStd", "yieldObservations", rate=0.2)


@query(
    "crop policyType unitType coverageAcres! coveragePixels! n",
    f"WITH units AS ({duck(UNITS)})\n--\nSELECT crop, \"policyType\", \"unitType\", acres AS \"coverageAcres\", acres * (17564481 / 3906250e0) AS \"coveragePixels\", count(*) AS n FROM units WHERE crop = 'Corn' AND \"policyType\" IN ('YP', 'RP') AND acres > 0 GROUP BY ALL",
)
def unit_size_rows(spark, d):
    """The cleaned sizes of insured units, and how often each occurs."""
    return actuals.unit_sizes(view(spark, d, UNITS)).groupBy("crop", "policyType", "unitType", "coverageAcres", "coveragePixels").agg(F.count("*").alias("n"))


# outcomes of given deltas

_DELTA = f"WITH q AS ({duck(DELTAS)}), b AS (SELECT geohash, avg(value) AS base, stddev_pop((value)) AS sd FROM q GROUP BY geohash), de AS (SELECT q.geohash, q.sample, greatest(-1e0, (value - base) / base) AS d, sd / base AS rs, date, id FROM q JOIN b ON q.geohash = b.geohash)"


def deltas(spark, d):
    rows = view(spark, d, DELTAS)
    base = rows.groupBy("geohash").agg(F.avg("value").alias("base"), F.stddev_pop("value").alias("sd"))
    return rows.join(base, "geohash").select("geohash", "sample", scalar.delta(F.col("value"), F.col("base")).alias("d"), (F.col("sd") / F.col("base")).alias("rs"), "date", "id")


@query(
    "geohash predictedChange! predictedClaims! predictedLoss! predictedClaimsStd! predictedLossStd! baselineChange! baselineClaims! num",
    _DELTA + """
--
SELECT geohash, avg(d) FILTER (sample = 'O') AS "predictedChange", coalesce(avg(CASE WHEN d <= -0.25::DOUBLE THEN 1e0 ELSE 0e0 END) FILTER (sample = 'O'), NULL) AS "predictedClaims", coalesce(avg(d) FILTER (sample = 'O' AND d <= -0.25::DOUBLE), 0) AS "predictedLoss",
avg(CASE WHEN d <= -(rs * 0.9::DOUBLE) THEN 1e0 ELSE 0e0 END) FILTER (sample = 'O') AS "predictedClaimsStd", coalesce(avg(d) FILTER (sample = 'O' AND d <= -(rs * 0.9::DOUBLE)), 0) AS "predictedLossStd", avg(d) FILTER (sample = 'F') AS "baselineChange", avg(CASE WHEN d <= -0.25::DOUBLE THEN 1e0 ELSE 0e0 END) FILTER (sample = 'F') AS "baselineClaims", count(*) AS num FROM de GROUP BY geohash""",
)
def outcome_metrics(spark, d):
    """D22, S7, S14 on given deltas."""
    rows = deltas(spark, d).withColumn("a", F.when(F.col("sample") == "O", F.col("d"))).withColumn("b", F.when(F.col("sample") == "F", F.col("d")))
    own = rows.where("sample = 'O'")
    a = outcomes.claim_metrics(own.withColumn("level", F.col("rs") * 0.9), ["geohash"], {"predicted": "a"}, F.lit(0.25), F.col("level"))
    b = outcomes.claim_metrics(rows.where("sample = 'F'"), ["geohash"], {"baseline": "b"}, F.lit(0.25), F.col("rs")).select("geohash", "baselineChange", "baselineClaims", F.col("num").alias("more"))
    return a.join(b, "geohash", "full").withColumn("num", F.coalesce("num", F.lit(0)) + F.coalesce("more", F.lit(0))).withColumn("predictedLoss", F.coalesce("predictedLoss", F.lit(0.0))).withColumn("predictedLossStd", F.coalesce("predictedLossStd", F.lit(0.0)))


@query(
    "geohash sample bin n",
    _DELTA + f""", k AS (SELECT DISTINCT geohash, sample FROM de), g AS (SELECT geohash, sample, CAST(round_even(least(greatest(d, -1e0), 1e0) * 100 / 5, 0) * 5 AS INT) AS bin, count(*) AS n FROM de GROUP BY ALL)
--
SELECT k.geohash, k.sample, CAST(r.b * 5 AS INT) AS bin, coalesce(g.n, 0) AS n FROM k CROSS JOIN range(-20, 21) r(b) LEFT JOIN g ON g.geohash = k.geohash AND g.sample = k.sample AND g.bin = r.b * 5""",
)
def outcome_bins(spark, d):
    """D23, S11."""
    return outcomes.histogram(deltas(spark, d), ["geohash", "sample"], "d")


@query(
    "geohash n1 n2 u! z!",
    _DELTA + """, c AS (SELECT geohash, d, count(*) FILTER (sample = 'O') AS a, count(*) AS t FROM de GROUP BY ALL), r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY geohash ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2e0 AS rk FROM c),
    s AS (SELECT geohash, sum(rk * a) AS r, CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(t) AS DOUBLE) AS n, CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM r GROUP BY geohash),
    x AS (SELECT *, n - n1 AS n2, r - n1 * (n1 + 1) / 2 AS u FROM s), y AS (SELECT *, u - n1 * n2 / 2 AS off, sqrt(n1 * n2 / 12 * ((n + 1) - ties / nullif(n * (n - 1), 0))) AS sd FROM x)
--
SELECT geohash, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CASE WHEN n1 > 0 AND n2 > 0 THEN u END AS u, CASE WHEN n1 > 0 AND n2 > 0 THEN CASE WHEN sd > 0 THEN (off - sign(off) * least(abs(off), 0.5)) / sd ELSE 0 END END AS z FROM y""",
)
def rank_tests(spark, d):
    """U and z; deltas are rounded to 9 digits first, so that equal values tie."""
    return outcomes.mann_whitney(deltas(spark, d), ["geohash"], "d", F.col("sample") == "O")


# evaluation

@query(
    "config trainMean! validMean! testMean!",
    f"""WITH p AS ({duck(PREDICTIONS)}), s AS (SELECT *, CASE WHEN year < 1998 THEN 'train' WHEN year % 2 = 1 THEN 'test' ELSE 'valid' END AS a FROM p)
--
SELECT config, """ + ", ".join(f"sum(abs(predicted - actual) * weight) FILTER (a = '{s}') / sum(weight) FILTER (a = '{s}') AS \"{s}Mean\"" for s in ("train", "valid", "test")) + " FROM s GROUP BY config",
)
def sweep_errors(spark, d):
    """D18, F3, R1."""
    rows = view(spark, d, PREDICTIONS).withColumn("setAssign", sampling.sweep_split(F.col("year") + 15))
    return evaluate.errors_by_split(rows, ["config"], "predicted", "actual", "weight")


@query(
    "config mae! wmae! wstd!",
    f"WITH p AS ({duck(PREDICTIONS)})\n--\nSELECT config, avg(abs(predicted - actual)) AS mae, sum(abs(predicted - actual) * weight) / sum(weight) AS wmae, sum(abs(\"predictedStd\" - \"actualStd\") * weight) / sum(weight) AS wstd FROM p GROUP BY config",
)
def plain_errors(spark, d):
    """D19, D18."""
    rows = view(spark, d, PREDICTIONS)
    return evaluate.plain_errors(rows, ["config"], "predicted", "actual").join(evaluate.weighted_errors(rows, ["config"], {"wmae": ("predicted", "actual"), "wstd": ("predictedStd", "actualStd")}, "weight"), "config")


@query(
    "meanResidualMae! meanResidualMdae! stdResidualMae! testWeight! testShare!",
    f"""WITH p AS ({duck(PREDICTIONS)}), s AS (SELECT *, predicted - actual AS r, "predictedStd" - "actualStd" AS q, weight / 1111e0 AS w, year >= 1999 AS test FROM p)
--
SELECT sum(abs(r) * w) FILTER (test) / sum(w) FILTER (test) AS "meanResidualMae", median(abs(r)) FILTER (test) AS "meanResidualMdae", sum(abs(q) * w) FILTER (test) / sum(w) FILTER (test) AS "stdResidualMae", sum(w) FILTER (test) AS "testWeight", sum(w) FILTER (test) / sum(w) AS "testShare" FROM s""",
)
def post_hoc_errors(spark, d):
    """D20."""
    rows = view(spark, d, PREDICTIONS).withColumn("setAssign", sampling.temporal_split(F.col("year") + 15)).withColumn("meanResidual", F.col("predicted") - F.col("actual")).withColumn("stdResidual", F.col("predictedStd") - F.col("actualStd"))
    return evaluate.post_hoc(rows.withColumnRenamed("weight", "yieldObservations"))


_BEST = "SELECT '{0}' AS kind, block, layers, \"l2Reg\", dropout, \"allowCount\", \"validMean\" + 0.25::DOUBLE * \"validStd\" AS score, id FROM sw {1} ORDER BY score, id LIMIT 1"


@query("kind block layers l2Reg! dropout! allowCount score! id text", f"WITH sw AS ({duck(SWEEP)})\n--\nSELECT *, array_to_string(['512', '256', '128', '64', '32', '8'][7 - layers:], ', ') AS text FROM (({_BEST.format('all', '')}) UNION ALL ({_BEST.format('constrained', chr(32) + 'WHERE layers BETWEEN 3 AND 6 AND block = ' + chr(39) + 'all attrs' + chr(39) + ' AND (' + chr(34) + 'l2Reg' + chr(34) + ' > 0 OR dropout > 0) AND ' + chr(34) + 'allowCount' + chr(34) + ' = 1')}))")
def best_configurations(spark, d):
    """O2, O3, S18, U3."""
    sweep = view(spark, d, SWEEP)
    out = evaluate.best(sweep, ["id"]).withColumn("kind", F.lit("all")).unionByName(evaluate.best(evaluate.constrained(sweep), ["id"]).withColumn("kind", F.lit("constrained")))
    return out.withColumn("text", scalar.layers_text(F.col("layers")))


@query("id layers validMean!", f"WITH sw AS ({duck(SWEEP)})\n--\nSELECT id, layers, \"validMean\" FROM sw WHERE \"allowCount\" = 1 AND block = 'all attrs' AND layers = 4 AND abs(\"l2Reg\" - 0.1) < 1e-4 AND abs(dropout - 0.1) < 1e-4")
def matching_configurations(spark, d):
    """B8, B17, B18."""
    text = view(spark, d, SWEEP)
    text = text.select(*[F.when(F.col("allowCount") == 1, "True").otherwise("False").alias(c) if c == "allowCount" else F.col(c).cast("string").alias(c) for c in text.columns])
    return evaluate.matching(exports.clean_sweep(text), "all attrs", 4, 0.1, 0.1).withColumn("id", F.col("id").cast("long"))


@query("layers l2Reg! dropout! block allowCount n", f"""WITH sw AS ({duck(SWEEP)}), r AS (SELECT layers, block, "allowCount", round("l2Reg", 4) AS l2, round(dropout, 4) AS dr, count(*) AS n FROM sw GROUP BY ALL),
    g AS (SELECT CAST(l AS INT) AS layers, l2 * 5e-2 AS l2, dr / 10e0 AS dr, b AS block FROM range(1, 7) a(l), range(0, 5) c(l2), range(0, 3) e(dr), (VALUES ('all attrs'), ('temp')) x(b))
--
SELECT g.layers, g.l2 AS "l2Reg", g.dr AS dropout, g.block, CAST(1 AS INT) AS "allowCount", coalesce(r.n, 0) AS n FROM g LEFT JOIN r ON r.layers = g.layers AND r.l2 = round(g.l2, 4) AND r.dr = round(g.dr, 4) AND r.block = g.block AND r."allowCount" = 1""")
def sweep_grid(spark, d):
    """How often each configuration of the grid was run."""
    g = tasks.grid(spark, layers=list(range(1, 7)), l2=[0.0, 0.05, 0.1, 0.15, 0.2], drop=[0.0, 0.1, 0.2], block=["all attrs", "temp"], allowCount=[1]).withColumn("layers", F.col("layers").cast("int")).withColumn("allowCount", F.col("allowCount").cast("int"))
    runs = view(spark, d, SWEEP).groupBy("layers", "block", "allowCount", F.round("l2Reg", 4).alias("l2"), F.round("dropout", 4).alias("drop")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(runs), ["layers", "block", "allowCount", "l2", "drop"], "left").select("layers", F.col("l2").alias("l2Reg"), F.col("drop").alias("dropout"), "block", "allowCount", F.coalesce("n", F.lit(0)).alias("n"))


_FIT = lambda y: (  # weighted least squares of two inputs, in centred sums
    f"SELECT mx, mz, my, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM (SELECT any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (z - mz) * (z - mz)) AS szz, sum(w * (x - mx) * (z - mz)) AS sxz, sum(w * (x - mx) * ({y} - my)) AS sxy, sum(w * (z - mz) * ({y} - my)) AS szy FROM fx, (SELECT sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * {y}) / sum(w) AS my FROM fx))"
)


@query(
    "geohash year predictedMean! predictedStd! meanResidual! stdResidual!",
    f"{_REL}, fx AS (SELECT geohash, year, CAST(year + 15 - 2007 AS DOUBLE) AS x, CAST(obs AS DOUBLE) AS z, CAST(obs AS DOUBLE) AS w, ym, ys FROM fr), fa AS ({_FIT('ym')}), fb AS ({_FIT('ys')}), p AS (SELECT geohash, year, ym, ys, fa.my + fa.b1 * (x - fa.mx) + fa.b2 * (z - fa.mz) AS pm, fb.my + fb.b1 * (x - fb.mx) + fb.b2 * (z - fb.mz) AS ps FROM fx, fa, fb)\n--\n"
    + 'SELECT geohash, year, pm AS "predictedMean", ps AS "predictedStd", pm - ym AS "meanResidual", ps - ys AS "stdResidual" FROM p',
)
def scored_frame(spark, d):
    """A weighted linear model fitted and scored by Spark; the SQL solves the same least squares in closed form."""
    rows = relative(spark, d).withColumn("effectiveYear", tasks.effective_year(F.col("year") + 15).cast("double")).withColumn("observations", F.col("yieldObservations").cast("double"))
    features = ["effectiveYear", "observations"]
    models = evaluate.fit_linear(rows, features, {"predictedMean": "yieldMean", "predictedStd": "yieldStd"}, "observations")
    return evaluate.residuals(rows.select("*", *[c.alias(n) for n, c in evaluate.linear_scores(models, features).items()]))


# exports

_SCOPE = "abs(\"stdMult\" - 1) < 1e-4 AND \"geohashSimSize\" = {0} AND abs(\"unitSize\") > 1.0001 AND \"offsetBaseline\" = 'always' AND series <> '2010'"
_ONE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY geohash, year, series, threshold ORDER BY id) AS rn FROM oc WHERE " + _SCOPE.format(4) + ") WHERE rn = 1)"
_OC = f"WITH oc AS ({duck(OUTCOMES)}), {_ONE}"


def scoped(spark, d):
    """In scope, one row for each cell, year, series and threshold."""
    return tasks.pick_one(view(spark, d, OUTCOMES).where(exports.in_scope()), ["geohash", "year", "series", "threshold"], ["id"])


@query("series familySize", _OC + '\n--\nSELECT series, count(*) AS "familySize" FROM oc WHERE abs(threshold - 0.25) < 1e-4 AND ' + _SCOPE.format(4) + " GROUP BY series")
def family_sizes(spark, d):
    """D21, B7."""
    return exports.family_sizes(view(spark, d, OUTCOMES))


_PAIR = _OC + """, fam AS (SELECT series, count(*) AS f FROM one GROUP BY series), pr AS (SELECT geohash, year, CASE WHEN o.series = 'historic' THEN 'historic' ELSE substr(o.series, 1, 4) || '_SSP245' END AS condition, threshold, contains(o.series, '_counterfactual') AS cf, num, "predictedClaims" AS c, "predictedChange" AS m, p, f FROM one o JOIN fam ON fam.series = o.series),
pd AS (SELECT geohash, year, condition, threshold AS "lossThreshold", coalesce(max(num) FILTER (NOT cf), max(num) FILTER (cf)) AS num, max(c) FILTER (NOT cf) AS "predictedRisk", max(c) FILTER (cf) AS "counterfactualRisk", max(p) FILTER (NOT cf) AS p, max(p < 0.05 / f) FILTER (NOT cf) AS "pMeets0.05n", max(p < 0.10 / f) FILTER (NOT cf) AS "pMeets0.10n", max(m) FILTER (NOT cf) AS "predictedMean", max(m) FILTER (cf) AS "counterfactualMean" FROM pr GROUP BY geohash, year, condition, threshold)"""


def paired(spark, d):
    rows = scoped(spark, d)
    return exports.pair(rows, rows.groupBy("series").agg(F.count("*").alias("familySize")), check=False)


@query("geohash year condition lossThreshold num predictedRisk! counterfactualRisk! p! pMeets0.05n pMeets0.10n predictedMean! counterfactualMean!", _PAIR + "\n--\nSELECT * FROM pd")
def paired_cells(spark, d):
    """J11, J12, B16."""
    return paired(spark, d)


@query("geohash lng! lat! num", f"WITH p AS ({duck(POINTS)}), c AS (SELECT k, {_cell_sql(4)} AS geohash, lon, lat FROM p)\n--\nSELECT geohash, min((floor((lon + 180) / 360e0 * 1024) + 0.5) * (360e0 / 1024) - 180) AS lng, min((floor((lat + 90) / 180e0 * 1024) + 0.5) * (180e0 / 1024) - 90) AS lat, count(*) AS num FROM c GROUP BY geohash")
def located_cells(spark, d):
    """S2 in exports: cells with their middles."""
    cells = view(spark, d, POINTS).select(geo.encode(F.col("lon"), F.col("lat")).alias("geohash")).groupBy("geohash").agg(F.count("*").alias("num"))
    return exports.with_location(cells)


@query(
    "offsetBaseline year condition threshold! thresholdStd! stdMult! geohashSimSize claimsRate! claimsRateStd! num",
    _OC + """
--
SELECT "offsetBaseline", year, CASE WHEN series = 'historic' THEN 'historic' ELSE substr(series, 1, 4) || '_SSP245' END AS condition, threshold, "thresholdStd", "stdMult", "geohashSimSize", sum("predictedClaims" * num) / sum(num) AS "claimsRate", sum("predictedClaimsStd" * num) / sum(num) AS "claimsRateStd", sum(num) AS num FROM oc GROUP BY ALL""",
)
def claims_rates(spark, d):
    """D26, S13."""
    return exports.claims_rates(view(spark, d, OUTCOMES).withColumn("condition", scalar.series_condition(F.col("series"))))


_BIN = "CAST(round_even(least(greatest(\"predictedChange\", -1e0), 1e0) * 100 / 5, 0) * 5 AS INT)"
_HIST = "\n UNION ALL ".join(
    f"""SELECT CAST({s} AS INT) AS "geohashSize", CAST(CASE WHEN series = 'historic' THEN '2010' ELSE substr(series, 1, 4) END AS INT) AS set, CASE WHEN contains(series, '_counterfactual') THEN 'counterfactual' ELSE 'predicted' END AS series, unnest([{", ".join(f"'{b}'" for b in BINS)}, 'claimsMpci', 'mean', 'cnt']) AS bin,
unnest([{", ".join(f"CAST(count(*) FILTER ({_BIN} = {b}) AS DOUBLE)" for b in BINS)}, sum(num * "predictedClaims"), sum(num * "predictedChange") / sum(num), sum(num)]) AS val FROM oc WHERE abs(threshold - 0.25) < 1e-4 AND {_SCOPE.format(s)} GROUP BY oc.series
UNION ALL SELECT CAST({s} AS INT), CAST(CASE WHEN series = 'historic' THEN '2010' ELSE substr(series, 1, 4) END AS INT), CASE WHEN contains(series, '_counterfactual') THEN 'counterfactual' ELSE 'predicted' END, 'claimsSco', sum(num * "predictedClaims") FROM oc WHERE abs(threshold - 0.15) < 1e-4 AND {_SCOPE.format(s)} GROUP BY oc.series"""
    for s in (4, 5)
)


def histograms(spark, d):
    rows = view(spark, d, OUTCOMES)
    at = scalar.bin_of(F.col("predictedChange"))
    rows = rows.select("*", *[(at == b).cast("int").alias(f"bin{b}") for b in BINS])
    return exports.histogram_export(rows, 4).unionByName(exports.histogram_export(rows, 5))


@query("geohashSize set series bin val!", f"WITH oc AS ({duck(OUTCOMES)})\n--\n{_HIST}")
def histogram_exports(spark, d):
    """D25, P3, P4, U3."""
    return histograms(spark, d)


@query(
    "set series bin percent! claimsRate!",
    f"""WITH oc AS ({duck(OUTCOMES)}), hi AS ({_HIST}), h AS (SELECT * FROM hi WHERE "geohashSize" = 4), s AS (SELECT set, series, max(val) FILTER (bin = 'claimsMpci') / max(val) FILTER (bin = 'cnt') AS cr FROM h GROUP BY ALL)
--
SELECT h.set, h.series, CAST(bin AS INT) AS bin, val / sum(val) OVER (PARTITION BY h.set, h.series) AS percent, cr AS "claimsRate" FROM h JOIN s ON h.set = s.set AND h.series = s.series WHERE TRY_CAST(bin AS INT) IS NOT NULL""",
)
def histogram_percents(spark, d):
    """D37, W5."""
    return explore.histogram_percents(histograms(spark, d).where("geohashSize = 4"))


# statistics

_STATS = _OC + """, st AS (SELECT CASE WHEN contains(series, 'historic') THEN 'historic' WHEN contains(series, '_counterfactual') THEN 'counterfactual' ELSE 'experimental' END AS kind, CAST(CASE WHEN series = 'historic' THEN '2010' ELSE substr(series, 1, 4) END AS INT) AS year, sum(num) AS num, sum("predictedChange" * num) / sum(num) AS mean, sum("predictedClaims" * num) / sum(num) AS probability, coalesce(sum("predictedLoss" * num) FILTER ("predictedLoss" <> 0) / sum(num) FILTER ("predictedLoss" <> 0), 0) AS severity FROM oc WHERE abs(threshold - 0.25) < 1e-4 AND """ + _SCOPE.format(4) + " GROUP BY ALL)"


@query("kind year num mean! probability! severity!", _STATS + "\n--\nSELECT * FROM st")
def series_statistics(spark, d):
    """D27."""
    return stats.series_stats(view(spark, d, OUTCOMES).where(exports.in_scope(0.25)))


@query(
    "experimentalMean2030 counterfactualProbability2050 experimentalSeverity2030 historicMean2010 rounded record cells",
    _STATS + r""", x AS (SELECT max(mean) FILTER (kind = 'experimental' AND year = 2030) AS a, max(probability) FILTER (kind = 'counterfactual' AND year = 2050) AS b, max(severity) FILTER (kind = 'experimental' AND year = 2030) AS c, max(mean) FILTER (kind = 'historic') AS e FROM st)
--
SELECT format('{:.1f}', a * 100) || '\%' AS "experimentalMean2030", format('{:.1f}', b * 100) || '\%' AS "counterfactualProbability2050", format('{:.1f}', (-c - 0.25::DOUBLE) * 100) || '\%' AS "experimentalSeverity2030", format('{:.1f}', e * 100) || '\%' AS "historicMean2010", CAST(CAST(round_even(b * 100, 0) AS INT) AS VARCHAR) || '\%' AS rounded,
'{"cells":' || (SELECT count(DISTINCT geohash) FROM one) || ',"share":"' || format('{:.1f}', b * 100) || '\\%"}' AS record, (SELECT count(DISTINCT geohash) FROM one) AS cells FROM x""",
)
def statistics_record(spark, d):
    """One record of all figures."""
    own = stats.series_stats(view(spark, d, OUTCOMES).where(exports.in_scope(0.25)))
    cells = scoped(spark, d).agg(F.countDistinct("geohash").alias("cells"))
    out = stats.combine_records((stats.record(own), ""), (cells, ""), (own.where("kind = 'counterfactual' and year = 2050").select(scalar.rounded_percent(F.col("probability")).alias("rounded")), ""))
    text = as_record(out.select("cells", F.col("counterfactualProbability2050").alias("share"))).select(F.col("value").alias("record"))
    return out.crossJoin(text)


@query("percentSignificant!", _PAIR + ', e AS (SELECT geohash, max(coalesce("pMeets0.05n", false)) AS s FROM pd GROUP BY geohash)\n--\nSELECT coalesce(sum(pd.num) FILTER (e.s), 0) / sum(pd.num) AS "percentSignificant" FROM pd JOIN e ON pd.geohash = e.geohash')
def significant_share(spark, d):
    """D28, J13."""
    return exports.significant_share(paired(spark, d))


@query("riskCells dualCells dualIncrease!", _PAIR + """, c AS (SELECT geohash, max(coalesce("predictedRisk" > "counterfactualRisk", false)) AS risk, sum("predictedMean" * num) / sum(num) FILTER ("predictedMean" IS NOT NULL) AS change FROM pd GROUP BY geohash)
--
SELECT count(*) FILTER (risk) AS "riskCells", count(*) FILTER (risk AND change >= 0) AS "dualCells", count(*) FILTER (risk AND change >= 0) / count(*) FILTER (risk)::DOUBLE AS "dualIncrease" FROM c""")
def dual_increase(spark, d):
    """D29, U4."""
    return stats.dual_increase(paired(spark, d))


@query("series year num! rows", f"WITH oc AS ({duck(OUTCOMES)})\n--\nSELECT label AS series, CASE WHEN series = 'historic' THEN 2010 ELSE CAST(substr(series, 1, 4) AS INT) END AS year, sum(num) AS num, count(*) AS rows FROM oc, (VALUES ('hold'), ('run')) v(label) GROUP BY ALL")
def labelled_series(spark, d):
    """Series below each other with their labels."""
    rows = view(spark, d, OUTCOMES).withColumn("year", scalar.series_year(F.col("series"))).groupBy("year").agg(F.sum("num").alias("num"), F.count("*").alias("rows"))
    return exports.union_series({"hold": rows, "run": rows})


@query(
    "year geohash month rhxMeanChange! tmaxMeanChange! chirpsMeanChange!",
    _CTE + f""", al AS (SELECT * FROM ({"SELECT geohash, attr, condition, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, sum(mean * count) / sum(count) AS mean FROM daily GROUP BY ALL"})), h AS (SELECT attr, avg(mean) AS m, stddev_samp(mean) AS s FROM al WHERE condition = 'observations' GROUP BY attr), z AS (SELECT year, geohash, month, al.attr, (mean - m) / s AS z FROM al JOIN h ON al.attr = h.attr WHERE condition <> 'observations' AND s > 0), w AS (SELECT year, geohash, month, avg(z) FILTER (attr = 'rhx') AS a, avg(z) FILTER (attr = 'tmax') AS b, avg(z) FILTER (attr = 'chirps') AS c FROM z GROUP BY ALL)
--
SELECT year, geohash, month, a AS "rhxMeanChange", b AS "tmaxMeanChange", c AS "chirpsMeanChange" FROM w WHERE a IS NOT NULL""",
)
def climate_changes(spark, d):
    """D32, D33 (rows with rhx; the stand-in has three of the attributes, never all at once)."""
    rows = monthly(spark, d)
    out = exports.climate_change(rows.where("condition = 'observations'"), rows.where("condition <> 'observations'"))
    return exports.complete_rows(out, ["rhxMeanChange"])


# actuals

_BU = f"WITH bu AS ({duck(BUSINESS)}), co AS (SELECT year, county, program, sum(units) AS units, sum(indemnified) AS indemnified, sum(\"lossRatio\" * units) / sum(units) AS lr FROM bu WHERE units > 0 GROUP BY ALL)"


@query("year county program units! indemnified! lossRatio!", _BU + '\n--\nSELECT year, county, program, units, indemnified, lr AS "lossRatio" FROM co')
def actual_claims(spark, d):
    """D30, S17."""
    return actuals.by_county(view(spark, d, BUSINESS))


@query("year units! indemnified! lossRatio! claimsRate!", _BU + '\n--\nSELECT year, sum(units) AS units, sum(indemnified) AS indemnified, sum(lr * units) / sum(units) AS "lossRatio", sum(indemnified) / sum(units) AS "claimsRate" FROM co GROUP BY year')
def actual_claims_by_year(spark, d):
    """D31."""
    return actuals.by_year(actuals.by_county(view(spark, d, BUSINESS)))


# explorers

@query(
    "geohash condition lossThreshold num! predictedRisk! counterfactualRisk! predictedMean! p! category percent!",
    _PAIR + """, po AS (SELECT geohash, condition, "lossThreshold", sum(num) AS num, sum("predictedRisk" * num) / sum(num) FILTER ("predictedRisk" IS NOT NULL) AS r, sum("counterfactualRisk" * num) / sum(num) FILTER ("counterfactualRisk" IS NOT NULL) AS c, sum("predictedMean" * num) / sum(num) FILTER ("predictedMean" IS NOT NULL) AS m, min(p) AS p FROM pd GROUP BY ALL),
ca AS (SELECT *, CASE WHEN p IS NULL OR r - c IS NULL THEN 'unknown' WHEN p >= 5e0 / ((SELECT count(*) FROM po) * 5) THEN 'no significant change' WHEN r - c > 0 THEN 'increase' ELSE 'decrease' END AS category FROM po)
--
SELECT geohash, condition, "lossThreshold", num, r AS "predictedRisk", c AS "counterfactualRisk", m AS "predictedMean", p, category, sum(num) OVER (PARTITION BY category) / sum(num) OVER () AS percent FROM ca""",
)
def explorer_categories(spark, d):
    """D36, S16, S20, O4; at a level that the stand-in reaches."""
    pooled = explore.pool_records(paired(spark, d))
    out = explore.categorise(pooled, F.col("predictedRisk") - F.col("counterfactualRisk"), alpha=5.0)
    return out.join(F.broadcast(explore.shares(out, "category", "num").select("category", "percent")), "category")


@query("at! weight! percent!", _PAIR + '\n--\nSELECT round_even("predictedMean" / 0.05::DOUBLE, 0) * 0.05::DOUBLE AS at, sum(num) AS weight, sum(num) / sum(sum(num)) OVER () AS percent FROM pd WHERE "predictedMean" IS NOT NULL GROUP BY 1')
def axis_shares(spark, d):
    """D38."""
    return explore.axis_shares(paired(spark, d).where("predictedMean is not null"), "predictedMean", "num", 0.05)


@query(
    "part bin n",
    f"WITH q AS ({duck(DELTAS)}), s AS (SELECT geohash, sample AS part, date_trunc('month', date) AS mo, avg(value) AS v FROM q GROUP BY ALL)\n--\nSELECT part, CAST(CASE WHEN v = 20 THEN 19 ELSE floor((v - 10) / 10e0 * 19) + 1 END AS INT) AS bin, count(*) AS n FROM s WHERE v >= 10 AND v <= 20 GROUP BY ALL",
)
def edge_histograms(spark, d):
    """D39."""
    s = view(spark, d, DELTAS).groupBy("geohash", F.col("sample").alias("part"), F.date_trunc("month", "date").alias("mo")).agg(F.avg("value").alias("v"))
    return explore.edge_histogram(s, ["part"], "v")


@query(
    "geohash year mean! expected! isLoss belowMean belowStd years",
    f"""WITH yp AS ({duck(YIELD_PIXELS)}), ys AS (SELECT geohash, year, avg(value) AS mean FROM yp GROUP BY ALL), a AS (SELECT geohash, avg(mean) AS m, stddev_samp(mean) AS s FROM ys GROUP BY geohash), e AS (SELECT ys.geohash, count(*) FILTER (mean < m * 0.75::DOUBLE) AS bm, count(*) FILTER (mean < m - 1.5::DOUBLE * s) AS bs, count(*) AS y FROM ys JOIN a ON ys.geohash = a.geohash GROUP BY ys.geohash)
--
SELECT ys.geohash, year, mean, avg(mean) OVER w AS expected, (mean - avg(mean) OVER w) / avg(mean) OVER w < 0.75::DOUBLE - 1 AS "isLoss", bm AS "belowMean", bs AS "belowStd", y AS years FROM ys JOIN e ON ys.geohash = e.geohash WINDOW w AS (PARTITION BY ys.geohash ORDER BY year ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def yield_histories(spark, d):
    """D40, W2, S14."""
    rows = view(spark, d, YIELD_PIXELS).groupBy("geohash", "year").agg(F.avg("value").alias("mean"))
    return explore.expected_yields(rows, "geohash", "year", "mean").join(explore.loss_events(rows, "geohash", "mean"), "geohash")


@query(
    "id covered! severity! loss price! label county quantised",
    """WITH p AS (SELECT p_partkey AS id, p_retailprice AS act, 1000e0 + p_size * 20e0 AS exp, 75e-2 AS c, p_brand AS b, p_type AS t FROM part)
--
SELECT id, greatest(c * exp - act, 0e0) AS covered, greatest(-((act - exp) / exp) - (1 - c), 0e0) AS severity, (act - exp) / exp < c - 1 AS loss, exp * 4e0 * 5e-2 * c * (1 - 55e-2) AS price, '75% loss' AS label, b || ', ' || t AS county, format('{:.4f}', act) AS quantised FROM p""",
)
def policy_terms(spark, d):
    """S13-S15, S17, S19."""
    p = given(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("act"), (F.lit(1000.0) + F.col("p_size") * 20.0).alias("exp"), F.lit(0.75).alias("c"), "p_brand", "p_type")
    act, exp, c = F.col("act"), F.col("exp"), F.col("c")
    return p.select(
        "id", scalar.covered_loss(act, exp, c).alias("covered"), scalar.severity(act, exp, c).alias("severity"), scalar.is_loss(act, exp, c).alias("loss"), scalar.price(exp, F.lit(4.0), F.lit(0.05), c, F.lit(0.55), F.lit("grower")).alias("price"),
        scalar.loss_label(c).alias("label"), scalar.county_label(F.col("p_brand"), F.col("p_type")).alias("county"), scalar.quantised(act).alias("quantised"),
    )


@query("geohash year z! back! stretched!", _REL + ", g AS (SELECT avg(ym) AS m, stddev_samp(ym) AS s FROM fr)\n--\nSELECT geohash, year, (ym - m) / s AS z, ym AS back, asinh(ym) AS stretched FROM fr, g")
def reversed_scores(spark, d):
    """Scores, what they came from, and the stretched response."""
    rel = relative(spark, d)
    g = rel.agg(F.avg("yieldMean").alias("m"), F.stddev_samp("yieldMean").alias("s"))
    z = scalar.z_score(F.col("yieldMean"), F.col("m"), F.col("s"))
    return rel.crossJoin(F.broadcast(g)).select("geohash", "year", z.alias("z"), scalar.from_z_score(z, F.col("m"), F.col("s")).alias("back"), scalar.stretch(scalar.stretch(scalar.stretch(F.col("yieldMean")), inverse=True)).alias("stretched"))


@query("year condition claims! level!", _OC + """
--
SELECT year, CASE WHEN series = 'historic' THEN 'historic' ELSE substr(series, 1, 4) || '_SSP245' END AS condition, sum("predictedClaimsStd" * num) / sum(num) AS claims, max("thresholdStd") AS level FROM oc WHERE "offsetBaseline" = 'always' AND "geohashSimSize" = 4 AND abs(threshold - 0.25) < 1e-4 GROUP BY ALL""")
def scheme_claims(spark, d):
    """B19."""
    return explore.scheme_claims(exports.claims_rates(view(spark, d, OUTCOMES).withColumn("condition", scalar.series_condition(F.col("series")))), using_std=True)


@query(
    "geohash year month tmaxMeanChange! rhxMeanChange! climateMissing",
    f"WITH px AS ({duck(PIXELS)}), daily AS ({_DAILY}), mo AS ({_MONTHLY}), st AS (SELECT attr, avg(mean) AS m, stddev_samp(mean) AS s FROM mo WHERE condition = 'observations' GROUP BY attr), ch AS (SELECT year, geohash, month, avg((mean - m) / s) FILTER (mo.attr = 'tmax') AS t, avg((mean - m) / s) FILTER (mo.attr = 'rhx') AS r FROM mo JOIN st ON mo.attr = st.attr WHERE condition <> 'observations' AND s > 0 GROUP BY ALL), po AS (SELECT DISTINCT geohash, year, month FROM mo)\n--\n"
    + 'SELECT po.geohash, po.year, po.month, t AS "tmaxMeanChange", r AS "rhxMeanChange", ch.geohash IS NULL AS "climateMissing" FROM po LEFT JOIN ch ON po.geohash = ch.geohash AND po.year = ch.year AND po.month = ch.month',
)
def points_with_climate(spark, d):
    """Climate changes attached to points."""
    rows = monthly(spark, d)
    change = exports.climate_change(rows.where("condition = 'observations'"), rows.where("condition <> 'observations'"))
    return explore.with_climate(rows.select("geohash", "year", "month").distinct(), change)


@query(
    "geohash values! n",
    f"""WITH q AS ({duck(DELTAS)}), g AS (SELECT geohash, list(value ORDER BY value) FILTER (sample = 'O') AS a, list(value ORDER BY value) FILTER (sample = 'F') AS b FROM q GROUP BY geohash),
    w AS (SELECT geohash, i, CASE WHEN ('0x' || substr(md5('side|' || geohash || '|' || i), 1, 8))::BIGINT / 4294967296e0 < len(a) / CAST(len(a) + len(b) AS DOUBLE) THEN a[('0x' || substr(md5('at|' || geohash || '|' || i), 1, 8))::BIGINT % len(a) + 1] ELSE b[('0x' || substr(md5('at|' || geohash || '|' || i), 1, 8))::BIGINT % len(b) + 1] END AS v FROM g, range(1, 1001) r(i))
--
SELECT geohash, sum(v * i) AS values, count(v) AS n FROM w GROUP BY geohash""",
)
def merged_samples(spark, d):
    """1,000 draws of two samples merged by their counts, each draw weighed by its number, so that order counts."""
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("sample") == s, F.col("value"))))
    both = view(spark, d, DELTAS).groupBy("geohash").agg(side("O").alias("a"), side("F").alias("b"))
    merged = both.withColumn("m", sampling.merge_samples(F.col("a"), F.col("b"), F.size("a"), F.size("b"), F.col("geohash")))
    weighed = F.zip_with("m", F.sequence(F.lit(1), F.size("m")), lambda v, i: v * i)
    return merged.select("geohash", F.aggregate(weighed, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("values"), F.size(F.array_compact("m")).cast("long").alias("n"))
