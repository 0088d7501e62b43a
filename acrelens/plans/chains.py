"""Queries over stored tables, and chains of several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrelens.config import ATTRIBUTES, STD_MULTIPLIERS, THRESHOLDS
from acrelens.functions import scalar
from acrelens.operators import distributions, evaluate, explore, exports, frame, gates, outcomes, sampling, stats, tasks, trials
from acrelens.plans.results import _FIT, _OC, _PAIR, _REL, _SCALER, _SIMULATED, _STATS, _TASKS, U_TABLE, paired, relative, test_residuals, unit_size_list
from acrelens.plans.standins import OUTCOMES, PIXELS, YIELD_PIXELS, duck, given, view
from acrelens.plans.training import _CTE, _DAILY, _POOL, _SUMMARY, _every_field, _fields, daily, long_frame
from acrelens.sources import tables

Q: dict = {}


def query(columns: str, sql: str | None):
    def register(f):
        Q[f.__name__] = (f, columns, sql)
        return f

    return register


# summaries

_SHAPE = ", ".join(f"sum({c} * count) FILTER ({c} IS NOT NULL) / sum(count) FILTER ({c} IS NOT NULL) AS {c}" for c in ("skew", "kurtosis"))


@query("geohash attr condition year month mean! std! min! max! count skew! kurtosis!", f"WITH px AS ({duck(PIXELS)}), daily AS ({_DAILY})\n--\nSELECT geohash, attr, condition, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, {_POOL}, {_SHAPE} FROM daily GROUP BY ALL")
def pooled_shapes(spark, d):
    """D3: months pooled from days, with weighted skew and kurtosis."""
    rows = daily(spark, d).withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    return distributions.pool(rows, ["geohash", "attr", "condition", "year", "month"])


@query("geohash attr mean! std! min! max! count skew! kurtosis!", f"WITH px AS ({duck(PIXELS)})\n--\nSELECT geohash, attr, {_SUMMARY} FROM px GROUP BY geohash, attr")
def merged_summaries(spark, d):
    """states of monthly parts, written, read, merged by condition and merged again; the SQL summarises all values at once."""
    path = tables.scratch(spark, "states")
    tables.write_table(distributions.state(view(spark, d, PIXELS), ["geohash", "attr", "condition", "year", "month"]), path, ["geohash", "attr", "condition", "year", "month", *distributions.STATE])
    some = distributions.merge_states(spark.read.parquet(path), ["geohash", "attr", "condition"])
    return distributions.finish_state(distributions.merge_states(some, ["geohash", "attr"]), ["geohash", "attr"])


# rank tests of small samples

_SMALL = """SELECT CAST(l_suppkey AS STRING) AS geohash, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS month, l_linestatus AS sample, l_extendedprice AS value FROM {lineitem}"""
@query(
    "geohash month n1 n2 u! p! exact",
    f"""WITH RECURSIVE q AS ({duck(_SMALL)}), {U_TABLE.format(60)}, c AS (SELECT geohash, month, value, count(*) FILTER (sample = 'O') AS a, count(*) AS t FROM q GROUP BY ALL),
    r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY geohash, month ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2e0 AS rk FROM c),
    s AS (SELECT geohash, month, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(t) - sum(a) AS BIGINT) AS n2, sum(rk * a) - sum(a) * (sum(a) + 1) / 2 AS u, max(t) AS most FROM r GROUP BY ALL)
--
SELECT geohash, month, n1, n2, s.u, p, true AS exact FROM s JOIN ut ON ut.m = least(n1, n2) AND ut.n = greatest(n1, n2) AND ut.u = least(s.u, n1 * n2 - s.u) WHERE most = 1 AND least(n1, n2) BETWEEN 1 AND 8""",
)
def exact_rank_tests(spark, d):
    """Exact p of the months' small samples; the SQL enumerates by recurrence."""
    rows = outcomes.mann_whitney(view(spark, d, _SMALL), ["geohash", "month"], "value", F.col("sample") == "O")
    p = outcomes.exact_p("n1", "n2", "u", F.col("tied"))
    return rows.withColumn("p", p).where("p is not null").withColumn("exact", F.lit(True))


# files

@query("year mean! rows files", f"WITH yp AS ({duck(YIELD_PIXELS)})\n--\nSELECT year, avg(value) AS mean, count(*) AS rows, 1::BIGINT AS files FROM yp GROUP BY year")
def discovered_yields(spark, d):
    """Inputs found by listing a folder, side files and files without a year left out, and their rows read with the year of their file."""
    rows = view(spark, d, YIELD_PIXELS).select("geohash", "value", "id", F.col("year").alias("_year"))
    side = F.when(F.col("id") % 3 == 0, F.array(F.lit(".tif"), F.lit(".tif.aux.xml"), F.lit("readme"))).otherwise(F.array(F.lit(".tif")))
    name = F.when(F.col("tail") == "readme", F.lit("readme")).otherwise(F.concat(F.lit("yields_"), "_year", "tail"))
    root = tables.scratch(spark, "found")
    rows.withColumn("tail", F.explode(side)).withColumn("name", name).drop("tail", "_year").write.partitionBy("name").option("header", True).csv(f"{root}/store/cells")
    listed = tables.find_inputs(tables.list_files(spark, root, "*.csv"), r"yields_(\d{4})", -2)
    names = listed.select("year", F.element_at(F.split("path", "/"), -2).alias("name")).distinct().groupBy("year").agg(F.count("*").alias("files"))
    found = tables.read_found(spark, root, "geohash string, value double, id long", r"yields_(\d{4})", -2)
    return found.groupBy("year").agg(F.avg("value").alias("mean"), F.count("*").alias("rows")).join(names, "year")


@query("geohash attr rows mean!", f"WITH px AS ({duck(PIXELS)})\n--\nSELECT geohash, attr, count(*) AS rows, avg(value) AS mean FROM px GROUP BY ALL")
def stored_pixels(spark, d):
    """A2, A10: a pixel table with entries that hold no data, below the lowest value, which reading leaves out."""
    path = tables.scratch(spark, "pixels")
    rows = view(spark, d, PIXELS).withColumn("value", F.explode(F.array("value", F.lit(-9999.0))))
    tables.write_table(rows, path, ["geohash", "attr", "date", "value"])
    return tables.pixels(spark, path).groupBy("geohash", "attr").agg(F.count("*").alias("rows"), F.avg("value").alias("mean"))


_YEARS = f"WITH yp AS ({duck(YIELD_PIXELS)}), ys AS (SELECT geohash, year, avg(value) AS mean, count(*) AS count FROM yp GROUP BY ALL)"


@query("geohash year mean! count revised", _YEARS + "\n--\nSELECT geohash, year, CASE WHEN year = 1997 THEN mean / 2 ELSE mean END AS mean, CASE WHEN year = 2001 THEN NULL ELSE count END AS count, CASE WHEN year = 1997 THEN true END AS revised FROM ys")
def replaced_year(spark, d):
    """One year of a stored table replaced, twice, by rows with other values and one more column, and a year from elsewhere that lacks one."""
    rows = distributions.summarize(view(spark, d, YIELD_PIXELS), ["geohash", "year"], with_range=False).select("geohash", "year", "mean", "count")
    path, kept = tables.scratch(spark, "years"), ["geohash", "mean", "count", "year"]
    tables.write_table(rows.where("year <> 2001"), path, kept, partition_by=("year",))
    revised = rows.where("year = 1997").withColumn("mean", F.col("mean") / 2).withColumn("revised", F.lit(True))
    for _ in range(2):
        tables.write_table(revised, path, [*kept, "revised"], partition_by=("year",))
    return tables.union_years([tables.read_years(spark, path), rows.where("year = 2001").drop("count")])


_FIGURES = {"experimentalMean2030": "mean", "counterfactualProbability2050": "probability", "experimentalSeverity2030": "severity"}
_HELD = "".join(f", {x}AS (SELECT max(mean) FILTER (kind = 'experimental' AND year = 2030) AS a, max(probability) FILTER (kind = 'counterfactual' AND year = 2050) AS b, max(severity) FILTER (kind = 'experimental' AND year = 2030) AS c FROM {y})" for x, y in (("x1 ", "st"), ("x2 ", "st2")))
_TEXTS = ", ".join(f"""format('{{:.1f}}', {x}.a * 100) || '\\%' AS "experimentalMean2030{s}", format('{{:.1f}}', {x}.b * 100) || '\\%' AS "counterfactualProbability2050{s}", format('{{:.1f}}', (-{x}.c - 0.25::DOUBLE) * 100) || '\\%' AS "experimentalSeverity2030{s}\"""" for x, s in (("x1", ""), ("x2", "HoldYr")))


@query(
    " ".join(f"{n}{s}" for s in ("", "HoldYr") for n in _FIGURES),
    _STATS + ", st2 AS (" + _STATS[_STATS.index("st AS (") + 7 :].replace("\"offsetBaseline\" = 'always'", "\"offsetBaseline\" = 'never'") + f"{_HELD}\n--\nSELECT {_TEXTS} FROM x1, x2",
)
def hold_year_records(spark, d):
    """The records of two runs written as JSON, read back by their schema and combined, those of the run with years held renamed. The stand-in for that run has no offset."""
    rows = view(spark, d, OUTCOMES)
    held = rows.where("offsetBaseline = 'never'").withColumn("offsetBaseline", F.lit("always"))
    read = []
    for name, run in (("run", rows), ("held", held)):
        path = tables.scratch(spark, f"record-{name}")
        tables.write_record(stats.record(stats.series_stats(run.where(exports.in_scope(0.25)))), path)
        read.append(tables.read_record(spark, path, ", ".join(f"{n} string" for n in _FIGURES)))
    return stats.combine_records((read[0], ""), (read[1], "HoldYr"))


# gates

def _gated(spark, d):
    valid = frame.own_deltas(_fields(spark, d)).groupBy("geohash", "year").agg(F.bool_and("valid").alias("valid"))
    parts = distributions.summarize(view(spark, d, YIELD_PIXELS).where("value > 0"), ["geohash", "year", "part"])
    return parts.join(valid, ["geohash", "year"], "left").withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("complete", F.col("skew").isNotNull())


@query(
    "rows invalid! complete! normal!",
    _every_field() + f""", av AS (SELECT geohash, field, avg(value) AS mean FROM lf WHERE value IS NOT NULL GROUP BY ALL), va AS (SELECT l.geohash, l.year, bool_and(a.mean IS NOT NULL) AS valid FROM lf l LEFT JOIN av a ON l.geohash = a.geohash AND l.field = a.field GROUP BY ALL),
    sp AS (SELECT geohash, year, part, {_SUMMARY} FROM yp WHERE value > 0 GROUP BY ALL), s AS (SELECT sp.*, coalesce(valid, false) AS valid FROM sp LEFT JOIN va ON sp.geohash = va.geohash AND sp.year = va.year)
--
SELECT count(*) AS rows, avg(CASE WHEN valid THEN 0e0 ELSE 1e0 END) AS invalid, avg(CASE WHEN skew IS NOT NULL THEN 1e0 ELSE 0e0 END) AS complete, avg(CASE WHEN abs(skew) <= 2 AND abs(kurtosis) <= 7 THEN 1e0 ELSE 0e0 END) AS normal FROM s""",
)
def gated_table(spark, d):
    """Partial summaries written once, the gates' figures taken in the same pass; a repeated key would raise in the plan."""
    rows = gates.unique_rows(_gated(spark, d), ["geohash", "year", "part"])
    table, found = gates.write_gated(rows, tables.scratch(spark, "gated"), gates.delta_figures(), at_most={"invalid": 1.0}, at_least={"complete": 0.0, "normal": 0.0})
    return table.agg(F.count("*").alias("rows"), *[F.max(F.lit(found[n]).cast("double")).alias(n) for n in ("invalid", "complete", "normal")])


# layout

_SOME = "CAST(l_suppkey AS STRING) IN (SELECT CAST(s_suppkey AS STRING) FROM supplier WHERE s_acctbal > 5000)"


@query(
    "geohash year yieldMean! yieldObservations climateCounts month attr c_mean!",
    _CTE.replace(duck(PIXELS), f"{duck(PIXELS)} WHERE {_SOME}").replace(duck(YIELD_PIXELS), f"{duck(YIELD_PIXELS)} WHERE {_SOME}") + '\n--\nSELECT geohash, year, ym AS "yieldMean", obs AS "yieldObservations", cc AS "climateCounts", month, attr, v AS c_mean FROM fr',
)
def regional_frame(spark, d):
    """The frame of a list of cells, from tables stored by region; the list prunes both scans to its regions."""
    cells = given(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("geohash")).withColumn("region", F.substring("geohash", 1, 1))
    own = {}
    for name, rows in (("climate", view(spark, d, PIXELS).where("condition = 'observations' and value >= 0")), ("yields", view(spark, d, YIELD_PIXELS).where("value > 0"))):
        path = tables.scratch(spark, name)
        tables.write_by_region(rows, path, length=1)
        own[name] = frame.restrict(spark.read.schema(rows.schema.add("region", "string")).parquet(path), cells, region="region")
    days = distributions.summarize(own["climate"], ["geohash", "attr", "condition", "date"]).withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    months = distributions.pool(days, ["geohash", "attr", "condition", "year", "month"], shape=False)
    return frame.combine(distributions.summarize(own["yields"], ["geohash", "year"], with_range=False), months)


# chains

@query(
    "geohash year mean! std! skew! kurtosis! complete",
    f"""WITH yp AS ({duck(YIELD_PIXELS)}), n AS (SELECT geohash, year, value, row_number() OVER (PARTITION BY geohash, year ORDER BY ('0x' || substr(md5('part|' || id), 1, 8))::BIGINT % 64, id, value) AS at FROM yp), c AS (SELECT geohash, year, count(*) AS n FROM yp GROUP BY ALL),
    w AS (SELECT geohash, year, ('0x' || substr(md5('draw|' || geohash || '|' || year || '|' || draw), 1, 8))::BIGINT % n + 1 AS at FROM c, range(1, 1001) r(draw)), b AS (SELECT geohash, avg(value) AS base FROM yp GROUP BY geohash),
    px AS (SELECT w.geohash, w.year, greatest(-1e0, (value - base) / base) AS value FROM w JOIN n ON w.geohash = n.geohash AND w.year = n.year AND w.at = n.at JOIN b ON b.geohash = w.geohash),
    m AS (SELECT geohash, year, avg(value) AS mean FROM px GROUP BY ALL), e AS (SELECT px.geohash, px.year, m.mean, avg((value - m.mean) ** 2) AS v, avg((value - m.mean) ** 3) AS t, avg((value - m.mean) ** 4) AS f, min(value) = max(value) AS flat FROM px JOIN m ON m.geohash = px.geohash AND m.year = px.year GROUP BY ALL)
--
SELECT geohash, year, mean, sqrt(v) AS std, CASE WHEN NOT flat THEN t / v ** 1.5::DOUBLE END AS skew, CASE WHEN NOT flat THEN f / (v * v) - 3 END AS kurtosis, NOT flat AS complete FROM e""",
)
def sampled_responses(spark, d):
    """Moments of the deltas of 1,000 draws from each cell-year's yields against the cell's baseline."""
    rows = view(spark, d, YIELD_PIXELS)
    base = rows.groupBy("geohash").agg(F.avg("value").alias("base"))
    draws = sampling.draw_values(rows, ["geohash", "year"], "value", ["id", "value"]).join(base, "geohash")
    # as many entries as draws
    samples = draws.groupBy("geohash", "year").agg(F.sort_array(F.collect_list("value")).alias("sample"), F.first("base").alias("base"))
    return samples.select("geohash", "year", frame.response(F.col("sample"), F.col("base")).alias("r")).select("geohash", "year", "r.*")


_SELECTED = _PAIR + """, se AS (SELECT *, abs("predictedMean") / 3 + 0.1::DOUBLE AS std, CAST(CASE WHEN condition = 'historic' THEN '2010' ELSE substr(condition, 1, 4) END AS INT) AS set FROM pd WHERE condition LIKE '2030%' AND "lossThreshold" = 0.25::DOUBLE),
po AS (SELECT geohash, condition, sum(num) AS num, sum("predictedRisk" * num) / sum(num) FILTER ("predictedRisk" IS NOT NULL) AS r, sum("counterfactualRisk" * num) / sum(num) FILTER ("counterfactualRisk" IS NOT NULL) AS c, sum("predictedMean" * num) / sum(num) FILTER ("predictedMean" IS NOT NULL) AS m,
    CASE WHEN sum(num) <> count(*) THEN sqrt(sum((num - 1) * std * std) / (sum(num) - count(*))) END AS std, min(p) AS p, max(set) AS set FROM se GROUP BY ALL)"""
_CATEGORY = lambda change, limit: f"CASE WHEN p IS NULL OR {change} IS NULL THEN 'unknown' WHEN p >= {limit} / (SELECT count(*) FROM po) THEN 'no significant change' WHEN {change} > 0 THEN 'increase' ELSE 'decrease' END"


@query(
    "geohash condition set num! std! predictedMean! p! byRisk byYield",
    _SELECTED + f"\n--\nSELECT geohash, condition, set, num, std, m AS \"predictedMean\", p, {_CATEGORY('r - c', '(5e-2::DOUBLE / 5)')} AS \"byRisk\", {_CATEGORY('m', '1e-1::DOUBLE')} AS \"byYield\" FROM po",
)
def explorer_selection(spark, d):
    """Records of a scenario and threshold, pooled with their std, at the 5 % level over five years and at the 10 % level over one."""
    rows = paired(spark, d).withColumn("loss", scalar.loss_label(F.col("lossThreshold"))).withColumn("std", F.abs("predictedMean") / 3 + 0.1)
    picked = explore.select_records(rows, "2030", "25% loss")
    pooled = explore.pool_records(picked)
    pooled = explore.relabel_historic(pooled.withColumn("series", F.when(F.col("condition") == "historic", "historic").otherwise(F.col("condition"))))
    out = explore.categorise(pooled, F.col("predictedRisk") - F.col("counterfactualRisk")).withColumnRenamed("category", "byRisk")
    return explore.categorise(out, F.col("predictedMean"), alpha=0.10, years_per_record=1).withColumnRenamed("category", "byYield")


@query("geohash condition num! std! predictedMean! p! category", _SELECTED + f", ca AS (SELECT *, {_CATEGORY('m', '1e-1::DOUBLE')} AS category FROM po)\n--\nSELECT geohash, condition, num, std, m AS \"predictedMean\", p, category FROM ca WHERE std IS NOT NULL AND m IS NOT NULL AND category IN ('increase', 'decrease')")
def significant_points(spark, d):
    """Of the selected records the complete ones whose yield changes significantly at the 10 % level over one year."""
    rows = paired(spark, d).withColumn("loss", scalar.loss_label(F.col("lossThreshold"))).withColumn("std", F.abs("predictedMean") / 3 + 0.1)
    pooled = explore.pool_records(explore.select_records(rows, "2030", "25% loss"))
    out = explore.categorise(pooled, F.col("predictedMean"), alpha=0.10, years_per_record=1)
    return explore.valid_points(out, ["num", "std", "predictedMean"], significant_only=True)


_ALL_ATTRS = "SELECT CAST(l_suppkey % 7 AS STRING) AS geohash, CASE CAST(l_partkey % 8 AS INT) " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ATTRIBUTES.values())) + " END AS attr, CASE WHEN l_linestatus = 'F' THEN 'observations' ELSE '2050_SSP245' END AS condition, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, l_quantity AS value FROM {lineitem}"


@query(
    "year geohash month " + " ".join(f"{a}MeanChange!" for a in ATTRIBUTES.values()),
    f"""WITH px AS ({duck(_ALL_ATTRS)}), mo AS (SELECT geohash, attr, condition, year, month, avg(value) AS mean FROM px GROUP BY ALL), h AS (SELECT attr, avg(mean) AS m, stddev_samp(mean) AS s FROM mo WHERE condition = 'observations' GROUP BY attr),
    z AS (SELECT year, geohash, month, mo.attr, (mean - m) / s AS z FROM mo JOIN h ON mo.attr = h.attr WHERE condition <> 'observations' AND s > 0), w AS (SELECT year, geohash, month, {", ".join(f"avg(z) FILTER (attr = '{a}') AS {a}" for a in ATTRIBUTES.values())} FROM z GROUP BY ALL)
--
SELECT year, geohash, month, {", ".join(f'{a} AS "{a}MeanChange"' for a in ATTRIBUTES.values())} FROM w WHERE {" AND ".join(f"{a} IS NOT NULL" for a in ATTRIBUTES.values())}""",
)
def complete_climate_changes(spark, d):
    """Only months in which all eight attributes have a change."""
    rows = view(spark, d, _ALL_ATTRS).groupBy("geohash", "attr", "condition", "year", "month").agg(F.avg("value").alias("mean"))
    out = exports.climate_change(rows.where("condition = 'observations'"), rows.where("condition <> 'observations'"))
    return exports.complete_rows(out, [f"{a}MeanChange" for a in ATTRIBUTES.values()])


_INPUTS = [f"{a}Mean{m}" for a in ("rhx", "tmax") for m in (3, 6)]


@query(
    "geohash year field value!",
    _CTE + f", wi AS (SELECT geohash, year, ym, {', '.join(f'''max(v) FILTER (attr = '{a}' AND month = {m}) AS \"{a}Mean{m}\"''' for a in ('rhx', 'tmax') for m in (3, 6))} FROM fr GROUP BY geohash, year, ym)\n--\n"
    + f"SELECT geohash, year, unnest([{', '.join(repr(c) for c in _INPUTS)}]) AS field, unnest([{', '.join(chr(34) + c + chr(34) for c in _INPUTS)}]) AS value FROM wi WHERE ym IS NOT NULL AND " + " AND ".join(f'"{c}" IS NOT NULL' for c in _INPUTS),
)
def model_inputs(spark, d):
    """The wide frame's feature columns without blocked names, words and counts, rows with a null among them dropped, as rows again."""
    months = (3, 6)
    wide = frame.widen(long_frame(spark, d), ("rhx", "tmax"), months)
    blocked = ("geohash", "year", *[c for c in wide.columns if "Min" in c or "Max" in c])
    features = evaluate.feature_columns(wide.columns, blocked, ("yield", "std"), exclude_counts=True)
    return frame.lengthen(wide.dropna(subset=[*features, "yieldMean"]), ["geohash", "year"], features)


@query("geohash year n", f"WITH yp AS ({duck(YIELD_PIXELS)}), s AS (SELECT DISTINCT geohash, year, part FROM yp)\n--\nSELECT geohash, year, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1")
def repeated_cell_years(spark, d):
    """Cell-years that occur more than once among partial summaries."""
    return frame.repeated_keys(view(spark, d, YIELD_PIXELS).select("geohash", "year", "part").distinct(), ["geohash", "year"])


@query("id grower! government! whole! category", """WITH p AS (SELECT p_partkey AS id, (1000e0 + p_size * 20e0) * 4e0 * 5e-2 * 75e-2 AS whole, (p_retailprice - 1000e0 - p_size * 20e0) / 1000e0 AS change, CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 10000e0 AS p FROM part)
--
SELECT id, whole * (1 - 55e-2) AS grower, whole * 55e-2 AS government, whole, CASE WHEN p >= 5e-2 THEN 'no significant change' WHEN change > 0 THEN 'gain' ELSE 'loss' END AS category FROM p""")
def price_perspectives(spark, d):
    """A policy's price as the grower, the government and both together see it, and categories by yield."""
    p = given(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.lit(1000.0) + F.col("p_size") * 20.0).alias("aph"), "p_retailprice")
    price = lambda who: scalar.price(F.col("aph"), F.lit(4.0), F.lit(0.05), F.lit(0.75), F.lit(0.55), F.lit(who)).alias(who)
    change, level = (F.col("p_retailprice") - F.col("aph")) / 1000, (F.col("id") * 7919) % 1000 / 10000
    return p.select("id", *[price(w) for w in ("grower", "government", "whole")], scalar.change_category(change, level, F.lit(0.05), "gain", "loss").alias("category"))


@query("series familySize", _OC + "\n--\nSELECT '2010' AS series, count(*) AS \"familySize\" FROM oc WHERE series = 'historic' AND abs(\"stdMult\" - 1) < 1e-4 AND \"geohashSimSize\" = 4 AND abs(\"unitSize\") > 1.0001 AND \"offsetBaseline\" = 'always'")
def historic_family(spark, d):
    """The scope of the historic series."""
    rows = view(spark, d, OUTCOMES).withColumn("series", F.when(F.col("series") == "historic", "2010").otherwise(F.col("series")))
    return rows.where(exports.in_scope(historic=True)).groupBy("series").agg(F.count("*").alias("familySize"))


# from pixels to exports

_KEYS = ["label", "series", "geohash", "year", "threshold", "geohashSimSize", "offsetBaseline"]
_PROJECTED = f"""fx AS (SELECT geohash, year, CAST(year + 15 - 2007 AS DOUBLE) AS x, CAST(obs AS DOUBLE) AS z, CAST(obs AS DOUBLE) AS w, ym, ys FROM fr), fa AS ({_FIT('ym')}), fb AS ({_FIT('ys')}),
    pj AS (SELECT label, geohash, year, fa.my + fa.b1 * (e - fa.mx) + fa.b2 * (obs - fa.mz) AS pm, fb.my + fb.b1 * (e - fb.mx) + fb.b2 * (obs - fb.mz) AS ps FROM (SELECT 'run' AS label, *, CAST(year + 15 - 1998 AS DOUBLE) AS e FROM fr WHERE year > 1998 UNION ALL SELECT 'hold', *, 0e0 FROM fr WHERE year > 1998), fa, fb),
    t0 AS (SELECT label, e.geohash, l.year, e.ym AS om, e.ys AS os, l.pm, l.ps, e.obs AS n FROM fr e JOIN pj l ON e.geohash = l.geohash AND e.year = l.year - 4 WHERE e.year <= 1998 AND e.obs > 0),
    ta AS (SELECT label, '2030' AS series, geohash, year, om, os, pm, ps, n FROM t0 UNION ALL SELECT label, '2030_counterfactual', geohash, year, om, os, om, os, n FROM t0)"""


def _exported_sql() -> str:
    out = _SIMULATED.replace(_TASKS.replace("WITH yp", "WITH RECURSIVE yp", 1), _REL.replace("WITH yp", "WITH RECURSIVE yp", 1) + ", " + _PROJECTED)
    out = out.replace("(VALUES (CAST(4 AS INT)), (5)) w(c)", "(VALUES (CAST(4 AS INT))) w(c)").replace("(VALUES ('always'), ('never'), ('negative')) x(o)", "(VALUES ('always')) x(o)")
    for word in ("unit", "trial"):
        out = out.replace(f"'{word}|' || geohash", f"'{word}|' || label || '|' || series || '|' || geohash")
    out = out.replace("geohash, year, threshold, size, policy", "label, series, geohash, year, threshold, size, policy")
    return out + """, o1 AS (SELECT label, series, geohash, year, threshold, count(*) AS num, avg(dp) AS change, avg(CASE WHEN dp <= -threshold THEN 1e0 ELSE 0e0 END) AS claims FROM de GROUP BY ALL),
    fam AS (SELECT label, series, count(*) AS f FROM o1 WHERE threshold = 0.25::DOUBLE GROUP BY ALL), o2 AS (SELECT o1.*, pv.p, f, series LIKE '%_counterfactual' AS cf FROM o1 JOIN pv USING (label, series, geohash, year, threshold) JOIN fam USING (label, series)),
    pd AS (SELECT label, geohash, year, threshold, coalesce(max(num) FILTER (NOT cf), max(num) FILTER (cf)) AS num, max(claims) FILTER (NOT cf) AS r, max(claims) FILTER (cf) AS c, max(change) FILTER (NOT cf) AS m, coalesce(bool_or(p < 0.05::DOUBLE / f) FILTER (NOT cf), false) AS sig FROM o2 GROUP BY label, geohash, year, threshold),
    ce AS (SELECT label, geohash, bool_or(coalesce(r > c, false)) AS risk, sum(m * num) / sum(num) FILTER (m IS NOT NULL) AS change, bool_or(sig) AS ever, sum(num) AS num FROM pd GROUP BY label, geohash),
    bn AS (SELECT label, CASE WHEN series = '2030' THEN 'predicted' ELSE 'counterfactual' END AS series, threshold, num, claims, change FROM o1),
    hi AS (SELECT label, CASE WHEN series = '2030' THEN 'predicted' ELSE 'counterfactual' END AS series, CAST(round_even(least(greatest(dp, -1e0), 1e0) * 100 / 5, 0) * 5 AS INT) AS bin, count(*) AS n FROM de WHERE threshold = 0.25::DOUBLE GROUP BY ALL),
    ks AS (SELECT DISTINCT label, series FROM bn)
--
SELECT ks.label, ks.series, CAST(r.b * 5 AS VARCHAR) AS bin, CAST(coalesce(n, 0) AS DOUBLE) AS val FROM ks CROSS JOIN range(-20, 21) r(b) LEFT JOIN hi ON hi.label = ks.label AND hi.series = ks.series AND hi.bin = r.b * 5
UNION ALL SELECT label, series, unnest(['cnt', 'mean', 'claimsMpci']), unnest([CAST(sum(num) AS DOUBLE), sum(num * change) / sum(num), sum(num * claims)]) FROM bn WHERE threshold = 0.25::DOUBLE GROUP BY label, series
UNION ALL SELECT label, series, 'claimsSco', sum(num * claims) FROM bn WHERE threshold = 0.15::DOUBLE GROUP BY label, series
UNION ALL SELECT label, 'paired', unnest(['dualIncrease', 'percentSignificant']), unnest([count(*) FILTER (risk AND change >= 0) / nullif(count(*) FILTER (risk), 0)::DOUBLE, coalesce(sum(num) FILTER (ever), 0) / sum(num)::DOUBLE]) FROM ce GROUP BY label"""


def _labelled_tasks(rel):
    """From relative(): tasks of the projections by a fitted model, with years as they run and held, each with its counterfactual, which stays as it was."""
    rel = rel.withColumn("observations", F.col("yieldObservations").cast("double"))
    features, at = ["effectiveYear", "observations"], lambda mode: tasks.effective_year(F.col("year") + 15, mode).cast("double")
    models = evaluate.fit_linear(rel.withColumn("effectiveYear", at("train")), features, {"yieldMean": "yieldMean", "yieldStd": "yieldStd"}, "observations")
    early, counts, out = tasks.copy_projection(rel.where("year <= 1998")), tasks.observation_counts(rel), {}
    for label, mode in (("run", "project"), ("hold", "hold")):
        late = rel.where("year > 1998").withColumn("effectiveYear", at(mode)).select("geohash", "year", "yieldObservations", *[c.alias(n) for n, c in evaluate.linear_scores(models, features).items()])
        found = tasks.build_tasks(early, tasks.copy_projection(late, late=True, shift=4), counts, "2030_SSP245")
        same = found.withColumn("projectedYieldMean", F.col("originalYieldMean")).withColumn("projectedYieldStd", F.col("originalYieldStd"))
        out[label] = exports.union_series({"2030": found, "2030_counterfactual": same}).withColumn("label", F.lit(label))
    return out["run"].unionByName(out["hold"])


@query("label series bin val!", _exported_sql())
def exported_simulation(spark, d):
    """From yields to a model, its projections with years run and held, trials, written outcomes, histograms and paired statistics."""
    rel = tables.stored(relative(spark, d), "relative")
    variants = tasks.with_variants(_labelled_tasks(rel), THRESHOLDS, STD_MULTIPLIERS, (4,), ("always",))
    variants = tasks.with_std_threshold(variants, tasks.std_equivalents(rel, list(THRESHOLDS)))
    units = sampling.draw_scaled_units(variants, _KEYS, "numObservations", unit_size_list(spark, d), _SCALER)
    units = trials.simulate_units(units, _KEYS, trials.residual_pool(test_residuals(rel))).withColumn("stdLevel", F.col("originalYieldStd") * F.col("thresholdStd"))
    units = tables.stored(units.select(*_KEYS, "stdLevel", "stdMult", *outcomes.KINDS), "units")
    rows = outcomes.trial_outcomes(units, _KEYS, "threshold", "stdLevel", carry=("stdMult",)).withColumnRenamed("units", "num").withColumn("unitSize", F.lit(8.0))
    rows = rows.join(outcomes.wide_histogram(units.withColumn("d", F.round("predicted", 9)), _KEYS, "d"), _KEYS)
    path = tables.scratch(spark, "outcomes")
    rows.write.parquet(path)
    tables.remove(spark, units.stored_at)
    rows, out = spark.read.schema(rows.schema).parquet(path), []
    for label in ("run", "hold"):
        own = rows.where(F.col("label") == label)
        paired = exports.pair(own, exports.family_sizes(own))
        figures = stats.combine_records((stats.dual_increase(paired).select("dualIncrease"), ""), (exports.significant_share(paired), ""))
        figures = figures.unpivot([], ["dualIncrease", "percentSignificant"], "bin", "val").withColumn("series", F.lit("paired"))
        out.append(exports.histogram_export(own).select("series", "bin", "val").unionByName(figures).withColumn("label", F.lit(label)))
    return out[0].unionByName(out[1])
