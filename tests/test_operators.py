"""Operators on hand-made rows with known answers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from acrelens import config
from acrelens.functions import geo, scalar
from acrelens.operators import actuals, distributions, evaluate, explore, exports, frame, gates, outcomes, sampling, stats, tasks, trials
from acrelens.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_pooling(spark):
    ddl = "k string, mean double, std double, min double, max double, count long, skew double, kurtosis double"
    rows = [("a", 1.0, 1.0, 0.0, 3.0, 3, 1.0, None), ("a", 5.0, 2.0, 2.0, 9.0, 5, float("nan"), None), ("a", 7.0, 1.0, 1.0, 1.0, 0, 1.0, 1.0), ("b", 2.0, 0.0, 2.0, 2.0, 1, None, None), ("b", 4.0, 0.0, 4.0, 4.0, 1, None, None)]
    got = {r["k"]: r for r in distributions.pool(spark.createDataFrame(rows, ddl), ["k"]).collect()}
    assert got["a"]["mean"] == 3.5 and got["a"]["std"] == pytest.approx(math.sqrt(3)) and got["a"]["count"] == 8 and (got["a"]["min"], got["a"]["max"], got["a"]["skew"], got["a"]["kurtosis"]) == (0, 9, 1.0, None)
    assert got["b"]["std"] == pytest.approx(math.sqrt(2))
    assert distributions.pool(spark.createDataFrame(rows[:2], ddl), ["k"], legacy_max=True).first()["max"] == 2
    whole = distributions.pool(spark.createDataFrame(rows[3:], ddl), ["k"], total_variance=True).first()
    assert whole["std"] == 1.0
    turned = distributions.pool(spark.createDataFrame(rows[::-1], ddl).repartition(5), ["k"]).orderBy("k").first()
    assert turned["std"] == pytest.approx(got["a"]["std"])


def test_geohash(spark):
    code = lambda lat, lon, p: value(spark, geo.encode(F.lit(lon), F.lit(lat), p))
    assert code(42.6, -5.6, 5) == "ezs42" and code(42.6, -5.6, 4) == "ezs4"
    assert code(90.0, 180.0, 4) == "zzzz" and code(-90.0, -180.0, 4) == "0000" and code(float("nan"), 0.0, 4) is None
    box = value(spark, geo.bounds(F.lit("ezs42"), 5))
    assert box["south"] <= 42.6 < box["north"] and box["west"] <= -5.6 < box["east"]
    assert code(box["south"], box["west"], 5) == "ezs42" and code(box["north"], box["east"], 5) != "ezs42"
    mid = value(spark, geo.center(F.lit("ezs42"), 5))
    assert code(mid["lat"], mid["lng"], 5) == "ezs42" and value(spark, geo.center(F.lit("ai!o"))) is None


def test_scalars(spark):
    assert [value(spark, scalar.try_int(F.lit(x))) for x in ("3", "3.5", "2.5", "x")] == [3, 4, 2, None]
    assert [value(spark, scalar.bin_of(F.lit(x))) for x in (0.024, 0.026, 0.025, 0.075, 1.7, -3.0)] == [0, 5, 0, 10, 100, -100]
    z = lambda v, m, s: value(spark, scalar.z_score(F.lit(v).cast("double"), F.lit(m), F.lit(s)))
    assert z(None, 1.0, 1.0) == z(float("nan"), 1.0, 1.0) == z(3.0, 1.0, 0.0) == config.INVALID and z(3.0, 1.0, 2.0) == 1.0
    assert value(spark, scalar.percent(F.lit(0.1234))) == "12.3\\%" and value(spark, scalar.severity_percent(F.lit(-0.35))) == "10.0\\%"
    assert value(spark, scalar.layers_text(F.lit(3))) == "64, 32, 8" and value(spark, scalar.loss_label(F.lit(0.25))) == "25% loss"
    assert value(spark, scalar.series_year(F.lit("2030_counterfactual"))) == 2030 and value(spark, scalar.series_condition(F.lit("historic"))) == "historic"
    assert value(spark, scalar.parse_sample(F.lit("1 2.5 x"))) == [1.0, 2.5, None] and value(spark, scalar.finite(F.lit(float("inf")))) is None
    assert value(spark, scalar.attribute(F.lit("chirps-v2"))) == "chirps"
    assert value(spark, scalar.covered_loss(F.lit(50.0), F.lit(100.0), F.lit(0.75))) == 25 and value(spark, scalar.severity(F.lit(50.0), F.lit(100.0), F.lit(0.75))) == 0.25
    assert value(spark, scalar.change_category(F.lit(-1.0), F.lit(0.001), F.lit(0.05))) == "decrease" and value(spark, scalar.change_category(F.lit(1.0), F.lit(0.5), F.lit(0.05))) == "no significant change"


def test_responses_and_gates(spark):
    r = value(spark, frame.response(F.array(F.lit(50.0), F.lit(100.0), F.lit(300.0)), F.lit(100.0)))
    assert r["mean"] == 0.5 and r["std"] == pytest.approx(math.sqrt((1 + 0.25 + 2.25) / 3)) and r["complete"]
    assert value(spark, frame.response(F.array(F.lit(-50.0), F.lit(-900.0)), F.lit(100.0)))["mean"] == -1.0
    assert value(spark, frame.response(F.array().cast("array<double>"), F.lit(100.0)))["complete"] is False
    rows = lambda bad: spark.range(100).select((F.col("id") >= bad).alias("valid"), F.lit(True).alias("complete"), F.lit(2.0).alias("skew"), F.lit(7.0).alias("kurtosis"))
    gates.require(gates.delta_gate(rows(5)), **gates.DELTA_LIMITS)
    with pytest.raises(gates.GateError):
        gates.require(gates.delta_gate(rows(6)), **gates.DELTA_LIMITS)
    with pytest.raises(gates.GateError):
        gates.require(gates.delta_gate(rows(0).withColumn("skew", F.lit(2.01))), **gates.DELTA_LIMITS)
    assert gates.unique_gate(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"]).first()["repeated"] == 1


def test_claims_and_ranks(spark):
    rows = spark.createDataFrame([(1, x) for x in (-0.3, -0.25, -0.1, 0.2)] + [(2, 0.5)], "k int, d double")
    got = {r["k"]: r for r in outcomes.claim_metrics(rows, ["k"], {"x": "d"}, F.lit(0.25), F.lit(0.5)).collect()}
    assert got[1]["xClaims"] == 0.5 and got[1]["xLoss"] == pytest.approx(-0.275) and got[2]["xLoss"] == 0 and got[1]["xClaimsStd"] == 0
    bins = outcomes.wide_histogram(rows, ["k"], "d").where("k = 1").first()
    assert bins["bin-30"] == 1 and bins["bin20"] == 1 and sum(bins[f"bin{b}"] for b in config.BINS) == 4
    assert outcomes.histogram(rows, ["k"], "d").agg(F.sum("n")).first()[0] == 5
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 7.0]
    both = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "v double, a boolean").withColumn("k", F.lit(1))
    r = outcomes.mann_whitney(both, ["k"], "v", F.col("a")).withColumn("p", outcomes.two_sided_p("z")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    sd = math.sqrt(12 / 12 * (8 - (27 - 3) / 42))
    assert r["u"] == u and r["z"] == pytest.approx((u - 6 + 0.5) / sd) and r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)))


def test_pairing(spark):
    ddl = "geohash string, year int, series string, threshold double, num double, predictedClaims double, predictedChange double, p double"
    rows = [("a", 1, "2030", 0.25, 5.0, 0.4, -0.1, 0.001), ("a", 1, "2030_counterfactual", 0.25, 7.0, 0.2, 0.1, 0.9), ("b", 1, "2030", 0.25, 2.0, 0.1, 0.3, 0.9), ("c", 1, "2030_counterfactual", 0.25, 3.0, 0.1, 0.3, 0.9)]
    families = spark.createDataFrame([("2030", 10), ("2030_counterfactual", 10)], "series string, familySize int")
    got = {r["geohash"]: r for r in exports.pair(spark.createDataFrame(rows, ddl), families).collect()}
    assert got["a"]["predictedRisk"] == 0.4 and got["a"]["counterfactualRisk"] == 0.2 and got["a"]["pMeets0.05n"] and got["a"]["num"] == 5
    assert got["b"]["counterfactualRisk"] is None and got["c"]["predictedRisk"] is None and got["c"]["num"] == 3
    with pytest.raises(Exception, match="more than one row of a kind"):
        exports.pair(spark.createDataFrame([*rows, rows[0]], ddl), families).collect()
    assert exports.significant_share(exports.pair(spark.createDataFrame(rows, ddl), families)).first()[0] == 0.5
    dual = stats.dual_increase(spark.createDataFrame([("a", 0.2, 0.1, 0.1, 1.0), ("b", 0.3, 0.1, -0.1, 1.0), ("c", 0.1, 0.3, 1.0, 1.0)], "geohash string, predictedRisk double, counterfactualRisk double, predictedMean double, num double")).first()
    assert dual["dualIncrease"] == 0.5


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(60).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("v"), "id")
    one = sampling.draw_values(rows.repartition(1), ["k"], "v", ["id"], 30).orderBy("k", "draw").collect()
    assert one == sampling.draw_values(rows.repartition(8), ["k"], "v", ["id"], 30).orderBy("k", "draw").collect() and len(one) == 90 and all(r["value"] % 3 == int(r["k"]) for r in one)
    units = sampling.draw_units(spark.createDataFrame([("a", 50), ("b", 0)], "k string, n long"), ["k"], "n", [7.0, 12.0])
    total = [r["unitSize"] for r in units.orderBy("unit").collect()]
    assert sum(total) >= 50 > sum(total[:-1])
    task = units.withColumn("pixels", F.lit(400)).withColumn("stdMult", F.lit(1.0)).withColumn("offsetBaseline", F.lit("never")).withColumn("originalYieldMean", F.lit(0.1)).withColumn("originalYieldStd", F.lit(0.2)).withColumn("projectedYieldMean", F.lit(-0.1)).withColumn("projectedYieldStd", F.lit(0.2))
    pool = trials.residual_pool(spark.createDataFrame([(0.05, 0.0), (None, float("nan"))], "meanResidual double, stdResidual double"))
    assert (pool.mean_count, pool.std_count) == (1, 1)
    runs = [trials.simulate_units(task.repartition(n), ["k"], pool).orderBy("unit").collect() for n in (1, 4)]
    assert runs[0] == runs[1] and all(r["baseline"] == 0.1 and abs(r["predicted"] + 0.15) < 0.05 and abs(r["adapted"] - 0.05) < 0.05 for r in runs[0])
    moved = trials.simulate_units(task.withColumn("offsetBaseline", F.lit("always")).withColumn("originalYieldStd", F.lit(0.0)), ["k"], pool).first()
    assert moved["baseline"] == 0.1 and abs(moved["predicted"] + 0.2) < 0.05  # less an expected yield of 0.1 - 0.05
    z = [r[0] for r in spark.range(4000).select(trials.gaussians(F.md5(F.col("id").cast("string")))[1]).collect()]
    assert abs(sum(z) / 4000) < 0.05 and abs(sum(x * x for x in z) / 4000 - 1) < 0.08
    one = spark.createDataFrame([(1, 0.0, 1.0, 10_000_000), (2, None, 1.0, 5)], "k int, m double, s double, n long")
    assert trials.individualise(one, ["k"], "m", "s", "n").count() == 20
    sizes = spark.createDataFrame([([3.0, 70.0],)], "unitSizes array<double>")
    cells = spark.createDataFrame([("a", 4, 100.0), ("b", 5, 100.0), ("c", 5, 700.0)], "k string, geohashSimSize int, n double")
    scaled = sampling.draw_scaled_units(cells, ["k"], "n", sizes, 10.0).orderBy("k", "unit").collect()
    assert {r["pixels"] for r in scaled if r["k"] == "a"} <= {1, 7} and sum(r["pixels"] for r in scaled if r["k"] == "a") >= 10
    assert not [r for r in scaled if r["k"] == "b"] and [(r["num"], r["pixels"]) for r in scaled if r["k"] == "c"] == [(2.0, 1)] * 2
    merged = value(spark, sampling.merge_samples(F.array(F.lit(1.0)), F.array(F.lit(2.0)), F.lit(3), F.lit(1), F.lit("k"), 400))
    assert 0.65 < merged.count(1.0) / 400 < 0.85
    assert [value(spark, sampling.sweep_split(F.lit(y))) for y in (2012, 2013, 2014)] == ["train", "valid", "test"]
    sides = spark.range(300).select(F.concat(F.lit("ab"), (F.col("id") % 10).cast("string"), F.col("id").cast("string")).alias("g")).select(geo.region(F.col("g")).alias("r"), sampling.random_split(geo.region(F.col("g"))).alias("s"))
    assert sides.groupBy("r").agg(F.countDistinct("s").alias("n")).where("n > 1").count() == 0
    assert value(spark, sampling.apply_offset(F.lit("negative"), F.lit(-0.5), F.lit(0.25))) == -0.75 and value(spark, sampling.apply_offset(F.lit("never"), F.lit(0.5), F.lit(0.25))) == 0.5


def test_tasks_and_frame(spark):
    rows = spark.createDataFrame([("a", 2005, 1.0, 0.5, 8), ("a", 2006, 2.0, 0.5, 0), ("b", 2005, 3.0, 0.0, 4)], "geohash string, year int, yieldMean double, yieldStd double, yieldObservations long")
    got = tasks.build_tasks(tasks.copy_projection(rows), tasks.copy_projection(rows.withColumn("year", F.col("year") + 10), late=True), tasks.observation_counts(rows), "2030_SSP245").collect()
    assert sorted((r["geohash"], r["year"], r["numObservations"]) for r in got) == [("a", 2015, 8), ("b", 2015, 4)]
    assert tasks.with_variants(rows, config.THRESHOLDS, config.STD_MULTIPLIERS, config.CELL_SIZES, config.OFFSETS).count() == 24
    assert tasks.std_equivalents(rows, [0.25]).first()["thresholdStd"] == 0.5
    climate = spark.createDataFrame([("a", 2005, 3, "tmax", 20.0, 1.0, 18.0, 22.0, 30), ("z", 2005, 3, "tmax", 20.0, 1.0, 18.0, 22.0, 30)], "geohash string, year int, month int, attr string, mean double, std double, min double, max double, count long")
    yields = rows.select("geohash", "year", F.col("yieldMean").alias("mean"), F.col("yieldStd").alias("std"), F.col("yieldObservations").alias("count"))
    wide = frame.widen(frame.combine(yields, climate))
    assert len(wide.columns) == 488 and wide.count() == 3
    cell = wide.where("geohash = 'a' and year = 2005").first()
    assert cell["tmaxMean3"] == 20 and cell["climateCounts"] == 1 and cell["tmaxMean4"] is None and cell["baselineYieldMean"] == 1.0
    assert [r["geohash"] for r in frame.strays(yields, climate).collect()] == ["z"]
    long = frame.lengthen(wide, ["geohash", "year"], ["tmaxMean3", "yieldMean"])
    same = lambda df: sorted(map(str, df.collect()))
    assert same(frame.own_deltas(long)) == same(frame.field_deltas(long, frame.averages(long)))
    ahead = frame.future_frame(climate).first()
    assert ahead["yieldMean"] == -1 and ahead["tmaxMax3"] == 22
    assert tasks.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6


def test_exact_median(spark):
    import statistics

    for values in ([], [3.0], [1.0, 2.0], [5.0] * 7 + [1.0, 9.0], [float(i * i % 97) for i in range(1000)], [i / 7 for i in range(4001)]):
        rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        assert evaluate.exact_median(rows, "v").first()["median"] == (statistics.median(values) if values else None)


def test_exact_median_of_many(spark):
    """A million distinct values, one value alone, and values of all sizes and signs: nothing is ordered in one task."""
    n = 1_000_001
    many = spark.range(n).select(((F.col("id") * 7919) % n - n // 3).cast("double").alias("a"), F.lit(-2.5).alias("b"), F.when(F.col("id") % 3 == 0, F.pow(F.lit(10.0), (F.col("id") % 600) - 300)).otherwise(-F.col("id") / 3).alias("c"))
    got = evaluate.exact_medians(many, ["a", "b", "c"])
    c = sorted(10.0 ** (i % 600 - 300) if i % 3 == 0 else -i / 3 for i in range(n))[n // 2]
    assert got["a"] == n // 2 - n // 3 and got["b"] == -2.5 and got["c"] == pytest.approx(c, rel=1e-12)
    both = spark.createDataFrame([(-0.0,), (0.0,), (float("-inf"),), (5e-324,)], "v double")
    assert evaluate.exact_medians(both, ["v"]) == {"v": 0.0}
    bits = [r[0] for r in spark.createDataFrame([(v,) for v in (float("-inf"), -3.0, -1e-320, -0.0, 1e-320, 2.0, float("inf"))], "v double").select(evaluate.order_bits(F.col("v"))).collect()]
    assert bits == sorted(bits) and len(set(bits)) == 7


def test_placed_rows(spark):
    rows = spark.createDataFrame([(float(x),) for x in [5, 3, 3, 9, -1, 7] * 50], "v double")
    for n in (1, 7):
        got = sorted((r["at"], r["v"]) for r in sampling.placed_rows(rows.repartition(n), ["v"]).collect())
        assert got == list(enumerate(sorted([5.0, 3, 3, 9, -1, 7] * 50)))
    assert sampling.placed_rows(rows.where("false"), ["v"]).count() == 0
    pool = trials.residual_pool(rows.select((F.col("v") / 3).alias("meanResidual"), F.lit(None).cast("double").alias("stdResidual")))
    assert (pool.mean_count, pool.std_count) == (300, 0)


def test_selection_and_features(spark):
    assert evaluate.feature_columns(["year", "tmaxMean1", "tmaxCount1", "geohash", "yieldMean"], ("year", "geohash"), ("yield",), exclude_counts=True) == ["tmaxMean1"]
    sweep = spark.createDataFrame([("all attrs", 2, 0.0, 0.0, 1, 0.1, 0.1), ("all attrs", 4, 0.1, 0.0, 1, 0.2, 0.1), ("temp", 4, 0.1, 0.0, 1, 0.01, 0.9)], "block string, layers int, l2Reg double, dropout double, allowCount int, validMean double, validStd double")
    assert evaluate.best(sweep, ["layers"]).first()["layers"] == 2 and evaluate.best(evaluate.constrained(sweep), ["layers"]).first()["validMean"] == 0.2
    rows = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"), F.lit(1.0).alias("w"))
    (slope,), intercept = evaluate.fit_linear(rows, ["x"], {"p": "y"}, "w")["p"]
    assert slope == pytest.approx(2, abs=1e-3) and intercept == pytest.approx(1, abs=1e-2)
    scored = evaluate.score(rows, ["x"], lambda pdf: pdf.assign(predictedMean=pdf["x"] * 2, predictedStd=0.5)).where("x = 3").first()
    assert scored["predictedMean"] == 6 and scored["predictedStd"] == 0.5


def test_actuals_and_explorers(spark, tmp_path):
    names = config.BUSINESS_FIELDS
    row = dict.fromkeys(names, "0") | {"commodityYear": "2012", "countyName": "Story ", "stateAbbreviation": "IA", "commodityName": " CORN", "insurancePlanAbbreviation": "RP ", "unitsReportingPrem": "10", "indemnifiedUnits": "4", "lossRatio": "0.5"}
    text = ["|".join(f" {row[n]} " for n in names), "|".join((row | {"commodityName": "WHEAT"})[n] for n in names), "|".join((row | {"unitsReportingPrem": "30", "lossRatio": "1.5", "indemnifiedUnits": "6"})[n] for n in names)]
    (tmp_path / "sob.txt").write_text("\n".join(text))
    rows = actuals.read_scope(tables.read_business(spark, str(tmp_path / "sob.txt")))
    county = actuals.by_county(rows).first()
    assert county["county"] == "Story, IA" and county["units"] == 40 and county["lossRatio"] == 1.25
    yearly = actuals.by_year(actuals.by_county(rows))
    assert yearly.first()["claimsRate"] == 0.25 and actuals.require_years(yearly, [2012])
    with pytest.raises(gates.GateError):
        actuals.require_years(yearly, [2012, 2013])
    sizes = actuals.unit_sizes(spark.createDataFrame([("Corn", "RP", "x", "10"), ("Corn", "RP", "x", "0"), ("Oats", "RP", "x", "9")], "crop string, policyType string, unitType string, acres string"))
    assert sizes.count() == 1 and sizes.first()["coveragePixels"] == pytest.approx(44.965, abs=1e-2)
    edges = explore.edge_histogram(spark.createDataFrame([(10.0,), (20.0,), (9.9,), (20.1,), (15.0,)], "v double"), [], "v").orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in edges] == [(1, 1), (10, 1), (19, 1)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(2001, " a ", 1.5), (2002, "b", None)], "year int, geohash string, mean double")
    tables.write_table(df, f"{tmp_path}/t.csv", ["geohash", "year", "mean"], "csv")
    back = tables.read_csv(spark, f"{tmp_path}/t.csv", "mean double, geohash string, year int")  # by name, not by place
    assert back.columns == ["mean", "geohash", "year"] and sorted((r["year"], r["mean"]) for r in back.collect()) == [(2001, 1.5), (2002, None)]
    for part in (df.where("year = 2001"), df.where("year = 2002")):
        tables.write_table(part, f"{tmp_path}/p", ["geohash", "year", "mean"], partition_by=("year",))
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    tables.write_lines(spark.createDataFrame([(" x ",), ("",), ("y",)], "v string"), f"{tmp_path}/lines")
    assert sorted(r["value"] for r in tables.read_lines(spark, f"{tmp_path}/lines").collect()) == ["x", "y"]
    assert tables.as_record(spark.range(1).select(F.lit(2).alias("b"), F.lit(None).cast("int").alias("a"))).first()["value"] == '{"a":null,"b":2}'
    found = tables.find_inputs(spark.createDataFrame([("s3://x/y_2004.tif",), ("y_2004.tif.aux.xml",), ("readme",)], "path string")).collect()
    assert [(r["path"], r["year"]) for r in found] == [("s3://x/y_2004.tif", 2004)]
    days = tables.manifest(spark.createDataFrame([(2000,)], "year int"), ["RHx", "chirps-v2"], ("observations",), 100)
    names = [r["n"] for r in days.withColumn("n", tables.raster_name(F.col("variable"), F.col("condition"), F.col("date"))).orderBy("variable", "date").collect()]
    assert names[0] == "RHx.2000.01.01.tif" and names[1] == "RHx.2000.04.10.tif" and "chirps-v2.0.2000.01.01.tif" in names and len(names) == 8


def test_merged_states(spark):
    """Any split of the values, merged in any order, gives the summary of all of them."""
    rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 11 > 0, F.exp((F.col("id") * 37 % 101) / 20.0) + 1e6).alias("value"), F.col("id"))
    rows = rows.unionByName(spark.createDataFrame([("one", 5.0, 1), ("flat", 2.0, 1), ("flat", 2.0, 2), ("none", None, 3), (None, 1.0, 4), (None, 3.0, 5), ("one", float("nan"), 6)], "k string, value double, id long"))
    key = lambda r: (r["k"] is None, r["k"])
    want = sorted(distributions.summarize(rows.where("not isnan(value)"), ["k"]).collect(), key=key)
    for parts in (1, 2, 60, 500):
        split = distributions.state(rows.withColumn("part", F.col("id") * 7919 % parts), ["k", "part"])
        blank = spark.createDataFrame([("flat", 0, 0, None)], "k string, part long, n long, mean double")
        split = split.unionByName(blank, allowMissingColumns=True)
        some = distributions.merge_states(split.withColumn("half", F.col("part") % 2), ["k", "half"])
        for merged in (distributions.merge_states(split, ["k"]), distributions.merge_states(some, ["k"])):
            got = sorted(distributions.finish_state(merged, ["k"]).collect(), key=key)
            assert [r["k"] for r in got] == [r["k"] for r in want]
            for a, b in zip(got, want):
                assert a["count"] == b["count"] and (a["min"], a["max"]) == (b["min"], b["max"])
                for c in ("mean", "std", "skew", "kurtosis"):
                    assert (a[c] is None and b[c] is None) or a[c] == pytest.approx(b[c], rel=1e-6, abs=1e-9), (parts, a, b)
    assert distributions.merge_states(split.drop("k"), []).first()["n"] == distributions.state(rows, []).first()["n"]


def test_exact_p(spark):
    """Against the enumeration of all orders, to 1e-12; ties and two large samples have none."""
    from itertools import combinations

    cases = []
    for m, n in ((1, 1), (1, 9), (3, 2), (4, 4), (8, 2), (2, 30), (5, 6)):
        counts = [0] * (m * n + 1)
        for s in combinations(range(m + n), m):
            counts[sum(s) - m * (m - 1) // 2] += 1
        for u in range(m * n + 1):
            cases.append((m, n, float(u), min(1.0, 2 * sum(counts[max(u, m * n - u) :]) / sum(counts))))
    df = spark.createDataFrame(cases, "a long, b long, u double, want double")
    for r in df.withColumn("p", outcomes.exact_p("a", "b", "u", F.lit(False))).collect():
        assert abs(r["p"] - r["want"]) < 1e-12
    none = spark.createDataFrame([(9, 9, 3.0, False), (3, 3, 3.0, True), (0, 3, 0.0, False), (3, 3, None, False), (3, 3, 4.0, None)], "a long, b long, u double, t boolean")
    assert [r["p"] for r in none.withColumn("p", outcomes.exact_p("a", "b", "u", F.col("t"))).collect()] == [None] * 5
    big = spark.createDataFrame([(8, 2000, 8000.0)], "a long, b long, u double").withColumn("p", outcomes.exact_p("a", "b", "u", F.lit(False))).first()
    assert big["p"] == pytest.approx(1.0, abs=1e-3)


def test_gates_in_the_plan(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") >= 6).alias("valid"), F.lit(True).alias("complete"), F.lit(2.0).alias("skew"), F.lit(7.0).alias("kurtosis"))
    back, seen = gates.write_gated(rows.where("id > 0"), f"{tmp_path}/ok", gates.delta_figures(), **(gates.DELTA_LIMITS | {"at_most": {"invalid": 0.06}}))
    assert back.count() == 99 and seen["invalid"] == 5 / 99 and seen["complete"] == seen["normal"] == 1
    with pytest.raises(gates.GateError):
        gates.write_gated(rows, f"{tmp_path}/bad", gates.delta_figures(), **gates.DELTA_LIMITS)
    assert not (tmp_path / "bad").exists()
    empty, seen = gates.write_gated(rows.where("false"), f"{tmp_path}/none", gates.delta_figures(), **gates.DELTA_LIMITS)
    assert empty.count() == 0 and seen["invalid"] is None
    assert gates.unique_rows(rows, ["id"]).count() == 100
    with pytest.raises(Exception, match="repeated key"):
        gates.unique_rows(rows.unionByName(rows.limit(1)), ["id"]).count()
    with pytest.raises(Exception, match="too small"):
        gates.enforce(rows, F.col("id") > 0, "too small").count()
    got = gates.report(rows.unionByName(rows.limit(1)), ["id"]).first()
    assert got["rows"] == 101 and got["repeated"] == 1 and got["missing"] == 0 and gates.report(rows.where("false"), ["id"]).first()["rows"] == 0


def test_stored_layouts(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("a"), (F.col("id") % 20).cast("string")).alias("geohash"), F.col("id").alias("v")).withColumn("geohash", F.concat(F.substring(F.lit("pqrstuvwxyz"), (F.col("v") % 10 + 1).cast("int"), F.lit(1)), "geohash"))
    tables.write_by_region(rows, f"{tmp_path}/t", length=1)
    stored = spark.read.parquet(f"{tmp_path}/t")
    spark.createDataFrame([("pa0", 9), ("pa10", 9), ("qa1", 1)], "geohash string, rank int").write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells").where("rank > 5").withColumn("region", F.substring("geohash", 1, 1))
    few = frame.restrict(stored, cells, region="region")
    plan = few._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and few.count() == 40
    assert frame.restrict(stored, cells).count() == 40
    for year, name in ((1999, "y_1999.csv"), (2000, "y_2000.csv"), (2001, "y_2001.csv.aux.xml"), (0, "readme.csv")):
        (tmp_path / "in" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "deep" / name).write_text(f"a,b\n{year},x\n{year + 1},\n")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in tables.list_files(spark, f"{tmp_path}/in", "*.csv").collect()) == ["readme.csv", "y_1999.csv", "y_2000.csv"]
    found = tables.read_found(spark, f"{tmp_path}/in", "a int, b string", r"y_(\d{4})")
    assert {(r["a"], r["b"], r["year"]) for r in found.collect()} == {(1999, "x", 1999), (2000, None, 1999), (2000, "x", 2000), (2001, None, 2000)}
    tables.write_record(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/r")
    assert tables.read_record(spark, f"{tmp_path}/r", "a int, b string, c int").first().asDict() == {"a": 1, "b": None, "c": None}
    tables.write_lines(spark.createDataFrame([("no json",)], "v string"), f"{tmp_path}/bad")
    with pytest.raises(Exception):
        tables.read_record(spark, f"{tmp_path}/bad", "a int").collect()
    both = tables.union_years([spark.range(1).withColumn("x", F.lit(1)), spark.range(1).withColumn("y", F.lit(2))])
    assert sorted(both.columns) == ["id", "x", "y"] and both.count() == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_stay_with_their_units(spark, monkeypatch):
    """No draw is shuffled, and a pool in several blocks gives what it gives whole and what a plain version makes of each draw."""
    rng = random.Random(3)
    pool_rows = [(rng.gauss(0, 0.1), rng.gauss(0, 0.05)) for _ in range(40)] + [(0.02, None)]
    pool = trials.residual_pool(spark.createDataFrame(pool_rows, "meanResidual double, stdResidual double"))
    means, stds = sorted(round(m, 9) for m, _ in pool_rows), sorted(round(s, 9) for _, s in pool_rows if s is not None)
    rows = [("a", 0.25, u, p, 1.5, o, om, 0.2, -0.1, 0.3) for u, p, o, om in ((1, 1, "always", 0.1), (2, 7, "never", 0.1), (3, 3, "negative", -0.2), (4, 0, "always", 0.1))] + [("b", 0.15, 1, 40, 1.0, "always", 0.0, 0.1, 0.2, None)]
    units = spark.createDataFrame(rows, "k string, level double, unit int, pixels int, stdMult double, offsetBaseline string, originalYieldMean double, originalYieldStd double, projectedYieldMean double, projectedYieldStd double")

    def plain(k, level, unit, pixels, mult, offset, om, os_, pm, ps):
        def draws(kind, n, m, s):
            for i in range(1, n + 1):
                w = [int(hashlib.md5(f"trial|{k}|{level}|{unit}|{kind}|{i}".encode()).hexdigest()[8 * j : 8 * j + 8], 16) for j in range(4)]
                r, turn = math.sqrt(-2 * math.log((w[0] + 0.5) / 2**32)), (w[1] + 0.5) / 2**32 * 2 * math.pi
                m_, s_ = m - means[w[2] % len(means)], s * mult - stds[w[3] % len(stds)]
                yield m_ + s_ * r * math.cos(turn), m_ + s_ + s_ * r * math.sin(turn)

        pixel = list(draws("pixel", pixels, pm, ps)) if ps is not None else []
        less = [sum(x for x, _ in draws(kind, 10, om, os_)) / 10 if offset == "always" or offset == "negative" and om < 0 else 0 for kind in ("history", "adaptedHistory")]
        return [max(-1.0, sum(x[j] for x in pixel) / len(pixel) - less[j]) if pixel else -1.0 for j in (0, 1)]

    want = {(r[0], r[2]): plain(*r) for r in rows}
    for block, step in ((1 << 22, 200_000), (7, 30)):
        monkeypatch.setattr(trials, "BLOCK", block)
        monkeypatch.setattr(trials, "STEP", step)
        out = trials.simulate_units(units.repartition(2), ["k", "level"], pool)
        got = {(r["k"], r["unit"]): [r["predicted"], r["adapted"]] for r in out.collect()}
        assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], abs=1e-12) for u in want)
    plan = plan_of(trials.simulate_units(units.coalesce(1), ["k", "level"], pool))
    assert "Exchange" not in plan and "Join" not in plan


def test_units_are_shuffled_once(spark):
    """Their tasks are dealt before units are made of them, and outcomes deal a row for each unit, not one for each delta."""
    sizes = spark.createDataFrame([([3.0, 70.0],)], "unitSizes array<double>")
    cells = spark.createDataFrame([("a", 0.25, 4, 100.0)], "k string, level double, geohashSimSize int, n double")
    units = sampling.draw_scaled_units(cells, ["k", "level"], "n", sizes, 10.0)
    plan = plan_of(units)
    assert plan.count(" Exchange ") == 1 and plan.index("Generate explode") < plan.index(" Exchange ")
    deltas = cells.select("k", "level", F.lit(0.1).alias("std"), *[F.rand(k).alias(n) for k, n in enumerate(outcomes.KINDS)])
    plan = plan_of(outcomes.trial_outcomes(deltas, ["k", "level"], "level", "std"))
    assert plan.count(" Exchange ") == 1 and plan.index("Generate explode(array(struct") < plan.index(" Exchange ")
