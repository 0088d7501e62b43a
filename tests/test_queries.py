"""Queries of the driver's contract against their SQL, on the smallest tables."""

import datetime
import hashlib
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from acrelens.operators import frame
from acrelens.plans import results, training
from acrelens.plans.standins import TABLES, YIELD_PIXELS, view
from acrelens.sources import tables

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10]
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(n for n in entry.OWN if entry.OWN[n][2]))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: [(v is None, str(v)) for v in r]
    got = sorted(([plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in want.columns]).collect()), key=key)
    assert got == sorted(([plain(v) for v in r] for r in want.fetchall()), key=key) and got


def test_every_query_has_sql(spark):
    assert not [n for n in entry.OWN if not entry.OWN[n][2]]
    draws = lambda: sorted(map(str, entry.queries()["single_observations"](spark, SMALL).collect()))
    assert draws() == draws() != []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_fields_of_the_frame(spark):
    wide = frame.widen(training.long_frame(spark, SMALL)).toPandas()
    names = [c for c in wide.columns if c not in ("geohash", "year", "climateCounts", "yieldObservations")]
    assert len(names) == 484
    long = wide.melt(["geohash", "year"], names, "field").astype({"value": float}).dropna()
    assert {"chirpsMean7", "chirpsCount12", "tmaxStd9"} <= set(long["field"])
    run = lambda name: entry.queries()[name](spark, SMALL).toPandas()
    same = lambda got, want: pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False, atol=2e-5)
    every = wide.melt(["geohash", "year"], [*names, "climateCounts", "yieldObservations"], "field").astype({"value": float}).dropna()
    same(run("historic_averages_all").set_index(["geohash", "field"])["mean"], every.groupby(["geohash", "field"])["value"].mean())
    di, by = run("field_distributions_all").set_index("field"), long.groupby("field")["value"]
    same(di["mean"], by.mean())
    same(di["std"], by.std())
    own = long[~long["field"].str.contains("count", case=False) & ~long["field"].str.contains("yield", case=False)]
    less = own["value"] - own.groupby(["geohash", "field"])["value"].transform("mean")
    same(run("field_deltas_all").set_index(["geohash", "year", "field"])["value"], less.set_axis(pd.MultiIndex.from_frame(own[["geohash", "year", "field"]])))
    z = run("z_scores_all")
    assert (z["z"] == -999).any()
    z = z[z["z"] != -999]
    assert set(z["field"]) > set(training._SLICE) and not z.duplicated(["geohash", "year", "field"]).any()
    both = z.merge(long.assign(z0=(long["value"] - by.transform("mean")) / by.transform("std")), on=["geohash", "year", "field"])
    assert len(both) == len(z) == long["field"].map(by.std() > 0).sum() and (both["z"] - both["z0"]).abs().max() < 2e-5


def test_all_draws_of_yields(spark):
    rows = view(spark, SMALL, YIELD_PIXELS).toPandas()
    rows["part"] = [int(hashlib.md5(f"part|{i}".encode()).hexdigest()[:8], 16) % 64 for i in rows["id"]]
    rows = rows.sort_values(["part", "id", "value"])
    pools = {k: g["value"].tolist() for k, g in rows.groupby(["geohash", "year"])}
    at = lambda g, y, i: int(hashlib.md5(f"draw|{g}|{y}|{i}".encode()).hexdigest()[:8], 16)
    want = sorted((g, y, i, round(float(v[at(g, y, i) % len(v)]), 5)) for (g, y), v in pools.items() for i in range(1, 1001))
    got = entry.queries()["yield_draws_all"](spark, SMALL).toPandas()
    assert sorted(map(tuple, got.astype({"value": float}).itertuples(index=False))) == want


def test_yields_are_summed_up_before_they_are_shuffled(spark):
    plan = results.relative(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "partial_avg" in plan[plan.rindex(" Exchange ") :] and "Join" not in plan


def test_simulated_units_are_stored_narrowly_and_go(spark, monkeypatch):
    seen = {}

    def stored(df, tag, own=tables.stored):
        out = seen[tag] = own(df, tag)
        return out

    monkeypatch.setattr(tables, "stored", stored)
    assert entry.queries()["exported_simulation"](spark, SMALL).count() > 0
    assert set(seen["units"].columns) == {"label", "series", "geohash", "year", "threshold", "geohashSimSize", "offsetBaseline", "stdLevel", "stdMult", "predicted", "baseline", "adapted"}
    assert not os.path.exists(seen["units"].stored_at.removeprefix("file://"))
