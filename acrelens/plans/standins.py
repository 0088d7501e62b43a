"""Domain tables derived from the given star schema, by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

POINTS = """SELECT CAST(s_suppkey AS STRING) AS k, CAST((s_suppkey * 7919) % 3600 AS DOUBLE) / 10e0 - 180e0 AS lon,
CAST((s_suppkey * 104729) % 1800 AS DOUBLE) / 10e0 - 90e0 AS lat FROM {supplier}"""
PIXELS = """SELECT CAST(l_suppkey AS STRING) AS geohash, CASE l_returnflag WHEN 'A' THEN 'tmax' WHEN 'N' THEN 'rhx' ELSE 'chirps' END AS attr,
CASE WHEN l_linestatus = 'F' THEN 'observations' ELSE '2050_SSP245' END AS condition, CAST(l_shipdate AS DATE) AS date,
CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, l_quantity AS value FROM {lineitem}"""
YIELD_PIXELS = """SELECT CAST(l_suppkey AS STRING) AS geohash, CAST(year(l_shipdate) AS INT) AS year, l_linestatus AS part,
l_extendedprice / 997e0 AS value, l_orderkey * 10 + l_linenumber AS id FROM {lineitem}"""
OUTCOMES = """SELECT CAST(o_custkey % 500 AS STRING) AS geohash, CAST(year(o_orderdate) AS INT) AS year,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '2030' WHEN '2' THEN '2030_counterfactual' WHEN '3' THEN '2050' WHEN '4' THEN '2050_counterfactual' ELSE 'historic' END AS series,
CASE WHEN o_orderkey % 2 = 0 THEN 25e-2 ELSE 15e-2 END AS threshold, CASE WHEN o_orderkey % 2 = 0 THEN 15e-1 ELSE 9e-1 END AS thresholdStd, 1e0 AS stdMult,
CAST(CASE WHEN CAST(floor(o_orderkey / 2e0) AS BIGINT) % 2 = 0 THEN 4 ELSE 5 END AS INT) AS geohashSimSize,
CASE WHEN CAST(floor(o_orderkey / 4e0) AS BIGINT) % 2 = 0 THEN 'always' ELSE 'never' END AS offsetBaseline,
CAST(1 + o_orderkey % 97 AS DOUBLE) AS num, (o_totalprice - 250000e0) / 523457e0 AS predictedChange, o_totalprice / 523457e0 AS predictedClaims,
o_totalprice / 611953e0 AS predictedClaimsStd, CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE -o_totalprice / 1000003e0 END AS predictedLoss,
CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 100000e0 AS p, 8e0 AS unitSize, o_orderkey AS id FROM {orders}"""
DELTAS = """SELECT CAST(l_suppkey AS STRING) AS geohash, l_linestatus AS sample, l_quantity AS value, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS id FROM {lineitem}"""
PREDICTIONS = """SELECT CAST(p_size % 6 AS INT) AS config, CAST(year(l_shipdate) AS INT) AS year, l_discount AS predicted, l_tax AS actual, l_discount / 2e0 AS predictedStd, l_tax / 3e0 AS actualStd, l_quantity AS weight
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
SWEEP = """SELECT CASE WHEN p_partkey % 4 = 0 THEN 'temp' ELSE 'all attrs' END AS block, CAST(1 + p_size % 6 AS INT) AS layers, CAST(p_partkey % 5 AS DOUBLE) * 5e-2 AS l2Reg, CAST(p_partkey % 3 AS DOUBLE) / 10e0 AS dropout,
CAST(p_partkey % 2 AS INT) AS allowCount, p_retailprice / 10007e0 AS validMean, CAST(p_size AS DOUBLE) / 100e0 AS validStd, p_partkey AS id FROM {part}"""
UNITS = """SELECT CASE WHEN p_size % 7 = 0 THEN 'Soybeans' ELSE 'Corn' END AS crop, CASE p_partkey % 3 WHEN 0 THEN 'YP' WHEN 1 THEN 'RP' ELSE 'APH' END AS policyType,
CASE WHEN p_size < 20 THEN 'OU' ELSE 'EU' END AS unitType, CASE WHEN p_size % 11 = 0 THEN 0e0 ELSE CAST(p_size AS DOUBLE) / 10e0 END AS acres FROM {part}"""
BUSINESS = """SELECT CAST(year(o_orderdate) AS INT) AS year, n_name || ', ' || c_mktsegment AS county, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'RP' WHEN '2' THEN 'YP' ELSE 'APH' END AS program,
CAST(o_orderkey % 50 AS DOUBLE) AS units, floor(CAST(o_orderkey % 50 AS DOUBLE) / 4e0) AS indemnified, o_totalprice / 250007e0 AS lossRatio
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE substr(o_orderpriority, 1, 1) <> '5'"""


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A stand-in as a DataFrame; only the tables that it names are read."""
    return spark.sql(sql, **{t: given(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def finish(df: DataFrame, columns: str) -> DataFrame:
    """The columns in their order; those with a ! are rounded, so that sums in another order compare equal."""
    return df.select(*[(F.round(F.col(f"`{c[:-1]}`"), 5) + 0.0).alias(c[:-1]) if c.endswith("!") else F.col(f"`{c}`") for c in columns.split()])


def finish_sql(sql: str, columns: str) -> str:
    cols = ", ".join(f'round("{c[:-1]}", 5) + 0.0::DOUBLE AS "{c[:-1]}"' if c.endswith("!") else f'"{c}"' for c in columns.split())
    with_part, _, body = sql.rpartition("\n--\n")
    return f"{with_part}\nSELECT {cols} FROM (\n{body}\n)"
