"""Mixing sources to target weights by hash-threshold histograms.

Each source's target is met by whole copies of all its documents plus one more copy of those whose hash
lies under a threshold. The threshold comes from a histogram of words by (source, leading hash bits); only
the boundary bucket is looked at again by its next bits, until it is one hash value. Nothing is sorted.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.llm.shared import settle, table

BITS, STEP = 48, 12  # bits of the hash, and bits that a level of the histogram looks at


def word_count(text) -> F.Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, cap: int = 3) -> dict:
    """Share sum(sizes) by weight; no target is above cap times its source's size, the excess is shared again by weight.

    Sources are met in the order in which they would reach their caps; sources of size 0 get 0.
    """
    out, left, weight = {k: 0.0 for k in sizes}, sum(sizes.values()), sum(weights[k] for k, v in sizes.items() if v > 0)
    order = sorted((k for k, v in sizes.items() if v > 0), key=lambda k: Fraction(sizes[k], weights[k]))
    for i, k in enumerate(order):
        if cap * sizes[k] * weight < left * weights[k]:
            out[k], left, weight = float(cap * sizes[k]), left - cap * sizes[k], weight - weights[k]
        else:
            unit = left / weight
            return out | {s: weights[s] * unit for s in order[i:]}
    return out


def mix(rows: DataFrame, key: F.Column, cycle: tuple = (1, 2, 3), cap: int = 3, rounds: int = 3) -> DataFrame:
    """Add source_size, target, copies and taken to `rows` (source string, size long, any other columns; of these names, they give way).

    Sources by code point, null last, weigh `cycle` in turn. `key` is a string whose md5 decides, with no
    other state, so reruns agree; documents with equal keys and sizes in a source are taken together. Within
    a source the documents of the smallest hashes get one copy more than the others, up to the last hash at
    which the words taken don't exceed the target. So that one long document at that boundary leaves no
    gap, further rounds fill it in the same way from the documents above the boundary of which none
    has over a quarter of the gap. A source of size 0 has target 0 and takes nothing. No document has more
    than `cap` copies. Only sums by source, and by source and hash bucket of the boundary, reach the driver;
    their number depends on the sources, not on the rows.
    """
    spark, plain = rows.sparkSession, [c for c in rows.columns if c not in ("source_size", "target", "copies", "taken")]
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), "source", "size", key.alias("_key"))
    rows = rows.withColumn("_h", F.conv(F.substring(F.md5("_key"), 1, BITS // 4), 16, 10).cast("long"))
    slim = settle(rows.groupBy("source", "_h", "size").agg(F.sum("size").alias("n")), "mix")
    sizes = {r["source"]: int(r["n"] or 0) for r in slim.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    want = targets(sizes, {s: cycle[i % len(cycle)] for i, s in enumerate(order)}, cap)
    base = {s: min(cap, int(want[s] // sizes[s])) if sizes[s] else 0 for s in order}
    gap = {s: want[s] - base[s] * sizes[s] for s in order}  # words still to take by one more copy
    cuts: list[tuple] = []  # a copy more for hashes in [from, to) and sizes of at most
    start = {s: 0 for s in order}
    for k in range(rounds):
        most = {s: gap[s] / 4 if k else float(sizes[s]) for s in order}
        ends = _boundaries(slim, {s: (start[s], most[s], gap[s]) for s in order if base[s] < cap and gap[s] > 0})
        for s, (end, taken) in ends.items():
            cuts.append((s, start[s], end, most[s]))
            start[s], gap[s] = end, gap[s] - taken
    plan = spark.createDataFrame(
        [(s, sizes[s], float(want[s]), base[s], [c[1:] for c in cuts if c[0] == s]) for s in order],
        "_s string, source_size long, target double, _base int, _cuts array<struct<lo: long, hi: long, most: double>>",
    )
    out = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_s")))
    more = F.exists("_cuts", lambda c: (F.col("_h") >= c["lo"]) & (F.col("_h") < c["hi"]) & (F.col("size") <= c["most"]))
    out = out.withColumn("copies", F.col("_base") + more.cast("int"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col(f"_row.`{c}`") for c in plain], "source_size", "target", "copies", "taken")


def _boundaries(slim: DataFrame, ask: dict) -> dict:
    """For each source of `ask` (start, most, gap): the hash below which the rows from start on, none larger than most, hold at most gap words; and how many they hold."""
    spark, prefix, taken = slim.sparkSession, {s: 0 for s in ask}, {s: 0 for s in ask}
    ends = {s: start for s, (start, _, _) in ask.items()}
    open_ = set(ask)
    for level in range(BITS // STEP):
        if not open_:
            break
        down = BITS - STEP * (level + 1)
        edge = spark.createDataFrame([(s, prefix[s], *map(float, ask[s][1:2]), ask[s][0]) for s in open_], "_s string, _p long, _most double, _start long")
        inside = slim.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("_s")))
        inside = inside.where((F.shiftright("_h", down + STEP) == F.col("_p")) & (F.col("_h") >= F.col("_start")) & (F.col("size") <= F.col("_most")))
        seen: dict = {s: [] for s in open_}
        for r in inside.groupBy("source", F.shiftright("_h", down).alias("b")).agg(F.sum("n").alias("n")).collect():
            seen[r["source"]].append((r["b"], int(r["n"])))
        for s in list(open_):
            for b, n in sorted(seen[s]):
                if taken[s] + n > ask[s][2]:
                    prefix[s] = b
                    break
                taken[s], ends[s] = taken[s] + n, (b + 1) << down
            else:  # all of the rows fit
                ends[s] = 1 << BITS
                open_.discard(s)
    return {s: (ends[s], taken[s]) for s in ask}


def key_of(doc_id) -> F.Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix(settle(docs, "sizes"), key_of("doc_id"))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"))


def _round_sql(k: int, before: str) -> str:
    """DuckDB SQL of a round of the threshold: rows below the hash bound of round k, and the gap that it leaves."""
    most = "t.gap / 4" if k > 1 else "1e300"
    return f"""
c{k} AS (SELECT d.source, d.h, d.size, t.gap, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS cum
  FROM h d JOIN {before} t ON d.source IS NOT DISTINCT FROM t.source WHERE t.base < 3 AND t.gap > 0 AND d.h >= t.start AND d.size <= {most}),
t{k} AS (SELECT t.* EXCLUDE (gap, start), t.gap - coalesce(e.taken, 0) AS gap, {most} AS most{k}, t.start AS lo{k},
    CASE WHEN t.base < 3 AND t.gap > 0 THEN coalesce(e.stop, {1 << BITS}) ELSE t.start END AS start,
    CASE WHEN t.base < 3 AND t.gap > 0 THEN coalesce(e.stop, {1 << BITS}) ELSE t.start END AS hi{k}
  FROM {before} t LEFT JOIN (SELECT source, max(cum) FILTER (cum <= gap) AS taken, min(h) FILTER (cum > gap) AS stop FROM c{k} GROUP BY source) e
  ON t.source IS NOT DISTINCT FROM e.source)"""


ORACLE_SQL = f"""
WITH h AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM h GROUP BY source),
r AS (SELECT *, sum(size) OVER () AS total, sum(w) OVER () AS weights, 3 * size::DOUBLE / w AS ratio FROM s WHERE size > 0),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k FROM r),
u AS (SELECT *, coalesce(sum(3 * size) OVER p, 0) AS capped, coalesce(sum(w) OVER p, 0) AS gone FROM o WINDOW p AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT CAST(total - capped AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS unit FROM u WHERE 3 * size * (weights - gone) >= (total - capped) * w ORDER BY k LIMIT 1),
t AS (SELECT s.source, s.size AS source_size, CASE WHEN s.size = 0 THEN 0.0::DOUBLE WHEN 3 * s.size < coalesce(unit, 1e300) * w THEN 3.0::DOUBLE * s.size ELSE unit * w END AS target FROM s LEFT JOIN f ON true),
t0 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)) END AS base, 0::BIGINT AS start,
    target - CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)) END * source_size AS gap FROM t),
{_round_sql(1, "t0")},
{_round_sql(2, "t1")},
{_round_sql(3, "t2")}
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(d.size * (t.base + CASE WHEN (d.h >= lo1 AND d.h < hi1) OR (d.h >= lo2 AND d.h < hi2 AND d.size <= most2)
    OR (d.h >= lo3 AND d.h < hi3 AND d.size <= most3) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM h d JOIN t3 t ON d.source IS NOT DISTINCT FROM t.source
"""
