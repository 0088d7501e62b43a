"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is cut into segments. If two fingerprints differ in at most `radius` bits, then by
the pigeonhole rule some segment differs in only a few; so every fingerprint is tabled under its exact
segments, and every fingerprint probes the small Hamming ball around each of its segments. What a probe
fetches is verified on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.llm.shared import components, discard, settle, table

PIECE = 1 << 15  # shingles that are hashed at a time


def fingerprint_text(text: str | None, width: int = 4) -> int:
    """Unsigned SimHash of one text, see fingerprints()."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only \x20 \x09-\x0D split
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        cut = zip(starts[at : min(n, at + PIECE)].tolist(), stops[at : at + PIECE].tolist())
        h = np.array([digest(joined[i:j], 42) for i, j in cut], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", width: int = 4) -> DataFrame:
    """Add `out`, the SimHash of the text as a signed long.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; shingles are `width` words
    joined by one space, repeats included. A text with fewer words is one shingle; without words, or null,
    it has the fingerprint 0. A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
    """

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_text(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text_col)))


def segments(count: int, radius: int) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, ball radius) of each segment.

    With radius = count * s + a, two fingerprints within radius differ by at most s bits in one of the
    first a + 1 segments or by at most s - 1 in one of the others.
    """
    s, a = divmod(radius, count)
    cuts = [64 * i // count for i in range(count + 1)]
    return [(lo, hi - lo, s if i <= a else s - 1) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if i <= a or s > 0]


def _key(fp: Column, i: int, lo: int, bits: int) -> Column:
    """Segment i of a fingerprint, with i above its bits so that segments never meet."""
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(i << 56))


def _ball(bits: int, radius: int) -> list[int]:
    """The masks of at most `radius` bits out of `bits`."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | 1 << j for m in masks for j in range(bits)}
    return sorted(masks)


def near_links(fps: DataFrame, radius: int = 4, count: int = 3) -> DataFrame:
    """Links (a, b) between rows of `fps` (fp long, distinct; id long) that give the components at `radius`.

    Every link is verified on all bits. Links inside a component that an earlier step has closed are left
    out, so that a dense group of n near copies costs a few n links and not n squared:
    first each fingerprint is compared with the smallest in its exact bucket, then all probes run but
    fetch only from other components. Nothing is capped.
    """
    parts = list(enumerate(segments(count, radius)))
    keys = F.explode(F.array(*[_key(F.col("fp"), i, lo, bits) for i, (lo, bits, _) in parts])).alias("key")
    tabled = fps.select("fp", "id", keys)
    heads = tabled.groupBy("key").agg(F.min(F.struct("id", "fp")).alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    star = tabled.join(heads, "key").where((F.col("id") != F.col("head.id")) & close(F.col("fp"), F.col("head.fp")))
    star = settle(star.select(F.col("id").alias("a"), F.col("head.id").alias("b")).distinct(), "star")
    known = components(star)
    labelled = fps.join(known.withColumnRenamed("node", "id"), "id", "left").select("fp", "id", F.coalesce("component", "id").alias("c"))
    labelled = settle(labelled, "labelled")
    at = F.explode(F.array(*[F.struct(_key(F.col("fp"), i, lo, bits).alias("key")) for i, (lo, bits, _) in parts])).alias("k")
    right = labelled.select(at, F.col("fp").alias("fp2"), F.col("c").alias("c2")).select("k.key", "fp2", "c2")
    probes = [_key(F.col("fp"), i, lo, bits).bitwiseXOR(F.lit(m)) for i, (lo, bits, r) in parts for m in _ball(bits, r)]
    left = labelled.select("fp", "c", F.explode(F.array(*probes)).alias("key"))
    found = left.join(right, "key").where((F.col("c") < F.col("c2")) & close(F.col("fp"), F.col("fp2")))
    out = star.unionByName(found.select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct())
    out.reads = (star, labelled)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, count: int = 3) -> DataFrame:
    """One row per row of `docs`: its id, fp, component_id, the smallest id reachable over links, and class, the smallest
    fingerprint reachable.

    Documents link if their fingerprints differ in at most `radius` bits; texts without words link with each
    other like any others (fingerprint 0). Rows with equal fingerprints are one node, so copies cost nothing;
    a null id keeps its row, links like others and gets its component, whose component_id is null if all its ids are. Extra
    columns are ignored. An empty table gives no rows.
    `count` is the number of segments: more make fewer probes but larger buckets (3 suits up to some 10^8
    distinct fingerprints, 2 more).
    """
    rows = settle(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), "t").drop("t"), "fps")
    fps = settle(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    links = near_links(fps.select("fp", F.col("fp").alias("id")), radius, count)
    known = components(links)
    for used in links.reads:
        discard(used)
    named = fps.join(known.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    # most classes are one fingerprint; those of more are met again by their class
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "class"), "fp").join(least, "class").select(F.col("id").alias(id_col), "fp", "component_id", "class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """The rows of `docs` of which one stays for each component: the row whose id is the component's.

    Of rows that repeat an id in one component, that with the smallest text stays; an id with texts in several components is
    looked at in each. Rows with a null id can't be told apart and all stay. Only rows of repeated ids are shuffled
    with their texts.
    """
    found = near_duplicates(docs, id_col, text_col, radius).where(F.col(id_col).isNotNull()).withColumn("_stays", F.col("component_id") == F.col(id_col))
    found = settle(found.select(id_col, "fp", "class", "_stays"), "found")
    ids = found.groupBy(id_col).agg(F.count("*").alias("_n"), F.bool_or("_stays").alias("_any"))
    ids = settle(ids.where("_n > 1 or not _any"), "gone")  # of most documents nothing is here
    # merge: the same plan at every size; AQE splits its hot keys
    once = docs.join(ids.select(id_col).hint("merge"), id_col, "left_anti")
    more = docs.join(ids.where("_n > 1 and _any").select(id_col), id_col, "left_semi").select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    more = fingerprints(more, "_t", "_fp")
    stay = found.where("_stays").select(F.col(id_col).alias("_id"), F.col("fp").alias("_fp"), F.col("class").alias("_class")).distinct()
    more = more.join(stay, ["_id", "_fp"]).groupBy("_id", "_class").agg(F.min_by("row", F.struct(F.col("_t").isNull(), "_t")).alias("row")).select("row.*")
    return once.unionByName(more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
