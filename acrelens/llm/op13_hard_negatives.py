"""Hard negatives: for each anchor and positive, rows of other labels that score nearly as high as the positive.

Scores are integers. They are multiplied modulo several small primes, in float32, where every product and sum is
exact, and put together by Chinese remaindering. Anchors meet all rows in blocks, twice: once for the positives, once for
the negatives in each positive's window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelens.llm.shared import settle, table

PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199)  # their product passes 2^64
STRIDE = 1024  # summed at once: 1024 products of residues up to 125 stay below 2^24, so float32 holds them exactly
LIMIT = 1 << 60  # of a row's squared norm, so that five times a score fits 64 bits
LEAST = np.iinfo(np.int64).min


def primes_for(bound: int) -> tuple[int, ...]:
    """As many primes as tell all integers of at most `bound` in size apart, with room to tell their sign."""
    product, out = 1, []
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > 4 * bound + 4:
            return tuple(out)
    raise ValueError("scores are too large")


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """v modulo p as float32, moved to -(p-1)/2 .. (p-1)/2."""
    half = (p - 1) // 2
    return ((v + half) % p - half).astype(np.float32)


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, of residues; the sums are cut so that each is exact."""
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], STRIDE):
        out += (a[:, at : at + STRIDE] @ b[:, at : at + STRIDE].T).astype(np.int64)
    return out % p


def reconstruct(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed integers whose residues are `parts`: mixed-radix digits, summed modulo 2^64; a fraction of the product above one half is negative."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        d = parts[i]
        for j in range(i):
            d = (d - digits[j]) * pow(primes[j], -1, p) % p
        digits.append(d)
    value, share, unit, product = np.zeros(parts[0].shape, np.uint64), np.zeros(parts[0].shape), 1, 1
    for p in primes:
        product *= p
    for d, p in zip(digits, primes):
        value += d.astype(np.uint64) * np.uint64(unit % (1 << 64))
        share += d * (unit / product)
        unit *= p
    return np.where(share > 0.5, value - np.uint64(product % (1 << 64)), value).view(np.int64)


def exact_scores(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """All inner products of the integer rows of a and b."""
    return reconstruct([product_modulo(residues(a, p), residues(b, p), p) for p in primes], primes)


def first(scores: np.ndarray, open_: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of the open scores in each row, ties to smaller ids; fewer where fewer are open."""
    s = np.where(open_, scores, LEAST)
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        open_ = open_ & (s >= least[:, None])
    at, col = np.nonzero(open_)
    order = np.lexsort((ids[col], -scores[at, col], at))
    at, col = at[order], col[order]
    place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
    return at[place < k], col[place < k]


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _slices(anchors: pd.DataFrame, rows: pd.DataFrame, cells: int = 1 << 20):
    """Exact scores of a few anchors at a time with all rows of the block."""
    a, b = _matrix(anchors["v"]), _matrix(rows["v"])
    norm = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(1).max())
    primes = primes_for(int(norm(a) * norm(b) * (1 + 1e-9)) + 1)
    right = [residues(b, p) for p in primes]
    step = max(1, cells // len(b))
    for at in range(0, len(a), step):
        left = a[at : at + step]
        yield anchors.iloc[at : at + step], reconstruct([product_modulo(residues(left, p), r, p) for p, r in zip(primes, right)], primes)


def _positives(k: int):
    """The k best rows of an anchor's label in a block."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            ids, label, key = (rows[c].to_numpy() for c in ("id", "label", "row"))
            for part, scores in _slices(anchors, rows):
                open_ = (part["label"].to_numpy()[:, None] == label) & (part["row"].to_numpy()[:, None] != key)
                at, col = first(scores, open_, ids, k)
                out.append(pd.DataFrame({"row": part["row"].to_numpy()[at], "positive_id": ids[col], "positive_score": scores[at, col]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "positive_id": [], "positive_score": []}, dtype=np.int64)

    return run


def _negatives(k: int, window: tuple[int, int]):
    """The k best rows of other labels in the window of each of an anchor's positives, in a block."""
    low, high = window

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            ids, label = rows["id"].to_numpy(), rows["label"].to_numpy()
            for part, scores in _slices(anchors, rows):
                other = part["label"].to_numpy()[:, None] != label
                tops = part["positives"].to_list()
                for j in range(max(map(len, tops))):
                    mine = np.flatnonzero([len(t) > j for t in tops])
                    top = np.array([tops[i][j] for i in mine], np.int64)[:, None]
                    s = scores[mine]
                    open_ = other[mine] & (s <= top) & (low * top <= high * s)
                    hit = open_.any(1)
                    at, col = first(s[hit], open_[hit], ids, k)
                    at = np.flatnonzero(hit)[at]
                    out.append(pd.DataFrame({"row": part["row"].to_numpy()[mine[at]], "place": j + 1, "negative_id": ids[col], "negative_score": s[at, col]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "place": [], "negative_id": [], "negative_score": []}, dtype=np.int64)

    return run


def mine(vectors: DataFrame, is_anchor: F.Column, label: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (4, 5), block: int = 1 << 22) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    A component x becomes floor(scale x); a score is the integer inner product with the anchor; higher ones come first, ties by smaller id. An
    anchor's positives are its first `positives` other rows of the same label; of rows with other labels the first `negatives` with
    window[0] / window[1] of the positive's score, up to all of it, are returned. Fewer where there are fewer.

    Rows take no part whose label, id or vector is null, that hold a null or non-finite component, or whose scaled squared norm reaches 2^60 (their
    scores might not fit 64 bits). Zero and empty vectors take part; only vectors of equal length meet. Rows that repeat
    an id, or all columns, are rows of their own, as anchors, positives and negatives. Empty tables give no rows. Columns with other
    names aren't read.

    Rows are dealt by hash into blocks of `block` components, anchors into as large ones, and each pair of blocks meets in one task, so
    hot labels and copies weigh nothing. Rows move once for each block of anchors, anchors once for each block of rows:
    2 n a / b vectors for n rows, a anchors and b rows in a block, far less than the n a products themselves.
    """
    spark = vectors.sparkSession
    x = F.col(vec_col).cast("array<double>")
    scaled = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double"))
    live = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("q"), x.alias("x"), scaled.alias("v"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    live = live.where("id is not null and label is not null and x is not null").where(~bad)
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    live = live.where(norm < float(LIMIT)).select("id", "label", "q", F.size("v").alias("dim"), F.col("v").cast("array<int>").alias("v"))
    live = settle(live.withColumn("row", F.monotonically_increasing_id()), "scaled")
    sizes = live.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("asked")).collect()  # one row for each length of vectors
    grid = [(r["dim"], max(1, -(-r["n"] // _rows(r["n"], r["dim"], block))), max(1, -(-r["asked"] // _rows(0, r["dim"], block)))) for r in sizes]
    blocks = F.broadcast(spark.createDataFrame(grid, "dim int, parts long, asks long"))
    spread = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n))
    keys = ["dim", "part", "ask"]
    placed = live.join(blocks, "dim")
    rows = placed.select("id", "label", "v", "row", "dim", spread(1, "parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)).alias("ask"))

    def meet(asked: DataFrame, run, schema: str) -> DataFrame:
        asked = asked.select("*", spread(2, "asks").alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).drop("parts", "asks")
        return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(lambda r, a: run(a, r), schema)

    anchors = settle(live.where("q").select(F.col("id").alias("anchor_id"), "label", "v", "row", "dim"), "anchors")
    asking = anchors.drop("anchor_id").join(blocks, "dim")
    best = meet(asking, _positives(positives), "row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    best = settle(best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    tops = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("positives"))
    found = meet(asking.join(tops, "row"), _negatives(negatives, window), "row long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = found.join(best, ["row", "place"]).join(anchors.select("row", "anchor_id"), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _rows(n: int, dim: int, block: int) -> int:
    """Rows in a block: what `block` components hold, less while there would be fewer than 64 blocks, but 1024 at least."""
    most = max(1, block // max(1, dim))
    return min(most, max(1024, n // 64)) if n else most


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CASE WHEN len(b.x) > 0 THEN list_inner_product(a.x, b.x) ELSE 0 END::BIGINT AS score
  FROM v a JOIN v b ON len(a.x) = len(b.x) AND a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, pr ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score QUALIFY rank <= 5
"""
