"""Nearest neighbours by inner product, with randomly rotated one-bit codes.

Every vector's residual to its cell's centroid is rotated at random and kept as sign bits with two
correction scalars. A query's rotated residual is quantised to four bits; popcounts of its bit planes with the
packed codes estimate all inner products without bias. The error bound of the estimate decides which
vectors are ranked again by their exact inner product. A query meets only cells that a measured recall calls for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelens.llm.op2_cover_tree import usable
from acrelens.llm.shared import settle, table

PLANES = 4  # bits of a quantised query component
WIDTH = 3.0  # error bounds are so many times 1 / sqrt(dimensions - 1)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix for `dim` dimensions, padded to whole 64-bit words."""
    full = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([seed, full]).normal(size=(full, full)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(x: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits as uint64 words, residual norm, alignment of the code with the residual) of each row."""
    r = x - centroid
    norm = np.sqrt((r * r).sum(1))
    v = r @ turn
    code = v > 0
    size = turn.shape[1]
    align = np.abs(v).sum(1) / (np.sqrt(size) * np.where(norm > 0, norm, 1))
    return np.packbits(code, axis=1, bitorder="little").view("<u8"), norm, np.where(norm > 0, align, 1.0)


def quantise(q: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the rotated queries with their lower end, step and sum."""
    v = q @ turn
    low, high = v.min(1), v.max(1)
    step = np.maximum((high - low) / (2**PLANES - 1), 1e-300)
    levels = np.rint((v - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([np.packbits(levels >> k & 1, axis=1, bitorder="little").view("<u8") for k in range(PLANES)])
    return planes, low, step, levels.sum(1, dtype=np.int64)


def estimates(planes, low, step, total, codes, norm, align, size: int) -> np.ndarray:
    """Estimated inner products of the queries with the vectors' residuals, from packed bits and scalars."""
    hits = np.zeros((planes.shape[1], len(codes)), np.float32)
    for k in range(PLANES):
        for w in range(codes.shape[1]):
            hits += np.bitwise_count(planes[k][:, w, None] & codes[None, :, w]).astype(np.float32) * np.float32(2**k)
    ones = np.bitwise_count(codes).sum(1).astype(np.float64)
    # sum of v_i * (2 bit_i - 1), with v_i = low + step * level_i
    signed = low[:, None] * (2 * ones - size)[None, :] + step[:, None] * (2 * hits - total[:, None])
    return signed / np.sqrt(size) * (norm / align)[None, :]


def centroids(sample: np.ndarray, cells: int, seed: int = 5, rounds: int = 4) -> np.ndarray:
    """A few rounds of k-means over a bounded sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = ((c * c).sum(1)[None, :] - 2 * sample @ c.T).argmin(1)
        c = np.stack([sample[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
    return c


def probes(sample: np.ndarray, cents: np.ndarray, k: int, share: float, most: int = 512) -> int:
    """To how many of its best cells, by the centroids' inner products, a query has to go so that `share` of its k nearest
    rows are there: measured on sampled rows against all of the sample, whose neighbours are farther than the table's."""
    if len(sample) < 2:
        return len(cents)
    own = ((cents * cents).sum(1)[None, :] - 2 * sample @ cents.T).argmin(1)
    some = np.arange(0, len(sample), max(1, len(sample) // most))
    s = sample[some] @ sample.T
    s[np.arange(len(some)), some] = -np.inf
    near = np.argpartition(-s, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(sample[some] @ cents.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))))]) + 1


def nearest(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, block: int = 4096, sample: int = 8192, recall: float | None = 0.99, per_cell: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `vectors` by inner product for each row with `is_query`.

    Candidates are all rows but the query's own; ties go to the smaller vec_id; score is the inner product of
    the original vectors in double precision. Vectors that are null, empty, all zero or hold null or non-finite
    components take no part, nor do rows with a null id; vectors of another length than the query's are no candidates. Rows
    that repeat an id are queries and candidates of their own. Fewer than k candidates: all of them.

    Centroids, and a first bound on each query's k-th score, come from at most `sample` rows; every row is
    indexed. A query meets only its best cells, as many as hold the share `recall` of neighbours on the sample, and more
    while those hold less than 4 k rows; with None it meets all cells. Cells have about `per_cell` rows; larger ones are cut into blocks of
    about `block` rows, whatever a cell's share of all rows. A row goes to its block and nowhere else, a query to all blocks of its cells; a task
    holds one block and lets the queries stream by.
    """
    spark = vectors.sparkSession
    live = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"), is_query.alias("q")).where(usable("x") & F.col("id").isNotNull())
    live = settle(live.withColumn("dim", F.size("x")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = {r["dim"]: (r["n"], r["nq"]) for r in live.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("nq")).collect()}
    total = sum(n for n, _ in counts.values())
    rate = -(-total // sample) if total else 1
    taken = live.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(rate)) == 0).orderBy("id", "row").limit(2 * sample).collect()
    model = {}
    for dim in counts:
        rows = [r for r in taken if r["dim"] == dim]
        x = np.array([r["x"] for r in rows]).reshape(len(rows), dim)
        cents = centroids(x, max(1, min(1024, len(x) // 4, counts[dim][0] // per_cell))) if len(x) else np.zeros((1, dim))
        model[dim] = (cents, x, np.array([r["row"] for r in rows], np.int64), probes(x, cents, k, recall) if recall else len(cents))
    sent = spark.sparkContext.broadcast(model)

    def index(batches):
        turns = {}
        for pdf in batches:
            out = []
            for dim, rows in pdf.groupby("dim", sort=False):
                x, c = np.stack(rows["x"]), sent.value[dim][0]
                turn = turns.setdefault(dim, rotation(dim))
                own = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
                codes, norm, align = encode(x, c[own], turn)
                out.append(rows[["row", "id", "x", "dim", "q"]].assign(cell=own.astype(np.int32), code=list(codes.view(np.int64)), norm=norm, align=align))
            yield pd.concat(out)

    indexed = settle(live.mapInPandas(index, "row long, id long, x array<double>, dim int, q boolean, cell int, code array<long>, norm double, align double"), "indexed")
    held = {(r["dim"], r["cell"]): r["n"] for r in indexed.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}  # as many as there are cells
    sizes = {dim: np.array([held.get((dim, c), 0) for c in range(len(model[dim][0]))]) for dim in counts}

    def bound(batches):
        for pdf in batches:
            low, where_to = np.full(len(pdf), -np.inf), np.empty(len(pdf), object)
            for dim, where in pdf.groupby("dim", sort=False).indices.items():
                cents, x, known, m = sent.value[dim]
                q = np.stack(pdf["x"].iloc[where])
                if len(x) > k:
                    s = q @ x.T
                    s[pdf["row"].to_numpy()[where][:, None] == known[None, :]] = -np.inf
                    low[where] = np.partition(s, -k, axis=1)[:, -k]
                order = np.argsort(-(q @ cents.T), axis=1, kind="stable")
                enough = (np.cumsum(sizes[dim][order], axis=1) < 4 * k).sum(1) + 1
                for i, cells, n in zip(where, order, enough):
                    where_to[i] = cells[: max(m, n)].astype(np.int32)
            yield pdf[["row", "id", "x", "dim"]].assign(low=low, cells=where_to)

    blocks = spark.createDataFrame([(d, c, max(1, -(-n // block))) for (d, c), n in held.items()], "dim int, cell int, blocks int")
    asked = indexed.where("q").select("row", "id", "x", "dim").mapInPandas(bound, "row long, id long, x array<double>, dim int, low double, cells array<int>")
    cols = [("row", "long"), ("id", "long"), ("x", "array<double>"), ("code", "array<long>"), ("norm", "double"), ("align", "double"), ("low", "double")]
    blank = lambda df: df.select("dim", "cell", "part", *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in cols])
    part = F.pmod(F.xxhash64("row", F.lit(4)), F.col("blocks").cast("long")).cast("int")
    table_side = indexed.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("part", part)
    query_side = asked.withColumn("cell", F.explode("cells")).join(F.broadcast(blocks), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["dim", "cell", "part"]
    met = blank(table_side).unionByName(blank(query_side)).repartition(*key).sortWithinPartitions(*key, F.col("code").isNull())
    best = met.mapInPandas(lambda batches: _stream(batches, sent.value, k), "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _stream(batches, model: dict, k: int):
    """The k best of each block for each query that comes to it. Rows are sorted by block, candidates before queries."""
    key, held, block = None, [], None
    for pdf in batches:
        for own_key, own in pdf.groupby(["dim", "cell", "part"], sort=False):
            if own_key != key:
                key, held, block = own_key, [], None
            asks = own["code"].isna().to_numpy()
            if not asks.all():
                held.append(own[~asks])
            if asks.any() and held:
                block = pd.concat(held) if block is None else block
                yield _search(own[asks].reset_index(drop=True), block, model, k)


def _search(asks: pd.DataFrame, rows: pd.DataFrame, model: dict, k: int) -> pd.DataFrame:
    """The k best of a block of a cell's vectors for each of some queries."""
    out_r, out_q, out_v, out_s = [], [], [], []
    if len(asks) and len(rows):
        dim = int(rows["dim"].iloc[0])
        turn, cent = rotation(dim), model[dim][0][int(rows["cell"].iloc[0])]
        size = turn.shape[1]
        q, x, ids, known = np.stack(asks["x"]), np.stack(rows["x"]), rows["id"].to_numpy(), rows["row"].to_numpy()
        codes, norm, align = np.stack(rows["code"]).view(np.uint64), rows["norm"].to_numpy(), rows["align"].to_numpy()
        base = q @ cent
        length = np.sqrt((q * q).sum(1))
        error = WIDTH / np.sqrt(max(1, size - 1)) * norm * np.sqrt(np.maximum(0, 1 - align**2)) / align
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            planes, low, step, total = quantise(q[part], turn)
            guess = estimates(planes, low, step, total, codes, norm, align, size) + base[part, None]
            # rounding a component to a level moves the estimate by at most half a step for each
            reach = error[None, :] * length[part, None] + 0.5 * step[:, None] * (norm / align)[None, :]
            floor = asks["low"].to_numpy()[part].copy()
            if guess.shape[1] > k:
                floor = np.maximum(floor, np.partition(guess - reach, -k - 1, axis=1)[:, -k - 1])
            for i, own in enumerate(asks["row"].to_numpy()[part]):
                found = np.flatnonzero(guess[i] + reach[i] >= floor[i])
                found = found[known[found] != own]
                # summed in one fixed order, whatever else is ranked along with it
                score = np.einsum("ij,j->i", x[found], q[at + i])
                least = asks["low"].iloc[at + i]  # what k sampled rows reach, less the rounding of another order of sums
                if np.isfinite(least):
                    good = score >= least - 1e-9 * abs(least) - 1e-12 * length[at + i]
                    found, score = found[good], score[good]
                if len(found) > k:
                    best = score >= np.partition(score, -k)[-k]
                    found, score = found[best], score[best]
                best = np.lexsort((ids[found], -score))[:k]
                out_r.append(np.full(len(best), own)), out_q.append(np.full(len(best), asks["id"].iloc[at + i])), out_v.append(ids[found[best]]), out_s.append(score[best])
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return pd.DataFrame({"row": join(out_r, np.int64), "query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
