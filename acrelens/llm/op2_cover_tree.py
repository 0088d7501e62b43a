"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

The top of the tree is a bounded sample of pivots; every vector goes to the cell of its nearest
pivot, and in large cells to the subcell of one of the cell's own pivots; blocks are of bounded size, and pairs of subcells
are pruned by their covering radii before any vector is copied. Each block has nested levels with halving radii,
built in one task. Two blocks are traversed together, level by level: a pair of nodes is dropped when
their distance less both covering radii is above the threshold, and taken whole when it plus both radii is
below, so that a dense group of copies isn't expanded into its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelens.llm.shared import components, settle, table

LEVELS = (1.0, 0.5, 0.25, 0.125)  # radii on the unit sphere, whose root has 2
SLACK = 1e-9  # what bounds give away for rounding; cosines themselves are compared exactly


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nets(x: np.ndarray, radii: tuple = LEVELS) -> list[np.ndarray]:
    """For each level the index of every row's centre. The centres of a level are all over its radius apart, and stay centres below; a
    centre lies within the radius above of the one that it hangs under, its nearest there; each row is within the last radius of its centre."""
    far = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    np.fill_diagonal(far, 0)
    levels, chosen = [], np.zeros(0, np.int64)
    for r in radii:
        covered = (far[chosen] <= r).any(0) if len(chosen) else np.zeros(len(x), bool)
        new = []
        for i in range(len(x)):
            if not covered[i]:
                new.append(i)
                covered |= far[i] <= r
        chosen = np.sort(np.concatenate([chosen, np.array(new, np.int64)]))
        levels.append(chosen)
    out = [levels[-1][far[:, levels[-1]].argmin(1)]]
    for above in levels[-2::-1]:
        up = np.arange(len(x))
        up[out[0]] = above[far[np.ix_(out[0], above)].argmin(1)]
        out.insert(0, up[out[0]])
    return out


class Tree:
    """Levels of nodes: centre row, covering radius, weight, and the first and last of its children in the next level."""

    def __init__(self, x: np.ndarray, paths: list[np.ndarray], weight: np.ndarray):
        order = np.lexsort((np.arange(len(x)), *paths[::-1]))
        self.x, self.weight, self.rows = x[order], weight[order], order
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.levels = []
        for path in [*paths, np.arange(len(x))]:
            p = path[order]
            lo = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            hi = np.r_[lo[1:], len(p)]
            centre = back[p[lo]]
            radius = np.maximum.reduceat(np.linalg.norm(self.x - self.x[np.repeat(centre, hi - lo)], axis=1), lo)
            self.levels.append((centre, radius, lo, hi))
        self.kids = []
        for (_, _, lo, hi), (_, _, below, _) in zip(self.levels, self.levels[1:]):
            self.kids.append((np.searchsorted(below, lo), np.searchsorted(below, hi)))


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and each member of the ranges [lo, hi)."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def dual_traversal(s: Tree, t: Tree, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row of s, of each row of t, and linked rows i of s and j of t that connect what is linked).

    With `same`, s and t are one tree and each pair of its rows counts once on both sides. Rows count as often
    as their weight.
    """
    tau = math.sqrt(2 - 2 * cosine)
    add_s, add_t = np.zeros(len(s.x) + 1, np.int64), np.zeros(len(t.x) + 1, np.int64)
    links_i, links_j = [], []
    cs, ct = np.r_[0, np.cumsum(s.weight)], np.r_[0, np.cumsum(t.weight)]

    def visit(level: int, a: np.ndarray, b: np.ndarray) -> None:
        (ca, ra, la, ha), (cb, rb, lb, hb) = s.levels[level], t.levels[level]
        for at in range(0, len(a), 1 << 18):
            i, j = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
            cos = np.einsum("ij,ij->i", s.x[ca[i]], t.x[cb[j]])
            if level == len(s.levels) - 1:
                hit = cos >= cosine
                i, j = i[hit], j[hit]
                np.add.at(add_s, i, t.weight[j]), np.add.at(add_s, i + 1, -t.weight[j])
                np.add.at(add_t, j, s.weight[i]), np.add.at(add_t, j + 1, -s.weight[i])
                links_i.append(i), links_j.append(j)
                continue
            d, slack = np.sqrt(np.maximum(0, 2 - 2 * cos)), ra[i] + rb[j]
            keep = d - slack <= tau + SLACK
            whole = keep & (d + slack <= tau - 1e-6) & ~(same & (i == j))
            if whole.any():
                u, v = i[whole], j[whole]
                wu, wv = cs[ha[u]] - cs[la[u]], ct[hb[v]] - ct[lb[v]]
                np.add.at(add_s, la[u], wv), np.add.at(add_s, ha[u], -wv)
                np.add.at(add_t, lb[v], wu), np.add.at(add_t, hb[v], -wu)
                for tree, lo, hi, swap in ((s, la[u], ha[u], False), (t, lb[v], hb[v], True)):
                    w, row = _expand(lo, hi)  # every row of the one node with the first of the other
                    other = (lb[v] if not swap else la[u])[w]
                    links_i.append(other if swap else row), links_j.append(row if swap else other)
            keep &= ~whole
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            (ks, ke), (ms, me) = s.kids[level], t.kids[level]
            w, p = _expand(ks[i], ke[i])
            i2, j2 = p, j[w]
            diagonal = i[w] == j2
            w, q = _expand(ms[j2], me[j2])
            p, on = i2[w], diagonal[w]
            if same:
                ok = ~on | ((p < q) if level + 1 == len(s.levels) - 1 else (p <= q))
                p, q = p[ok], q[ok]
            visit(level + 1, p, q)

    na, nb = len(s.levels[0][0]), len(t.levels[0][0])
    for at in range(0, na, max(1, (1 << 18) // nb)):
        i = np.repeat(np.arange(at, min(na, at + max(1, (1 << 18) // nb))), nb)
        j = np.tile(np.arange(nb), len(i) // nb)
        visit(0, *((i[i <= j], j[i <= j]) if same else (i, j)))
    both = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (links_i, links_j)]
    return np.cumsum(add_s)[:-1], np.cumsum(add_t)[:-1], *both


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, given links i-j of nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low), np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def usable(vector) -> F.Column:
    """Not null, not empty, only finite components, not all zero."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def _with_cells(rows: DataFrame, pivots: dict) -> DataFrame:
    """Add cell (a pivot's number, or -1), far, the distance to it, and top, its unit vector (null for -1)."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for pdf in batches:
            cell, far, top = np.full(len(pdf), -1, np.int64), np.ones(len(pdf)), np.full(len(pdf), None, object)
            for group, at in pdf.groupby("group", sort=False).indices.items():
                if found := sent.value.get(group):
                    x = unit(pdf["embedding"].iloc[at])
                    d = np.sqrt(np.maximum(0, 2 - 2 * x @ found[1].T))
                    best = d.argmin(1)
                    cell[at], far[at] = found[0][best], d.min(1)
                    for i, j in zip(at, best):
                        top[i] = found[1][j]
            yield pdf.assign(cell=cell, far=far, top=top)

    return rows.mapInPandas(assign, "id long, n long, group string, embedding array<double>, cell long, far double, top array<double>")


def _to_subcells(batches):
    """Give each row the nearest pivot of its cell's own (sub 0 and the cell's pivot where there are none), near, the distance to it, and its unit vector.

    Rows are sorted by group, cell and part, a cell's pivots before its rows, so a task holds one cell's pivots at a time.
    """
    key, held, ready = None, [], None
    for pdf in batches:
        for own_key, own in pdf.groupby(["group", "cell", "part"], sort=False):
            if own_key != key:
                key, held, ready = own_key, [], None
            pivot = own["pivot"].to_numpy(bool)
            if pivot.any():
                held.append(own[pivot])
            rows = own[~pivot]
            if ready is None and len(rows) and held:
                every = pd.concat(held).sort_values("sub")
                ready = every["sub"].to_numpy(np.int32), unit(every["embedding"])
            for at in range(0, len(rows), 1024):
                some = rows.iloc[at : at + 1024]
                sub, near, centre = np.zeros(len(some), np.int32), some["far"].to_numpy().copy(), some["top"].to_numpy(object).copy()
                if ready is not None:
                    d = np.sqrt(np.maximum(0, 2 - 2 * unit(some["embedding"]) @ ready[1].T))
                    best = d.argmin(1)
                    sub, near = ready[0][best], d.min(1)
                    for i, j in enumerate(best):
                        centre[i] = ready[1][j]
                yield some[["id", "n", "group", "embedding", "cell"]].assign(sub=sub, near=near, centre=centre)


def _subcells(celled: DataFrame, cells: DataFrame, block: int, most_pivots: int) -> DataFrame:
    """celled with sub, near and centre. Cells of over a block have pivots of their own, about one in `block` rows, which are sent once to each part of a
    cell of 16 blocks; the others have one subcell."""
    plain = celled.join(cells.where("subs = 1").select("group", "cell"), ["group", "cell"])
    plain = plain.select("id", "n", "group", "embedding", "cell", F.lit(0).alias("sub"), F.col("far").alias("near"), F.col("top").alias("centre"))
    parts = F.ceil(F.col("subs") / 16).cast("int")
    large = celled.join(cells.where("subs > 1").select("group", "cell", parts.alias("parts")), ["group", "cell"])
    order = Window.partitionBy("group", "cell").orderBy("id")
    inner = large.where(F.pmod(F.xxhash64("id", "group", F.lit(13)), F.lit(block)) == 0).withColumn("sub", F.row_number().over(order)).where(F.col("sub") <= most_pivots)
    inner = inner.select("group", "cell", "embedding", "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("pivot"))
    rows = large.withColumn("part", F.pmod(F.xxhash64("id", F.lit(17)), F.col("parts").cast("long")).cast("int")).withColumn("pivot", F.lit(False)).drop("parts")
    key = ["group", "cell", "part"]
    met = rows.unionByName(inner, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, ~F.col("pivot"))
    return plain.unionByName(met.mapInPandas(_to_subcells, "id long, n long, group string, embedding array<double>, cell long, sub int, near double, centre array<double>"))


def _near_cells(spark: SparkSession, pivots: dict, radius: dict, tau: float) -> DataFrame:
    """(group, cell, cell2): cells of two pivots that may hold linked vectors, by their covering radii; found in tasks, a few pivots each."""
    sent = spark.sparkContext.broadcast((pivots, radius))
    slices = [(g, lo) for g, (ids, _) in pivots.items() for lo in range(0, len(ids), 64)]

    def run(batches):
        pivots, radius = sent.value
        for pdf in batches:
            for g, lo in zip(pdf["group"], pdf["lo"]):
                ids, x = pivots[g]
                r = np.array([radius.get((g, int(k)), -9.0) for k in ids])
                own = np.arange(lo, min(lo + 64, len(ids)))
                d = np.sqrt(np.maximum(0, 2 - 2 * x[own] @ x.T))
                i, j = np.nonzero((d - r[own, None] - r[None, :] <= tau + SLACK) & (own[:, None] < np.arange(len(ids))[None, :]))
                yield pd.DataFrame({"group": g, "cell": ids[own[i]], "cell2": ids[j]})

    return spark.createDataFrame(slices, "group string, lo int").repartition(max(1, len(slices) // 4)).mapInPandas(run, "group string, cell long, cell2 long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, block: int = 2048, most_pivots: int = 4096) -> DataFrame:
    """One row per row of `vectors`: id, n_links (others of equal label with a cosine of at least `cosine`), component_id, kept.

    Vectors with a null label, null, empty or all zero ones, and those with null or non-finite components
    link with nothing; so do vectors of different lengths. Equal vectors of a label are one node with a weight:
    copies link with each other but are never paired one by one. Extra columns are ignored. Rows that repeat an id
    with another vector have links and components of their own, named by the smallest id among their component's rows. Rows with a null id link with nothing. About one in `block` vectors is a pivot,
    `most_pivots` at most; cells of over a block have pivots of their own, as many at most, and what a subcell
    still holds beyond a block (vectors so close that no pivot parts them) is cut into blocks. Every vector is indexed, and
    pruning drops no link.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("embedding", F.when(usable("embedding") & F.col("label").isNotNull(), F.transform("embedding", lambda x: x + F.lit(0.0))))
    rows = rows.withColumn("group", F.concat_ws(":", F.size("embedding"), "label"))
    live = rows.where("embedding is not null and id is not null")
    # a node is a vector with a number of its own, as its rows' ids may name other vectors too
    nodes = live.groupBy("group", "embedding").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    nodes = settle(nodes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    total = nodes.count()
    rate = max(block, -(-total // most_pivots))
    picked = nodes.where(F.pmod(F.xxhash64("id", "group"), F.lit(rate)) == 0).select("group", "embedding", "id").orderBy("id").limit(2 * most_pivots).collect()
    pivots, groups = {}, {}
    for k, r in enumerate(picked):
        groups.setdefault(r["group"], []).append((k, r["embedding"]))
    for g, found in groups.items():
        pivots[g] = (np.array([k for k, _ in found]), unit([v for _, v in found]))
    celled = settle(_with_cells(nodes.drop("least"), pivots), "cells")
    cells = celled.groupBy("group", "cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius"))
    cells = settle(cells.withColumn("subs", F.ceil(F.col("rows") / block).cast("int")), "sizes")
    tau = math.sqrt(2 - 2 * cosine)
    subbed = settle(_subcells(celled, cells, block, most_pivots), "subcells")
    subs = subbed.groupBy("group", "cell", "sub").agg(F.count("*").alias("rows"), F.max("near").alias("radius"), F.any_value("centre").alias("centre"))
    subs = settle(subs.withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")), "blocks")
    pairs = settle(_near_cells(spark, pivots, {(r["group"], r["cell"]): r["radius"] for r in cells.where("cell >= 0").collect()}, tau), "near")
    pairs = pairs.unionByName(cells.select("group", "cell", F.col("cell").alias("cell2")))
    other = subs.select("group", *[F.col(c).alias(f"{c}2") for c in ("cell", "sub", "radius", "centre", "blocks")])
    cross = pairs.join(subs.drop("rows"), ["group", "cell"]).join(other, ["group", "cell2"]).where("cell < cell2 or sub <= sub2")
    dot = F.aggregate(F.zip_with("centre", "centre2", lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    # what bounds prune is never copied; the vectors of cells without a pivot have no centre
    cross = cross.where(F.col("centre").isNull() | F.col("centre2").isNull() | (apart - F.col("radius") - F.col("radius2") <= tau + 1e-6))
    cross = cross.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    one, two = F.struct("cell", "sub", "b"), F.struct(F.col("cell2").alias("cell"), F.col("sub2").alias("sub"), F.col("b2").alias("b"))
    cross = cross.where((F.col("cell") < F.col("cell2")) | (F.col("sub") < F.col("sub2")) | (F.col("b") <= F.col("b2")))
    name = F.concat_ws("/", "group", "cell", "sub", "b", "cell2", "sub2", "b2")
    sides = F.when(one == two, F.array(F.struct(one.alias("at"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(one.alias("at"), F.lit(1).alias("side")), F.struct(two.alias("at"), F.lit(2).alias("side"))))
    visits = cross.select("group", name.alias("pair"), F.explode(sides).alias("s")).select("group", "pair", "s.at.*", "s.side")
    inside = subbed.join(subs.select("group", "cell", "sub", "blocks"), ["group", "cell", "sub"]).withColumn("b", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks").cast("long")).cast("int"))
    inside = settle(inside.groupBy("group", "cell", "sub", "b").applyInPandas(_levels, "id long, n long, group string, embedding array<double>, cell long, sub int, b int, path array<int>"), "levels")
    found = inside.join(visits, ["group", "cell", "sub", "b"]).select("pair", "side", "id", "n", "embedding", "path")
    found = settle(found.groupBy("pair").applyInPandas(lambda pdf: _visit(pdf, cosine), "id long, links long, root long"), "links")
    whole = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    summed = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = nodes.join(summed, "id", "left").join(whole.withColumnRenamed("node", "id"), "id", "left").withColumn("own", F.coalesce("component", "id"))
    firsts = named.groupBy("own").agg(F.min("least").alias("first"))
    named = named.join(firsts, "own").select("group", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.col("first").alias("component"))
    out = rows.select("id", "group", "embedding").join(named, ["group", "embedding"], "left")
    whose = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), whose.alias("component_id"), F.coalesce(F.col("id") == whose, F.lit(True)).alias("kept"))


def _levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's rows with the centre of each of their levels, as numbers of rows in the order of ids."""
    pdf = pdf.sort_values("id").reset_index(drop=True)
    paths = np.stack(nets(unit(pdf["embedding"])), 1).astype(np.int32)
    return pdf[["id", "n", "group", "embedding", "cell", "sub", "b"]].assign(path=list(paths))


def _visit(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """What the dual traversal of a pair of blocks, or of one with itself (side 0), gives each of their rows."""
    trees, ids = [], []
    for _, side in pdf.groupby("side"):
        side = side.sort_values("id")
        trees.append(Tree(unit(side["embedding"]), list(np.stack(side["path"]).T), side["n"].to_numpy()))
        ids.append(side["id"].to_numpy()[trees[-1].rows])
    if len(trees) < 2 and pdf["side"].iloc[0] != 0:
        return pd.DataFrame({"id": ids[0][:0], "links": ids[0][:0], "root": ids[0][:0]})
    same = len(trees) == 1
    s, t = trees[0], trees[-1]
    n_s, n_t, i, j = dual_traversal(s, t, same, cosine)
    every, links = (ids[0], n_s + n_t) if same else (np.concatenate(ids), np.concatenate([n_s, n_t]))
    order = np.argsort(every, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    root = roots(len(every), place[i], place[j if same else j + len(ids[0])])
    every, links = every[order], links[order]
    out = pd.DataFrame({"id": every, "links": links, "root": every[root]})
    return out[out["links"] > 0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair of a label by plain SQL, and components by following links.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS i, vec_id AS j FROM u UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS c FROM r GROUP BY i), n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT v.vec_id::BIGINT AS vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, v.vec_id)::BIGINT AS component_id, coalesce(c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN c ON v.vec_id = c.i LEFT JOIN n ON v.vec_id = n.i
"""
