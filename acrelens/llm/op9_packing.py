"""Best-fit packing into sequences of several permitted lengths.

Items go, longest first, into the open bin that they leave the least room in. If none has room, a bin of that
length opens whose cost for each token that can still come into it is least; in the end each bin shrinks to the least
permitted length that holds its contents. Which of the permitted lengths may open is optimised jointly: every set of them
that can hold all items is tried on all sizes of a block, and the one whose bins cost least is kept. A sequence costs
something besides its tokens, and attention that grows with the square of its length, so neither the shortest nor the longest
bins are cheapest for all items. Blocks of bounded size are packed independently.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.llm.op7_mix import word_count
from acrelens.llm.shared import settle, table

LENGTHS = (512, 1024, 2048, 4096, 8192)  # permitted sequence lengths, in words
OVERHEAD = 64  # cost of a sequence besides its tokens, in tokens
ATTENTION = 16_384  # length at which attention costs as much as all else


def cost_of(length: int) -> float:
    """What a sequence of a permitted length costs, filled or not."""
    return OVERHEAD + length + length * length / ATTENTION


def fill(order: list[int], sizes: list[int], opening: tuple, lengths: tuple, cost=cost_of) -> tuple[float, list, list, list]:
    """Best fit in the given order, with bins of `opening` lengths: what all shrunk bins cost, (bin, offset) of each item, and the lengths."""
    left = sum(sizes)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    room: list[tuple[int, int]] = []  # (free words, bin), in order
    used: list[int] = []
    prices = [(c, cost(c)) for c in sorted(opening)]
    for i in order:
        n = sizes[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            _, free = min((price / max(1, min(c, left)), c) for c, price in prices if c >= n)
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left -= n
        if free > n:
            insort(room, (free - n, b))
    sized = sorted(lengths)
    final = [sized[bisect_left(sized, u)] for u in used]
    return sum(map(cost, final)), bins, offsets, final


def pack(sizes: list[int], lengths: tuple = LENGTHS, cost=cost_of) -> tuple[list[int], list[int], dict[int, int]]:
    """(bin, offset) of each item, items in any order, and the length of each bin. No size is above max(lengths).

    Of all sets of lengths that may open, each with the least length that holds the largest item or a longer one, that with the least cost is taken.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    biggest = max(sizes, default=0)
    sets = [s for k in range(1, len(lengths) + 1) for s in combinations(sorted(lengths), k) if s[-1] >= biggest]
    best = min((fill(order, sizes, s, lengths, cost) for s in sets), key=lambda x: x[0], default=(0, [], [], []))
    return best[1], best[2], dict(enumerate(best[3]))


def best_fit(items: DataFrame, size_col: str, lengths: tuple = LENGTHS, block: int = 20_000) -> DataFrame:
    """Each row of `items` as a struct `row`, cut into pieces that fit: row, piece, start, n_tokens, bin_id, capacity, offset.

    A row of more than max(lengths) words is cut into pieces of that many and a rest; start is the piece's first
    word. Null or negative sizes count as 0; rows of size 0 are placed like others and take no room. Equal rows are
    separate items. Nothing is dropped. A random number of the row, kept in a written table, decides its
    block; blocks have about `block` pieces, and only sizes go through the packing.
    """
    most = max(lengths)
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    rows = settle(items.select(F.struct("*").alias("row"), size.alias("_size")).withColumn("_row", F.monotonically_increasing_id()), "items")
    pieces = rows.select("_row", "_size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_size") / most).cast("int") - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.withColumn("n_tokens", F.least(F.col("_size") - F.col("piece").cast("long") * most, F.lit(most)))
    blocks = max(1, -(-pieces.count() // block))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("_row", "piece"), F.lit(blocks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_row", "piece"])
        bins, offsets, capacity = pack(pdf["n_tokens"].tolist(), lengths)
        first = int(pdf["block"].iloc[0]) << 32
        return pdf[["_row", "piece", "n_tokens"]].assign(bin_id=[first + b for b in bins], capacity=[capacity[b] for b in bins], offset=offsets)

    placed = pieces.select("block", "_row", "piece", "n_tokens").groupBy("block").applyInPandas(run, "_row long, piece int, n_tokens long, bin_id long, capacity int, offset long")
    out = rows.select("_row", "row").join(placed, "_row")
    return out.select("row", "piece", (F.col("piece").cast("long") * most).alias("start"), "n_tokens", "bin_id", "capacity", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, capacity, offset of every document's pieces; words are runs of anything but ASCII white space."""
    out = best_fit(docs.select(id_col, word_count(F.col(text_col)).alias("_words")), "_words")
    return out.select(F.col(f"row.{id_col}").alias(id_col), "piece", "start", "n_tokens", "bin_id", "capacity", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
