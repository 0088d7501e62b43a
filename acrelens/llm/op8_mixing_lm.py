"""Language-model scores by logistic context mixing.

A text is its words and an end. It is cut into phrases, which end at words whose hash says so. Before a phrase a match bit
tells whether it is the phrase that most often follows the one before; the bit's history is looked up under the hashed
previous phrase. Where there is no such history, or the bit says no, the phrase's words are coded one by one: a run bit (does
the word repeat the last one?), then the word's bytes, bit by bit. Several predictors look up each bit's history under
a hashed context (one to three bytes before it, and the whole word so far, each with the kind of text that the words before
show), their stretched probabilities are added by weights that a gate picks from how much the longer contexts have seen, and an
adaptive probability map refines the sum.

Texts go into blocks of numbered words, read once. Histories are gathered by Spark from all training texts: of
whole words in sorted pages, exactly and however rare, where neighbouring pages exchange what words at their borders share;
of short contexts in tables of fixed size, as languages have few of those; of phrases in grouped sums. A (kind, word) has one
probability, which its page computes once. All pages use one mixer, whose weights and map are fitted to the bits of all training words, counted
in cells that the pages' sums fill, and then stay as they are: so the probabilities of all words of a kind sum to at most 1, however they are paged.
The kinds are a mixture fitted by EM to all training texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelens.llm.shared import discard, release, settle, table

KINDS, PROBE = 6, 3  # kinds of text, and words before which a text's kind is 0
CLASS_DIMS, CLASS_ROUNDS = 1024, 20  # hashed byte pairs, and rounds of EM at most
TABLES = (("one", 16), ("two", 19), ("three", 20))  # short contexts and their tables' sizes, as bits
SLOTS = 1 << 14  # slots of the tables that travel together
OFFSETS = np.cumsum([0] + [1 << b for _, b in TABLES])
END = b" "  # as no word is; it is spelled as nothing
RUNS = 4  # lengths of a run that are told apart
BLOCK = 500_000  # tokens of a block
DEALT = 400_000  # distinct words of blocks that are looked up together
PAGE = 20_000  # neighbouring (kind, word) that are spelled together
LEARN, STEP = 1, 50_000  # every training word teaches the mixer; bytes that are worked on at a time
RATE, ROUNDS = 0.15, 60  # how far a weight of the mixer moves in a round at most, and rounds
LEVELS = (-5.0, -2.0, 0.0, 2.0, 5.0)  # between them inputs count as alike in the cells that the mixer is fitted to
PHRASE = 12  # words of a phrase, as a mean
LIMIT = 12.0  # of stretched probabilities
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = (np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

_NODES = [(((1 << bit) | (np.arange(256) >> (8 - bit))) * 0xD9B4E019 % (1 << 32)).astype(np.uint32) for bit in range(8)]


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased; the end is not among them."""
    return (text or "").encode().lower().split()


def spelled(words: list[bytes]) -> list[bytes]:
    return [b"" if w == END else w for w in words]


def _pack(x: np.ndarray, kind) -> bytes:
    """Numbers by byte planes: the first bytes of all, then the second ones; most high bytes are equal, so that tables and shuffles compress."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


# kinds of text


def _pairs(words: list[bytes]) -> np.ndarray:
    """Hashed pairs of neighbouring bytes, one for each byte of the words and of the spaces behind them."""
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint16)
    return (b[:-1] * np.uint16(31) + b[1:] * np.uint16(7)) & np.uint16(CLASS_DIMS - 1)


def text_vectors(rows: DataFrame) -> DataFrame:
    """(sizes, at, x): counts of the byte pairs of up to 1,000 texts, those that aren't zero, lessened to 400 a text so that long texts don't outweigh the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                found = np.stack([np.bincount(_pairs(tokens(t)), minlength=CLASS_DIMS) for t in pdf["text"].iloc[i : i + 1000]])
                x = (found / np.maximum(1, found.sum(1, keepdims=True) / 400)).astype(np.float32).reshape(-1)
                at = np.flatnonzero(x)
                yield pd.DataFrame({"sizes": [np.bincount(at // CLASS_DIMS, minlength=len(found)).astype(np.int32).tobytes()], "at": [(at % CLASS_DIMS).astype(np.uint16).tobytes()], "x": [x[at].tobytes()]})

    return rows.select("text").mapInPandas(run, "sizes binary, at binary, x binary")


def _rows_of(r) -> np.ndarray:
    sizes = np.frombuffer(r.sizes, np.int32)
    out = np.zeros((len(sizes), CLASS_DIMS), np.float32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.x, np.float32)
    return out


def _log_kinds(theta: np.ndarray, prior: np.ndarray) -> np.ndarray:
    return np.round(np.c_[np.log(theta / theta.sum(1, keepdims=True)), np.log(prior)], 7)  # sums in another order give the same


def _expected(x: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of rows by kind, rows by kind, and log likelihood."""
    logs = (x @ np.ascontiguousarray(kinds[:, :-1].T, x.dtype)).astype(float) + kinds[:, -1]
    top = logs.max(1, keepdims=True)
    r = np.exp(logs - top)
    total = r.sum(1, keepdims=True)
    r /= total
    return (r.astype(x.dtype).T @ x).astype(float), r.sum(0), float((top + np.log(total)).sum())


def _by_em(expected, kinds: np.ndarray) -> np.ndarray:
    """Rounds of EM until one moves the mean log likelihood by less than a hundred-thousandth. `expected`: from kinds to their sums over all rows."""
    before = -np.inf
    for _ in range(CLASS_ROUNDS):
        sums, weight, fit = expected(kinds)
        n = weight.sum()
        kinds = _log_kinds(sums + 0.05, (weight + 1) / (n + KINDS))
        if fit / n - before < 1e-5 * abs(fit / n):
            break
        before = fit / n
    return kinds


def start_kinds(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Kinds to start from, of the rows of a few texts: each next one begins at a text unlike those before."""
    rng = np.random.default_rng(seed)
    centre, y = [x[rng.integers(len(x))]], np.sqrt(x / x.sum(1, keepdims=True))
    for _ in range(KINDS - 1):
        far = np.maximum(np.min([1 - y @ np.sqrt(c / c.sum()) for c in centre], axis=0), 1e-12).astype(float)
        centre.append(x[rng.choice(len(x), p=far / far.sum())])
    return _by_em(lambda kinds: _expected(x, kinds), _log_kinds(np.array(centre, float) + 0.5, np.full(KINDS, 1 / KINDS)))


def first_vectors(vectors: DataFrame, n: int = 4) -> list:
    """The first `n` rows by a hash of what they hold.

    Hashes alone are ordered, and then their rows fetched: of an ordered limit each task sends its own first rows to the driver, which grow with the tasks.
    """
    hashed = vectors.withColumn("h", F.xxhash64("at", "x"))
    least = [r["h"] for r in hashed.select("h").orderBy("h").limit(n).collect()]
    if not least:
        return []
    own = hashed.where(F.col("h").isin(*set(least))).groupBy("h").agg(F.min(F.struct("at", "x", "sizes")).alias("row"))  # rows of a hash are equal
    rows = {r["h"]: r["row"] for r in own.collect()}
    return [rows[h] for h in least]


def fit_kinds(vectors: DataFrame) -> np.ndarray:
    """Log probabilities of byte pairs by kind (and, in the last column, of the kind), of text_vectors(): a mixture fitted to all of them by EM.

    Only its start comes from a few texts; each round is a pass over all, whose sums by kind come back.
    """
    few = first_vectors(vectors)  # up to 4,000 texts
    if not few:
        return np.zeros((KINDS, CLASS_DIMS + 1))

    def expected(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    sums, weight, fit = _expected(_rows_of(r), kinds)
                    yield pd.DataFrame({"k": 0, "sums": [np.r_[sums.reshape(-1), weight, fit].tobytes()]})

        def summed(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": pdf["k"].iloc[:1], "sums": [sum(np.frombuffer(x) for x in sorted(pdf["sums"])).tobytes()]})

        parts = vectors.mapInPandas(run, "k int, sums binary").withColumn("k", F.spark_partition_id() % 64)
        found = sum(np.frombuffer(r["sums"]) for r in sorted(parts.groupBy("k").applyInPandas(summed, "k int, sums binary").collect(), key=lambda r: r["k"]))
        return found[: -KINDS - 1].reshape(KINDS, CLASS_DIMS), found[-KINDS - 1 : -1], float(found[-1])

    return _by_em(expected, start_kinds(np.concatenate([_rows_of(r) for r in few])))


def kinds_of(tok: np.ndarray, start: np.ndarray, words: list[bytes], kinds: np.ndarray) -> np.ndarray:
    """For each token the kind, 1 to KINDS, that the words before it in its text show; 0 for the first PROBE."""
    sizes = np.array([len(w) + 1 for w in words])
    pairs, first = _pairs(words), np.cumsum(sizes) - sizes
    begin = np.flatnonzero(start == np.arange(len(tok)))
    text = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(tok)]))
    best, found = np.full(len(tok), -np.inf), np.zeros(len(tok), np.int64)
    each, total, better = np.empty(len(tok)), np.empty(len(tok)), np.empty(len(tok), bool)
    for k in range(KINDS):
        np.take(np.add.reduceat(kinds[k, :-1].take(pairs), first), tok, out=each, mode="clip")
        np.cumsum(each, out=total)
        total -= each
        np.take(kinds[k, -1] - total[begin], text, out=each, mode="clip")
        total += each
        np.copyto(found, k + 1, where=np.greater(total, best, out=better))
        np.maximum(best, total, out=best)
    found[np.arange(len(tok)) - start < PROBE] = 0
    return found


# blocks


def runs_of(tok: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each token twice the length of the run before it (up to RUNS - 1), and 1 more if the token goes on with it."""
    at = np.arange(len(tok))
    same = np.r_[False, tok[1:] == tok[:-1]] & (at != start)
    began = np.maximum.accumulate(np.where(~same, at, 0))
    length = np.where(at == start, 0, np.minimum(np.r_[0, (at - began + 1)[:-1]], RUNS - 1))
    return length * 2 + same


def phrases_of(tok: np.ndarray, start: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of each phrase: phrases end at the end of a text and at words whose hash is divisible by PHRASE."""
    h = hashes[tok]
    ends = h % np.uint64(PHRASE) == 0
    first = np.flatnonzero(np.r_[True, ends[:-1]] | (np.arange(len(tok)) == start))
    place = np.arange(len(tok)) - np.repeat(first, np.diff(np.r_[first, len(tok)]))
    with np.errstate(over="ignore"):
        total = np.add.reduceat((h + np.uint64(1)) * (_STEP[place & 255] + (place >> 8).astype(np.uint64)), first)
        return first, (total ^ (total >> np.uint64(31))) * _MIX


def block_of(texts: list, ids: list, apart: list, number: int, kinds: np.ndarray) -> dict:
    """Texts as a block: distinct words, (kind, word) pairs with their training counts, and for each token its pair and run."""
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    each = []
    for text in texts:  # a text's words go before the next ones come, as memory that is touched again is faster
        words = tokens(text)
        words.append(END)
        each.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    tok, sizes, words = np.concatenate(each), np.array([len(x) for x in each]), list(index)
    begin = np.cumsum(sizes) - sizes
    start, train = np.repeat(begin, sizes), np.repeat(~np.array(apart, bool), sizes)
    go = runs_of(tok, start)
    fresh = np.flatnonzero(go % 2 == 0)
    key = tok * (KINDS + 1) + kinds_of(tok, start, words, kinds)
    own = key[fresh]
    met = np.zeros(len(words) * (KINDS + 1), bool)
    met[own] = True
    pairs, own = np.flatnonzero(met), (np.cumsum(met) - 1).take(own)
    pair = np.zeros(len(tok), np.int64)
    pair[fresh] = own
    pair = pair[np.maximum.accumulate(np.where(go % 2 == 0, np.arange(len(tok)), 0))]  # what repeats a word has its pair
    first, phrase = phrases_of(tok, start, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    inner = start[first] != first  # phrases with one before them in their text
    before, after = np.roll(phrase, 1)[inner], phrase[inner]
    with np.errstate(over="ignore"):
        _, some, which = np.unique((before ^ (before >> np.uint64(29))) * _MIX + after, return_index=True, return_inverse=True)
    at = np.full(len(first), -1)
    at[inner] = which
    return {
        "block": number, "ids": _pack([-1 if i is None or i != i else int(i) for i in ids], np.int64), "named": _pack([i is not None and i == i for i in ids], bool), "apart": _pack(apart, bool), "sizes": _pack(sizes, np.int64),
        "pair": _pack(pair, np.int32), "go": _pack(go, np.uint8), "first": _pack(first, np.int32), "phrase": _pack(at, np.int32),
        "words": b"\n".join(words), "counts": _pack(np.bincount(tok, weights=train, minlength=len(words)), np.int32), "of": _pack(np.diff(pairs // (KINDS + 1), prepend=0), np.int32), "kind": _pack(pairs % (KINDS + 1), np.uint8),
        "n": _pack(np.bincount(own, weights=train[fresh], minlength=len(pairs)), np.int32), "n_words": len(words), "runs": np.bincount(go[train], minlength=2 * RUNS),
        "before": before[some].view(np.int64), "after": after[some].view(np.int64), "times": np.bincount(which, weights=train[first][inner], minlength=len(some)).astype(np.int32),
    }


BLOCKS = "block long, ids binary, named binary, apart binary, sizes binary, pair binary, go binary, first binary, phrase binary, words binary, counts binary, of binary, kind binary, n binary, n_words int, runs array<long>, before array<long>, after array<long>, times array<int>"


def make_blocks(rows: DataFrame, kinds: np.ndarray) -> DataFrame:
    """Rows (id, text, held_out) as blocks of about BLOCK tokens; a longer text is a block of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for pdf in batches:
            for row in zip(pdf["text"], pdf["id"], pdf["held_out"]):
                held.append(row)
                size += len(row[0] or "") // 6 + 1
                if size >= BLOCK:
                    yield pd.DataFrame([block_of(*zip(*held), number, kinds)])
                    number, held, size = number + 1, [], 0
        if held:
            yield pd.DataFrame([block_of(*zip(*held), number, kinds)])

    return rows.select("text", "id", "held_out").mapInPandas(run, BLOCKS)


def dealt_order(words: list[bytes], of: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How a block's words and pairs are dealt: words in the order of buckets, pairs in the order of their words' buckets, and the first of each bucket in both."""
    to = np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
    to = to.astype(np.uint16) if buckets <= 1 << 16 else to  # which Numpy sorts by radix
    by_word, by_pair = np.argsort(to, kind="stable"), np.argsort(to[of], kind="stable")
    edges = np.arange(buckets + 1)
    return by_word, by_pair, np.searchsorted(to[by_word].astype(np.int64), edges), np.searchsorted(to[of][by_pair].astype(np.int64), edges)


def deal(blocks: DataFrame, buckets: int, counted: bool = True) -> DataFrame:
    """(bucket, block, words, counts, of, kind, n): what each block asks of each bucket of words; n, the pairs' training counts, only if `counted`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                words, of = r.words.split(b"\n"), np.cumsum(_unpack(r.of, np.int32))
                counts, kind, n = _unpack(r.counts, np.int32), _unpack(r.kind, np.uint8), _unpack(r.n, np.int32)
                by_word, by_pair, w, p = dealt_order(words, of, buckets)
                place = np.empty(len(words), np.int64)
                place[by_word] = np.arange(len(words))
                words, counts = [words[i] for i in by_word.tolist()], counts[by_word]
                of, kind, n = place[of[by_pair]], kind[by_pair], n[by_pair]
                out = []
                for b in np.flatnonzero(np.diff(w)).tolist():
                    own, mine = slice(w[b], w[b + 1]), slice(p[b], p[b + 1])
                    out.append((b, r.block, b"\n".join(words[own]), _pack(counts[own], np.int32), _pack(of[mine] - w[b], np.int32), _pack(kind[mine], np.uint8), _pack(n[mine], np.int32) if counted else b""))
                yield pd.DataFrame(out, columns=["bucket", "block", "words", "counts", "of", "kind", "n"])

    return blocks.select("block", "words", "counts", "of", "kind", "n").mapInPandas(run, "bucket int, block long, words binary, counts binary, of binary, kind binary, n binary")


def _unified(asked: pd.DataFrame) -> tuple[list[bytes], np.ndarray, list]:
    """Of a bucket's requests: the words in the order of their numbers, their training counts, and each request's numbers."""
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    each = []
    for blob in asked["words"]:
        words = blob.split(b"\n")
        each.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    counts = np.concatenate([_unpack(c, np.int32) for c in asked["counts"]])
    return list(index), np.bincount(np.concatenate(each), weights=counts, minlength=len(index)).astype(np.int64), each


def _gathered(asked: pd.DataFrame) -> pd.DataFrame:
    """A bucket's (kind, word) pairs: n, how often training texts spell it, c, the word's count, and lead on one pair of each word."""
    words, c, each = _unified(asked)
    key = np.concatenate([at[_unpack(of, np.int32)] * (KINDS + 1) + _unpack(kind, np.uint8) for at, of, kind in zip(each, asked["of"], asked["kind"])])
    pairs, own = np.unique(key, return_inverse=True)
    n = np.bincount(own, weights=np.concatenate([_unpack(x, np.int32) for x in asked["n"]])).astype(np.int64)
    of = pairs // (KINDS + 1)
    return pd.DataFrame({"bucket": asked["bucket"].iloc[0], "kind": (pairs % (KINDS + 1)).astype(np.int32), "word": [words[i] for i in of.tolist()], "n": n, "c": c[of], "lead": np.r_[True, of[1:] != of[:-1]]})


def _replied(asked: pd.DataFrame, priced: pd.DataFrame) -> pd.DataFrame:
    """To each block's request of a bucket: the words' training counts, and the pairs' log10 probabilities."""
    words, c, each = _unified(asked)
    lp, index = np.zeros((len(words), KINDS + 1)), dict(zip(words, range(len(words))))
    at = np.fromiter(map(index.__getitem__, priced["word"]), np.int64, len(priced))
    lp[at, priced["kind"].to_numpy()] = priced["lp"].to_numpy()
    out = [(_pack(c[own], np.int64), _pack(lp[own[_unpack(of, np.int32)], _unpack(kind, np.uint8)], np.float32)) for own, of, kind in zip(each, asked["of"], asked["kind"])]
    return pd.DataFrame({"block": asked["block"], "bucket": asked["bucket"], "c": [x[0] for x in out], "lp": [x[1] for x in out]})


# bit histories


def flatten(words: list[bytes], kinds: np.ndarray) -> dict:
    """All bytes of the spelled words, each word ended by a space, with the hash of each context of each byte."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    b = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    start = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(b)) - start[of]
    kind = kinds[of].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)

    def back(k: int) -> np.ndarray:
        out = np.zeros(len(b), np.uint64)
        out[k:] = b[:-k]
        return np.where(at >= k, out + np.uint64(1), np.uint64(0))

    with np.errstate(over="ignore"):
        h, contexts = np.zeros(len(b), np.uint64), []
        for k in range(1, 4):
            h = (h + back(k) + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(29)
            contexts.append(((h + kind) * _MIX >> np.uint64(32)).astype(np.uint32))
        steps = _STEP[at & 255] * (np.uint64(1) + (at >> 8).astype(np.uint64))
        total = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * steps)
        before = np.where(np.arange(len(b)) > 0, np.roll(total, 1), np.uint64(0))
        whole = before - before[start][of]
        whole = (((whole ^ (whole >> np.uint64(31))) * _MIX + at.astype(np.uint64)) + kind) * _MIX
    return {"byte": b, "of": of, "at": at, "start": start, "sizes": sizes, "contexts": contexts, "whole": (whole ^ (whole >> np.uint64(32))).view(np.int64)}


def slots(flat: dict, bit: int, which: int) -> np.ndarray:
    """Slot of each byte's `bit` (0: the highest) in the tables of short contexts."""
    h = flat["contexts"][which] + _NODES[bit][flat["byte"]]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - TABLES[which][1])
    return h + np.uint32(OFFSETS[which])


def bits(flat: dict, bit: int) -> np.ndarray:
    return (flat["byte"] >> (7 - bit)) & 1


def spelling_order(words: list[bytes], kinds: np.ndarray) -> list[int]:
    """Places of the words by kind, then by spelling with the space."""
    ahead = [bytes([k]) for k in range(KINDS + 1)]
    keys = [ahead[k] + w + b" " for k, w in zip(kinds.tolist(), words)]
    return sorted(range(len(words)), key=keys.__getitem__)


def _gathered_words(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words as they are spelled, kinds, n) of several batches at a time, sorted."""
    held: list = []
    for pdf in chain(batches, [None]):
        held += [] if pdf is None else [pdf]
        if held and (pdf is None or sum(map(len, held)) >= 5 * PAGE):
            every, held = pd.concat(held), []
            words, kind, n = spelled(every["word"].map(bytes).tolist()), every["kind"].to_numpy(), every["n"].to_numpy(float)
            order = spelling_order(words, kind)
            yield [words[i] for i in order], kind[order], n[order]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's histories of short contexts: for each stretch of slots that it touches, their zeros and ones."""
    size = int(OFFSETS[-1])
    counts, touched = np.zeros((2, size)), False
    for words, kind, n in _gathered_words(batches):
        flat = flatten(words, kind)
        alike = first_alike(flat, shared_bits(flat, kind))
        often = np.bincount(alike, weights=n[flat["of"]], minlength=len(alike))
        first = np.flatnonzero(often > 0)  # what words share at their beginning is added once
        for i in range(0, len(first), STEP):
            at = first[i : i + STEP]
            flat_at, touched = {"byte": flat["byte"][at], "contexts": [c[at] for c in flat["contexts"]]}, True
            for bit in range(8):
                one = bits(flat_at, bit).astype(np.uint32) * np.uint32(size)
                for which in range(len(TABLES)):
                    np.add.at(counts.reshape(-1), slots(flat_at, bit, which) + one, often[at])
    for k in range(-(-size // SLOTS) if touched else 0):
        own = counts[:, k * SLOTS : (k + 1) * SLOTS]
        if own.any():
            yield pd.DataFrame({"stretch": [k], "zeros": [own[0].tobytes()], "ones": [own[1].tobytes()]})


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"stretch": [pdf["stretch"].iloc[0]], **{c: [sum(np.frombuffer(x) for x in pdf[c]).tobytes()] for c in ("zeros", "ones")}})


def count_short(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of all slots of the short contexts, whose number is fixed."""
    found = pairs.where("n > 0").select("kind", "word", "n").mapInPandas(_counted, "stretch int, zeros binary, ones binary")
    zeros, ones = np.zeros(int(OFFSETS[-1])), np.zeros(int(OFFSETS[-1]))
    for r in found.groupBy("stretch").applyInPandas(_summed, "stretch int, zeros binary, ones binary").coalesce(4).toLocalIterator():  # a job for each of 4 parts
        for counts, got in ((zeros, r["zeros"]), (ones, r["ones"])):
            own = np.frombuffer(got)
            counts[r["stretch"] * SLOTS : r["stretch"] * SLOTS + len(own)] = own
    return zeros.astype(np.float32), ones.astype(np.float32)


def shared_bits(flat: dict, kinds: np.ndarray) -> np.ndarray:
    """Bits that each word shares with the next one, -1 where kinds differ."""
    b, start, sizes = flat["byte"], flat["start"], flat["sizes"]
    shared = np.full(max(len(sizes) - 1, 0), -1)
    alive, p = np.flatnonzero(kinds[1:] == kinds[:-1]), 0
    while len(alive):
        x, y = b[start[alive] + p], b[start[alive + 1] + p]
        off = x != y
        differ = np.where(off, 7 - np.floor(np.log2(np.maximum(x ^ y, 1))).astype(np.int64), 8)
        shared[alive] = 8 * p + differ
        alive, p = alive[~off], p + 1
        alive = alive[np.minimum(sizes[alive], sizes[alive + 1]) > p]
    return shared


def first_alike(flat: dict, shared: np.ndarray) -> np.ndarray:
    """For each byte the first of those that stand for the same beginning of a word: all their histories are the same."""
    out, start = np.arange(len(flat["byte"])), flat["start"]
    for p in range(int(shared.max(initial=0)) // 8):
        own = np.flatnonzero(np.r_[-1, shared] >= 8 * (p + 1))  # words that have byte p from the one before
        run = np.maximum.accumulate(np.where(np.diff(own, prepend=-2) > 1, np.arange(len(own)), 0))
        out[start[own] + p] = start[own[run] - 1] + p
    return out


def whole_histories(flat: dict, shared: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones, each (bit, byte), under the whole word so far. The words are sorted by kind and by spelling with the
    space, so words that share some bits stand together, and each history is the sum of a stretch of words."""
    b, start, m = flat["byte"], flat["start"], len(n)
    weight = n[flat["of"]]
    ones = np.stack([bits(flat, bit) * weight for bit in range(8)])
    zeros = weight - ones
    depth = np.maximum(np.r_[-1, shared], np.r_[shared, -1])
    for p in range(int(depth.max(initial=-1)) // 8 + 1 if m else 0):
        live = np.flatnonzero(depth >= 8 * p)
        at, own = start[live] + p, n[live]
        joined = np.where(np.diff(live) == 1, shared[live[:-1]], -1)
        for bit in range(8):
            new = np.r_[True, joined < 8 * p + bit]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            one = np.add.reduceat(own * ((b[at] >> (7 - bit)) & 1), first)[group]
            ones[bit, at], zeros[bit, at] = one, np.add.reduceat(own, first)[group] - one
    return zeros, ones


def border(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """(page, key, byte, n): how often each byte follows the beginnings of words that a page shares with its neighbours."""
    r, keys = ends.iloc[0], []
    for own, other in ((("first_kind", "first_word"), ("before_kind", "before_word")), (("last_kind", "last_word"), ("after_kind", "after_word"))):
        if r[other[1]] is not None and r[own[0]] == r[other[0]]:
            a, b = spelled([bytes(r[own[1]]), bytes(r[other[1]])])
            k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            keys.append(flatten([a], np.array([r[own[0]]]))["whole"][: k + 1])
    flat = flatten(spelled(pdf["word"].map(bytes).tolist()), pdf["kind"].to_numpy())
    at = np.flatnonzero(np.isin(flat["whole"], np.concatenate([np.zeros(0, np.int64), *keys])))
    out = pd.DataFrame({"key": flat["whole"][at], "byte": flat["byte"][at].astype(np.int16), "n": pdf["n"].to_numpy(np.int64)[flat["of"][at]]})
    return out.groupby(["key", "byte"], as_index=False)["n"].sum().assign(page=pdf["page"].iloc[0])[["page", "key", "byte", "n"]]


def correct_borders(flat: dict, zeros: np.ndarray, ones: np.ndarray, known: pd.DataFrame) -> None:
    """Put the counts of all pages where a page shares the beginning of a word with its neighbours."""
    for key, own in known.groupby("key"):
        at = np.flatnonzero(flat["whole"] == key)
        byte, n = own["byte"].to_numpy(np.int64), own["n"].to_numpy(float)
        for bit in range(8):
            node, one = byte >> (8 - bit), (byte >> (7 - bit)) & 1
            mine = flat["byte"][at].astype(np.int64) >> (8 - bit)
            ones[bit, at] = np.bincount(node, weights=n * one, minlength=256)[mine]
            zeros[bit, at] = np.bincount(node, weights=n * (1 - one), minlength=256)[mine]


# mixing


def above(x: np.ndarray, edges: tuple) -> np.ndarray:
    """How many edges each number reaches."""
    return sum((x >= edge).view(np.int8) for edge in edges)


def stretched(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched probability of a one, and how much was seen (0 to 5)."""
    n = zeros + ones
    return np.log((ones + 0.05) / (zeros + 0.05)), above(n, (0.5, 1.5, 3.5, 15.5, 255.5))


def gate(seen: list[np.ndarray]) -> np.ndarray:
    """Which weights are used, by what the longer contexts have seen."""
    return seen[-1].astype(np.int64) * 36 + seen[-2].astype(np.int64) * 6 + seen[-3]


SETS, INPUTS = 216, len(TABLES) + 1
SUMS = ["n", "ones", *[f"input_{k}" for k in range(INPUTS)]]  # of a cell's bits


def merged_cells(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells (sorted) and their sums, one row of SUMS each."""
    own, cells = pd.factorize(np.concatenate([c for c, _ in parts]))
    each, order = np.concatenate([x for _, x in parts]), np.argsort(cells)
    return cells[order], np.stack([np.bincount(own, weights=x, minlength=len(cells)) for x in each.T], 1)[order]


class Mixer:
    """Gated weights and an adaptive probability map, fitted to cells of alike bits: same weights' set, same place in the word, alike inputs.

    The sums of a cell don't depend on the order or the grouping of its bits, so tasks count their words' cells, and the sums of all tasks are what
    the weights are fitted to: by Newton's steps, each set's by itself.
    """

    def __init__(self):
        self.weights = np.full((SETS, INPUTS), 0.3)
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, 49))), (48, 1))
        self.counted, self.rate = [], RATE

    def learn(self, inputs, which, row, bit, weight, rate: float = RATE) -> None:
        """Count bits, each `weight` times. `rate`: how far a weight moves in a round of the fit at most."""
        self.rate = rate
        cell = which.astype(np.int64) * 8 + row % 8
        for v in inputs.T:
            cell = cell * (len(LEVELS) + 1) + above(v, LEVELS)
        self.counted.append(merged_cells([(cell, np.c_[weight, weight * bit, inputs * weight[:, None]])]))

    def cells(self) -> pd.DataFrame:
        """All that was counted."""
        if not self.counted:
            return pd.DataFrame(columns=["cell", *SUMS])
        cells, sums = merged_cells(self.counted)
        return pd.DataFrame(sums, columns=SUMS).assign(cell=cells)[["cell", *SUMS]]

    def fit(self) -> Mixer:
        """Weights and map of what was counted since the last fit."""
        if not self.counted:
            return self
        cells, sums = merged_cells(self.counted)
        self.counted = []
        place = cells // (len(LEVELS) + 1) ** INPUTS
        which, row, n, ones = place // 8, place // 8 // 36 * 8 + place % 8, sums[:, 0], sums[:, 1]
        inputs = sums[:, 2:] / n[:, None]
        total = lambda x: np.bincount(which, weights=x, minlength=SETS)
        first = self.weights.copy()
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-self.mixed(inputs, which)))
            off, bend = ones - n * p, n * p * (1 - p)
            slope = np.stack([total(v * off) for v in inputs.T], 1) - (self.weights - first)
            curve = np.stack([np.stack([total(v * w * bend) for w in inputs.T], 1) for v in inputs.T], 1) + np.eye(INPUTS)
            step = np.clip(np.linalg.solve(curve, slope[:, :, None])[:, :, 0], -self.rate, self.rate)
            self.weights = self.weights + step
            if np.abs(step).max() < 1e-9:
                break
        z = (self.mixed(inputs, which) + LIMIT) * 2
        low = np.minimum(z.astype(np.int64), 47)
        z -= low
        total, of = (sum(np.bincount(row * 49 + low + k, weights=w * part, minlength=48 * 49) for k, part in ((0, 1 - z), (1, z))).reshape(48, 49) for w in (ones, n))
        self.map = self.map + (total - of * self.map) / (of + 60)
        return self

    def mixed(self, inputs: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Stretched probability of a one."""
        self.fit() if self.counted else None
        return np.clip(np.einsum("ij,ij->i", inputs, self.weights[which]), -LIMIT, LIMIT)

    def mixed_columns(self, columns: list[np.ndarray], which: np.ndarray) -> np.ndarray:
        """The same of inputs that stand in columns."""
        x = np.zeros(len(which))
        for column, weights in zip(columns, np.ascontiguousarray(self.weights.T)):
            x += column * weights.take(which)
        return np.clip(x, -LIMIT, LIMIT, out=x)

    def refine(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Probability of a one, by half from the map."""
        z = (x + LIMIT) * 2
        low = np.minimum(z.astype(np.int64), 47)
        z -= low
        flat, at = self.map.reshape(-1), row * 49 + low
        q = flat[at] * (1 - z) + flat[at + 1] * z
        return np.clip(0.5 / (1 + np.exp(-x)) + 0.5 * q, 1e-6, 1 - 1e-6)


EXAMPLE = np.dtype([("inputs", "<f8", (len(TABLES) + 1,)), ("which", "<i2"), ("row", "<i2"), ("bit", "u1")])


def learned(words: list[tuple[int, bytes, int, bytes]]) -> Mixer:
    """One mixer, taught by a few words (kind, word, n, examples)."""
    mixer = Mixer()
    bits_ = [np.frombuffer(w[3], EXAMPLE) for w in words]
    x, n = np.concatenate(bits_), np.repeat([float(w[2]) for w in words], [len(b) for b in bits_])
    mixer.learn(x["inputs"], x["which"], x["row"], x["bit"], n)
    return mixer.fit()


def map_row(seen: np.ndarray, at: np.ndarray) -> np.ndarray:
    return seen.astype(np.int64) * 8 + np.minimum(at, 7)


class Spelling:
    """Words in order, with the histories of all bits of their bytes."""

    def __init__(self, words: list[bytes], kinds: np.ndarray, n: np.ndarray, short: tuple, known: pd.DataFrame | None = None):
        self.n, self.short, self.flat = n, short[:2], flatten(words, kinds)
        self.stretched = short[2:] if len(short) > 2 else stretched(*short)
        shared = shared_bits(self.flat, kinds)
        self.zeros, self.ones = whole_histories(self.flat, shared, n)
        self.alike = first_alike(self.flat, shared)
        if known is not None and len(known):
            correct_borders(self.flat, self.zeros, self.ones, known)

    def part(self, words: np.ndarray) -> np.ndarray:
        """Bytes of some words."""
        start, sizes = self.flat["start"][words], self.flat["sizes"][words]
        return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)

    def inputs(self, at: np.ndarray | slice, bit: int, less: float):
        """(columns of stretched inputs, weights' set, map's row, bit) of a bit of some bytes, `less` of its own occurrences left out."""
        flat = {"byte": self.flat["byte"][at], "contexts": [c[at] for c in self.flat["contexts"]]}
        b, found, seen = bits(flat, bit), [], []
        for which in range(len(TABLES) + 1):
            s = slots(flat, bit, which) if which < len(TABLES) else None
            if s is not None and not less:
                found.append(self.stretched[0][s]), seen.append(self.stretched[1][s])
                continue
            zeros, ones = (self.zeros[bit, at], self.ones[bit, at]) if s is None else (self.short[0][s], self.short[1][s])
            if less:
                zeros, ones = np.maximum(zeros - less * (1 - b), 0), np.maximum(ones - less * b, 0)
            st, k = stretched(zeros, ones)
            found.append(st), seen.append(k)
        return found, gate(seen), map_row(seen[-1], self.flat["at"][at]), b

    def examples(self, chosen: np.ndarray) -> list[bytes]:
        """Of each of some training words the inputs, weights' set, map's row and value of all its bits, predicted from histories without one occurrence of itself."""
        at, sizes = self.part(chosen), self.flat["sizes"][chosen]
        each = [(np.stack(columns, 1), *rest) for columns, *rest in (self.inputs(at, bit, 1.0) for bit in range(8))]
        inputs, which, row, b = (np.stack([e[k] for e in each], 1) for k in range(4))
        made = np.zeros(len(at) * 8, EXAMPLE)
        made["inputs"], made["which"], made["row"], made["bit"] = inputs.reshape(len(made), -1), which.reshape(-1), row.reshape(-1), b.reshape(-1)
        return [part.tobytes() for part in np.split(made, np.cumsum(sizes)[:-1] * 8)] if len(chosen) else []

    def teach(self, mixer: Mixer) -> None:
        """Count the bits of all training words, predicted from histories without one occurrence of themselves. What words share at their beginning is one bit, that often."""
        often = np.bincount(self.alike, weights=self.n[self.flat["of"]], minlength=len(self.alike))
        first = np.flatnonzero(often > 0)
        for i in range(0, len(first), STEP):
            at = first[i : i + STEP]
            for bit in range(8):
                columns, which, row, b = self.inputs(at, bit, 1.0)
                mixer.learn(np.stack(columns, 1), which, row, b, often[at])

    def prices(self, mixer: Mixer) -> np.ndarray:
        """log10 probability of each word's bits, its ending space included."""
        out = np.zeros(len(self.alike))
        first = np.flatnonzero(self.alike == np.arange(len(out)))
        for i in range(0, len(first), STEP):
            at = first[i : i + STEP]
            chance = np.ones(len(at))  # of a byte's eight bits, at least 1e-48
            for bit in range(8):
                columns, which, row, b = self.inputs(at, bit, 0.0)
                p = mixer.refine(mixer.mixed_columns(columns, which), row)
                chance *= np.where(b == 1, p, 1 - p)
            out[at] = np.log10(chance)
        return np.bincount(self.flat["of"], weights=out[self.alike], minlength=len(self.n))


def _spelled_page(pdf: pd.DataFrame, known: pd.DataFrame, short: tuple) -> tuple[list[int], list[bytes], Spelling]:
    """A page of (kind, word, n) in order: places in `pdf`, words as they are spelled, and their histories."""
    words, kind = pdf["word"].map(bytes).tolist(), pdf["kind"].to_numpy()
    words = spelled(words)
    order = spelling_order(words, kind)
    own = [words[i] for i in order]
    return order, own, Spelling(own, kind[order], pdf["n"].to_numpy(float)[order], short, known)


def teach_page(pdf: pd.DataFrame, known: pd.DataFrame, short: tuple) -> pd.DataFrame:
    """(cell, sums) of all training words of a page."""
    mixer = Mixer()
    _spelled_page(pdf, known, short)[2].teach(mixer)
    return mixer.cells()


def price_page(pdf: pd.DataFrame, known: pd.DataFrame, short: tuple, mixer: Mixer) -> pd.DataFrame:
    """log10 probabilities (lp) of a page of (kind, word, n)."""
    order, own, spelling = _spelled_page(pdf, known, short)
    lp = np.empty(len(own))
    lp[order] = spelling.prices(mixer)
    return pdf[["bucket", "kind", "word"]].assign(lp=lp)


def price(pairs: DataFrame, short: tuple, page: int = PAGE) -> DataFrame:
    """(bucket, kind, word, lp) of all pairs, spelled in pages of neighbours."""
    pages = max(1, -(-pairs.count() // page))
    placed = pairs.select("bucket", "kind", "word", "n").repartitionByRange(pages, "kind", "word").withColumn("page", F.spark_partition_id())
    placed = settle(placed, "placed")
    one = F.struct("kind", "word")
    ends = placed.groupBy("page").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    row = Window.orderBy("page")  # a row for each page
    ends = ends.select("page", "first", "last", F.lag("last").over(row).alias("before"), F.lead("first").over(row).alias("after"))
    ends = settle(ends.select("page", *[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("first", "last", "before", "after") for f in ("kind", "word")]), "ends")
    borders = settle(placed.groupBy("page").cogroup(ends.groupBy("page")).applyInPandas(border, "page int, key long, byte short, n long"), "borders")
    total = borders.groupBy("key", "byte").agg(F.sum("n").alias("n"))
    known = borders.select("page", "key").distinct().join(total, "key").select("page", "key", "byte", "n")
    st, seen = stretched(*short)
    context = pairs.sparkSession.sparkContext
    sent = context.broadcast((*short, st.astype(np.float32), seen.astype(np.uint8)))
    meets = lambda some, run, schema: some.groupBy("page").cogroup(known.groupBy("page")).applyInPandas(lambda pdf, k: run(pdf, k) if len(pdf) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")]), schema)
    taught = meets(placed.where("n > 0"), lambda pdf, k: teach_page(pdf, k, sent.value), "cell long, " + ", ".join(f"{c} double" for c in SUMS))
    cells = taught.groupBy("cell").agg(*[F.sum(c).alias(c) for c in SUMS])  # some ten thousands, of 216 * 8 * 6^4 at most
    mixer = Mixer()
    rows = np.array([tuple(r) for r in cells.coalesce(4).toLocalIterator()], float).reshape(-1, 1 + len(SUMS))
    mixer.counted = [(rows[:, 0].astype(np.int64), rows[:, 1:])] if len(rows) else []
    mixer = context.broadcast(mixer.fit())
    out = meets(placed, lambda pdf, k: price_page(pdf, k, sent.value, mixer.value), "bucket int, kind int, word binary, lp double")
    out = settle(out, "priced")
    for used in (placed, ends, borders):
        discard(used)
    return out


# phrases


CODES, PHRASES = 16, 500_000  # codes, and pairs of phrases of blocks that are looked up together


def _code(hit: np.ndarray, c: np.ndarray, every: np.ndarray) -> np.ndarray:
    return 4 * above(c, (2, 4, 8)).astype(np.int64) + 2 * (c == every) + hit


def _coded(asked: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's pairs of phrases: to each block their codes, and how often its training phrases have each code."""
    before, after, times = (np.concatenate([_unpack(x, t) for x in asked[name]]) for name, t in (("before", np.int64), ("after", np.int64), ("times", np.int32)))
    order = np.lexsort((after, before))
    x, y = before[order], after[order]
    new_x = np.r_[True, x[1:] != x[:-1]]
    first = np.flatnonzero(new_x | np.r_[True, y[1:] != y[:-1]])
    c, y, of = np.add.reduceat(times[order].astype(np.int64), first), y[first], (np.cumsum(new_x) - 1)[first]
    last = np.lexsort((y, c, of))[np.searchsorted(of, np.arange(of[-1] + 1), side="right") - 1]  # the most frequent, then the largest hash
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new_x) - 1
    most, best, every = c[last][own], y[last][own], np.bincount(of, weights=c).astype(np.int64)[own]
    hit = after == best
    code = np.where(every > 1, _code(hit & (most > 1), np.maximum(most - hit, 1), every - 1), -1)
    held = np.where(every > 0, _code(hit, most, every), -1)
    out, at = [], 0
    for block, i in zip(asked["block"], asked["i"]):
        i = _unpack(i, np.int32)
        mine, at = slice(at, at + len(i)), at + len(i)
        told = held[mine] >= 0
        n = np.bincount(code[mine][code[mine] >= 0], weights=times[mine][code[mine] >= 0], minlength=CODES).astype(np.int64)
        out.append((block, _pack(i[told], np.int32), _pack(code[mine][told], np.int8), _pack(held[mine][told], np.int8), n))
    return pd.DataFrame(out, columns=["block", "i", "code", "held", "n"])


def phrase_codes(blocks: DataFrame) -> DataFrame:
    """(block, i, code, held, n): what the phrase before predicts of some of a block's pairs of phrases (i), for a training
    text (without that occurrence) and for another, and how often training phrases have each code. A code is 2 x class + 1 where the phrase is the
    predicted one, 2 x class where it isn't, -1 where nothing is predicted; pairs without either are left out."""
    n = blocks.agg(F.sum(F.size("times").cast("long"))).first()[0] or 0
    buckets = max(1, -(-n // PHRASES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                to = ((r.before.view(np.uint64) * _MIX) >> np.uint64(32)).astype(np.int64) % buckets
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1))
                parts = [order[edges[b] : edges[b + 1]] for b in range(buckets)]
                out = [(b, r.block, _pack(i, np.int32), _pack(r.before[i], np.int64), _pack(r.after[i], np.int64), _pack(r.times[i], np.int32)) for b, i in enumerate(parts) if len(i)]
                yield pd.DataFrame(out, columns=["bucket", "block", "i", "before", "after", "times"])

    asked = blocks.select("block", "before", "after", "times").mapInPandas(run, "bucket int, block long, i binary, before binary, after binary, times binary")
    return asked.groupBy("bucket").applyInPandas(_coded, "block long, i binary, code binary, held binary, n array<long>")


def match_prices(codes: DataFrame) -> np.ndarray:
    """log10 probability of each code's bit, from how often training phrases have it."""
    n = np.zeros(CODES)
    for r in codes.select(F.posexplode("n").alias("code", "n")).groupBy("code").agg(F.sum("n").alias("n")).collect():
        n[r["code"]] = r["n"]
    n = n.reshape(-1, 2)
    return np.log10((n + 0.5) / (n.sum(1, keepdims=True) + 1)).reshape(-1)


# scores


def score_block(r, go: np.ndarray, match: np.ndarray, n_all: int, v: int, buckets: int) -> pd.DataFrame:
    """Scores of a block's texts, from the replies to what it asked and the codes of its phrases."""
    words, of = r.words.split(b"\n"), np.cumsum(_unpack(r.of, np.int32))
    c, lp = np.zeros(len(words), np.int64), np.zeros(len(of))
    by_word, by_pair, w, p = dealt_order(words, of, buckets)
    for reply in r.replies:
        b = reply["bucket"]
        c[by_word[w[b] : w[b + 1]]] = _unpack(reply["c"], np.int64)
        lp[by_pair[p[b] : p[b + 1]]] = _unpack(reply["lp"], np.float32)
    pair, run, first, at = (_unpack(x, t) for x, t in ((r.pair, np.int32), (r.go, np.uint8), (r.first, np.int32), (r.phrase, np.int32)))
    sizes, apart = _unpack(r.sizes, np.int64), _unpack(r.apart, bool)
    begin = np.cumsum(sizes) - sizes
    cost = np.add.reduceat(go[run] + np.where(run % 2 == 0, lp[pair], 0), first)
    text = np.searchsorted(begin, first, side="right") - 1
    if r.codes is not None and len(r.codes):
        code = np.full((2, int(at.max(initial=0)) + 1), -1)
        for x in r.codes:
            code[:, _unpack(x["i"], np.int32)] = _unpack(x["code"], np.int8), _unpack(x["held"], np.int8)
        own = np.where(at >= 0, np.where(apart[text], code[1][at], code[0][at]), -1)
        cost = np.where(own >= 0, match[own] + np.where(own % 2 == 1, 0, cost), cost)
    base, length = np.log10((c + 1) / (n_all + v + 1)), np.array([0 if x == END else len(x) + 1 for x in words])
    sums = lambda x: np.add.reduceat(x[of][pair], begin)
    return pd.DataFrame({
        "id": pd.Series(_unpack(r.ids, np.int64)).astype("Int64").where(pd.Series(_unpack(r.named, bool))), "held_out": apart, "n_tokens": sizes, "n_known": sums((c > 0).astype(np.int64)),
        "base_score": sums(base), "score": np.bincount(text, weights=cost, minlength=len(sizes)), "n_bytes": sums(length),
    })


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 7 is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from the rows that aren't held out; a training text's phrases are predicted without its own occurrence.
    A null text is empty: its only token is the end.
    Extra columns are ignored, repeated rows are scored apart. Without training rows all histories are empty. Words of any length
    are spelled whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))

    vectors = settle(text_vectors(rows.where(~F.col("held_out"))), "vectors")
    kinds = fit_kinds(vectors)
    discard(vectors)
    blocks = settle(make_blocks(rows, kinds), "blocks")
    buckets = max(1, -(-(blocks.agg(F.sum(F.col("n_words").cast("long"))).first()[0] or 0) // DEALT))
    asked = deal(blocks, buckets)
    pairs = settle(asked.groupBy("bucket").applyInPandas(_gathered, "bucket int, kind int, word binary, n long, c long, lead boolean"), "pairs")
    release(spark)
    n_all, v = pairs.where("lead and c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    priced = price(pairs, count_short(pairs))
    discard(pairs)
    release(spark)
    runs = np.zeros(2 * RUNS)
    for r in blocks.select(F.posexplode("runs").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        runs[r["k"]] = r["n"]
    runs = runs.reshape(-1, 2)
    go = np.log10((runs + 0.5) / (runs.sum(1, keepdims=True) + 1)).reshape(-1)
    codes = settle(phrase_codes(blocks), "codes")
    match = match_prices(codes)
    release(spark)
    replies = deal(blocks, buckets, counted=False).groupBy("bucket").cogroup(priced.groupBy("bucket")).applyInPandas(_replied, "block long, bucket int, c binary, lp binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "c", "lp")).alias("replies"))  # one for each bucket
    codes = codes.groupBy("block").agg(F.collect_list(F.struct("i", "code", "held")).alias("codes"))  # one for each bucket
    used = blocks.select("block", "ids", "named", "apart", "sizes", "pair", "go", "first", "phrase", "words", "of")
    joined = used.join(replies.hint("merge"), "block").join(codes.hint("merge"), "block", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield score_block(r, go, match, n_all, v, buckets)

    out = joined.mapInPandas(run, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    per_byte = -F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score", per_byte.alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
