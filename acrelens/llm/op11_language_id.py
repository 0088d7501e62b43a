"""Language identification by unigrams over a fixed public vocabulary, marginalised over segmentations.

A word may be cut into pieces of the vocabulary in many ways. Its probability in a language is the sum over all of them of the
products of that language's piece probabilities, which a forward pass over the word's bytes adds up. The probabilities are learned
by expectation maximisation from the counts of words in each language.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.llm.shared import discard, settle, table

RUN = regex.compile(r"[\p{L}\p{M}]{1,16}")  # runs of letters and marks; what is longer than 16 is cut
LETTER = regex.compile(r"\p{L}")
LIFT = 10  # every byte's probability is multiplied by 2^LIFT, so that neither tiny nor large products leave the doubles


def default_vocabulary() -> str:
    """Path of the installed byte-level vocabulary for many languages."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks, and each single byte, so that every word can be cut."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    return sorted(found | {bytes([b]) for b in range(256)})


@dataclass
class Trie:
    """Pieces by their bytes: `child` of each (node, byte) in `keys`, and the piece that ends at a node, or -1."""

    keys: np.ndarray
    child: np.ndarray
    piece: np.ndarray


def trie(pieces: list[bytes]) -> Trie:
    keys: dict[int, int] = {}
    ends = {}
    for i, piece in enumerate(pieces):
        node = 0
        for b in piece:
            node = keys.setdefault(node << 8 | b, len(keys) + 1)
        ends[node] = i
    order = sorted(keys)
    found = np.full(len(keys) + 1, -1, np.int64)
    found[list(ends)] = list(ends.values())
    return Trie(np.array(order, np.int64), np.array([keys[k] for k in order], np.int64), found)


@dataclass
class Model:
    index: Trie
    langs: list[str]
    probs: np.ndarray  # pieces x languages
    prior: np.ndarray  # log share of the documents of each language


@dataclass
class Lattice:
    """All pieces in some words, each an edge from a byte to a later one."""

    sizes: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


def lattice(words: list[str], index: Trie) -> Lattice:
    """All words walk through the trie at once, from each of their bytes. They are spelled with a space before them, as pieces that begin one are."""
    spelled = [b" " + w.encode() for w in words]
    sizes = np.array([len(s) for s in spelled], np.int64)
    data = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(data))
    start, stop, node = at, (begin + sizes)[word], np.zeros(len(data), np.int64)
    found = []
    while len(at):
        key = node << 8 | data[at]
        i = np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)
        on = np.flatnonzero(index.keys[i] == key)
        start, stop, node, at = start[on], stop[on], index.child[i[on]], at[on] + 1
        piece = index.piece[node]
        whole = np.flatnonzero(piece >= 0)
        found.append((start[whole], at[whole], piece[whole]))
        on = np.flatnonzero(at < stop)
        start, stop, node, at = start[on], stop[on], node[on], at[on]
    start, end, piece = (np.concatenate(c) for c in zip(*found))
    own = word[start]
    return Lattice(sizes, own, start - begin[own], end - begin[own], piece)


def _sweep(n_words: int, width: int, at: np.ndarray, other: np.ndarray, word: np.ndarray, weight: np.ndarray, first: np.ndarray, positions) -> np.ndarray:
    """Sums over paths, position by position: what reaches `at` is the sum over edges of what reached `other` times the edge's weight."""
    reached = np.zeros((n_words, width, weight.shape[1]))
    reached[np.arange(n_words), first] = 1.0
    order = np.argsort(at * n_words + word, kind="stable")
    begin = np.searchsorted(at[order], np.arange(width + 1))
    for i in positions:
        e = order[begin[i] : begin[i + 1]]
        if len(e):
            ws = word[e]
            edge = np.flatnonzero(np.concatenate([[True], ws[1:] != ws[:-1]]))
            reached[ws[edge], i] = np.add.reduceat(reached[ws, other[e]] * weight[e], edge, axis=0)
    return reached


def forward(lat: Lattice, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lifted probabilities of all beginnings, weights of the edges), by language."""
    weight = np.ldexp(probs[lat.piece], (LIFT * (lat.end - lat.start))[:, None])
    width = int(lat.sizes.max()) + 1
    return _sweep(len(lat.sizes), width, lat.end, lat.start, lat.word, weight, np.zeros(len(lat.sizes), np.int64), range(1, width)), weight


def log_probabilities(words: list[str], index: Trie, probs: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability in each language, over all its segmentations."""
    out = np.zeros((len(words), probs.shape[1]))
    for some in _chunks(words, probs.shape[1]):
        lat = lattice([words[i] for i in some], index)
        alpha, _ = forward(lat, probs)
        out[some] = np.log(alpha[np.arange(len(some)), lat.sizes]) - (lat.sizes * (LIFT * np.log(2)))[:, None]
    return out


def expected_counts(words: list[str], counts: np.ndarray, index: Trie, probs: np.ndarray) -> np.ndarray:
    """How often each piece is used in each language, over all segmentations of words that occur counts[word, language] times."""
    out = np.zeros_like(probs)
    for some in _chunks(words, probs.shape[1]):
        lat = lattice([words[i] for i in some], index)
        alpha, weight = forward(lat, probs)
        width = alpha.shape[1]
        beta = _sweep(len(some), width, lat.start, lat.end, lat.word, weight, lat.sizes, range(width - 2, -1, -1))
        share = counts[some] / alpha[np.arange(len(some)), lat.sizes]
        use = alpha[lat.word, lat.start] * weight * beta[lat.word, lat.end] * share[lat.word]
        for k in range(probs.shape[1]):
            out[:, k] += np.bincount(lat.piece, use[:, k], len(probs))
    return out


def _chunks(words: list[str], langs: int, cells: int = 1 << 20) -> Iterator[np.ndarray]:
    """Places of words of alike lengths, as many at once as `cells` numbers hold."""
    sizes = np.array([4 * len(w) + 2 for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = at + max(1, int(cells // (sizes[order[at]] * max(1, langs))))
        end = min(len(order), at + max(1, int(cells // (sizes[order[min(end, len(order)) - 1]] * max(1, langs)))))
        yield order[at:end]
        at = end


def maximise(used: np.ndarray, own: float = 20.0, even: float = 100.0) -> np.ndarray:
    """Piece probabilities from expected counts: each language leans on the pool of all by `own` counts, the pool on an even spread by `even`."""
    pool = used.sum(1)
    pool = (pool + even / len(pool)) / (pool.sum() + even)
    return (used + own * pool[:, None]) / (used.sum(0) + own)


def word_counts(docs: DataFrame, langs: list[str], held: int = 1 << 20) -> DataFrame:
    """(word, langs, counts): how often each word occurs in which languages (numbers into `langs`)."""
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches):
        seen: dict[int, Counter] = {}

        def full():
            rows = [(w, k, n) for k, c in seen.items() for w, n in c.items()]
            seen.clear()
            return pd.DataFrame(rows, columns=["word", "lang", "n"])

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                seen.setdefault(place[lang], Counter()).update(RUN.findall(text.lower()))
                if sum(map(len, seen.values())) > held:
                    yield full()
        yield full()

    rows = docs.mapInPandas(run, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    each = F.collect_list(F.struct("lang", F.col("n").cast("double").alias("n")))  # one entry a language
    return rows.groupBy("word").agg(each.alias("e")).select("word", F.col("e.lang").alias("langs"), F.col("e.n").alias("counts"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, rounds: int = 3, fit_rows: int = 10_000) -> Model:
    """Piece probabilities of each language of `docs`, learned from whole texts; rows with a null language or text are left out.

    Of a language with more than `fit_rows` documents about so many are taken, those of the smallest hashes of their texts.

    Words are counted by Spark; a round of expectation maximisation is a pass over the distinct words, and sends one number for
    each piece of the vocabulary (`vocabulary`: path of its file) and language to the driver. The first starts from equal probabilities.
    """
    spark = docs.sparkSession
    pieces = read_vocabulary(vocabulary or default_vocabulary())
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    total = sum(sizes.values())
    index = trie(pieces)
    model = Model(index, langs, np.full((len(pieces), len(langs)), 1 / len(pieces)), np.log([sizes[k] / total for k in langs]))
    if not langs:
        return model
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fit_rows / sizes[k]))])[F.col("lang")]
    few = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    words = settle(word_counts(few, langs), "words")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((index, model.probs))

        def run(batches, sent=sent):
            index, probs = sent.value
            used = np.zeros_like(probs)
            for pdf in batches:
                counts = np.zeros((len(pdf), probs.shape[1]))
                sizes = pdf["langs"].map(len).to_numpy()
                if len(pdf):
                    counts[np.repeat(np.arange(len(pdf)), sizes), np.concatenate(pdf["langs"].to_list())] = np.concatenate(pdf["counts"].to_list())
                    used += expected_counts(pdf["word"].to_list(), counts, index, probs)
            piece, lang = np.nonzero(used)
            yield pd.DataFrame({"piece": piece, "lang": lang, "used": used[piece, lang]})

        found = words.mapInPandas(run, "piece int, lang int, used double").groupBy("piece", "lang").agg(F.sum("used").alias("used")).toPandas()
        used = np.zeros_like(model.probs)
        used[found["piece"], found["lang"]] = found["used"]
        model.probs = maximise(used)
        sent.unpersist()
    discard(words)
    return model


def _texts(texts: list, chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Slices of texts that hold about so many characters."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def predict(docs: DataFrame, model: Model, text_col: str = "text", remembered: int = 1 << 18) -> DataFrame:
    """Add lang_pred and score to `docs` (columns of these names give way).

    lang_pred is the language with the highest posterior, score that posterior, from the documents' shares and the probabilities of all
    runs of letters of the whole text, lower-cased, runs of over 16 letters cut. Ties go to the smallest language by code point. A
    text that is null or has no letter gets `und` and 0.0, and so do all where no language was learned. Repeated rows get the same; empty
    tables stay empty; a text's length isn't limited. Each task remembers at most `remembered` distinct words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        known: dict[str, np.ndarray] = {}

        def scores(words: list[str]) -> np.ndarray:
            new = [w for w in words if w not in known]
            found = dict(zip(new, log_probabilities(new, m.index, m.probs))) if new else {}
            out = np.stack([found[w] if w in found else known[w] for w in words])
            if len(known) + len(found) > remembered:
                known.clear()
            known.update(found if len(found) <= remembered else {})
            return out

        for texts in batches:
            texts = texts.to_list()
            pred, share = np.full(len(texts), "und", object), np.zeros(len(texts))
            for a, b in _texts(texts) if m.langs else ():
                runs = [RUN.findall(t.lower()) if t and LETTER.search(t) else [] for t in texts[a:b]]
                sizes = np.array([len(r) for r in runs])
                if not sizes.any():
                    continue
                codes, words = pd.factorize(np.array([w for r in runs for w in r], dtype=object))
                each = scores(list(words))[codes]
                some = np.flatnonzero(sizes)
                total = np.add.reduceat(each, np.cumsum(sizes)[some] - sizes[some], axis=0) + m.prior
                best = total.argmax(1)
                pred[a + some] = np.array(m.langs, object)[best]
                share[a + some] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            yield pd.DataFrame({"lang_pred": pred, "score": share})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), run(F.col(text_col).cast("string")).alias("_found"))
    return found.select(*[F.col(f"_row.`{c}`") for c in kept], "_found.lang_pred", "_found.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
