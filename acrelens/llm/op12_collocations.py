"""Collocations: phrases whose words occur together far more often than their parts allow.

Every phrase of up to four words has a hash, and the range of hashes is cut into partitions. Each partition is summed up by
mergeable Misra-Gries summaries with more counters than its mass divided by the threshold, so no frequent phrase is lost.
A second pass over the texts counts the survivors exactly, by their words; each task's counts meet the others' as lists, one for each part of the phrases. Scores and pruning are joins of what is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelens.llm.shared import discard, settle, table

GAP = b"\xff"  # between pieces; no UTF-8 text holds this byte
#: A-Z become small; what ends a piece becomes a line feed, a tab a space
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
KEY_BITS = 48


def words_of(text: str) -> list[bytes]:
    """The words of a text, lower-cased, with GAP between pieces."""
    return text.encode().translate(PLAIN).replace(b"\n", b" " + GAP + b" ").split()


def numbered(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Number of each token, 0 for GAP, and the distinct tokens in the order of their numbers."""
    ids, words = pd.factorize(np.array([GAP, *tokens], dtype=object))
    return ids.astype(np.int32), list(words)


def phrase_keys(lang: str, words: list[bytes], ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and number of words of every phrase of up to `longest` words that crosses no GAP."""
    own = pd.util.hash_array(np.array(words, dtype=object), categorize=False) ^ pd.util.hash_array(np.array([lang], dtype=object), categorize=False)
    h, gap = own[ids], ids == 0
    keys, places, lengths = [], [], []
    mixed, broken = np.full(len(ids), 0x9E3779B97F4A7C15, np.uint64), np.zeros(len(ids), bool)
    for n in range(1, longest + 1):
        rest = max(len(ids) - n + 1, 0)
        broken = broken[:rest] | gap[n - 1 :]
        mixed = (mixed[:rest] ^ (mixed[:rest] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[n - 1 :]
        at = np.flatnonzero(~broken)
        k = mixed[at]
        k = (k ^ (k >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        keys.append(k >> np.uint64(64 - KEY_BITS)), places.append(at), lengths.append(np.full(len(at), n, np.int8))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(lengths)


def pack(numbers: np.ndarray, width: int) -> bytes:
    """Planes of the lowest `width` bytes of non-negative numbers; the shuffle compresses those that are all alike."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """The same of the steps between sorted keys."""
    return pack(np.diff(keys, prepend=np.uint64(0)), KEY_BITS // 8)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, KEY_BITS // 8), dtype=np.uint64)


def merge(summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One Misra-Gries summary of several: counts of a key are added, then all lessened by the first that has no room.

    Also returns by how much they were lessened: capacity + 1 keys lose so much each, so all merges of a mass m take at most
    m / (capacity + 1) off any count.
    """
    keys, counts = (np.concatenate(parts) for parts in zip(*summaries))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    kept = counts > cut
    return keys[kept], counts[kept] - cut, cut


def survivors(summaries: Iterator[tuple[np.ndarray, np.ndarray]], mass: int, threshold: int) -> np.ndarray:
    """Sorted keys among which are all that occur `threshold` times or more in summaries of altogether `mass` occurrences.

    The capacity exceeds mass / threshold, so counts lose less than the threshold. Summaries wait until they fill a
    capacity and are merged together.
    """
    capacity = mass // threshold + 1
    total, lost, waiting, held = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0, [], 0
    for keys, counts in summaries:
        waiting.append((keys, counts))
        held += len(keys)
        if held > capacity:
            *total, cut = merge([total, *waiting], capacity)
            lost, waiting, held = lost + cut, [], 0
    *total, cut = merge([total, *waiting], capacity)
    return total[0][total[1] + lost + cut >= threshold]


def tokenised(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, lang, n, words, ids): the words of about `block_bytes` of one language's texts, each word spelled once."""

    def run(batches):
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def full(langs):
            rows = []
            for lang in langs:
                tokens = held.pop(lang)
                del size[lang]
                ids, words = numbered(tokens)
                rows.append((lang, int((ids != 0).sum()), b" ".join(words), pack(ids, 4)))
            return pd.DataFrame(rows, columns=["lang", "n", "words", "ids"])

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                held.setdefault(lang, []).extend([*words_of(text), GAP])
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= block_bytes:
                    yield full([lang])
                while sum(size.values()) >= 8 * block_bytes:  # many languages
                    yield full([max(size, key=size.get)])
        yield full(list(held))

    rows = docs.mapInPandas(run, "lang string, n long, words binary, ids binary")
    return rows.withColumn("block", F.monotonically_increasing_id())


def _pieces(row) -> tuple[list[bytes], np.ndarray]:
    return row.words.split(b" "), unpack(row.ids, 4).astype(np.int32)


def _summaries(parts: int, longest: int):
    """Of each block and hash partition: its distinct keys, their counts, and the mass."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                words, ids = _pieces(row)
                keys, counts = np.unique(phrase_keys(row.lang, words, ids, longest)[0], return_counts=True)
                part = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                out = [(part[a], row.block, counts[a:b].sum(), pack_keys(keys[a:b]), pack(counts[a:b], 4)) for a, b in zip(edge, [*edge[1:], len(keys)])]
                yield pd.DataFrame(out, columns=["part", "block", "mass", "keys", "counts"])

    return run


def _replies(threshold: int):
    """Of a hash partition: to each block the keys that survive and occur `threshold` times or more, as the blocks' counts together say.

    Summaries let through what loses less than the threshold; without the exact sums blocks would spell each of those again.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each = ((unpack_keys(k), unpack(c, 4).astype(np.int64)) for k, c in zip(pdf["keys"], pdf["counts"]))
        live = survivors(each, int(pdf["mass"].sum()), threshold)
        total = np.zeros(len(live), np.int64)
        for k, c in zip(pdf["keys"], pdf["counts"]):
            keys = unpack_keys(k)
            kept = np.isin(keys, live, assume_unique=True)
            total[np.searchsorted(live, keys[kept])] += unpack(c, 4)[kept].astype(np.int64)
        live = live[total >= threshold]  # a key's sum is at least that of each of its phrases
        rows = []
        for block, data in zip(pdf["block"], pdf["keys"]):
            keys = unpack_keys(data)
            kept = keys[np.isin(keys, live, assume_unique=True)]
            if len(kept):
                rows.append((block, pack_keys(kept)))
        return pd.DataFrame(rows, columns=["block", "keys"])

    return run


def _counted(longest: int, most: int = 1 << 19):
    """Exact counts of the phrases whose keys survive, by their words: of all blocks of a task together, or of as many as have about `most` phrases."""

    def frame(held):
        rows = [(lang, p.count(" ") + 1, p, n) for lang, found in held.items() for p, n in found.items()]
        return pd.DataFrame(rows, columns=["lang", "size", "phrase", "a"])

    def run(batches):
        held: dict[str, dict[str, int]] = {}
        for pdf in batches:
            for row in pdf.itertuples():
                words, ids = _pieces(row)
                keys, places, lengths = phrase_keys(row.lang, words, ids, longest)
                kept = np.isin(keys, np.concatenate([unpack_keys(k) for k in row.keys]))
                keys, places, lengths = keys[kept], places[kept], lengths[kept]
                # phrases of one key are nearly always one phrase; where they aren't, each is counted for itself
                order = np.lexsort((places, lengths, keys))
                keys, places, lengths = keys[order], places[order], lengths[order]
                same = np.ones(max(len(keys) - 1, 0), bool)
                same &= (keys[1:] == keys[:-1]) & (lengths[1:] == lengths[:-1])
                for n in range(longest):
                    ends = np.minimum(places + n, len(ids) - 1)
                    same &= (ids[ends[1:]] == ids[ends[:-1]]) | (lengths[1:] <= n)
                edge = np.flatnonzero(np.concatenate([[True], ~same])) if len(keys) else np.zeros(0, np.int64)
                text = np.array(["", *[w.decode() for w in words[1:]]], dtype=object)  # none for GAP
                later, at, size = " " + text, places[edge], lengths[edge]
                phrase = text[ids[at]]
                for k in range(1, longest):
                    longer = np.flatnonzero(size > k)
                    phrase[longer] += later[ids[at[longer] + k]]
                found = held.setdefault(row.lang, {})
                for p, n in zip(phrase.tolist(), np.diff(np.append(edge, len(keys))).tolist()):
                    found[p] = found.get(p, 0) + n
                if sum(map(len, held.values())) >= most:
                    yield frame(held)
                    held = {}
        yield frame(held)

    return run


def _listed(longest: int, parts: int):
    """The same counts as lists by language and hash of the phrase: (part, lang, phrases, counts)."""

    def run(batches):
        for pdf in _counted(longest)(batches):
            for lang, own in pdf.groupby("lang", sort=False):
                part = (pd.util.hash_array(own["phrase"].to_numpy(object), categorize=False) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                phrases, counts = own["phrase"].to_numpy(object)[order].tolist(), own["a"].to_numpy(np.int64)[order]
                edges = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                out = [(k, lang, "\n".join(phrases[a:b]), pack(counts[a:b], 6)) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]  # no phrase holds a line feed
                yield pd.DataFrame(out, columns=["part", "lang", "phrases", "counts"])

    return run


def _frequent(threshold: int):
    """The phrases of a list's part whose counts together reach the threshold, by their words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        phrases = [p for data in pdf["phrases"] for p in data.split("\n")]
        of, names = pd.factorize(np.array(phrases, dtype=object))
        a = np.zeros(len(names), np.int64)
        np.add.at(a, of, np.concatenate([unpack(c, 6) for c in pdf["counts"]]).astype(np.int64))
        kept = names[a >= threshold]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "size": [p.count(" ") + 1 for p in kept], "phrase": kept, "a": a[a >= threshold]})

    return run


def frequent_phrases(docs: DataFrame, threshold: int = 30, longest: int = 4, block_bytes: int = 4 << 20, part_mass: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a) of the phrases of up to `longest` words with a >= threshold occurrences in a language, and (lang, n).

    `docs` has lang and text, without nulls. A block holds about `block_bytes` of a language's text, a hash partition about `part_mass`
    occurrences besides those of phrases so frequent that each block sends them as one entry. Both are written tables.
    """
    tokens = settle(tokenised(docs, block_bytes), "tokens")
    totals = tokens.groupBy("lang").agg(F.sum("n").alias("n"))
    n = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(64, -(-longest * n // part_mass))
    slim = tokens.select("block", "lang", "words", "ids")
    summed = slim.mapInPandas(_summaries(parts, longest), "part long, block long, mass long, keys binary, counts binary")
    replies = summed.groupBy("part").applyInPandas(_replies(threshold), "block long, keys binary")
    replies = replies.groupBy("block").agg(F.collect_list("keys").alias("keys"))  # at most one entry for each key that the block holds
    listed = slim.join(replies, "block").mapInPandas(_listed(longest, max(16, parts // 8)), "part long, lang string, phrases string, counts binary")
    frequent = settle(listed.groupBy("part", "lang").applyInPandas(_frequent(threshold), "lang string, size int, phrase string, a long"), "phrases")
    totals = settle(totals, "totals")
    discard(tokens)
    return frequent, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = 30, longest: int = 4, cover: tuple[int, int] = (80, 100), top: int | None = 2000, block_bytes: int = 4 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to `longest` words, best first.

    A text is lower-cased (A-Z), cut at `. , ; : ! ?` and line ends into pieces, and those at spaces and tabs into words. a is how often
    a phrase occurs, overlaps included, l and r how often the two parts of its weakest cut, n the language's number of words,
    score floor(2,000,000 a / (l + r)); the lowest score counts, ties go to the shortest first part. Phrases with a below `threshold` are
    out, and those inside a longer candidate that has at least cover[0] of each cover[1] of their occurrences. Ties in rank: a descending, then phrase in the order
    of its UTF-8 bytes. All counts are exact and of whole texts.

    Null language: `und`, together with texts that say so. Null and empty texts have no words. Repeated rows count each time. Empty tables
    give no rows. Other columns, whatever their names, aren't read. A very long text is one task's work, in a block of its own.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    frequent, totals = frequent_phrases(texts.where("text is not null and text <> ''"), threshold, longest, block_bytes)
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice("_w", start, size), " ")
    candidates = frequent.where("size > 1").withColumn("_w", words)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "size", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    counts = lambda phrase, a: frequent.select("lang", F.col("phrase").alias(phrase), F.col("a").alias(a))
    cuts = cuts.join(counts("first", "l"), ["lang", "first"]).join(counts("rest", "r"), ["lang", "rest"])
    exact = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = cuts.withColumn("score", exact).groupBy("lang", "size", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("s"))
    # what lies inside longer candidates, with the most that one of them has
    spans = [F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(size).alias("size")) for size in range(3, longest + 1) for n in range(2, size) for i in range(1, size - n + 2)]
    if spans:
        longer = candidates.where("size > 2").withColumn("s", F.explode(F.filter(F.array(*spans), lambda s: s["size"] == F.col("size"))))
        inside = longer.select("lang", part(F.col("s.i"), F.col("s.n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        weakest = weakest.join(inside, ["lang", "phrase"], "left").where(
            F.col("most").isNull() | (F.col("most").cast("decimal(22,0)") * cover[1] < F.col("a").cast("decimal(22,0)") * cover[0])
        )
    ranked = weakest.join(totals, "lang").select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)  # each task keeps its own best before rows of a language meet
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS size),
starts AS (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM pieces, sizes WHERE len(w) >= size),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT lang, phrase, a, w, size, unnest(generate_series(1, size - 1)) AS k FROM c),
scored AS (SELECT u.lang, u.phrase, u.a, u.k, x.a AS l, y.a AS r, (2000000::HUGEINT * u.a) // (x.a + y.a) AS score FROM cuts u
    JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.k], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.k + 1:u.size], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
lasting AS (SELECT * FROM weakest s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = s.lang AND c.size > len(string_split(s.phrase, ' '))
    AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ') AND 100::HUGEINT * c.a >= 80::HUGEINT * s.a))
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lasting s JOIN totals t ON t.lang = s.lang QUALIFY rank <= 2000
"""
