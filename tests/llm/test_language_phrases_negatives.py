"""Language identification, collocations and hard negatives against brute force, and their edges."""

import re
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acrelens.llm import op11_language_id as lid
from acrelens.llm import op12_collocations as col
from acrelens.llm import op13_hard_negatives as neg

DDL = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = [b" ", b"a", b"b", b"c", b" a", b"ab", b"bc", b"abc", b" ab"]


def cuts(data, pieces):
    if not data:
        yield ()
    for p in pieces:
        if data.startswith(p):
            yield from ((p, *rest) for rest in cuts(data[len(p) :], pieces))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    probs = rng.random((len(PIECES), 2))
    index, words = lid.trie(PIECES), ["", "a", "abc", "cabab", "bbbb", "abcabcab"]
    each = {w: list(cuts(b" " + w.encode(), PIECES)) for w in words}
    chance = lambda cut, k: np.prod([probs[PIECES.index(p), k] for p in cut])
    want = np.array([[np.log(sum(chance(c, k) for c in each[w])) for k in (0, 1)] for w in words])
    assert np.allclose(lid.log_probabilities(words, index, probs), want)
    counts = rng.integers(0, 5, (len(words), 2)).astype(float)
    used = np.zeros_like(probs)
    for i, w in enumerate(words):
        for k in (0, 1):
            for c in each[w]:
                for p in c:
                    used[PIECES.index(p), k] += counts[i, k] * chance(c, k) / np.exp(want[i, k])
    assert np.allclose(lid.expected_counts(words, counts, index, probs), used)
    better = lid.maximise(used)
    assert np.allclose(better.sum(0), 1) and (better > 0).all()
    assert [sorted(i.tolist()) for i in lid._chunks(words, 2, 30)] and sorted(i for c in lid._chunks(words, 2, 30) for i in c.tolist()) == list(range(6))


def test_words_of_any_length_stay_finite():
    pieces = [bytes([b]) for b in range(256)]
    probs = lid.maximise(np.zeros((256, 1)), 1e-9)
    words = ["é" * 16, "\U00020000" * 16, "x"]
    got = lid.log_probabilities(words, lid.trie(pieces), probs)[:, 0]
    assert np.allclose(got, [-np.log(256) * (1 + len(w.encode())) for w in words])


@pytest.fixture(scope="module")
def tongues(spark):
    rng = np.random.default_rng(3)
    stems = {"aa": ["lo", "mi", "ret", "su"], "bb": ["kra", "zop", "whi", "dunk"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k], 3)) for _ in range(int(rng.integers(2, 40)))), k, "s", 1) for i, k in enumerate(["aa", "bb"] * 60)]
    return spark.createDataFrame(rows, DDL)


def test_language_edges(spark, tongues):
    model = lid.train(tongues)
    assert model.langs == ["aa", "bb"]
    got = lid.predict(tongues, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in got.collect())
    odd = [(1, None), (2, ""), (3, "12 34 !?"), (4, "LOMIRET sulo"), (4, "LOMIRET sulo"), (None, "krazop " * 60_000), (6, "z" * 5000), (7, "\U00020000कि"), (8, "½ ²")]
    odd = spark.createDataFrame(odd, "score long, text string").withColumn("lang_pred", F.lit("x")).withColumn("_found", F.lit(2)).withColumn("_row", F.lit(3))
    rows = lid.predict(odd, model).collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und", "und", "aa", "aa", "bb", "bb", rows[7]["lang_pred"], "und"] and rows[7]["lang_pred"] in ("aa", "bb")
    assert [r["score"] for r in rows if r["lang_pred"] == "und"] == [0, 0, 0, 0] and rows[3]["score"] == rows[4]["score"]
    assert rows[0].asDict() == {"text": None, "_found": 2, "_row": 3, "lang_pred": "und", "score": 0.0}
    for docs in (tongues.where("false"), tongues.withColumn("lang", F.lit(None).cast("string")), tongues.withColumn("text", F.lit(None).cast("string"))):
        none = lid.train(docs)
        assert none.langs == [] and {(r["lang_pred"], r["score"]) for r in lid.predict(tongues, none).collect()} == {("und", 0.0)}
    assert lid.predict(tongues.where("false"), model).count() == 0


def test_language_fit_is_bounded(spark, tongues):
    many = lid.word_counts(tongues.select("text", "lang"), ["aa", "bb"])
    want = Counter((w, r["lang"]) for r in tongues.collect() for w in r["text"].split())
    assert {(r["word"], "ab"[k] * 2): n for r in many.collect() for k, n in zip(r["langs"], r["counts"])} == want
    few = lid.train(tongues, fit_rows=20)
    right = [r["lang"] == r["lang_pred"] for r in lid.predict(tongues, few).collect()]
    assert np.mean(right) > 0.95


def held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = lid.query(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    return got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]


def test_held_out_documents(spark):
    assert held_out_accuracy(spark, "/root/testdata/sf0.01") >= 0.98


def plain_collocations(rows, threshold, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < threshold:
            continue
        if any(q[i : i + len(p)] == p and 100 * b >= 80 * a for (g, q), b in f.items() if g == lang and len(q) > len(p) and b >= threshold for i in range(len(q))):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((score, a, " ".join(p), l, r))
    final = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        final += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(final)


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_collocations_match_brute_force(spark, block):
    rng = np.random.default_rng(block)
    words = ["Red", "red", "fox", "été", "fox-x", "\x00", "a b", "is\ta", "the."]
    rows = [(" ".join(rng.choice(words, int(rng.integers(1, 60)))) + str(rng.choice(["", "!", "\r\n", ";;"])), [None, "en", "fr", "und"][int(rng.integers(4))]) for _ in range(80)]
    rows += [(None, "en"), ("", None), (" \t.\n", "zz"), ("red fox " * 900, "en")] + [("to be or not to be", "xx")] * 9
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("a", F.lit(1)).withColumn("block", F.lit("b"))
    for top in (5, 2000):
        got = sorted(map(tuple, col.collocations(docs, threshold=6, top=top, block_bytes=block).collect()))
        assert got == plain_collocations(rows, 6, 4, top) and got
    assert col.collocations(docs.where("false")).count() == 0


def test_summaries_lose_no_frequent_key():
    rng = np.random.default_rng(7)
    for threshold, skew in product((3, 10), (1.1, 2.0)):
        stream = np.minimum(rng.zipf(skew, 6000), 10**6).astype(np.uint64)
        parts = [np.unique(p, return_counts=True) for p in np.array_split(stream, 40)]
        keys, counts = np.unique(stream, return_counts=True)
        got = col.survivors(iter(parts), len(stream), threshold)
        assert set(keys[counts >= threshold]) <= set(got)
        total, counts, lost = col.merge(parts, 50)
        assert len(total) <= 50 and lost <= len(stream) / 51
        true = dict(zip(*np.unique(stream, return_counts=True)))
        assert all(true[k] - lost <= c <= true[k] for k, c in zip(total, counts))
    some = np.unique(rng.integers(0, 1 << 48, 1000).astype(np.uint64))
    assert (col.unpack_keys(col.pack_keys(some)) == some).all() and len(col.unpack_keys(b"")) == 0


def test_colliding_keys_are_counted_apart(spark, monkeypatch):
    monkeypatch.setattr(col, "phrase_keys", lambda lang, words, ids, longest, real=col.phrase_keys: (real(lang, words, ids, longest)[0] % np.uint64(5), *real(lang, words, ids, longest)[1:]))
    words, ids = [b"a", b"b", b"c"], None
    tokens = [b"a", b"b", col.GAP, b"c", b"a", b"b", b"b"]
    ids, words = col.numbered(tokens)
    import pandas as pd

    row = pd.DataFrame([("en", b" ".join(words), col.pack(ids, 4), [col.pack_keys(np.arange(5, dtype=np.uint64))])], columns=["lang", "words", "ids", "keys"])
    got = next(col._counted(3)(iter([row])))
    want = Counter(" ".join(p) for piece in (["a", "b"], ["c", "a", "b", "b"]) for k in (1, 2, 3) for p in zip(*[piece[i:] for i in range(k)]))
    assert Counter(dict(zip(got["phrase"], got["a"]))) == want


def test_exact_products():
    rng = np.random.default_rng(5)
    for dim, size in ((0, 9), (1, 1 << 29), (64, 300), (3000, 1 << 20), (64, 1 << 26)):
        a, b = rng.integers(-size, size + 1, (7, dim)), rng.integers(-size, size + 1, (9, dim))
        bound = dim * size * size + 1
        want = np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a])
        assert (neg.exact_scores(a, b, neg.primes_for(bound)) == want).all()
    full = np.full((1, 5000), 125)
    assert neg.product_modulo(neg.residues(full, 251), neg.residues(full, 251), 251)[0, 0] == 125 * 125 * 5000 % 251
    with pytest.raises(ValueError):
        neg.primes_for(1 << 70)


def plain_negatives(rows, k, m):
    live = []
    for i, (id_, x, label) in enumerate(rows):
        if id_ is None or x is None or label is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = [int(np.floor(256 * float(c))) for c in x]
        if sum(c * c for c in v) < neg.LIMIT:
            live.append((i, id_, v, (label + 1) % 10 if id_ % 7 == 0 else label))
    out = []
    for i, id_, v, label in live:
        if id_ % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), other, same == label) for j, other, w, same in live if j != i and len(w) == len(v))
        for s, pos, _ in [t for t in scores if t[2]][:k]:
            inside = [t for t in scores if not t[2] and 80 * -s <= 100 * -t[0] <= 100 * -s][:m]
            out += [(id_, pos, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block", [8 * 7, 1 << 22])
def test_negatives_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(neg, "_rows", lambda n, dim, block, real=neg._rows: max(1, block // max(1, dim)))
    rng = np.random.default_rng(2)
    rows = [(i * 25, rng.normal(size=8).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(120)]
    rows += [(i, rows[4][1], 1) for i in range(1, 12)] + [rows[4], rows[4], (100, rows[9][1], 2), (-100, rows[8][1], 0)]
    rows += [(200, None, 1), (300, rows[3][1], None), (None, rows[3][1], 1), (400, [1.0, None] * 4, 1), (500, [float("nan")] * 8, 1), (600, [float("inf")] * 8, 1), (700, [1e30] * 8, 1)]
    rows += [(800, [0.0] * 8, 0), (900, [], 1), (901, [], 2), (902, [], 1), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.5], 1), (1002, [1.0, 1.9], 2), (1003, [5e6, -5e6], 1), (1100, [4e6, 4e6], 2)]
    rows = [(i, x, label) for i, x, label in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("v", F.lit(0))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    run = lambda t: sorted(map(tuple, neg.mine(t, F.col("vec_id") % 100 == 0, label, block=block).collect()))
    got, want = run(table), plain_negatives(rows, 5, 5)
    assert got == want and len(got) > 100
    assert run(table.where("false")) == [] and run(table.where("vec_id = 1")) == []


def test_only_keys_that_occur_often_enough_are_spelled():
    """What a summary lets through although all blocks together have it too seldom goes back to no block; what is frequent goes to all that hold it."""
    from acrelens.llm import op12_collocations as op12

    blocks = [(np.arange(1, 101), np.ones(100)), (np.array([500, 600]), np.array([29, 15])), (np.array([600, 700]), np.array([15, 1]))]
    rows = [(b, int(c.sum()), op12.pack_keys(k.astype(np.uint64)), op12.pack(c.astype(np.int64), 4)) for b, (k, c) in enumerate(blocks)]
    assert 500 in op12.survivors(iter([(k.astype(np.uint64), c.astype(np.int64)) for k, c in blocks]), sum(r[1] for r in rows), 30)
    out = op12._replies(30)(pd.DataFrame(rows, columns=["block", "mass", "keys", "counts"]))
    assert {b: op12.unpack_keys(k).tolist() for b, k in zip(out["block"], out["keys"])} == {1: [600], 2: [600]}


def test_blocks_of_a_task_count_a_phrase_once():
    """However many blocks of a language a task reads, it counts each phrase once; the lists of several tasks add up by words."""
    pieces = [[b"red", b"fox", col.GAP, b"red", b"fox"], [b"a", b"red", b"fox"], [b"fox", b"red", b"fox", b"fox"]]
    rows = []
    for lang, tokens in zip(("en", "en", "fr"), pieces):
        ids, words = col.numbered(tokens)
        rows.append((lang, b" ".join(words), col.pack(ids, 4), [col.pack_keys(np.unique(col.phrase_keys(lang, words, ids, 2)[0]))]))
    pdf = pd.DataFrame(rows, columns=["lang", "words", "ids", "keys"])
    got = pd.concat(col._counted(2)(iter([pdf[:1], pdf[1:]])))
    counts = dict(zip(zip(got["lang"], got["phrase"]), zip(got["size"], got["a"])))
    assert len(got) == len(counts) == 10
    assert counts["en", "red fox"] == (2, 3) and counts["fr", "fox"] == (1, 3) and counts["en", "a"] == (1, 1)
    lists = pd.concat([*col._listed(2, 3)(iter([pdf[:1]])), *col._listed(2, 3)(iter([pdf[1:]]))])
    found = pd.concat([col._frequent(3)(own) for _, own in lists.groupby(["part", "lang"])])
    assert set(zip(found["lang"], found["phrase"], found["a"])) == {("en", "red", 3), ("en", "fox", 3), ("en", "red fox", 3), ("fr", "fox", 3)}
