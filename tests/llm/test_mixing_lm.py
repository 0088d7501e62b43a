"""The language model against a plain version that keeps its histories in dictionaries."""

from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
import xxhash

from acrelens.llm import op8_mixing_lm as lm

VOCABULARY = [a + b for a in ("ta", "re", "mo", "li", "nu") for b in ("ka", "so", "vi", "den", "pur", "gl")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY, n))


def histories(rows):
    """(bit prefix, kind) -> zeros and ones of the words (kind, word, n), by whole prefixes and by one to three bytes back."""
    whole, short = {}, {}
    for kind, word, n in rows:
        for key, where, bit in contexts(kind, word):
            for store, k in ((whole, key), *((short, w) for w in where)):
                store.setdefault(k, [0, 0])[bit] += n
    return whole, short


def contexts(kind, word):
    """For each bit of a word: its key by the whole prefix, its slots by one to three bytes back, and the bit."""
    data = word + b" "
    flat = lm.flatten([word], np.array([kind]))
    where = [[lm.slots(flat, bit, k).tolist() for k in range(3)] for bit in range(8)]
    for at, byte in enumerate(data):
        for bit in range(8):
            node = (1 << bit) | (byte >> (8 - bit))
            yield (kind, data[:at], node), [x[at] for x in where[bit]], (byte >> (7 - bit)) & 1


def test_slots_tell_contexts_apart():
    kinds, words = np.array([1, 1, 2, 1]), [b"xyzab", b"qyzab", b"xyzab", b"zab"]
    for which in range(3):
        at = [lm.slots(lm.flatten([w], k[None]), 7, which)[len(w) - 1] for w, k in zip(words, kinds)]  # before "b"
        assert at[0] == at[1] and at[0] != at[2] and (at[0] == at[3]) == (which < 2)


def spelling_of(rows, short=None):
    own = sorted(rows, key=lambda r: (r[0], r[1] + b" "))
    words, kinds, n = [r[1] for r in own], np.array([r[0] for r in own]), np.array([r[2] for r in own], float)
    if short is None:
        zeros, ones = np.zeros(int(lm.OFFSETS[-1])), np.zeros(int(lm.OFFSETS[-1]))
        pdf = pd.DataFrame({"word": [w or lm.END for w in words], "kind": kinds, "n": n})
        for got in lm._counted(iter([pdf])):
            for r in got.itertuples():
                for store, x in ((zeros, r.zeros), (ones, r.ones)):
                    part = np.frombuffer(x)
                    store[r.stretch * lm.SLOTS : r.stretch * lm.SLOTS + len(part)] = part
        short = zeros, ones
    return own, lm.Spelling(words, kinds, n, short)


def test_histories():
    rng = np.random.default_rng(0)
    words = {b"", b"\x01", b"a", b"a\x01", b"ab", b"abc" * 30, b"abc" * 30 + b"d", "\u00e9t\u00e9".encode()} | {bytes(rng.choice(list(b"abc"), rng.integers(1, 7)).astype(np.uint8)) for _ in range(150)}
    rows = [(int(k), w, int(rng.integers(0, 4))) for w in words for k in rng.choice(3, 2, replace=False)]
    own, spelling = spelling_of(rows)
    whole, short = histories(rows)
    i = 0
    for kind, word, _ in own:
        every = list(contexts(kind, word))
        for at in range(len(word) + 1):
            for bit in range(8):
                key, where, _ = every[at * 8 + bit]
                assert [spelling.zeros[bit, i], spelling.ones[bit, i]] == whole[key]
                for which, w in enumerate(where):
                    s = lm.slots(spelling.flat, bit, which)[i]
                    assert [spelling.short[0][s], spelling.short[1][s]] == short[w]
            i += 1


def test_pages_share_their_borders():
    rng = np.random.default_rng(1)
    words = sorted({bytes(rng.choice(list(b"ab\x02"), rng.integers(1, 6)).astype(np.uint8)) for _ in range(120)})
    rows = sorted((int(k), w, int(rng.integers(0, 5))) for w in words for k in (0, 1))
    whole, _ = histories(rows)
    for size in (1, 5, 17):
        pages = [rows[i : i + size] for i in range(0, len(rows), size)]
        frames = [pd.DataFrame(p, columns=["kind", "word", "n"]).assign(page=i) for i, p in enumerate(pages)]
        out = []
        for i, p in enumerate(pages):
            ends = {f"{name}_{f}": (None if r is None else r[k]) for name, r in (("first", p[0]), ("last", p[-1]), ("before", pages[i - 1][-1] if i else None), ("after", pages[i + 1][0] if i + 1 < len(pages) else None)) for k, f in enumerate(("kind", "word"))}
            out.append(lm.border(frames[i], pd.DataFrame([ends])))
        every = pd.concat(out)
        total = every.groupby(["key", "byte"], as_index=False)["n"].sum()
        for i, p in enumerate(pages):
            known = total[total["key"].isin(out[i]["key"])]
            own = sorted(p, key=lambda r: (r[0], r[1] + b" "))
            s = lm.Spelling([r[1] for r in own], np.array([r[0] for r in own]), np.array([r[2] for r in own], float), (np.zeros(1), np.zeros(1)), known)
            want = [whole[key] for kind, word, _ in own for key, _, _ in contexts(kind, word)]
            got = np.stack([s.zeros.T.reshape(-1), s.ones.T.reshape(-1)], 1)
            assert (got == np.array(want)).all()


def mixer_of(rows, spelling):
    every = np.arange(len(rows))
    return lm.learned([(k, w, n, x) for (k, w, n), x in zip(rows, spelling.examples(every))])


def test_words_are_some_of_all_words():
    rng = np.random.default_rng(0)
    rows = [(1, w.encode(), 50) for w in VOCABULARY]
    own, spelling = spelling_of(rows)
    mixer = mixer_of(own, spelling)
    known = spelling.prices(mixer)
    assert known.mean() > -2.2
    strange = [(1, bytes(rng.permutation(list(w)).astype(np.uint8)), 0) for _, w, _ in own]
    extra = [r for r in strange if r[1] not in {w for _, w, _ in own}]
    both, mixed = spelling_of(rows + list(dict.fromkeys(extra)), spelling.short)
    lp = mixed.prices(mixer)
    assert lp[[r[2] > 0 for r in both]].mean() > lp[[r[2] == 0 for r in both]].mean() + 1
    singles = [(1, bytes([b]), 0) for b in range(256) if bytes([b]) not in (b" ",)]
    _, one = spelling_of(rows + singles + [(1, b"", 0)], spelling.short)
    assert (10.0 ** one.prices(mixer)).sum() <= 1 + 1e-6


def plain_score(rows, apart):
    """Scores of texts by dictionaries, for kinds that nothing tells apart."""
    texts = [[*(t or "").encode().lower().split(), b" "] for _, t in rows]
    pairs, runs, follow, placed = Counter(), Counter(), Counter(), []
    for words, out in zip(texts, apart):
        run, phrase, before, own = 0, [], None, []
        for i, w in enumerate(words):
            same = i > 0 and words[i - 1] == w
            run = 0 if i == 0 else (min(run + 1, 3) if i > 1 and words[i - 1] == words[i - 2] else 1)
            kind = 0 if i < lm.PROBE else 1
            phrase.append((w, kind, run, same))
            if not out:
                runs[run, same] += 1
            if not same:
                pairs[kind, b"" if w == b" " else w] += not out
            if w == b" " or xxhash.xxh64_intdigest(w) % lm.PHRASE == 0:
                name = tuple(x[0] for x in phrase)
                own.append((before, name, phrase))
                if before is not None and not out:
                    follow[before, name] += 1
                before, phrase = name, []
        placed.append(own)
    whole, short = histories([(k, w, n) for (k, w), n in pairs.items()])
    words = sorted(pairs, key=lambda p: (p[0], p[1] + b" "))

    def inputs(p, less):
        for at, (key, where, bit) in enumerate(contexts(*p)):
            st, seen = [], []
            for z, o in [*(short[w] for w in where), whole[key]]:
                z, o = (max(z - less * (1 - bit), 0), max(o - less * bit, 0)) if less else (z, o)
                a, b = lm.stretched(np.array([float(z)]), np.array([float(o)]))
                st.append(a[0]), seen.append(int(b[0]))
            yield st, seen[3] * 36 + seen[2] * 6 + seen[1], seen[3] * 8 + min(at // 8, 7), bit, pairs[p]

    mixer = lm.Mixer()
    drawn = [i for i, p in enumerate(words) if crc32(p[1]) % lm.LEARN == 0 and pairs[p] > 0]
    order = np.random.default_rng(4).permutation(drawn)
    assert len(order) <= lm.STEP
    every = [list(inputs(words[i], 1.0)) for i in order]
    for bit in range(8):
        x = [b for p in every for b in p[bit::8]]
        if x:
            mixer.learn(np.array([b[0] for b in x]), *(np.array([b[k] for b in x]) for k in (1, 2, 3)), np.array([b[4] for b in x], float), 0.15)
    price = {}
    for p in words:
        x = list(inputs(p, 0.0))
        q = mixer.refine(mixer.mixed(np.array([b[0] for b in x]), np.array([b[1] for b in x])), np.array([b[2] for b in x]))
        price[p] = sum(np.log10(v if b[3] else 1 - v) for v, b in zip(q, x))
    go = lambda run, same: np.log10((runs[run, same] + 0.5) / (runs[run, True] + runs[run, False] + 1))
    tops, codes = {}, Counter()
    for (before, name), c in follow.items():
        tops.setdefault(before, []).append((c, name))

    def hashed(name):
        h = np.array([xxhash.xxh64_intdigest(w) for w in name], np.uint64)
        return int(lm.phrases_of(np.arange(len(h)), np.zeros(len(h), np.int64), h)[1][-1:].view(np.int64)[0])

    def code(before, name, out):
        found = tops.get(before)
        if before is None or not found:
            return None
        most, _, best = max((c, hashed(n), n) for c, n in found)
        every, hit = sum(c for c, _ in found), name == best
        if out:
            return hit, most, every
        return (hit and most > 1, max(most - hit, 1), every - 1) if every > 1 else None

    cls = lambda c: (min(int(np.log2(c[1])), 3), c[1] == c[2])
    for own, out in zip(placed, apart):
        for before, name, _ in own:
            if not out and (c := code(before, name, out)):
                codes[cls(c), c[0]] += 1
    scores = []
    for own, out in zip(placed, apart):
        total = 0.0
        for before, name, phrase in own:
            cost = sum(go(run, same) + (0 if same else price[kind, b"" if w == b" " else w]) for w, kind, run, same in phrase)
            if c := code(before, name, out):
                bit = np.log10((codes[cls(c), c[0]] + 0.5) / (codes[cls(c), True] + codes[cls(c), False] + 1))
                cost = bit + (0 if c[0] else cost)
            total += cost
        scores.append(total)
    return scores


def test_scores_are_those_of_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm, "fit_kinds", lambda x: np.zeros((lm.KINDS, lm.CLASS_DIMS + 1)))
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, int(rng.integers(0, 50)))) for i in range(40)]
    copied = prose(rng, 120)
    rows += [(50, copied), (51, copied), (52, copied + " " + prose(rng, 30)), (60, None), (61, "ta ta ta ta ta re re"), (62, "W" * 3000 + " " + prose(rng, 5000))]
    apart = [crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for (i, _), want in zip(rows, plain_score(rows, apart)):
        assert got[i] == pytest.approx(want, abs=1e-3), i
    single = next(i for i, t in rows if t and len(t.split()) > 40 and i < 40)
    assert got[50] / 121 > 0.5 * got[single] / (len(dict(rows)[single].split()) + 1)  # what occurs again costs far less


def test_one_mixer_for_all_pages(spark):
    """However words are paged, their probabilities are the same, and those of all words of a kind sum to at most 1."""
    rng = np.random.default_rng(2)
    words = {w.encode() for w in VOCABULARY} | {bytes(rng.choice(list(b"abcdef"), rng.integers(1, 5)).astype(np.uint8)) for _ in range(900)} | {lm.END}
    rows = [(0, k, w, int(rng.integers(0, 9))) for w in words for k in (0, 1)]
    pairs = spark.createDataFrame(rows, "bucket int, kind int, word binary, n long")
    short = lm.count_short(pairs)
    lp = {page: {(r["kind"], bytes(r["word"])): r["lp"] for r in lm.price(pairs, short, page).collect()} for page in (40, 20_000)}
    assert len(lp[40]) == len(rows) and all(abs(lp[40][k] - lp[20_000][k]) < 1e-9 for k in lp[40])
    for kind in (0, 1):
        assert 0.3 < sum(10.0**v for (k, _), v in lp[40].items() if k == kind) <= 1 + 1e-6


def test_every_training_word_teaches_the_mixer():
    """What a page counts for the mixer are the bits of all its training words, each as often as it occurs."""
    rng = np.random.default_rng(3)
    words = {bytes(rng.choice(list(b"abcdef"), rng.integers(1, 6)).astype(np.uint8)) for _ in range(3000)}
    rows = [(k, w, int(rng.integers(0, 4))) for w in sorted(words) for k in (0, 1)]
    own, spelling = spelling_of(rows)
    page = pd.DataFrame([(0, k, w, n) for k, w, n in rows], columns=["bucket", "kind", "word", "n"])
    cells = lm.teach_page(page, pd.DataFrame(), spelling.short)
    assert cells["n"].sum() == 8 * sum((len(w) + 1) * n for _, w, n in own)
    each = lm.Mixer()
    for (_, _, n), x in zip(own, spelling.examples(np.arange(len(own)))):
        if n:
            x = np.frombuffer(x, lm.EXAMPLE)
            each.learn(x["inputs"], x["which"], x["row"], x["bit"], np.full(len(x), float(n)))
    want = each.cells()
    assert (want["cell"].to_numpy() == cells["cell"].to_numpy()).all() and np.allclose(want[lm.SUMS], cells[lm.SUMS])


def test_kinds_are_fitted_to_all_texts(spark):
    """Texts of which a sample of 4,000 holds none or a few shift the kinds as the rest does."""
    rows = [(i, "ba bab abba baba " * 3 if i % 9 else "xyx yxxy xyxy " * 3) for i in range(9000)]
    kinds = lm.fit_kinds(lm.text_vectors(spark.createDataFrame(rows, "id long, text string").repartition(9)))
    mass = np.exp(kinds[:, -1])
    strange = kinds[:, :-1][:, lm._pairs([b"xyx"])].sum(1) > kinds[:, :-1][:, lm._pairs([b"aba"])].sum(1)
    assert abs(mass[strange].sum() - 1 / 9) < 2e-3 and abs(mass.sum() - 1) < 1e-6


def test_phrases_are_foretold_alike_however_texts_are_blocked(spark, monkeypatch):
    """A held-out text's phrases are foretold by a training text that alone has them, also where one block holds both."""
    monkeypatch.setattr(lm, "fit_kinds", lambda x: np.zeros((lm.KINDS, lm.CLASS_DIMS + 1)))
    rng = np.random.default_rng(6)
    apart = [i for i in range(400) if crc32(str(i).encode()) % 7 == 2]
    taught = [i for i in range(400) if i not in apart]
    rows = [(i, prose(rng, 60)) for i in taught[:40]]
    rows += [(i, t) for i, (_, t) in zip(apart, rows[:10])]  # each pair of phrases once in training texts, once held out
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_score(rows, [i in apart for i, _ in rows])
    for placed in (docs.coalesce(1), docs.repartition(9)):  # a block for each part
        got = {r["doc_id"]: r["score"] for r in lm.score(placed).collect()}
        assert [got[i] for i, _ in rows] == pytest.approx(want, abs=1e-3)


def test_tasks_do_not_send_their_texts_to_the_driver(spark):
    """With many tasks: the results of a stage stay under a limit that the first rows of all tasks together pass."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(200))) for i in range(1600)]
    vectors = lm.text_vectors(spark.createDataFrame(rows, "id long, text string").repartition(16, "id")).persist()
    plain = vectors.orderBy(lm.F.xxhash64("at", "x"), "at", "x").limit(4).collect()
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", str(sum(len(r["at"]) + len(r["x"]) for r in plain) * 2))
    try:
        few = lm.first_vectors(vectors)
    finally:
        conf.set("spark.driver.maxResultSize", before)
        vectors.unpersist()
    assert [(r["at"], r["x"], r["sizes"]) for r in few] == [(r["at"], r["x"], r["sizes"]) for r in plain]
