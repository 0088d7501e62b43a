"""Toxicity: Levenshtein automata over a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned from labelled rows: terms and stems whose share of the words is far higher in documents
that are marked. Each distinct word runs through one lazily determinised automaton, the product of the
lexicon's trie with a Levenshtein automaton, so misspelled terms are caught at the cost of a few
dictionary lookups. A hit's evidence is the log of how much likelier it is in marked documents; hits in quotations count
less. A document's score is a logistic function, growing with the hits, of the most evidence that a window of its
words holds, so a toxic passage counts the same in a long text as alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.llm.shared import discard, settle, table

FIT_ROWS = 20_000  # labelled rows that the model is fitted on, at most
MIN_LEN, MAX_LEN = 3, 12  # letters of a stem
DENSE = 0.01  # share of a document's words at which a term counts fully
MOST = 20.0  # evidence beyond which a text is as toxic as can be
MISSPELLED, QUOTED = 0.2, 0.2  # how likely a misspelling is against the term itself; what a quoted hit counts
NEAR = 3  # words around a hit that are looked at for signs of quotation
#: Signs written for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
OPEN, CLOSE = "\"'“‘«„‹", "\"'”’»“›"
#: Words that report what others say.
REPORTING = frozenset("said says wrote writes quote quoted quoting called calls term word words slur phrase reported reports stated".split())
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    """A lower-cased word without signs at its ends, with signs inside read as letters."""
    word = EDGES.sub("", word)
    return word if word.isalpha() or word.isdigit() else word.translate(SIGNS)


def allowed_edits(term: str) -> int:
    """Edits by which a misspelled word may differ: none below 5 letters, 1 below 9, else 2."""
    return (len(term) >= 5) + (len(term) >= 9)


class Automaton:
    """The trie of a lexicon intersected with a Levenshtein automaton, determinised as words are met.

    terms: term -> whole. A whole term matches with any ending, a stem at a word's start; with edits
    (see allowed_edits, anywhere in the term) a whole term matches whole words, and a stem the start of a word.
    """

    def __init__(self, terms: dict[str, bool]):
        self.terms = sorted(terms)
        self.whole = [terms[t] for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.most: list[int] = [0]  # the most edits of a term at or below a node
        for own, term in enumerate(self.terms):
            path = [0]
            for c in term:
                if c not in self.children[path[-1]]:
                    self.children[path[-1]][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                path.append(self.children[path[-1]][c])
            for node in path:
                self.most[node] = max(self.most[node], allowed_edits(term))
            self.ends[path[-1]] = own
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.after: list[dict[str, int]] = []
        self.accepts: list[tuple] = []
        self.start = self._number({(0, 0)})

    def _number(self, states: set) -> int:
        """The determinised state of (node, edits) pairs, closed under left-out letters, the fewest edits by node."""
        todo = list(states)
        while todo:
            node, e = todo.pop()
            for below in self.children[node].values():
                if e < self.most[below] and (below, e + 1) not in states:
                    states.add((below, e + 1))
                    todo.append((below, e + 1))
        least: dict[int, int] = {}
        for node, e in states:
            least[node] = min(e, least.get(node, e))
        own = frozenset(least.items())
        if own not in self.number:
            self.number[own] = len(self.sets)
            self.sets.append(own)
            self.after.append({})
            ends = [(e, -len(self.terms[self.ends[n]]), self.ends[n]) for n, e in own if n in self.ends and e <= allowed_edits(self.terms[self.ends[n]])]
            exact = min([x for x in ends if x[0] == 0], default=None)
            begun = min([x for x in ends if x[0] and not self.whole[x[2]]], default=None)
            ended = min([x for x in ends if x[0]], default=None)
            self.accepts.append(tuple(x and x[2] for x in (exact, begun, ended)))
        return self.number[own]

    def _step(self, state: int, c: str) -> int:
        after = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                after.add((self.children[node][c], e))
            if e < self.most[node]:
                after.add((node, e + 1))
                after.update((below, e + 1) for below in self.children[node].values() if e < self.most[below])
        got = self.after[state][c] = self._number(after)
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(term's number, kind): kind 3 for a whole term, 2 for a stem, 1 for either but for a few edits; None for neither."""
        state, begun = self.start, None
        for c in word:
            after = self.after[state].get(c)
            state = self._step(state, c) if after is None else after
            exact, near, _ = self.accepts[state]
            if exact is not None:
                return exact, 2 + self.whole[exact]
            begun = near if begun is None else begun
            if not self.sets[state]:
                break
        ended = self.accepts[state][2] if begun is None else begun
        return None if ended is None else (ended, 1)


# the lexicon


def shares(text: str | None) -> dict[str, tuple[float, int]]:
    """For each bare word ("=word") and each start of words: how far it fills the text (1 at DENSE of its words or more), and
    a sketch of the pairs of words that it stands between: one of 63 bits for each."""
    words = [b for w in (text or "").lower().split() if (b := bare(w))]
    places: dict[str, tuple[int, int]] = {}
    for before, word, behind in zip(["", *words], words, [*words[1:], ""]):
        n, sketch = places.get(word, (0, 0))
        places[word] = n + 1, sketch | 1 << crc32(f"{before} {behind}".encode()) % 63
    seen: dict[str, tuple[int, int]] = {}
    for word, (n, sketch) in places.items():
        for term in ["=" + word] * (len(word) >= MIN_LEN) + [word[:k] for k in range(MIN_LEN, min(MAX_LEN, len(word)) + 1)]:
            had = seen.get(term, (0, 0))
            seen[term] = had[0] + n, had[1] | sketch
    full = DENSE * max(len(words), 1)
    return {t: (min(1.0, n / full), sketch) for t, (n, sketch) in seen.items()}


def learn_lexicon(labelled: DataFrame, most: int = 200, ratio: float = 6.0, surprise: float = 10.0, places: int = 4) -> dict[str, bool]:
    """Terms and stems of which marked documents (toxic = 1) hold at least `ratio` times the share of others: term -> whole word.

    A likelihood-ratio test must reject, by `surprise`, that a term is as frequent in both, and marked documents must hold it between
    at least `places` different pairs of words, so that what only copies of a document repeat is none. The sums are grouped in
    Spark; only terms that pass reach the driver, at most 50 times `most`, of which nested ones give
    way to the strongest, or the longest of equally strong ones. Sums are rounded, so that their order doesn't decide.
    """

    def emit(batches):
        for pdf in batches:
            out: dict = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                for term, (share, sketch) in shares(text).items():
                    got = out.setdefault(term, [0.0, 0.0, 0])
                    got[int(toxic)] += share
                    got[2] |= sketch * int(toxic)
            yield pd.DataFrame({"term": list(out), "no": [v[0] for v in out.values()], "yes": [v[1] for v in out.values()], "at": [v[2] for v in out.values()]})

    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}
    sums = labelled.select("text", "toxic").mapInPandas(emit, "term string, no double, yes double, at long").groupBy("term").agg(F.round(F.sum("no"), 6).alias("no"), F.round(F.sum("yes"), 6).alias("yes"), F.bit_count(F.bit_or("at")).alias("places"))
    odds = (F.col("yes") / n[1]) / ((F.col("no") + 0.5) / n[0])
    both, apart = F.col("yes") + F.col("no"), n[1] / (n[0] + n[1])
    test = 2 * (F.col("yes") * F.log(F.col("yes") / (both * apart)) + F.when(F.col("no") > 0, F.col("no") * F.log(F.col("no") / (both * (1 - apart)))).otherwise(0))
    passed = sums.where((F.col("yes") > 0) & (odds >= ratio) & (test >= surprise) & (F.col("places") >= places))
    found = passed.orderBy(F.desc(F.round(F.col("yes") * F.log(odds), 6)), F.desc(F.length("term")), "term").limit(50 * most).collect()
    total = {r["term"]: r["yes"] for r in found}
    chosen: dict[str, bool] = {}
    for r in found:
        term = r["term"].lstrip("=")
        if any(term.startswith(c) or c.startswith(term) for c in chosen):
            continue
        chosen[term] = total.get("=" + term, 0) >= 0.8 * total.get(term, r["yes"])
        if len(chosen) == most:
            break
    return chosen


# evidence


def hits(text: str | None, automaton: Automaton, known: dict) -> list[tuple[int, int, int, bool]]:
    """(word's place, term's number, kind, quoted) of each hit in the whole text; known: a cache of words."""
    words = (text or "").lower().split()
    for w in set(words):
        if w not in known:
            known[w] = automaton.match(bare(w))
    return [(i, *known[w], _is_quoted(words, i)) for i, w in enumerate(words) if known[w]]


def _is_quoted(words: list[str], i: int) -> bool:
    """Whether words nearby open a quotation before a hit and close it after, or one reports speech and a quotation mark stands there."""
    before, after = words[max(0, i - NEAR) : i], words[i + 1 : i + 1 + NEAR]
    opened = words[i][0] in OPEN or any(w[0] in OPEN for w in before)
    closed = words[i].rstrip(".,;:!?")[-1:] in CLOSE and len(words[i]) > 1 or any(w.rstrip(".,;:!?")[-1:] in CLOSE for w in after)
    return bool(opened and closed) or bool((opened or closed) and REPORTING & {w.strip(".,;:!?\"'") for w in before})


def weigh(found: list, weights: dict, drift: float) -> list[float]:
    """The most evidence that a window of a text's words holds, by its hits: windows begin at a hit, and each further word
    takes `drift` from their evidence, which is what a toxic text has a word; at most MOST."""
    best = now = 0.0
    last = 0
    for i, term, kind, quoted in found:
        now = max(0.0, now - drift * (i - last)) + weights.get((term, kind), 0.0) * (QUOTED if quoted else 1.0)
        best, last = max(best, now), i
    return [min(MOST, best)]


def learn_weights(sums: dict, words: tuple[int, int], whole: list[bool]) -> dict[tuple[int, int], float]:
    """(term, kind) -> evidence of a hit: the log of how much likelier a word is one in marked documents, at least 0.

    sums: (term, kind, toxic) -> hits; words: of unmarked and of marked documents. A misspelling is taken to be MISSPELLED as likely as
    the term itself in marked documents; how often clean words look like one is counted.
    """
    out = {}
    for term in range(len(whole)):
        exact = 2 + whole[term]
        rate = (sums.get((term, exact, 1), 0) + 0.5) / (words[1] + 1)
        for kind, share in ((exact, 1.0), (1, MISSPELLED)):
            out[term, kind] = max(0.0, float(np.log(share * rate * (words[0] + 1) / (sums.get((term, kind, 0), 0) + 0.5))))
    return out


def features(terms: dict[str, bool], weights: dict, drift: float):
    """A column function: what weigh() finds in a text, as an array of doubles."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, known = Automaton(terms), {}
        for texts in batches:
            if len(known) > 500_000:  # only a cache
                known.clear()
            yield pd.Series([weigh(hits(t, automaton, known), weights, drift) for t in texts], dtype=object)

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last one is the intercept) by Newton's method; features whose weight would be below 0 get 0."""
    own = np.arange(x.shape[1])
    while True:
        z = np.c_[x[:, own], np.ones(len(x))]
        w, penalty = np.zeros(z.shape[1]), ridge * np.r_[np.ones(len(own)), 0]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
            step = np.linalg.solve(h, z.T @ (p - y) + penalty * w)
            w -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[own], out[-1] = w[:-1], w[-1]
            return out
        own = own[w[:-1] >= 0]


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 teach nothing; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[dict[str, bool], dict, float, list[float]]:
    """The lexicon, the evidence of its terms, the drift and the logistic weights, from at most about `fit_rows` labelled rows that aren't held out.

    The sample is the rows of the smallest hashes, drawn by a threshold. Rows with a null label or id teach
    nothing; of a document labelled more than once the largest label counts, of an id with several texts the smallest text.
    Every marked document is also shown with only one to three of its hits left, as a long text with
    a toxic passage is toxic too: that sets how little evidence is enough.
    """
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = max(1, -(-labels.count() // fit_rows))
    # about fit_rows rows, whatever the table's size
    sample = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(parts)) == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = settle(rows, "labelled")
    terms = learn_lexicon(rows)

    @F.pandas_udf("array<struct<at:int,term:int,kind:int,quoted:boolean>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, known = Automaton(terms), {}
        for texts in batches:
            yield pd.Series([[dict(zip(("at", "term", "kind", "quoted"), h)) for h in hits(t, automaton, known)] for t in texts], dtype=object)

    n_words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    matched = settle(rows.select(F.xxhash64("text").alias("mark"), "toxic", n_words.alias("words"), found("text").alias("hits")), "hits")
    words = {r["toxic"]: r["n"] for r in matched.groupBy("toxic").agg(F.sum("words").alias("n")).collect()}
    each = matched.select("toxic", F.explode("hits").alias("h")).groupBy("h.term", "h.kind", "toxic").agg(F.count("*").alias("n"))
    sums = {(r["term"], r["kind"], r["toxic"]): r["n"] for r in each.collect()}
    drift = max(0.0, sum(n * (1 if toxic else -1) / max(1, words.get(toxic, 0)) for (_, kind, toxic), n in sums.items() if kind > 1))
    weights = learn_weights(sums, (words.get(0, 0), words.get(1, 0)), [terms[t] for t in sorted(terms)])

    @F.pandas_udf("array<array<double>>")
    def shown(marks: pd.Series, toxic: pd.Series, hit_lists: pd.Series) -> pd.Series:
        out = []
        for mark, marked, own in zip(marks, toxic, hit_lists):
            own = [(h["at"], h["term"], h["kind"], h["quoted"]) for h in own]
            cases = [own]
            if marked and own:
                draw = np.random.default_rng(mark & (1 << 63) - 1)
                few = min(len(own), int(draw.integers(1, 4)))
                cases.append([own[i] for i in sorted(draw.choice(len(own), few, replace=False))])
            out.append([weigh(c, weights, drift) for c in cases])
        return pd.Series(out, dtype=object)

    got = matched.select("toxic", F.explode(shown("mark", "toxic", "hits")).alias("f")).toPandas()
    for used in (rows, matched):
        discard(used)
    if got["toxic"].nunique() < 2:
        return terms, weights, drift, [0.0, -4.0]
    return terms, weights, drift, fit_logistic(np.stack(got["f"]), got["toxic"].to_numpy(float)).tolist()


def score(docs: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """(row, score): each row of `docs` as a struct, whatever its columns, and the score (0 to 1) of its whole text.

    A null or empty text has no hit, and the score of such a text, which is the least. Further hits never lower a score,
    nor does the length of a text.
    """
    terms, weights, drift, w = model
    out = docs.select(F.struct("*").alias("row"), features(terms, weights, drift)(text_col).alias("f"))
    z = F.lit(w[-1])
    for k, v in enumerate(w[:-1]):
        z = z + F.lit(v) * F.col("f")[k]
    return out.select("row", (1 / (1 + F.exp(-z))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
