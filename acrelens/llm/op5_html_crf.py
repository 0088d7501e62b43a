"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A block is a run of text between block-level tags. Its features are its ancestors' tags and the words of
their classes, ids and roles, and what its text looks like. The field is trained on labelled pages and decoded
by Viterbi for each page. The labelled pages are made from a bounded sample of the table: the sample's
own pages, labelled where their markup tells (article or main, outside of nav, footer, names of adverts and the like), and
their texts laid out anew with other containers and with every kind of boilerplate, where labels are known.
"""

from __future__ import annotations

import html as codec
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.llm.shared import table

SAMPLE = 300  # pages of the table that labelled pages are made from, at most
DIMS = 1 << 13
MARK = ""  # stands before the texts that are known to be content
#: Tags by how they are read.
SKIPPED = frozenset("script style noscript template textarea select option button iframe svg canvas object audio video head title datalist math map".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside table thead tbody tfoot tr td th caption blockquote pre form fieldset figure figcaption address details summary hr center legend menu dialog".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section main div nav header footer aside form blockquote body td th".split())
#: Words of boilerplate that texts are searched for.
SAYS = "cookie cookies subscribe newsletter advertisement sponsored comment comments reply copyright rights reserved privacy terms login sign share follow related read menu search home contact about previous next posted".split()
#: Words of classes and ids that name page furniture.
FURNISHED = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies discussion disqus footer header masthead menu modal nav navbar navigation newsletter notice alert pagination popup promo related replies reply share sharing sidebar social sponsored subscribe tags widget".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|<[a-zA-Z/!?][^<]*\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    """A leaf block: its path of (tag, words of class, id and role), its text, and the letters of it inside links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in its order, character references decoded, white space made one space, empty ones left out.

    Scripts, styles, comments, form controls and hidden elements are no text. Tags that are cut off at the end of
    the page are dropped; unclosed and wrongly closed ones are let pass.
    """
    html, out, stack, parts = html or "", [], [], []
    linked = at = hidden = 0

    def close() -> None:
        nonlocal linked, parts
        text = " ".join(codec.unescape("".join(parts)).split())
        if text:
            out.append(Block(tuple(x for x in stack if x[0] in BLOCKS or x[1]), text, linked))
        parts, linked = [], 0

    def pop(k: int) -> None:
        nonlocal hidden
        if any(x[0] in BLOCKS for x in stack[k:]):
            close()
        hidden -= sum(x[2] for x in stack[k:])
        del stack[k:]

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            parts.append(piece)
            if any(x[0] == "a" for x in stack):
                linked += len(piece.strip())

    while found := TOKEN.search(html, at):
        text(html[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                pop(k)
            elif tag == "p":
                close()
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    pop(i)
                    break
                if stack[i][0] in SCOPE and not (tag in ("tr", "td", "th") and stack[i][0] in ("td", "th")):
                    break
        elif tag in BLOCKS and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        if tag == "br" and not hidden:
            parts.append(" ")
        if tag in BLOCKS:
            close()
        if tag in VOID or found[4]:
            continue
        names, gone = (), tag in SKIPPED
        if found[3].strip():
            attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(found[3])}
            gone = gone or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
            names = tuple(w.lower() for c in ("class", "id", "role") for w in WORDS.findall(attrs.get(c, "")))
        if tag in RAW:
            end = re.compile(rf"</{tag}", re.I).search(html, at)
            at = end.start() if end else len(html)
        stack.append((tag, names, gone))
        hidden += gone
    text(html[at:])
    close()
    return out


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMS


def path_features(path: tuple) -> list[int]:
    """Ancestors' tags, and the words of classes, ids and roles, near and far."""
    out = {"bias"}
    inner = [x for x in path if x[0] in BLOCKS]
    out.update(f"tag {x[0]}" for x in path)
    out.update(f"own {x[0]}" for x in inner[-1:])
    out.update(f"pair {a[0]} {b[0]}" for a, b in zip(inner[-3:], inner[-2:]))
    out.update(f"name {w}" for x in path for w in x[1])
    out.update(f"depth {min(len(inner), 8)}" for _ in "x")
    if any(x[0] in ("article", "main") for x in path) and not any(x[0] in ("nav", "footer", "aside", "form") for x in path):
        out.add("inside")
    return [_hash(f) for f in sorted(out)]


def text_features(block: Block) -> list[int]:
    """Length, links, punctuation, and words of boilerplate."""
    text, words = block.text, block.text.split()
    n = len(words)
    out = [f"words {min(7, n.bit_length())}", f"link {min(4, 4 * block.linked // max(1, len(text)))}", f"stop {text[-1] in '.!?…'}", f"commas {min(3, text.count(','))}"]
    out.append(f"first {text[:1].isupper()}")
    if n < 40:
        low = {w.strip(".,:;!?()").lower() for w in words}
        out += [f"says {w}" for w in SAYS if w in low]
        out += [f"sign {c}" for c in "©»›|→·" if c in text]
    return [_hash(f) for f in out]


class Field:
    """Binary linear-chain CRF: weights of features for label 1, transitions, and the start."""

    def __init__(self):
        self.w, self.t, self.s = np.zeros(DIMS), np.zeros((2, 2)), np.zeros(2)

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = 6, rate: float = 0.15, seed: int = 1) -> None:
        """Gradient steps on the likelihood of each page's labels, by the forward-backward algorithm."""
        slope, slope_t = np.full(DIMS, 1e-3), np.full((2, 2), 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            for k in rng.permutation(len(pages)):
                feats, y = pages[k]
                e = np.zeros((len(y), 2))
                e[:, 1] = [self.w[f].sum() for f in feats]
                e[0] += self.s
                a, b = e.copy(), np.zeros_like(e)
                for i in range(1, len(y)):
                    a[i] += np.logaddexp(a[i - 1][0] + self.t[0], a[i - 1][1] + self.t[1])
                for i in range(len(y) - 2, -1, -1):
                    x = self.t + e[i + 1] + b[i + 1]
                    b[i] = np.logaddexp(x[:, 0], x[:, 1])
                z = np.logaddexp(*a[-1])
                p = np.exp(a + b - z)
                g, pair = np.array(y) - p[:, 1], np.zeros((2, 2))
                for i in range(1, len(y)):
                    pair[y[i - 1], y[i]] += 1
                    pair -= np.exp(a[i - 1][:, None] + self.t + e[i] + b[i] - z)
                grad = np.zeros(DIMS)
                for f, d in zip(feats, g):
                    np.add.at(grad, f, d)
                own = np.flatnonzero(grad)
                step = grad[own] - 1e-4 * self.w[own]
                slope[own] += step * step
                self.w[own] += rate * step / np.sqrt(slope[own])
                slope_t += pair * pair
                self.t += rate * pair / np.sqrt(slope_t)
                self.s[y[0]] += 0.01
                self.s -= 0.01 * p[0]

    def decode(self, scores: list[float]) -> list[int]:
        """The likeliest labels, by Viterbi; scores: the emission of label 1 of each block."""
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.t.tolist()
        v0, v1 = float(self.s[0]), float(self.s[1]) + scores[0]
        back = []
        for e in scores[1:]:
            from0, from1 = v1 + t10 > v0 + t00, v1 + t11 > v0 + t01
            back.append((from0, from1))
            v0, v1 = (v1 + t10 if from0 else v0 + t00), (v1 + t11 if from1 else v0 + t01) + e
        label = int(v1 > v0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


# labelled pages

#: Names and phrases of common page furniture, for the pages that are laid out anew.
CONTENT = ["<article>{}</article>", "<main>{}</main>", "<main><article class='post'>{}</article></main>", '<div class="content">{}</div>', '<div class="post-body entry-content">{}</div>', '<div id="main"><div class="story">{}</div></div>', '<section class="article-text">{}</section>', '<div class="article">{}</div>', '<div id="content">{}</div>', '<div class="main"><div class="text">{}</div></div>']
FURNITURE = {
    "links": ["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="nav navbar">{}</ul>', '<div class="breadcrumb">{}</div>', '<div class="related"><h3>Related</h3><ul>{}</ul></div>', '<div class="share social">{}</div>', '<div class="tags">{}</div>', '<div class="pagination">{}</div>', '<aside class="sidebar"><ul>{}</ul></aside>'],
    "prose": ["<aside><p>{}</p></aside>", '<div class="ad">{}</div>', '<div class="advert">{}</div>', '<div class="advertisement"><p>{}</p></div>', '<div class="sidebar"><h4>{}</h4><p>{}</p></div>', '<div class="ads banner"><p>{}</p></div>', '<div class="cookie-notice">We use cookies. {}</div>', '<div class="notice alert"><p>{}</p></div>', '<div class="promo sponsored"><p>{}</p></div>', '<form action="/s"><label>Newsletter</label><p>{}</p></form>', '<div class="newsletter">Subscribe {}</div>', '<div id="cookie-banner" role="dialog"><p>{}</p></div>', '<div class="popup modal"><p>{}</p></div>', '<aside class="widget"><h3>{}</h3><p>{}</p></aside>'],
    "remarks": ['<section class="comments"><h2>Comments</h2>{}</section>', '<div id="comments"><ol class="commentlist">{}</ol></div>', '<div class="comment-list">{}</div>', '<section id="disqus" class="discussion replies">{}</section>'],
    "top": ["<header><h2>{}</h2></header>", '<div class="header"><p>{}</p></div>', '<header class="site-header"><span>{}</span></header>', '<div id="masthead"><h1>{}</h1></div>'],
    "foot": ["<footer>&copy; {}</footer>", '<div class="footer"><p>&copy; {}</p></div>', '<div id="footer"><p>All rights reserved. {}</p></div>', '<footer><p>Contact Privacy Terms</p><p>{}</p></footer>'],
}


def lay_out(rng: np.random.Generator, title: str, texts: list[str], other: list[str]) -> str:
    """A page of the texts (marked as content) amid furniture made of other texts."""
    pick = lambda options: options[rng.integers(len(options))]
    esc = lambda s: codec.escape(s, quote=False)
    some = lambda n: esc(" ".join(pick(other).split()[: rng.integers(1, n)]) or "x")

    def furniture(kind: str) -> str:
        shape = pick(FURNITURE[kind])
        if kind == "links":
            item = pick(["<li><a href='/x'>{}</a></li>", "<a href='#'>{}</a> ", "<li><a href='/y'><span>{}</span></a></li>"])
            return shape.format("".join(item.format(some(5)) for _ in range(rng.integers(2, 8))))
        if kind == "remarks":
            item = pick(['<div class="comment"><b>{}</b><p>{}</p></div>', '<li class="comment"><p>{}</p><p>{}</p></li>', '<p>{}: {}</p>'])
            return shape.format("".join(item.format(some(3), some(60)) for _ in range(rng.integers(1, 6))))
        return shape.format(*[some(40) for _ in range(shape.count("{}"))])

    inner = f"<h1>{MARK}{esc(title)}</h1>" if rng.random() < 0.8 else ""
    for t in texts:
        shape = pick(["<p>{}</p>"] * 8 + ["<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<p><b>{}<br>", "<pre>{}</pre>"])
        inner += shape.format(MARK + esc(t))
        if rng.random() < 0.15:
            inner += furniture(pick(["prose", "prose", "links", "remarks"]))
    if rng.random() < 0.08:  # some pages are nothing but their text
        return pick(["{}", "<body>{}</body>", "<div>{}</div>"]).format(inner)
    before = "".join(furniture(k) for k in ("top", "links", "prose") if rng.random() < 0.6)
    after = "".join(furniture(k) for k in ("prose", "links", "remarks", "prose", "foot") if rng.random() < 0.6)
    page = before + pick(CONTENT).format(inner) + after
    return f"<html><head><title>{esc(title)}</title></head><body>" + (f'<div class="{pick(["page", "wrapper", "container"])}">{page}</div>' if rng.random() < 0.4 else page) + "</body></html>"


def labelled_pages(pages: list[str], each: int = 4, seed: int = 9) -> list[tuple[list[Block], list[int]]]:
    """Training pages from a sample of pages, see the module's docstring."""
    rng, out, parsed = np.random.default_rng(seed), [], [blocks(p) for p in pages]
    told = []
    for own in parsed:
        tags = [{x[0] for x in b.path} for b in own]
        if any(t & {"article", "main"} for t in tags):
            names = [{w for x in b.path for w in x[1]} for b in own]
            y = [int(bool(t & {"article", "main"}) and not t & {"nav", "aside", "footer", "form"} and not n & FURNISHED) for t, n in zip(tags, names)]
            told.append([b.text for b, k in zip(own, y) if k])
            out.append((own, y))
    every = [b.text for own in parsed for b in own] or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    for texts in told or [every[:8]] * 20:
        for _ in range(each):
            chosen = [texts[i] for i in rng.integers(0, len(texts), rng.integers(1, 14))] if texts else [every[0]]
            own = blocks(lay_out(rng, chosen[0][:60], chosen, every))
            y = [int(MARK in b.text) for b in own]
            for b in own:
                b.text = b.text.replace(MARK, "") or "x"
            out.append((own, y))
    return [x for x in out if x[0]]


def train(pages: list[str]) -> Field:
    field = Field()
    field.fit([([path_features(b.path) + text_features(b) for b in own], y) for own, y in labelled_pages(pages)])
    return field


def main_text(html: str | None, field: Field, known: dict) -> str:
    """The texts of the blocks that are content, in page order, joined by a space. `known` keeps the scores of paths."""
    own, scores = blocks(html), []
    for b in own:
        path = known.get(b.path)
        if path is None:
            path = known[b.path] = float(field.w[path_features(b.path)].sum())
        scores.append(path + float(field.w[text_features(b)].sum()))
    return " ".join(b.text for b, y in zip(own, field.decode(scores)) if y)


def extract(pages: DataFrame, html_col: str = "html", out: str = "main_text", sample: int = SAMPLE) -> DataFrame:
    """Add `out`, the main text of each page ("" if there is none, and for null), to `pages`.

    The field is trained on the driver from at most `sample` pages, those of the smallest hashes of their
    html among a thinned part of the table, whole, so equal tables give equal fields. Repeated rows are treated alike. A column of
    `pages` that is named `out` gives way.
    """
    total = pages.count()
    thin = max(1, total // (4 * sample))
    some = pages.select(F.col(html_col).alias("h"), F.xxhash64(html_col).alias("x")).where("h is not null").where(F.pmod("x", F.lit(thin)) == 0)
    taken = [r["h"] for r in some.orderBy("x").select("h").limit(sample).toLocalIterator()]
    sent = pages.sparkSession.sparkContext.broadcast(train(taken))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for series in batches:
            if len(known) > 200_000:  # only a cache
                known.clear()
            yield pd.Series([main_text(h, sent.value, known) for h in series], dtype=object)

    return pages.withColumn(out, run(F.col(html_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
