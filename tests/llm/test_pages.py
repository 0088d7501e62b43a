"""The page extractor, trained on pages of the table, on pages written by hand and not made by its generator."""

import os

import pandas as pd
import pytest

from acrelens.llm import op5_html_crf

SMALL = "/root/testdata/sf0.01/pages.parquet"
PAGES = {
    "blog": (
        """<!DOCTYPE html><html><head><title>On bees</title><script src="x.js"></script></head><body class="home"><div id="top"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/contact">Contact</a></div>
<div class="wrapper"><div class="post"><h1>On keeping bees in a small town</h1><div class="post-body"><p>Last spring we moved two hives to the roof of the library, and the neighbours were worried at first.</p><p>By June nobody minded: the bees fly high, and the lime trees along the river keep them busy all day.</p><ul><li>The first hive gave eleven jars of honey.</li><li>The second one was weaker and gave only four.</li></ul></div></div>
<aside class="sidebar"><h3>Archive</h3><ul><li><a href="/2020">2020</a></li><li><a href="/2021">2021</a></li></ul></aside></div><div class="footer"><p>Copyright 2021. All rights reserved.</p></div></body></html>""",
        'On keeping bees in a small town Last spring we moved two hives to the roof of the library, and the neighbours were worried at first. By June nobody minded: the bees fly high, and the lime trees along the river keep them busy all day. The first hive gave eleven jars of honey. The second one was weaker and gave only four.',
    ),
    "news": (
        """<html><body><header><div class="logo">The Daily Ferry</div><nav><a href="/w">World</a><a href="/s">Sport</a></nav></header><main><article><h1>Harbour bridge to close for two weeks</h1><p>The council said on Monday that the old bridge &mdash; built in 1911 &mdash; needs new cables before winter, and that traffic will be led through the tunnel.</p><p>Shop owners in the harbour expect fewer visitors. &quot;We have seen this before,&quot; said one of them, who has sold fish there for thirty years.</p></article><div class="advert">Buy one pair of shoes and get another one free!</div><div class="newsletter"><form><label>Your e-mail</label><input type="text"><button>Subscribe</button></form></div><section id="comments"><h2>3 comments</h2><div class="comment"><p>About time, that bridge has been shaking for years.</p></div></section></main><footer><ul><li><a href="/imprint">Imprint</a></li><li><a href="/privacy">Privacy policy</a></li></ul></footer></body></html>""",
        'Harbour bridge to close for two weeks The council said on Monday that the old bridge — built in 1911 — needs new cables before winter, and that traffic will be led through the tunnel. Shop owners in the harbour expect fewer visitors. "We have seen this before," said one of them, who has sold fish there for thirty years.',
    ),
    "german": (
        """<html><body><div id="cookie-banner"><p>Wir verwenden Cookies, um diese Seite zu verbessern.</p><button>OK</button></div><div id="navigation"><ul><li><a href="/">Start</a></li><li><a href="/rezepte">Rezepte</a></li></ul></div><div id="content"><h2>Kartoffelsuppe nach Art der Gro&szlig;mutter</h2><p>F&uuml;r vier Personen braucht man ein Kilo Kartoffeln, zwei Zwiebeln und einen Liter Br&uuml;he. Die Kartoffeln werden gesch&auml;lt und in W&uuml;rfel geschnitten.</p><p>Dann kocht alles zwanzig Minuten, bis die Kartoffeln weich sind, und wird mit Majoran gew&uuml;rzt.</p></div><div id="footer">Impressum | Datenschutz</div></body></html>""",
        'Kartoffelsuppe nach Art der Großmutter Für vier Personen braucht man ein Kilo Kartoffeln, zwei Zwiebeln und einen Liter Brühe. Die Kartoffeln werden geschält und in Würfel geschnitten. Dann kocht alles zwanzig Minuten, bis die Kartoffeln weich sind, und wird mit Majoran gewürzt.',
    ),
    "bare": (
        """<p>A page of one single paragraph, without any furniture around it, is all text and should come back whole.</p>""",
        'A page of one single paragraph, without any furniture around it, is all text and should come back whole.',
    ),
    "menu": (
        """<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>Shop</a></li></ul></nav><footer>&copy; 2020</footer></body></html>""",
        '',
    ),
    "docs": (
        """<html><body><div class="breadcrumb"><a href="/">Docs</a> &gt; <a href="/i">Install</a></div><div class="container"><div class="toc"><ul><li><a href="#a">Before you begin</a></li><li><a href="#b">Steps</a></li></ul></div><div class="main-content"><h1>Installing the pump</h1><h2>Before you begin</h2><p>Make sure that the valve is closed and that the tank holds at least ten litres of water.</p><h2>Steps</h2><ol><li>Turn the pump so that the arrow points upwards.</li><li>Fasten both screws by hand, then by half a turn of the key.</li></ol><blockquote>Never run the pump dry: its seals need water.</blockquote></div></div><div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div></body></html>""",
        'Installing the pump Before you begin Make sure that the valve is closed and that the tank holds at least ten litres of water. Steps Turn the pump so that the arrow points upwards. Fasten both screws by hand, then by half a turn of the key. Never run the pump dry: its seals need water.',
    ),
}


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data here")
def test_pages_written_by_hand():
    field = op5_html_crf.train(pd.read_parquet(SMALL, columns=["html"])["html"].tolist())
    for name, (html, text) in PAGES.items():
        assert op5_html_crf.main_text(html, field, {}) == text, name
    long = "<html><body><article>" + "<p>One more paragraph of a very long story, as long as a book, told in whole.</p>" * 20_000 + "</article><footer>us</footer></body></html>"
    assert op5_html_crf.main_text(long, field, {}) == " ".join(["One more paragraph of a very long story, as long as a book, told in whole."] * 20_000)
