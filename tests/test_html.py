"""Readable text of pages: nesting, tags left open, character references, titles."""

import time

import pytest

from noviscan.sources.html import readable
from noviscan.sources.web import web_sources

TEXTS = {
    "nested notice": ('<div>a<div class="ad"><div>x</div>y</div>b</div>', "a b"),
    "notice among other classes": ('<p>a</p><section class="Cookie big"><p>x</p></section><p>b</p>', "a\n\nb"),
    "notice never closed": ('<article><p>a</p><div class="ad">x<p>b</p></article>', "a\n\nx\n\nb"),
    "menu never closed": ("<nav><ul><li>x</ul><p>a", "- x\n\na"),
    "items left open in a menu": ("<nav><ul><li>x<li>y</nav><p>a", "a"),
    "paragraph of a notice left open": ('<p class="ad">x<p>a', "a"),
    "references": ("<p>it&#x2019;s &eacute;t&eacute; &amp;lt; a&nbsp;b &copy; 1 &amp", "it\u2019s \u00e9t\u00e9 &lt; a b \u00a9 1 &amp"),
    "script holding tags": ('<p>a<script>var t = "</p><p>x";</script>b', "a b"),
    "article before body": ("<body><p>x</p><article>a</article><p>y</p></body>", "a"),
    "two articles": ("<article>a</article><hr><article>b</article>", "ab"),
    "article inside a sidebar is none": ("<main>a</main><aside><article>x</article></aside>", "a"),
    "empty article": ("<body><article><img></article><p>a</p></body>", "a"),
    "stray ends": ("</div>a</p>b</li></b>", "a\n\nb"),
    "lines": ("<h1>a</h1><p>b<br>c</p><ul><li>d<li>e</ul><h4>f</h4>", "# a\n\nb\nc\n\n- d\n- e\n\n### f"),
    "comment and section": ("a<!-- <p>x -->b<![if !IE]>c<![endif]>", "a bc"),
    "own marks": ("a\ufdd2b", "ab"),
    "plain text": ("a < b & c", "a < b & c"),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", TEXTS)
def test_text(name):
    html, text = TEXTS[name]
    assert readable(html)[1] == text


def test_titles():
    assert readable("<title>A &amp; B&#8217;s\n  c</title><p>a")[0] == "A & B\u2019s c"
    assert readable("<svg><title>x</title></svg><title>a</title><title>b</title>")[0] == "a"
    assert readable(None) == ("", "")


def test_deep_and_long_pages_take_linear_time():
    def seconds(html):
        start = time.perf_counter()
        readable(html)
        return time.perf_counter() - start

    for piece in ("<div>", "<div>a</b>", "<p>a</p>", '<div class="ad">x</div>', "<article>"):
        assert seconds(piece * 50_000) < 20 * max(seconds(piece * 5_000), 0.01)


def test_pages_table(spark):
    rows = [(1, "http://a.example/x", "<title>t</title><p>a"), (2, "http://a.example/y", "<p>b"), (3, "http://a.example/z", None), (4, None, "<nav>x</nav>")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id int, url string, html string, text string")
    got = {r.page_id: (r.title, r.text, r.rejected) for r in web_sources(pages).collect()}
    assert got == {
        1: ("t", "t\n\na", False), 2: ("http://a.example/y", "b", False), 3: ("http://a.example/z", "", True), 4: (None, "", True),
    }
    assert web_sources(pages.limit(0)).count() == 0
