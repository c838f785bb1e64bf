import itertools
import math
import random
import time

import pytest

from sitegraph.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href="/a">a</a><li><a href="/b">b</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy now, it is cheap and good.</div>
<article><h1>Title &amp; more</h1><p><b>First   paragraph,&nbsp;with text.<br><p>Short.</p><div class="share-bar">Share this</div><p>Last one ends here &lt;ok&gt;.</p>
<section id="comments"><p>I like it, said a reader of this page.</p></section></article><aside>Elsewhere on this site</aside><form><p>Mail me</p><button>Go</button></form><footer>&copy; Site</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "Title & more\nFirst paragraph, with text.\nShort.\nLast one ends here <ok>."
    plain = PAGE.replace("<article>", "<div class=content>").replace("</article>", "</div>")
    assert H.main_text(plain) == H.main_text(PAGE)
    assert H.main_text(PAGE[:PAGE.index("Last one") + 12]).endswith("Short.\nLast one end")


ARTICLE = """<article><h1>A title of some words</h1><p>The first paragraph is long enough to be the text of an article, with a full stop.</p>
<p>The second paragraph goes on about the same thing, and ends here as well.</p></article>"""
PLAIN = "A title of some words\nThe first paragraph is long enough to be the text of an article, with a full stop.\nThe second paragraph goes on about the same thing, and ends here as well."


@pytest.mark.parametrize("open_, close", [
    ('<body class="no-sidebar">', "</body>"), ('<body class="has-sidebar header-fixed">', "</body>"), ('<body class="single with-ads">', "</body>"), ('<body class="post-template search-enabled">', "</body>"),
    ('<html class="no-js cookie-banner"><body id="comments-page">', "</body></html>"), ("<form action=x>", "</form>"), ('<div class="sidebar-layout">', "</div>"), ('<div class="with-sidebar">', "</div>"),
])
def test_names_of_the_page_are_not_its_content(open_, close):
    menu = '<nav><a href="/a">Home</a></nav>'
    assert H.main_text(open_ + menu + ARTICLE + "<footer>Imprint</footer>" + close) == PLAIN
    assert H.main_text(open_ + ARTICLE.replace("<article>", '<article class="post has-ads">') + close) == PLAIN


def test_long_comments_stay_out():
    comments = '<section id="comments">' + "<div><p>I read this with joy and would like to say so at some length here.</p></div>" * 20 + "</section>"
    assert H.main_text(f"<body>{ARTICLE}{comments}</body>") == PLAIN


def test_text_in_formulas_and_objects():
    assert H.main_text(ARTICLE.replace("the same thing", "<math><mi>x</mi></math> and <object>y</object>")) == PLAIN.replace("the same thing", "x and y")


@pytest.mark.parametrize("page", ["<div>some text of a block here, " * 100_000, "<blockquote>" * 50_000 + "<td>x</td></p>" * 50_000, "<div>" * 50_000 + "text. " + "</div>" * 50_000 + "<p>more.</p>" * 10])
def test_deep_pages_are_linear(page):
    start = time.process_time()
    H.blocks_of(page)
    H.smoothness(*H.blocks_of(page))
    assert time.process_time() - start < 10


def test_broken_markup():
    for page in ("", "<", "<p", "<p>", "</p>", "<!--", "<script>", "<a href=\"x", "<p class='>text", "&#xZZ;&unknown;"):
        H.main_text(page)
    for page in ("<a " + "x" * 10 ** 6, "<a \"" * 10 ** 5, "<a =\"" * 10 ** 5 + ">", "<script " * 10 ** 5, "<!--" * 10 ** 5, "<p>" * 10 ** 5, "<div>" * 3000 + "text here."):
        start = time.process_time()
        H.main_text(page)
        assert time.process_time() - start < 10


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 9)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        cost = lambda labels: sum(math.log1p(math.exp(-s if x else s)) for s, x in zip(scores, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])
        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(H.minimum_cut(scores, edges)) - best) < 1e-6


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "x")]
    got = sorted((tuple(r) for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()), key=repr)
    text = H.main_text(PAGE)
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (None, "v", "", 0), (1, "u", text, len(text))], key=repr)
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
