"""Randomised differential tests of the intricate column expressions."""

import random
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from sitegraph.functions.text import url_netloc
from sitegraph.functions.urls import url_join
from sitegraph.operators.sitemaps import loc_lines, malformed_index_items

NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
PIECES = ["a", "b", "..", ".", "", "x y", "%20", "é", "A", "1", "q=1", "&", ";p", ":", "@", "~"]
SEPS = ["/", "/", "/", "?", "#", "//"]
STARTS = ["", "/", "//", "./", "../", "?", "#", "http:", "https:", "HTTPS://h.c/", "mailto:", " ", "\t/", "a:b/"]


def rand_href(rnd):
    s = rnd.choice(STARTS)
    for _ in range(rnd.randint(0, 5)):
        s += rnd.choice(PIECES) + rnd.choice(SEPS)
    return s + rnd.choice(PIECES)


def test_url_join_random(spark):
    rnd = random.Random(11)
    bases = ["https://a.b", "http://h.example.com:81", "https://u@h.c"]
    rows = [(rnd.choice(bases), rand_href(rnd)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "base string, href string")
    j = url_join(F.col("base"), F.col("href"))
    got = df.select("base", "href", j.alias("j"), url_netloc(j).alias("n")).collect()
    bad = []
    for r in got:
        exp = urljoin(r.base, r.href)
        if r.j != exp or r.n != urlsplit(exp).netloc:
            bad.append((r.base, r.href, r.j, exp))
    assert not bad, bad[:5]


# --- line scans: the generator knows what it planted on each line -------------

def planted_line(rnd):
    """A line and the URL that its scan gives (None: no URL)."""
    url = f"https://a.b/{rnd.randrange(10 ** 6)}" + rnd.choice(["", ".xml", "?x=1&amp;y=2", ".xml "])
    pad = rnd.choice(["", " ", "\t"])
    shape = rnd.randrange(6)
    if shape == 0:
        return f"<url><loc>{pad}{url}{pad}</loc></url>", url.strip()
    if shape == 1:  # only the first pair of a line counts
        return f"<loc>{url}</loc><loc>https://other/</loc>", url.strip()
    if shape == 2:  # a closing tag before the opening one spoils the line
        return f"</loc><loc>{url}</loc>", None
    if shape == 3:
        return f"<loc>{url}", None
    if shape == 4:
        return "<loc></loc>", None
    return rnd.choice(["", "<urlset>", "text", "</url>"]), None


def planted_body(rnd):
    lines = [planted_line(rnd) for _ in range(rnd.randint(0, 12))]
    return rnd.choice(["\n", "\r\n", "\r"]).join(x for x, _ in lines), [u for _, u in lines if u is not None]


def test_line_scans_find_what_was_planted(spark):
    rnd = random.Random(5)
    cases = [planted_body(rnd) for _ in range(1500)]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, body string")
    for r in df.select("i", loc_lines(F.col("body")).alias("l"), malformed_index_items(F.col("body")).alias("m"),
                       malformed_index_items(F.col("body"), 2).alias("two")).collect():
        urls = cases[r.i][1]
        assert list(r.l) == urls, repr(cases[r.i][0])
        routed = [("child" if u.endswith(".xml") else "page", u) for u in urls]
        assert [(x.kind, x.value) for x in r.m] == routed
        children = [i for i, (kind, _) in enumerate(routed) if kind == "child"]
        assert [(x.kind, x.value) for x in r.two] == (routed[:children[1] + 1] if len(children) > 1 else routed)


def planted_urlset(rnd):
    """A well-formed urlset and its unique URLs in order."""
    from xml.sax.saxutils import escape

    prefix, declared = rnd.choice([("", ""), ("", f' xmlns="{NS}"'), ("s:", f' xmlns:s="{NS}"'), ("", ' xmlns="urn:other"'), ("q:", ' xmlns:q="urn:other"')])
    urls = [rnd.choice([f"https://a.b/p{rnd.randint(0, 60)}", "https://a.b/2?x=1&y=2", "https://a.b/é", "https://a.b/<x>"]) for _ in range(rnd.choice([0, 1, 3, 10, 150]))]
    cell = lambda u: rnd.choice([escape(u), f"<![CDATA[{u}]]>", f"\n {escape(u)}\t"])
    entries = [f"<{prefix}url><{prefix}loc>{cell(u)}</{prefix}loc><{prefix}lastmod>2024</{prefix}lastmod></{prefix}url>" for u in urls]
    lead = rnd.choice(["", '<?xml version="1.0"?>\n', '<!-- <urlset xmlns="urn:x"> -->\n'])
    body = f"{lead}<{prefix}urlset{declared}>" + rnd.choice(["", "\n"]).join([*entries, f"</{prefix}urlset>"])
    return body, [] if "urn:other" in declared else list(dict.fromkeys(urls))


def test_urlsets_give_what_was_planted(spark):
    from sitegraph.operators.sitemaps import urlset_urls

    rnd = random.Random(3)
    cases = [planted_urlset(rnd) for _ in range(300)]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, body string")
    for r in df.select("i", urlset_urls(F.col("body")).alias("u")).collect():
        assert list(r.u) == cases[r.i][1], cases[r.i][0][:300]
