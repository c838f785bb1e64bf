from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from sitegraph.functions.text import base_domain, url_netloc, ustrip, with_scheme
from sitegraph.functions.urls import url_join

HREFS = [
    "x", "/x", "//o.p/x", "?q=1", "#f", "../x", "./x", "a/../b", "/a/../b", "https://A.b/x",
    "http:foo", "data:1", "x y", "/p?q=1&r=2", "/a#f", "", "  /lead", "a//b/./c/..", "/a//b",
    "HTTPS://a.b/Up", "https:rel/x", "..", ".", "/..", "a/b/../../..", "?", "#", "/p?#",
    "//o.p", "//o.p?x#y", "mailto:x@y", "a:b", "1a:b", "/x?y#z?w", "/x#y?z", "\t/tab\n",
    "../../../../g", "g;x?y#s", "g/./h/../i/", "https://a.b", "http://a.b/x", "ftp://h/x",
]
BASES = ["https://a.b", "http://h.example.com:8080", "https://u:p@h.c"]


def test_url_join_matches_stdlib(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "base string, href string")
    got = df.select("base", "href", url_join(F.col("base"), F.col("href")).alias("j"),
                    url_netloc(url_join(F.col("base"), F.col("href"))).alias("n")).collect()
    for r in got:
        exp = urljoin(r.base, r.href)
        assert r.j == exp, (r.base, r.href, r.j, exp)
        assert r.n == urlsplit(exp).netloc, (r.base, r.href, r.n)


def test_fixture_goldens(spark):
    golden = {
        "x": "https://a.b/x", "/x": "https://a.b/x", "//o.p/x": "https://o.p/x", "?q=1": "https://a.b?q=1",
        "#f": "https://a.b#f", "../x": "https://a.b/x", "./x": "https://a.b/x", "a/../b": "https://a.b/b",
        "/a/../b": "https://a.b/b", "https://A.b/x": "https://A.b/x", "http:foo": "http:foo",
        "data:1": "data:1", "x y": "https://a.b/x y",
    }
    df = spark.createDataFrame([(k,) for k in golden], "href string")
    got = {r.href: r.j for r in df.select("href", url_join(F.lit("https://a.b"), F.col("href")).alias("j")).collect()}
    assert got == golden


def test_strip_scheme_base(spark):
    rows = [("  Acme \n",), ("HTTP://bolt.com",), ("q.com",), ("http://x.y:81/p?q",), ("\x1cz\x1f",)]
    df = spark.createDataFrame(rows, "v string")
    got = df.select(ustrip("v").alias("s"), with_scheme(F.col("v")).alias("w"),
                    base_domain(with_scheme(F.col("v"))).alias("b")).collect()
    assert [r.s for r in got] == [r[0].strip() for r in rows]
    assert got[1].w == "https://HTTP://bolt.com" and got[1].b == "https://HTTP:"
    assert got[2].w == "https://q.com" and got[3].b == "http://x.y:81"
