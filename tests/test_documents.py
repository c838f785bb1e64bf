"""Unit goldens for the document operators (FIXTURES §3-§6)."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitegraph.operators.frontier import robots_directives, sites
from sitegraph.operators.links import anchor_hrefs, attribute_text, link_array
from sitegraph.operators.resolve import site_url_lists
from sitegraph.operators.sitemaps import SHORT, Limits, Snapshot, expand_sitemaps, first_of, index_children, malformed_index_items, parse_snapshot, urlset_urls, with_positions
from sitegraph.plans import bindings

NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
TS = datetime(2024, 6, 1)


def fetch_df(spark, rows):
    return spark.createDataFrame([(u, s, "application/xml", b, TS) for u, s, b in rows],
                                 "url string, status int, content_type string, body string, fetched_at timestamp")


def urlset(*locs, ns=NS, close=True):
    x = "".join(f"<url><loc>{l}</loc></url>\n" for l in locs)
    head = f'<urlset xmlns="{ns}">\n' if ns else "<urlset>\n"
    return head + x + ("</urlset>" if close else "")


def index(*locs, ns=NS, close=True):
    x = "".join(f"<sitemap><loc>{l}</loc></sitemap>\n" for l in locs)
    head = f'<sitemapindex xmlns="{ns}">\n' if ns else "<sitemapindex>\n"
    return head + x + ("</sitemapindex>" if close else "")


def urls_of(spark, body, cap=None):
    df = spark.createDataFrame([(body,)], "body string")
    return df.select(urlset_urls(F.col("body"), cap).alias("u")).first().u


def test_urlset_cases(spark):
    ns_body = (f'<urlset xmlns="{NS}"><url><loc> https://a.b/1?x=1&amp;y=2 </loc></url>'
               f'<url><loc>https://a.b/2</loc></url></urlset>')
    assert urls_of(spark, ns_body) == ["https://a.b/1?x=1&y=2", "https://a.b/2"]
    assert urls_of(spark, ns_body.replace(f' xmlns="{NS}"', "")) == ["https://a.b/1?x=1&y=2", "https://a.b/2"]
    assert urls_of(spark, ns_body.replace(NS, "urn:other")) == []
    assert urls_of(spark, '<q:urlset xmlns:q="urn:x"><q:url><q:loc>z</q:loc></q:url></q:urlset>') == []
    assert urls_of(spark, urlset("1", "2", "1")) == ["1", "2"]
    many = [f"https://a.b/{i}" for i in range(150)]
    assert urls_of(spark, urlset(*many)) == many and urls_of(spark, urlset(*many), cap=100) == many[:100]
    assert urls_of(spark, urlset(*(many[:60] + many))) == many
    assert urls_of(spark, urlset(*many), cap=5) == many[:5]
    assert urls_of(spark, f'<urlset><url><loc>1</loc></url><url><loc/></url><url><loc>2</loc></url></urlset>') == ["1", "2"]
    assert urls_of(spark, "<urlset><url><loc><![CDATA[https://c.d/1]]></loc></url></urlset>") == ["https://c.d/1"]
    assert urls_of(spark, "<html><body>not found</body></html>") == []


def test_urlset_truncated_line_scan(spark):
    body = urlset("https://a.b/1?a=1&amp;b=2", "https://a.b/2", close=False)
    assert urls_of(spark, body) == ["https://a.b/1?a=1&amp;b=2", "https://a.b/2"]
    two = "<urlset>\n<url><loc>x</loc><loc>y</loc></url>\n<url><loc>z</loc></url>\n"
    assert urls_of(spark, two) == ["x", "z"]
    bad = "<urlset>\n</loc><loc>q</loc>\n<url><loc>ok</loc></url>\n"
    assert urls_of(spark, bad) == ["ok"]


def test_index_children_and_compat(spark):
    df = spark.createDataFrame([(index("c1", "c2", "c3", "c4", "c5"),), (index("c1", "c2", ns=None),)], "body string")
    got = [r.c for r in df.select(index_children(F.col("body")).alias("c")).collect()]
    assert got == [["c1", "c2", "c3", "c4", "c5"], ["c1", "c2"]]
    few = [r.c for r in df.select(index_children(F.col("body"), children=3).alias("c")).collect()]
    assert few == [["c1", "c2", "c3"], ["c1", "c2"]]
    compat = [r.c for r in df.select(index_children(F.col("body"), compat=True).alias("c")).collect()]
    assert compat == [[], ["c1", "c2"]]


def test_malformed_index_routing(spark):
    body = index("a.xml", "b", "c.xml", "d.xml", "e", "f.xml", close=False)
    df = spark.createDataFrame([(body,)], "body string")
    whole, three = df.select(malformed_index_items(F.col("body")), malformed_index_items(F.col("body"), 3)).first()
    kinds = [("child", "a.xml"), ("page", "b"), ("child", "c.xml"), ("child", "d.xml"), ("page", "e"), ("child", "f.xml")]
    assert [(i.kind, i.value) for i in whole] == kinds and [(i.kind, i.value) for i in three] == kinds[:4]


def lists_of(tree):
    out = {}
    for r in with_positions(tree, "root").orderBy("root", "pos").collect():
        out.setdefault(r.root, []).append(r.url)
        assert r.pos == len(out[r.root])
    return out


def test_recursive_expansion_and_cycles(spark):
    f = fetch_df(spark, [
        ("https://s/i1.xml", 200, index("https://s/i2.xml", "https://s/u1.xml")),
        ("https://s/i2.xml", 200, index("https://s/u2.xml")),
        ("https://s/u1.xml", 200, urlset("https://s/a", "https://s/b")),
        ("https://s/u2.xml", 200, urlset("https://s/b", "https://s/c")),
        ("https://s/self.xml", 200, index("https://s/self.xml", "https://s/u1.xml")),
        ("https://s/m.xml", 200, index("https://s/u1.xml", "https://s/p", "https://s/u2.xml", close=False)),
    ])
    roots = spark.createDataFrame([("https://s/i1.xml",), ("https://s/self.xml",), ("https://s/m.xml",)], "root string")
    edges = parse_snapshot(f)
    lists = lists_of(expand_sitemaps(roots, edges, chunk=2))
    assert lists["https://s/i1.xml"] == ["https://s/b", "https://s/c", "https://s/a"]
    assert lists["https://s/self.xml"] == ["https://s/a", "https://s/b"]
    assert lists["https://s/m.xml"] == ["https://s/a", "https://s/b", "https://s/p", "https://s/c"]
    shallow = lists_of(expand_sitemaps(roots, edges, max_depth=1))
    assert shallow["https://s/i1.xml"] == ["https://s/a", "https://s/b"]


def test_nothing_is_cut(spark):
    """50 children, 10,000 URLs in one urlset, and a chain of 10 indexes."""
    chain = [(f"https://s/d{i}.xml", 200, index(f"https://s/d{i + 1}.xml")) for i in range(10)]
    children = [f"https://s/c{i}.xml" for i in range(50)]
    f = fetch_df(spark, [*chain, ("https://s/d10.xml", 200, index(*children)),
                         *[(c, 200, urlset(f"{c}/p")) for c in children[:-1]],
                         (children[-1], 200, urlset(*[f"https://s/{i}" for i in range(10_000)]))])
    roots = spark.createDataFrame([("https://s/d0.xml",)], "root string")
    tree = expand_sitemaps(roots, parse_snapshot(f))
    rows = with_positions(tree, "root").orderBy("pos").collect()
    assert [r.url for r in rows] == [f"{c}/p" for c in children[:-1]] + [f"https://s/{i}" for i in range(10_000)]
    assert [r.pos for r in rows] == list(range(1, 10_050))


def test_large_malformed_index(spark):
    body = index(*[f"https://s/{i}.xml" for i in range(50_000)], close=False)
    df = spark.createDataFrame([(body,)], "body string")
    start = time.time()
    assert df.select(F.size(malformed_index_items(F.col("body"))).alias("n")).first().n == 50_000
    assert time.time() - start < 15


def test_hostile_anchor_tags(spark):
    long_tag = '<a title="' + "x" * 1_000_000 + '" href="/long">l</a>'
    attributes = "<a " + " ".join(f'k{i}="v{i}"' for i in range(60_000)) + ' href="/many">m</a>'
    bare = "<a " + "y" * 1_000_000 + ' href=/bare>b</a>'
    unclosed = '<a "' * 200_000 + '<a href="/after">a</a>'
    rows = [(0, long_tag), (1, attributes), (2, bare), (3, unclosed), (4, '<a href="x' + "<p>" * 100_000), (5, "<script " * 100_000 + "<!--" * 10)]
    start = time.time()
    got = {r.i: r.l for r in spark.createDataFrame(rows, "i int, h string").select("i", link_array(F.col("h"), F.lit("https://a.b"), F.lit("a.b")).alias("l")).collect()}
    assert time.time() - start < 30
    assert got == {0: ["https://a.b/long"], 1: ["https://a.b/many"], 2: ["https://a.b/bare"], 3: ["https://a.b/after"], 4: [], 5: []}


ROBOTS = ("User-agent: *\nSitemap: https://a.b/one.xml\n Sitemap: https://a.b/ignored.xml\n"
          "SITEMAP:https://a.b/two.xml\nHost: a.b\n")


def chosen(lists):
    urls = {}
    for r in lists.urls.orderBy("base_domain", "pos").collect():
        urls.setdefault(r.base_domain, []).append(r.url)
    return {r.base_domain: (r.source, urls.get(r.base_domain, [])) for r in lists.sites.collect()}


def test_robots_and_source_choice(spark):
    comp = spark.createDataFrame([("https://a.b",), ("https://c.d",), ("https://e.f",)], "website_url string")
    s = sites(comp)
    f = fetch_df(spark, [
        ("https://a.b/robots.txt", 200, ROBOTS),
        ("https://a.b/two.xml", 200, urlset("https://a.b/x")),
        ("https://a.b/sitemap.xml", 200, urlset("https://a.b/never")),
        ("https://c.d/robots.txt", 404, "Sitemap: https://c.d/r.xml\n"),
        ("https://c.d/r.xml", 200, urlset("https://c.d/never")),
        ("https://c.d/sitemap.txt", 200, urlset("https://c.d/late")),
        ("https://c.d/sitemap_index.xml", 200, index("https://c.d/u.xml")),
        ("https://c.d/u.xml", 404, urlset("https://c.d/early")),
        ("https://e.f", 200, '<a href="/p">p</a><a href="https://x.y/q">q</a>'),
    ])
    d = robots_directives(s, f).orderBy("base_domain", "dir_pos").collect()
    assert [(r.dir_pos, r.sitemap_url) for r in d] == [(1, "https://a.b/one.xml"), (3, "https://a.b/two.xml")]
    lists = chosen(site_url_lists(s, f))
    assert lists["https://a.b"] == ("robots", ["https://a.b/x"])
    assert lists["https://c.d"] == ("sitemap", ["https://c.d/early"])
    assert lists["https://e.f"] == ("html", ["https://e.f/p"])


def test_links(spark):
    html = ('<!-- <a href="/in-comment"> --><script>var s = "<a href=\'/in-script\'>";</script>'
            '<a href="">e</a><a href="#top">t</a><a href="javascript:x()">j</a><a href="mailto:x@y">m</a>'
            '<a href="tel:1">t</a><a href="/p?q=1&amp;r=2">p</a><a href="https://www.a.b/x">w</a>'
            '<a href="https://A.b/x">c</a><a href="/a">a</a><a href="/a#f">f</a><A HREF=\'/q\'>q</A>'
            '<a class="x" data-href="/no" href=/u>u</a><a href="/a">dup</a><abbr href="/abbr">')
    df = spark.createDataFrame([(html,)], "h string")
    got = df.select(link_array(F.col("h"), F.lit("https://a.b"), F.lit("a.b")).alias("l")).first().l
    assert got == ["https://a.b/p?q=1&r=2", "https://a.b/a", "https://a.b/a#f", "https://a.b/q", "https://a.b/u"]
    many = "".join(f'<a href="/{i}">x</a>' for i in range(150))
    df = spark.createDataFrame([(many,)], "h string")
    got = df.select(link_array(F.col("h"), F.lit("https://a.b"), F.lit("a.b")).alias("l")).first().l
    assert got == [f"https://a.b/{i}" for i in range(150)]


@pytest.mark.parametrize("html, want", [
    ('<a title="a > b" href="/1">x</a><a href=\'/2\'>y</a>', ["/1", "/2"]),
    ('<a href="/1>x</a><a href="/2">y</a>', ["/1>x</a><a href="]),  # the quote is closed by the next one
    ('<a href="/never closed>x</a> text', []),
    ('<a title=\'it"s\' href=/q?a=b&c>x</a>', ["/q?a=b&c"]),
    ('<a href=/1/>x</a><a/href="/2"/>y</a><A HREF = "/3" href="/4">z</A>', ["/1/", "/2", "/3"]),
    ('<a href>x</a><a href=>y</a><a href="">z</a><a name="href=/no">n</a>', ["", "", ""]),
    ("<script><!-- <script> <a href='/no'> </script> <a href='/no'> --></script><a href='/1'>x</a>", ["/1"]),
    ("<script>if (a<b) '<a href=/no>' </scripty></SCRIPT ><a href='/1'>x</a>", ["/1"]),
    ("<title><a href='/no'></title><textarea><a href='/no'></textarea><style><a href='/no'></style><a href='/1'>", ["/1"]),
    ("<!-- <a href='/no'> --!><a href='/1'><!--><a href='/2'><!---><a href='/3'><!doctype a><a href='/4'></ a><a href='/5'>", ["/1", "/2", "/3", "/4", "/5"]),
    ("<script><a href='/no'>", []),
    ("<!-- <a href='/no'>", []),
    ("a < b <a href='/1'> <3 <abbr href='/no'> </a href='/no'>", ["/1"]),
    ('<a href="/a?x=1&copy=2&copy&amp;lt=3&notit;&not;&CounterClockwiseContourIntegral;&#x41;&#66&#0;&#x80;">', ["/a?x=1&copy=2\u00a9&lt=3&notit;\u00ac\u2233AB\ufffd\u20ac"]),
    ("", []), ("<", []), ("<a", []), ("</", []), ("<!", []), ("<a href='/1'", []),
])
def test_tokeniser(html, want):
    assert anchor_hrefs(html) == want


@pytest.mark.parametrize("piece", ["<", "<a ", "<!--", "</", "<script>", "<a href='", "<a b=\"c\" ", "<title>", "<script><!--<script>", "&amp", "<a\t=", "--!", "<!---"])
def test_tokeniser_is_linear(piece):
    start = time.time()
    anchor_hrefs(piece * 100_000)
    anchor_hrefs("<script>" + piece * 100_000)
    attribute_text(piece * 100_000)
    assert time.time() - start < 5


def test_only_the_bodies_asked_for_are_parsed(spark):
    s = sites(spark.createDataFrame([("https://a.b",), ("https://c.d",), ("https://e.f",)], "website_url string"))
    old = [("https://a.b/two.xml", urlset("https://a.b/old")), ("https://e.f", "<a href=/old>")]
    f = fetch_df(spark, [
        ("https://a.b/robots.txt", 200, ROBOTS), ("https://a.b/two.xml", 200, urlset("https://a.b/x")),
        ("https://a.b/sitemap.xml", 200, urlset("https://a.b/never")), ("https://a.b", 200, "<a href=/never>"),
        ("https://c.d/sitemap_index.xml", 200, index("https://c.d/u.xml")), ("https://c.d/u.xml", 200, urlset("https://c.d/1")), ("https://c.d", 200, "<a href=/never>"),
        ("https://e.f", 200, "<a href=/p>"), ("https://other/sitemap.xml", 200, urlset("https://other/never"))])
    f = f.unionByName(spark.createDataFrame([(u, 200, "x", b, datetime(2020, 1, 1)) for u, b in old], f.schema))
    parsed = []
    documents = Snapshot.documents

    def seen(self, urls):
        docs = documents(self, urls)
        parsed.extend((r.url, r.body) for r in docs.collect())
        return docs

    Snapshot.documents = seen
    try:
        assert {k: v[1] for k, v in chosen(site_url_lists(s, f)).items()} == {"https://a.b": ["https://a.b/x"], "https://c.d": ["https://c.d/1"], "https://e.f": ["https://e.f/p"]}
    finally:
        Snapshot.documents = documents
    assert sorted(u for u, _ in parsed) == ["https://a.b/robots.txt", "https://a.b/two.xml", "https://c.d/sitemap_index.xml", "https://c.d/u.xml", "https://e.f"]
    assert not any("old" in b for _, b in parsed)


def test_large_documents_take_time_in_proportion(spark):
    """The kind of a document is told once, not once for each of its items."""
    urls = [f"https://s/some/longer/path/of/a/page/{i}" for i in range(20_000)]
    f = fetch_df(spark, [("https://s/u.xml", 200, urlset(*urls)), ("https://s/m.xml", 200, index(*urls[:10_000], "https://s/u.xml", close=False))])
    start = time.time()
    got = parse_snapshot(f).groupBy("url", "kind").agg(F.count("*"), F.min("p"), F.max("p")).collect()
    assert {tuple(r) for r in got} == {("https://s/u.xml", "page", 20_000, 1, 20_000), ("https://s/m.xml", "entry", 10_000, 1, 10_000), ("https://s/m.xml", "child", 1, 10_001, 10_001)}
    assert time.time() - start < 20


def test_fetches_that_tie(spark):
    rows = [("https://s/u.xml", 200, urlset("https://s/1", "https://s/2")), ("https://s/u.xml", 200, urlset("https://s/3")), ("https://s/u.xml", 200, urlset("https://s/3"))]
    got = [(r.p, r.value) for r in parse_snapshot(fetch_df(spark, rows)).orderBy("p").collect()]
    assert got in ([(1, "https://s/1"), (2, "https://s/2")], [(1, "https://s/3")])


def test_limits(spark):
    s = sites(spark.createDataFrame([("https://a.b",), ("https://e.f",)], "website_url string"))
    f = fetch_df(spark, [("https://a.b/sitemap.xml", 200, index("https://a.b/1.xml", "https://a.b/2.xml", "https://a.b/3.xml")),
                         *[(f"https://a.b/{k}.xml", 200, urlset(*[f"https://a.b/{k}/{i}" for i in range(9)])) for k in (1, 2, 3)],
                         ("https://e.f", 200, "".join(f"<a href=/{i}>" for i in range(9)))])
    got = chosen(site_url_lists(s, f, limits=Limits(urlset=4, children=2, links=3, site=6)))
    assert got["https://a.b"][1] == [f"https://a.b/1/{i}" for i in range(4)] + [f"https://a.b/2/{i}" for i in range(2)]
    assert got["https://e.f"][1] == [f"https://e.f/{i}" for i in range(3)]
    assert site_url_lists(s, f, limits=SHORT).urls.count() == 27 + 9


def test_first_of_each_group(spark):
    rows = spark.createDataFrame([("a", i // 2) for i in range(8)] + [("b", 5)], "k string, ord int")
    assert sorted((r.k, r.pos, r.ord) for r in first_of(rows, "k", 3).collect()) == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 1, 5)]
    assert sorted((r.k, r.pos) for r in first_of(rows, "k", 3, ties=True).collect()) == [("a", 1), ("a", 1), ("a", 3), ("a", 3), ("b", 1)]
    assert "WindowGroupLimit" in first_of(rows, "k", 3)._jdf.queryExecution().executedPlan().toString()


def test_bad_ipv6_site_is_an_error(spark):
    comp = spark.createDataFrame([("https://[::1]/x",), ("https://[oops/",), ("https://ok.b",)], "website_url string")
    f = fetch_df(spark, [("https://ok.b", 200, '<a href="/p">p</a>')])
    got = chosen(site_url_lists(sites(comp), f))
    assert got["https://[oops"] == ("error", [])
    assert got["https://[::1]"] == ("none", [])
    assert got["https://ok.b"] == ("html", ["https://ok.b/p"])


def test_documents_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    """Sitemaps that lie in one file are parsed by several tasks."""
    body = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda i: F.concat(F.lit("<url><loc>https://s/"), F.sha2(F.concat_ws("-", "id", i), 256), F.lit("</loc></url>"))), "\n"), F.lit("</urlset>"))
    docs = spark.range(16).select(F.concat(F.lit("https://s/m"), "id", F.lit(".xml")).alias("url"), F.lit(200).alias("status"), F.lit("application/xml").alias("content_type"), body.alias("body"), F.lit(TS).alias("fetched_at"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/fetches")
    fetches = spark.read.parquet(f"{tmp_path}/fetches")
    snapshot = Snapshot(fetches)
    tasks = snapshot.documents(fetches.select("url")).groupBy(F.spark_partition_id()).agg(F.max(F.length("body"))).collect()
    assert len(tasks) > 1
    assert snapshot.edges(fetches.select("url")).count() == parse_snapshot(fetches).count() == 160_000


def test_files_of_a_hot_host_are_made_by_several_tasks(spark, monkeypatch):
    """The bound sitemap files are dealt by file, not by host."""
    monkeypatch.setattr(bindings, "MAX_ENTRIES_PER_FILE", 100)
    entries = spark.range(2_000).select(F.concat(F.lit("h"), F.col("id") % 1).alias("host"), F.col("id").alias("page_id"), F.concat(F.lit("https://h/"), "id").alias("url"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # the counts of very many hosts are not broadcast
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = bindings._chunked(entries, "host", "page_id", "url").select("*", F.spark_partition_id().alias("t")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.t for r in rows}) > 1 and len(rows) == 20
    assert sorted(u for r in rows for u in r.lines) == sorted(f"https://h/{i}" for i in range(2_000))
    assert all(r.lines == sorted(r.lines, key=lambda u: int(u[10:])) for r in rows)
