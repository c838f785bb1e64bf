"""Sitemap documents: F3 body gate, X1 urlset, X2 index, X3/X4 line-scan
fallbacks for malformed bodies, F6 ``.xml`` routing, J4 recursive expansion
and U1 ordered union.

Every document is parsed inside its own row (``from_xml`` is permissive: a
malformed body yields ``_corrupt`` instead of failing the task), so parsing is
a narrow transformation. ``parse_snapshot`` does that once for the newest
fetch of every URL of a snapshot; the recursion then joins narrow edges, never
bodies. ``Snapshot.edges`` parses the bodies of wanted URLs alone.

Nothing is cut by default: ``Limits`` (URLs per urlset, entries per index,
links per page, …) and ``max_depth`` are off unless given.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base_domain, url_netloc, ustrip
from ..session import stored
from .frontier import directive_items
from .links import link_array

# Fixed value: the sitemaps.org 0.9 namespace.
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"

_URLSET_SCHEMA = "url array<struct<loc: array<string>>>, _corrupt string"
_INDEX_SCHEMA = "sitemap array<struct<loc: array<string>>>, _corrupt string"
# Python's str.splitlines() boundaries.
_LINES_RE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
_NO_STRINGS = "array<string>"
ITEMS = "array<struct<kind:string,value:string>>"
SITEMAP_KINDS = ("page", "entry", "child")
KINDS = ("page", "entry", "child", "directive", "link")
# Positions of a document that are numbered together.
CHUNK = 1000


class Limits(NamedTuple):
    """The first so many of each; ``None`` is no limit."""
    urlset: int | None = None    # URLs of a urlset
    children: int | None = None  # children of an index
    links: int | None = None     # links of a home page
    site: int | None = None      # URLs of a site's list
    prompt: int | None = None    # URLs in a prompt


# The limits of a crawl that looks at the beginnings only.
SHORT = Limits(urlset=100, children=3, links=100, site=500, prompt=100)


def doc_kind(body: Column) -> Column:
    """``index`` if the body contains ``<sitemapindex``, else ``urlset``
    if it contains ``<urlset``, else NULL (the content type never decides).
    A prefixed root (``<s:urlset``) counts as well."""
    def has(tag: str) -> Column:
        return body.contains(f"<{tag}") | body.rlike(f"<[\\w.\\-]+:{tag}\\b")

    return F.when(has("sitemapindex"), F.lit("index")).when(has("urlset"), F.lit("urlset"))


def _root(body: Column, tag: str, group: int) -> Column:
    """Prefix (1) or attributes (2) of the root element, comments skipped."""
    return F.regexp_extract(F.regexp_replace(body, "(?s)<!--.*?-->", ""), f"<([\\w.\\-]+:)?{tag}\\b([^>]*)>", group)


def root_namespace(body: Column, tag: str) -> Column:
    """The namespace of the root element, by its own prefix or the default."""
    prefix, attributes = F.rtrim(_root(body, tag, 1), F.lit(":")), _root(body, tag, 2)
    plain = F.regexp_extract(attributes, "(?<![\\w:])xmlns\\s*=\\s*[\"']([^\"']*)[\"']", 1)
    bound = F.regexp_extract(F.replace(attributes, F.concat(F.lit("xmlns:"), prefix, F.lit("=")), F.lit("\u0001=")), "\u0001=\\s*[\"']([^\"']*)[\"']", 1)
    return F.when(prefix == "", plain).otherwise(bound)


def _without_prefix(body: Column, tag: str) -> Column:
    """The body with the root's own prefix taken off all its elements."""
    prefix = _root(body, tag, 1)
    bare = F.replace(F.replace(body, F.concat(F.lit("<"), prefix), F.lit("<")), F.concat(F.lit("</"), prefix), F.lit("</"))
    return F.when(body.rlike(f"<[\\w.\\-]+:{tag}\\b") & (prefix != ""), bare).otherwise(body)


def _ns_ok(body: Column, tag: str, compat: bool = False) -> Column:
    ns = root_namespace(body, tag)
    return (ns == "") if compat else ((ns == "") | (ns == SITEMAP_NS))


def _parsed(body: Column, tag: str, schema: str) -> Column:
    options = {"rowTag": tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return F.from_xml(_without_prefix(body, tag), schema, options)


def loc_lines(body: Column) -> Column:
    """X3/X4 helper: per line (``splitlines``), the stripped text between the
    first ``<loc>`` and the first ``</loc>`` when the latter comes after the
    former; NULL for other lines. No entity decoding (as in a text scan)."""
    lines = F.split(body, _LINES_RE, -1)

    def one(line: Column) -> Column:
        s = F.instr(line, "<loc>")
        e = F.instr(line, "</loc>")
        ok = (s > 0) & (e > 0) & (s + 5 < e)
        return F.when(ok, ustrip(F.substr(line, s + 5, e - s - 5)))

    return F.filter(F.transform(lines, one), lambda x: x.isNotNull())


def _locs(entries: Column) -> Column:
    """The non-empty, stripped ``loc`` texts of parsed entries."""
    locs = F.flatten(F.transform(F.coalesce(entries, F.array()), lambda u: F.coalesce(u["loc"], F.array())))
    return F.filter(F.transform(locs, ustrip), lambda s: s.isNotNull() & (s != ""))


def _first(items: Column, n: int | None) -> Column:
    return F.slice(items, 1, n) if n else items


def _urlset_from(parsed: Column, body: Column, cap: int | None) -> Column:
    good = F.when(_ns_ok(body, "urlset"), _locs(parsed["url"])).otherwise(F.array().cast(_NO_STRINGS))
    return _first(F.array_distinct(F.when(parsed["_corrupt"].isNotNull(), loc_lines(body)).otherwise(good)), cap)


def _children_from(parsed: Column, body: Column, compat: bool, children: int | None) -> Column:
    good = F.when(_ns_ok(body, "sitemapindex", compat), _locs(parsed["sitemap"])).otherwise(F.array().cast(_NO_STRINGS))
    return _first(good, children)


def urlset_urls(body: Column, cap: int | None = None) -> Column:
    """X1 (+X3 fallback): ordered unique ``loc`` URLs of a urlset body (the
    first ``cap`` if given). Empty ``<loc/>`` elements are dropped; another
    root namespace yields nothing (S11)."""
    return _urlset_from(_parsed(body, "urlset", _URLSET_SCHEMA), body, cap)


def index_children(body: Column, compat: bool = False, children: int | None = None) -> Column:
    """The child ``loc`` entries of a well-formed index (the first
    ``children`` if given). ``compat=True`` reproduces the original's
    namespaced-path typo: a namespaced index then yields no children (S1)."""
    return _children_from(_parsed(body, "sitemapindex", _INDEX_SCHEMA), body, compat, children)


def index_is_corrupt(body: Column) -> Column:
    return _parsed(body, "sitemapindex", _INDEX_SCHEMA)["_corrupt"].isNotNull()


def malformed_index_items(body: Column, children: int | None = None) -> Column:
    """Line scan of a malformed index, ARRAY<STRUCT<kind, value>> in
    line order: entries ending in ``.xml`` are child sitemaps, others page
    URLs. With ``children``, nothing after that many children is read. One
    pass over the lines, and one more for the limit."""
    entries = loc_lines(body)
    items = F.transform(entries, lambda v: F.struct(F.when(v.endswith(".xml"), F.lit("child")).otherwise(F.lit("page")).alias("kind"), v.alias("value")))
    if not children:
        return items
    places = F.filter(F.transform(entries, lambda v, i: F.when(v.endswith(".xml"), i + 1)), lambda i: i.isNotNull())
    return F.slice(items, F.lit(1), F.coalesce(F.try_element_at(places, F.lit(children)), F.size(entries)))


def _as_items(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def parse_documents(docs: DataFrame, body: str = "body", cap: int | None = None, compat: bool = False,
                    out: str = "items", children: int | None = None) -> DataFrame:
    """One document per row → ``out`` ARRAY<STRUCT<kind, value>> in document
    order: ``page`` items are URLs, ``child`` items are sitemaps to expand.
    Each body is parsed once, with the schema of its kind (F3 routing)."""
    b = F.col(body)
    d = docs.withColumn("_kind", doc_kind(b))
    d = d.withColumn("_px", F.when(F.col("_kind") == "urlset", _parsed(b, "urlset", _URLSET_SCHEMA)))
    d = d.withColumn("_ix", F.when(F.col("_kind") == "index", _parsed(b, "sitemapindex", _INDEX_SCHEMA)))
    ix = F.col("_ix")
    of_index = F.when(ix["_corrupt"].isNotNull(), malformed_index_items(b, children)).otherwise(
        _as_items(_children_from(ix, b, compat, children), "child"))
    items = (F.when(F.col("_kind") == "index", of_index)
             .when(F.col("_kind") == "urlset", _as_items(_urlset_from(F.col("_px"), b, cap), "page"))
             .otherwise(F.array().cast(ITEMS)))
    return d.withColumn(out, items).drop("_kind", "_px", "_ix")


EDGE = "array<struct<p:int,kind:string,value:string>>"


def newest_versions(fetches: DataFrame) -> DataFrame:
    """``url, fetched_at, status, n`` of every URL's newest fetch; ``n`` > 1
    where rows tie on all three. Bodies are not read."""
    seen = fetches.groupBy("url", "fetched_at", "status").agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("url").agg(F.max(F.struct("fetched_at", "status", "n")).alias("v")).select("url", "v.*")


def _numbered(items: str, page: str) -> Column:
    """Items with their places, ``page`` items named ``page``. What depends on
    the whole document stays out of the lambda, which runs once an item."""
    return F.transform(items, lambda x, i: F.struct((i + 1).cast("int").alias("p"), F.when(x["kind"] == "page", page).otherwise(x["kind"]).alias("kind"), x["value"].alias("value")))


def document_edges(docs: DataFrame, kinds: tuple[str, ...], limits: Limits = Limits(), compat: bool = False) -> DataFrame:
    """The edges ``p, kind, value`` of each document (``url, status, body, n``)
    as ``url, n, hash, e``; nothing that belongs to other ``kinds`` is parsed."""
    parts, none = [], F.array().cast(EDGE)
    if set(kinds) & set(SITEMAP_KINDS):
        docs = parse_documents(docs, "body", limits.urlset, compat, children=limits.children)
        parts.append(F.when(doc_kind(F.col("body")) == "index", _numbered("items", "entry")).otherwise(_numbered("items", "page")))
    if "directive" in kinds:
        parts.append(F.when(F.col("url").endswith("/robots.txt") & (F.col("status") == 200), F.transform(
            directive_items(F.col("body")), lambda d: F.struct(d["line"].alias("p"), F.lit("directive").alias("kind"), d["value"].alias("value")))))
    if "link" in kinds:
        home = F.when(F.col("url") == base_domain(F.col("url")), F.col("body"))  # other bodies are not tokenised
        parts.append(F.transform(link_array(home, F.col("url"), url_netloc(F.col("url")), limits.links), lambda v, i: F.struct(
            (i + 1).cast("int").alias("p"), F.lit("link").alias("kind"), v.alias("value"))))
    every = F.concat(*[F.coalesce(x.cast(EDGE), none) for x in parts])
    return docs.select("url", "n", F.when(F.col("n") > 1, F.xxhash64("body")).alias("hash"), F.explode_outer(every).alias("e"))


def _settled(edges: DataFrame) -> DataFrame:
    """One document per URL: of fetches that tie, the one with the greatest
    hash of its body."""
    single = edges.where("n = 1 and e is not null").select("url", "e.*")
    tied = edges.where("n > 1")
    chosen = tied.groupBy("url").agg(F.max("hash").alias("_hash"))
    return single.unionByName(tied.join(chosen, "url").where("hash = _hash and e is not null").select("url", "e.*").distinct())


def _dealt(docs: DataFrame) -> DataFrame:
    """Documents dealt over tasks by URL: one file of a snapshot may hold many
    large sitemaps, and parsing them is the work. A set number of tasks, as
    sitemaps compress so well that AQE would put them together again."""
    return docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "url")


class Snapshot:
    """A crawl snapshot read by need: ``edges`` parses the newest bodies of
    the wanted URLs alone."""

    def __init__(self, fetches: DataFrame, limits: Limits = Limits(), compat: bool = False):
        self.fetches, self.limits, self.compat = fetches.select("url", "status", "body", "fetched_at"), limits, compat
        self.newest = stored(newest_versions(fetches), "newest")

    def documents(self, urls: DataFrame) -> DataFrame:
        """``url, status, body, n``: the newest fetch(es) of ``urls(url)``."""
        wanted = self.newest.join(urls.select("url").distinct(), "url", "left_semi")
        return _dealt(self.fetches.join(wanted, ["url", "fetched_at", "status"]))

    def edges(self, urls: DataFrame, kinds: tuple[str, ...] = SITEMAP_KINDS) -> DataFrame:
        return stored(_settled(document_edges(self.documents(urls), kinds, self.limits, self.compat)), "edges")


def parse_snapshot(fetches: DataFrame, cap: int | None = None, compat: bool = False, children: int | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One scan of a crawl snapshot's newest bodies → edges ``url, p, kind,
    value`` (``p`` is the position in the document).

    Kinds: ``page`` of urlsets, ``child`` and ``entry`` (a page among the
    children) of indexes, ``directive`` of robots files (status 200; ``p`` is the line), ``link`` of home pages (URLs that
    are their own base domain). The newest fetch per URL is picked from times
    and status; older bodies and unwanted ``kinds`` are not parsed."""
    docs = _dealt(fetches.select("url", "status", "body", "fetched_at").join(newest_versions(fetches), ["url", "fetched_at", "status"]))
    return _settled(stored(document_edges(docs, kinds, Limits(urlset=cap, children=children), compat), "edges"))


def position_path(p: Column, chunk: int = CHUNK) -> Column:
    """The last two steps of a page's position path: its chunk of the document
    and its place there."""
    return F.array((p / chunk).cast("int"), (p % chunk).cast("int"))


def expand_sitemaps(roots: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], max_depth: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Expand every root sitemap URL recursively (index → child → …)
    until no new child turns up (or ``max_depth`` levels below the root). A
    sitemap is expanded once per root, where it is first met, so cycles and
    shared children end (S25). ``edges`` is ``parse_snapshot``'s output, or gives the edges of a level's URLs
    (``Snapshot.edges``).

    Output long form ``root, ord ARRAY<INT>, url``: ``ord`` is the position
    path (a child's place in each index on the way, then ``position_path``),
    so sorting by it gives document order with each child's URLs in place; URLs are unique per root (first position wins). Each level is one
    join of the frontier with the narrow edges, written once."""
    lookup = edges if callable(edges) else lambda urls: edges.where(F.col("kind").isin(*SITEMAP_KINDS))
    step = F.when(F.col("kind") == "page", position_path(F.col("p"), chunk)).when(F.col("kind") == "entry", F.array("p", F.lit(0))).otherwise(F.array("p"))
    frontier = stored(roots.select("root", F.array().cast("array<int>").alias("ord"), F.col("root").alias("sitemap_url")).distinct(), "frontier")
    visited, pages, depth = frontier.select("root", "sitemap_url"), None, 0
    while True:
        level = lookup(frontier.select(F.col("sitemap_url").alias("url")))
        items = stored(frontier.join(level, frontier.sitemap_url == level.url).select(
            "root", F.concat("ord", step).alias("ord"), "kind", "value"), "items")
        found = items.where("kind <> 'child'").select("root", "ord", F.col("value").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        if max_depth is not None and depth >= max_depth:
            break
        children = items.where("kind = 'child'").groupBy("root", F.col("value").alias("sitemap_url")).agg(F.min("ord").alias("ord"))
        frontier = stored(children.join(visited, ["root", "sitemap_url"], "left_anti").select("root", "ord", "sitemap_url"), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("root", "sitemap_url"))
        depth += 1
    return pages.groupBy("root", "url").agg(F.min("ord").alias("ord")).select("root", "ord", "url")


def with_positions(rows: DataFrame, key: str, order: str = "ord", out: str = "pos") -> DataFrame:
    """Add the 1-based position of each row within its ``key``, by the
    position path ``order`` (which ends with a chunk and the place in it).

    A key may hold very many rows, so they are counted per chunk; one window
    adds up a key's chunk counts, the other numbers the few rows of a chunk."""
    rows = rows.withColumn("_chunk", F.slice(order, F.lit(1), F.size(order) - 1))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "_chunk").agg(F.count("*").alias("_n")).select(
        F.col(key).alias("_key"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(key, "_chunk").orderBy(order)
    placed = rows.withColumn("_row", F.row_number().over(own)).join(starts, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_c")))
    return placed.withColumn(out, F.col("_start") + F.col("_row")).drop("_chunk", "_row", "_key", "_c", "_start")


def first_of(rows: DataFrame, key: str, n: int, order: str = "ord", ties: bool = False, out: str = "pos") -> DataFrame:
    """The first ``n`` rows of each ``key`` by ``order``, numbered in
    ``out``; with ``ties``, also the rows that tie with the last of them. A
    ranked window with a limit: every task hands on ``n`` rows a key."""
    own = Window.partitionBy(key).orderBy(order)
    rank = (F.rank() if ties else F.row_number()).over(own)
    return rows.withColumn(out, rank).where(F.col(out) <= n)
