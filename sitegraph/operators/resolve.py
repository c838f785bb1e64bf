"""U2 union of the three URL sources, W2 first non-empty source per site,
G3 ordered unique URLs, G5 URL lists in long form, J8 company ⟕ URL list.

Lists are long form (site, position, URL). Where rows of lists are needed
(prompts, results), a site has numbered parts of at most ``PART_URLS`` URLs
that together hold every URL, so no row grows with a site.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_domain
from ..session import stored
from .frontier import path_frontier, robots_url
from .sitemaps import Limits, Snapshot, expand_sitemaps, position_path, with_positions

PART_URLS = 1000

# source_rank values (lower wins)
ROBOTS, WELL_KNOWN, HTML = 0, 1, 2
SOURCE_NAMES = {ROBOTS: "robots", WELL_KNOWN: "sitemap", HTML: "html"}


class SiteLists(NamedTuple):
    sites: DataFrame  # base_domain, netloc, bad_url, source, source_pos
    urls: DataFrame   # base_domain, pos, url


def robots_candidates(site_df: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The sitemaps that the sites' robots files name.
    Output: base_domain, source_rank, source_pos, sitemap_url."""
    robots = site_df.select("base_domain", robots_url().alias("url"))
    return robots.join(snapshot.edges(robots, ("directive",)), "url").select(
        "base_domain", F.lit(ROBOTS).alias("source_rank"), F.col("p").alias("source_pos"), F.col("value").alias("sitemap_url"))


def path_candidates(site_df: DataFrame) -> DataFrame:
    """The well-known paths of the sites, as ``robots_candidates``."""
    return path_frontier(site_df).select("base_domain", F.lit(WELL_KNOWN).alias("source_rank"), F.col("path_pos").alias("source_pos"), "sitemap_url")


def _first_filled(cands: DataFrame, snapshot: Snapshot, max_depth: int | None) -> tuple[DataFrame, DataFrame]:
    """The first candidate of each site that yields URLs, and these URLs."""
    cands = stored(cands, "candidates")
    tree = stored(expand_sitemaps(cands.select(F.col("sitemap_url").alias("root")).distinct(), snapshot.edges, max_depth), "tree")
    filled = tree.select(F.col("root").alias("sitemap_url")).distinct()
    best = cands.join(filled, "sitemap_url", "left_semi").groupBy("base_domain").agg(F.min(F.struct("source_rank", "source_pos", "sitemap_url")).alias("b")).select("base_domain", "b.*")
    best = stored(best, "sources")
    return best, best.join(tree, F.col("sitemap_url") == F.col("root")).select("base_domain", "ord", "url")


def site_url_lists(site_df: DataFrame, fetches: DataFrame, max_depth: int | None = None,
                   limits: Limits = Limits(), compat: bool = False) -> SiteLists:
    """For each site, the URL list of its first non-empty source in
    (source_rank, source_pos) order, unique in first-seen order. Sites without
    any URL have source ``none``, sites whose URL cannot be parsed ``error``.

    Sources are tried one after the other, each for the sites that are still
    without URLs: robots files, then well-known paths, then home pages. Only
    the newest bodies that a stage asks for are parsed. With ``limits``, a
    list ends with its first so many URLs (L3, W3)."""
    site_df = stored(site_df, "sites")
    snapshot = Snapshot(fetches, limits, compat)
    good = site_df.where(~F.col("bad_url")).select("base_domain").distinct()
    by_robots, robots_urls = _first_filled(robots_candidates(good, snapshot), snapshot, max_depth)
    left = good.join(by_robots, "base_domain", "left_anti")
    by_path, path_urls = _first_filled(path_candidates(left), snapshot, max_depth)
    left = left.join(by_path, "base_domain", "left_anti")
    links = snapshot.edges(left.select(F.col("base_domain").alias("url")), ("link",)).select(F.col("url").alias("base_domain"), position_path(F.col("p")).alias("ord"), F.col("value").alias("url"))
    by_links = links.select("base_domain", F.lit(HTML).alias("source_rank"), F.lit(0).alias("source_pos")).distinct()
    best = by_robots.unionByName(by_path).drop("sitemap_url").unionByName(by_links)
    placed = with_positions(robots_urls.unionByName(path_urls).unionByName(links), "base_domain").select("base_domain", "pos", "url")
    urls = stored(placed.where(F.col("pos") <= limits.site) if limits.site else placed, "site-urls")
    name = F.lit("none")
    for rank, label in SOURCE_NAMES.items():
        name = F.when(F.col("source_rank") == rank, F.lit(label)).otherwise(name)
    sites = site_df.join(best, "base_domain", "left").select(
        "base_domain", "netloc", "bad_url", F.when(F.col("bad_url"), F.lit("error")).otherwise(name).alias("source"), "source_pos")
    return SiteLists(stored(sites, "site-sources"), urls)


def url_parts(urls: DataFrame, key: str = "base_domain", part_urls: int = PART_URLS) -> DataFrame:
    """``key, part`` (from 1)``, urls``: the values in position order,
    at most ``part_urls`` a row."""
    part = ((F.col("pos") - 1) / part_urls).cast("int") + 1
    return urls.groupBy(key, part.alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("urls"))


def company_url_lists(companies: DataFrame, lists: SiteLists) -> DataFrame:
    """Every company keeps its row(s), one per part of its site's list
    (S14); a company without URLs has part 1 with none. Companies with lists
    are met by an inner join, so that Spark picks the smaller side from real
    sizes and splits hot sites (it splits no right side of a left join)."""
    of_site = lists.sites.select(F.col("base_domain").alias("_site"), "source", "source_pos").dropDuplicates(["_site"])
    c = companies.withColumn("base_domain", base_domain(F.col("website_url")))
    c = stored(c.join(of_site, F.col("base_domain") == F.col("_site"), "left").select(*companies.columns, "source", "source_pos", "_site"), "company-sites")
    listed = c.join(url_parts(lists.urls.withColumnRenamed("base_domain", "_site"), "_site"), "_site")
    bare = c.join(lists.urls.select(F.col("base_domain").alias("_site")).distinct(), "_site", "left_anti").withColumn(
        "part", F.lit(1)).withColumn("urls", F.array().cast("array<string>"))
    return listed.unionByName(bare).select(*companies.columns, "source", "source_pos", "part", "urls")
