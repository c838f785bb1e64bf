"""Sites, the well-known-path frontier (J1), fetch lookup (J2/J3, A3-A5) and
robots directives (X6, F2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_domain, bad_ipv6_netloc, url_netloc, ustrip

# Well-known sitemap paths, tried in this order.
WELL_KNOWN_PATHS = [
    "/sitemap.xml",
    "/sitemaps.xml",
    "/sitemap_index.xml",
    "/sitemap-index.xml",
    "/wp-sitemap.xml",
    "/site-map.xml",
    "/sitemap.php",
    "/sitemap.txt",
    "/sitemap/sitemap.xml",
]

def sites(companies: DataFrame, url_col: str = "website_url") -> DataFrame:
    """Distinct crawl units ``base_domain, netloc`` (plus ``bad_url`` when the
    netloc would make ``urlparse`` raise, S24)."""
    u = F.col(url_col)
    nl = url_netloc(u)
    return companies.select(base_domain(u).alias("base_domain"), nl.alias("netloc"),
                            bad_ipv6_netloc(nl).alias("bad_url")).dropDuplicates(["base_domain", "netloc"])


def path_frontier(site_df: DataFrame) -> DataFrame:
    """Every site × the 9 well-known paths. The path list is a fixed
    literal, so each site row is expanded in place (``inline``): no join and
    no shuffle."""
    paths = F.array(*[F.struct(F.lit(i).alias("path_pos"), F.lit(p).alias("path"))
                      for i, p in enumerate(WELL_KNOWN_PATHS)])
    return site_df.select("base_domain", F.inline(paths)).select(
        "base_domain", "path_pos", F.concat("base_domain", "path").alias("sitemap_url"))


def latest_fetches(fetches: DataFrame, wanted_urls: DataFrame, url_col: str = "url") -> DataFrame:
    """A3-A5: the newest fetch of each wanted URL (whole bodies). Only wanted
    rows pass the semi-join; Spark picks its strategy from real sizes."""
    wanted = wanted_urls.select(F.col(url_col).alias("url")).dropDuplicates()
    newest = F.max_by(F.struct("status", "content_type", "body", "fetched_at"), F.struct("fetched_at", F.xxhash64("body"))).alias("_f")
    return fetches.join(wanted, "url", "left_semi").groupBy("url").agg(newest).select("url", "_f.*")


def robots_url(base: str = "base_domain"):
    return F.concat(F.col(base), F.lit("/robots.txt"))


def directive_items(body: Column) -> Column:
    """X6/F2 in-row: the values of a robots file's ``Sitemap:`` lines, in file
    order, each with its 0-based line (ARRAY<STRUCT<line, value>>). Matching is
    ``lower(line) startswith 'sitemap:'`` with no leading-space tolerance."""
    lines = F.transform(F.split(body, "\n", -1), lambda x, i: F.struct(i.cast("int").alias("line"), x.alias("value")))
    found = F.filter(lines, lambda x: F.lower(x["value"]).startswith("sitemap:"))
    return F.transform(found, lambda x: F.struct(x["line"].alias("line"), ustrip(F.substr(x["value"], F.lit(9))).alias("value")))


def robots_directives(site_df: DataFrame, fetches: DataFrame) -> DataFrame:
    """The directives of each site's newest robots.txt, if its status is 200.
    Output: base_domain, dir_pos, sitemap_url."""
    r = site_df.select("base_domain", robots_url().alias("url"))
    docs = latest_fetches(fetches, r).filter(F.col("status") == 200)
    found = r.join(docs.select("url", "body"), "url").select("base_domain", F.explode(directive_items(F.col("body"))).alias("d"))
    return found.select("base_domain", F.col("d.line").alias("dir_pos"), F.col("d.value").alias("sitemap_url"))
