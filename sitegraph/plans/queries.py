"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Inputs are bound from the driver tables by ``bindings`` (whole tables, all
rows); the names are the contract with ``__spark_entry__``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_domain, url_netloc
from ..operators.links import extract_links
from ..operators.normalize import dedupe_companies, job_ack as _job_ack, normalize_companies, submission_summary
from ..operators.frontier import latest_fetches, path_frontier, robots_directives as _robots, sites
from ..operators.resolve import company_url_lists, site_url_lists as _site_url_lists
from ..operators.sitemaps import (SITEMAP_KINDS, Limits, expand_sitemaps, first_of, index_children, malformed_index_items, parse_snapshot,
                                  urlset_urls, with_positions)
from ..operators import jobs as J
from ..operators import store as S
from ..operators.insights import generate_insights, insight_requests
from ..session import stored
from ..sources.companies import scan_companies
from ..sources.sinks import write_results_csv
from . import bindings as B
from . import stream_queries as SQ
from .compose import half_cache, process_companies
from .stubs import echo_model
from .tables import table


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """X5/F4/F5/H8 on every page, each page joined against its own root."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    p = pages.select("page_id", "html", base_domain(F.col("url")).alias("base"), url_netloc(F.col("url")).alias("netloc"))
    return extract_links(p, "html", "base", "netloc", ["page_id"]).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "url")


def company_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_companies(B.companies_raw(spark, sf))


def company_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe_companies(company_normalize(spark, sf))


def job_ack(spark: SparkSession, sf: str) -> DataFrame:
    return _job_ack(company_dedupe(spark, sf), submission="upload-1")


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return sites(company_dedupe(spark, sf))


def site_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Every company site × the 9 well-known paths."""
    return path_frontier(_sites(spark, sf)).select("base_domain", F.col("path_pos").cast("bigint"), "sitemap_url")


def robots_directives(spark: SparkSession, sf: str) -> DataFrame:
    """A3/X6/F2/J3 over the bound robots files."""
    return _robots(_sites(spark, sf), B.fetches(spark, sf)).select(
        "base_domain", F.col("dir_pos").cast("bigint"), "sitemap_url")


def _docs(spark: SparkSession, sf: str, urls: DataFrame) -> DataFrame:
    return latest_fetches(B.fetches(spark, sf), urls)


def _explode(df: DataFrame, key: str, arr, names=("pos", "url")) -> DataFrame:
    out = df.select(F.col(key), F.posexplode(arr).alias("_p", "_v"))
    return out.select(key, (F.col("_p") + 1).cast("bigint").alias(names[0]), F.col("_v").alias(names[1]))


def urlset_expand(spark: SparkSession, sf: str) -> DataFrame:
    """The unique URLs of every bound urlset."""
    docs = _docs(spark, sf, B.urlset_files(spark, sf).select("url"))
    return _explode(docs.withColumnRenamed("url", "sitemap_url"), "sitemap_url", urlset_urls(F.col("body")))


def urlset_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """Every bound urlset with its closing tag cut: line-scan fallback."""
    docs = _docs(spark, sf, B.urlset_files(spark, sf).select("url"))
    cut = F.regexp_replace("body", "</urlset>\\s*$", "")
    return _explode(docs.withColumnRenamed("url", "sitemap_url"), "sitemap_url", urlset_urls(cut))


def index_expand(spark: SparkSession, sf: str) -> DataFrame:
    """The children of every bound domain index."""
    docs = _docs(spark, sf, B.domain_index_files(spark, sf).select("url"))
    return _explode(docs.withColumnRenamed("url", "index_url"), "index_url", index_children(F.col("body")),
                    ("pos", "child_url"))


def index_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """Every domain index with its closing tag cut: line scan with
    ``.xml`` routing."""
    docs = _docs(spark, sf, B.domain_index_files(spark, sf).select("url"))
    cut = F.regexp_replace("body", "</sitemapindex>\\s*$", "")
    e = _explode(docs.withColumnRenamed("url", "index_url"), "index_url", malformed_index_items(cut), ("pos", "item"))
    return e.select("index_url", "pos", F.col("item.kind").alias("kind"), F.col("item.value").alias("url"))


def sitemap_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Recursive expansion of every domain index."""
    roots = B.domain_index_files(spark, sf).select(F.col("url").alias("root"))
    tree = expand_sitemaps(roots, parse_snapshot(B.fetches(spark, sf), kinds=SITEMAP_KINDS))
    return with_positions(tree, "root").select("root", "pos", "url")


def sitemap_top(spark: SparkSession, sf: str) -> DataFrame:
    """The first five URLs of every domain index's expansion."""
    roots = B.domain_index_files(spark, sf).select(F.col("url").alias("root"))
    tree = expand_sitemaps(roots, parse_snapshot(B.fetches(spark, sf), kinds=SITEMAP_KINDS))
    return first_of(tree, "root", 5).select("root", F.col("pos").cast("bigint").alias("pos"), "url")


#: L3: small enough to show on the bound snapshot.
LIMITS = Limits(urlset=3, children=1, links=4, site=3, prompt=2)


def limited_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """L3/W3 from end to end: lists and prompts of the first URLs only."""
    companies = stored(company_dedupe(spark, sf), "companies")
    lists = company_url_lists(companies, _site_url_lists(sites(companies), B.fetches(spark, sf), limits=LIMITS))
    return insight_requests(lists.withColumn("listed", F.size("urls")), limit=LIMITS.prompt).select(
        "_ord", "company", "source", F.col("listed").cast("bigint").alias("n_urls"), "key", "prompt")


def _company_lists(spark: SparkSession, sf: str) -> DataFrame:
    companies = stored(company_dedupe(spark, sf), "companies")
    lists = _site_url_lists(sites(companies), B.fetches(spark, sf))
    return company_url_lists(companies, lists)


def site_url_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: U2/W2/G3/G5/J5/J8 — every company with the URL list (in
    parts) of its site's first non-empty source."""
    c = _company_lists(spark, sf)
    return c.select("_ord", "company", "website_url", "source", F.col("part").cast("bigint").alias("part"), F.size("urls").cast("bigint").alias("n_urls"),
                    F.array_join("urls", ", ").alias("sitemap_complete"))


def insight_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """M1/M2/H9 over the flagship lists."""
    return insight_requests(_company_lists(spark, sf)).select("_ord", "company", F.col("part").cast("bigint").alias("part"), "key", "prompt")


def _insight_rows(spark: SparkSession, sf: str) -> DataFrame:
    req = stored(insight_requests(_company_lists(spark, sf)), "requests")
    rows, _ = generate_insights(req, half_cache(req), echo_model)
    return rows


def insight_cache_join(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the keys answered by the cache, the rest by the
    (stub) model once per distinct key; failures become error text."""
    return _insight_rows(spark, sf).select("_ord", "company", F.col("part").cast("bigint").alias("part"), "key", "cached", "insight")


def company_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The store record of every processed company."""
    d = S.company_documents(_insight_rows(spark, sf), now=B.STORE_NOW)
    return d.select("_ord", "company_name", "website_url", F.col("part").cast("bigint").alias("part"), F.size("sitemap_urls").cast("bigint").alias("n_urls"),
                    F.array_join("sitemap_urls", ", ").alias("sitemap_complete"), "ai_insights", "last_updated",
                    "company_name_normalized")


def results_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The output rows of every processed company."""
    return J.output_rows(_insight_rows(spark, sf)).withColumn("Part", F.col("Part").cast("bigint"))


def processed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """M5: companies through the whole chain to their job rows. Rows with a
    website that cannot be parsed are among them (every 7th page id): these end
    as errors, without prompt or document."""
    raw = B.companies_raw(spark, sf)
    asked = F.struct("_ord", "company", "website")
    broken = F.struct((F.col("_ord") + 1_000_000_000_000).alias("_ord"), "company", F.concat(F.lit("https://[bad-"), "company").alias("website"))
    rows = raw.select(F.inline(F.when(F.col("_ord") % 7 == 0, F.array(asked, broken)).otherwise(F.array(asked))))
    companies = dedupe_companies(normalize_companies(rows))
    out = process_companies(companies, B.fetches(spark, sf), echo_model, None, B.STORE_NOW, submission="upload-1")
    return out["jobs"].select("_ord", F.col("part").cast("bigint").alias("part"), "job_id", "status", "message", F.col("data.Company").alias("company"),
                              F.col("data.`Insight from Prompt`").alias("insight"))


def processed_store(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of that chain in the store: of documents that
    share a name the last of the intake stays."""
    companies = company_dedupe(spark, sf)
    docs = process_companies(companies, B.fetches(spark, sf), echo_model, None, B.STORE_NOW)["documents"]
    root = SQ._run_dir(spark, "processed-store")
    S.upsert_snapshot(spark, root, docs, B.STORE_NOW, "_ord")
    return S.by_freshness(S.scan_store(spark, root)).select("company_name", "website_url", F.col("part").cast("bigint").alias("part"),
                                                            F.size("sitemap_urls").cast("bigint").alias("n_urls"), "last_updated")


def _uploads(spark: SparkSession, sf: str) -> str:
    """The bound companies as CSV uploads: two files' worth of folders whose
    headers differ in names and order."""
    root = SQ._run_dir(spark, "uploads")
    raw = B.companies_raw(spark, sf)
    for i, names in enumerate((("Company", "Website"), ("Home URL", "Organization"))):
        part = raw.where(F.col("_ord") % 2 == i).select(*[F.col("website" if n in ("Website", "Home URL") else "company").alias(n) for n in names])
        part.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/upload-{i}")
    return root


def uploaded_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Companies read back from uploaded CSV files, each by its own
    header, then cleaned."""
    rows = normalize_companies(scan_companies(spark, _uploads(spark, sf)))
    return rows.groupBy("company", "website_url").agg(F.count("*").alias("n_rows"))


def uploaded_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """A1 with line breaks in quoted cells: read by records, each with its
    place in the file."""
    root = SQ._run_dir(spark, "multiline")
    raw = B.companies_raw(spark, sf)
    name = F.concat("company", F.lit(', "of"\nbranch '), (F.col("_ord") % 3).cast("string"))
    raw.select(name.alias("Company"), F.lit("first\n\nthird, line").alias("Note"), F.col("website").alias("Website")).write.option("header", True).option(
        "quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/upload")
    rows = normalize_companies(scan_companies(spark, root, multiline=True))
    return rows.groupBy("company", "website_url").agg(F.count("*").alias("n_rows"))


def results_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A10: the de-duplicated results written as CSV and read back."""
    path = f"{SQ._run_dir(spark, 'results')}/csv"
    write_results_csv(J.dedupe_results(B.jobs(spark, sf)).select(*J.OUTPUT_COLUMNS), path)
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def store_reset(spark: SparkSession, sf: str) -> DataFrame:
    """A stored snapshot, a reset, and the update batch upserted into
    the empty store."""
    root = SQ._run_dir(spark, "store-reset")
    S.write_snapshot(B.store_snapshot(spark, sf), root, 0)
    S.reset_store(spark, root)
    S.upsert_snapshot(spark, root, B.store_updates(spark, sf), B.STORE_NOW, "event_id")
    return S.scan_store(spark, root).select("company_name", "ai_insights", "last_updated", "company_name_normalized")


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    """The upsert result, written once (as the next store snapshot would be)."""
    u, supplied = S.prepare_updates(B.store_updates(spark, sf), now=B.STORE_NOW, order="event_id")
    return S.upsert(B.store_snapshot(spark, sf), u, supplied).checkpoint()


def _store_view(df: DataFrame) -> DataFrame:
    return df.select("company_name", "website_url", F.array_join("sitemap_urls", ", ").alias("sitemap_complete"),
                     "ai_insights", "last_updated", "company_name_normalized")


def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The store after upserting the update batch."""
    return _store_view(S.documents(_upserted(spark, sf)))


def store_upsert_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Inserted / modified / matched counters of that upsert."""
    return S.upsert_counts(_upserted(spark, sf))


def store_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Freshest record per normalised name."""
    return _store_view(S.latest_per_company(S.documents(_upserted(spark, sf))))


def store_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """The update batch in many small ones, appended to a store of
    small buckets: read through its deltas, and again after compaction."""
    root, settings = SQ._run_dir(spark, "store-compaction"), {"bucket_rows": 64, "max_deltas": 4}
    S.write_snapshot(B.store_snapshot(spark, sf), root, 0, **settings)
    updates = stored(B.store_updates(spark, sf), "updates")
    for part in SQ._chunks(updates, "event_id", 6):
        S.upsert_snapshot(spark, root, part, B.STORE_NOW, "event_id", **settings)
    store = S.open_store(spark, root, **settings)
    before, after = store.latest(), store.compact()
    both = [_store_view(store.read(v)).withColumn("stage", F.lit(name)) for v, name in ((before, "deltas"), (after, "compacted"))]
    return both[0].unionByName(both[1])


def store_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """F8/L2: find-one in the stored documents by exact name (both spellings
    and an unknown lower-case one per user) and by website, through the
    buckets of the probes."""
    root = SQ._run_dir(spark, "store-lookup")
    S.write_snapshot(B.store_snapshot(spark, sf), root, 0)
    S.upsert_snapshot(spark, root, B.store_updates(spark, sf), B.STORE_NOW, "event_id")
    users = table(spark, sf, "events").select("user_id").dropDuplicates()
    base = F.concat(F.lit("Company "), F.col("user_id").cast("string"))
    names = users.select(F.explode(F.array(base, F.upper(base), F.lower(base))).alias("probe"))
    web = users.select(F.explode(F.array(
        F.concat(F.lit("https://c"), F.col("user_id").cast("string"), F.lit(".example.com/view")),
        F.concat(F.lit("https://c"), F.col("user_id").cast("string"), F.lit(".example.com/none")))).alias("probe"))
    by_name = S.find(spark, root, names, "probe", "company_name").withColumn("by", F.lit("name"))
    by_web = S.find(spark, root, web, "probe", "website_url").withColumn("by", F.lit("website"))
    cols = ["by", "probe", "found", "company_name", "website_url", "ai_insights", "last_updated"]
    return by_name.select(*cols).unionByName(by_web.select(*cols))


def results_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Last completed result per company, first-completion position."""
    return J.dedupe_results(B.jobs(spark, sf))


def job_status_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Status of probed ids ``job_<2·event_id>`` (half unknown)."""
    probes = table(spark, sf, "events").select(
        F.concat(F.lit("job_"), (F.col("event_id") * 2).cast("string")).alias("job_id"))
    return J.status_lookup(B.jobs(spark, sf), probes)


def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    """G6/H15/H16 per submission."""
    return J.job_progress(B.jobs(spark, sf))


def job_eta(spark: SparkSession, sf: str) -> DataFrame:
    """G7/H14 per submission."""
    return J.job_eta(B.jobs(spark, sf))


def queue_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """G8."""
    return J.queue_sizes(B.jobs(spark, sf))


def status_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document per job."""
    return J.status_json(B.jobs(spark, sf))


def submission_ack(spark: SparkSession, sf: str) -> DataFrame:
    """The submission acknowledgement (status, job count, message)."""
    return submission_summary(job_ack(spark, sf))


REGISTRY = {
    "company_normalize": company_normalize,
    "company_dedupe": company_dedupe,
    "job_ack": job_ack,
    "submission_ack": submission_ack,
    "site_frontier": site_frontier,
    "robots_directives": robots_directives,
    "urlset_expand": urlset_expand,
    "urlset_malformed": urlset_malformed,
    "index_expand": index_expand,
    "index_malformed": index_malformed,
    "sitemap_tree": sitemap_tree,
    "sitemap_top": sitemap_top,
    "limited_prompts": limited_prompts,
    "site_url_lists": site_url_lists,
    "insight_prompts": insight_prompts,
    "insight_cache_join": insight_cache_join,
    "company_documents": company_documents,
    "results_rows": results_rows,
    "processed_jobs": processed_jobs,
    "processed_store": processed_store,
    "uploaded_companies": uploaded_companies,
    "uploaded_multiline": uploaded_multiline,
    "results_csv": results_csv,
    "store_reset": store_reset,
    "store_upsert": store_upsert,
    "store_upsert_counts": store_upsert_counts,
    "store_latest": store_latest,
    "store_lookup": store_lookup,
    "store_compaction": store_compaction,
    "results_dedupe": results_dedupe,
    "job_status_lookup": job_status_lookup,
    "job_progress": job_progress,
    "job_eta": job_eta,
    "queue_sizes": queue_sizes,
    "status_json": status_json,
    "stream_dedupe": SQ.stream_dedupe,
    "stream_company_upsert": SQ.stream_company_upsert,
    "stream_status": SQ.stream_status,
    "stream_job_status": SQ.stream_job_status,
    "stream_eta": SQ.stream_eta,
    "stream_queue_sizes": SQ.stream_queue_sizes,
    "stream_dedupe_within": SQ.stream_dedupe_within,
    "page_links": page_links,
}
