"""M5 process_companies: companies → site URL lists → insights → documents
and output rows, as one DataFrame chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frontier import sites
from ..operators.insights import generate_insights, insight_requests
from ..operators.jobs import OUTPUT_COLUMNS, outcome_rows
from ..operators.normalize import job_id
from ..operators.resolve import company_url_lists, site_url_lists
from ..operators.sitemaps import Limits
from ..operators.store import company_documents
from ..session import stored


def process_companies(companies: DataFrame, fetches: DataFrame, complete_fn: Callable[[str], str],
                      cache: DataFrame | None, now: float, max_depth: int | None = None,
                      call_partitions: int | None = None, submission: str = "", limits: Limits = Limits()) -> dict[str, DataFrame]:
    """Returns ``lists`` (company + URL list parts), ``insights`` (+ key,
    prompt, insight, cached), ``documents`` (store records with ``_ord``),
    ``jobs`` (a ``complete`` or ``error`` row per company) and ``new_cache``
    (entries to append to the durable cache).

    A company whose website cannot be parsed ends as an ``error`` job: it gets
    no prompt, no model call and no document. The companies are read once."""
    companies = stored(companies, "companies")
    lists = stored(company_url_lists(companies, site_url_lists(sites(companies), fetches, max_depth=max_depth, limits=limits)), "lists")
    bad = F.col("source") == "error"
    req = insight_requests(lists.where(~bad), limit=limits.prompt)
    spark = companies.sparkSession
    if cache is None:
        cache = spark.createDataFrame([], "key string, insight string")
    rows, new_cache = generate_insights(req, cache, complete_fn, call_partitions=call_partitions)
    ids = [job_id(submission).alias("job_id"), F.lit(submission).alias("batch_id")]
    done = rows.select("_ord", "part", *ids, *[c.alias(n) for c, n in zip(
        (F.col("company"), F.col("website_url"), F.array_join("urls", ", "), F.col("insight")), OUTPUT_COLUMNS)])
    failed = lists.where(bad).select("_ord", *ids, F.concat(F.lit("Invalid URL: "), "website_url").alias("message"))
    return {"lists": lists, "insights": rows, "documents": company_documents(rows, now),
            "jobs": outcome_rows(done, failed), "new_cache": new_cache}


def half_cache(requests: DataFrame) -> DataFrame:
    """Test cache: keys whose md5 starts with 0-7 are already answered."""
    r = requests.select("key").dropDuplicates()
    return r.filter(F.substr(F.col("key"), F.lit(1), F.lit(1)) < "8").select(
        "key", F.concat(F.lit("cached:"), F.col("key")).alias("insight"))
