"""M1 build_prompt, M2/H9 insight_key, M3 generate_insights behind a durable
cache (J6), M4 error / timeout texts.

The model is an injected callable ``complete_fn(prompt) -> str`` (it may
raise). It runs in an iterator Pandas UDF, once per *distinct missing* key;
everything around it (keys, prompts, cache hits, joins) is built-in SQL.
"""

from __future__ import annotations

import concurrent.futures as cf
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The prompt text around the newline-joined URL list (16-space
# continuation indent), and the messages for failed / timed-out calls.
_PROMPT_HEAD = ("You are analyzing a company's online presence based on its sitemap. Below is a list of all the "
                "URLs found on the company's website:\n                ")
_PROMPT_TAIL = ("\n                Based on this structure, generate a concise business insight about the company. "
                "Identify key focus areas, business priorities, and any indications of growth, investment, or "
                "technology adoption.\n                Format the response as:\n                - Company Overview:"
                "\n                - Key Focus Areas:\n                - Potential Opportunities:\n                ")
ERROR_TEXT = "Error: Error generating AI insights: {msg}. Please try again later."
TIMEOUT_TEXT = "AI analysis for {company} timed out. Analysis limited to prevent system overload."
ANALYSIS_ERROR_TEXT = "Error during analysis: {msg}"


def build_prompt(urls: Column) -> Column:
    """M1: the fixed template around the URLs, one per line. A site with more
    URLs than fit one row has several parts, each with a prompt of its own."""
    return F.concat(F.lit(_PROMPT_HEAD), F.array_join(urls, "\n"), F.lit(_PROMPT_TAIL))


def insight_key(company: Column, urls: Column) -> Column:
    """M2/H9: md5 hex of ``company:url1,url2,…`` over all URLs of the part."""
    return F.md5(F.concat(company, F.lit(":"), F.array_join(urls, ",")))


def insight_requests(df: DataFrame, company: str = "company", urls: str = "urls", limit: int | None = None) -> DataFrame:
    """Adds ``key`` and ``prompt`` columns. With ``limit``, a company has one
    request, of its first so many URLs (at most those of a part)."""
    if limit:
        df = df.where("part = 1").withColumn(urls, F.slice(urls, 1, limit))
    return df.withColumn("key", insight_key(F.col(company), F.col(urls))).withColumn(
        "prompt", build_prompt(F.col(urls)))


def _completion_udf(complete_fn: Callable[[str], str], timeout_s: float):
    @F.pandas_udf("status string, text string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        # one worker thread per task: the client is built once per partition
        pool = cf.ThreadPoolExecutor(max_workers=1)
        try:
            for prompts, companies in batches:
                status, text = [], []
                for p, c in zip(prompts, companies):
                    try:
                        fut = pool.submit(complete_fn, p)
                    except Exception as e:  # the call could not be started
                        status.append("error")
                        text.append(ANALYSIS_ERROR_TEXT.format(msg=e))
                        continue
                    try:
                        text.append(str(fut.result(timeout=timeout_s)))
                        status.append("ok")
                    except cf.TimeoutError:
                        status.append("timeout")
                        text.append(TIMEOUT_TEXT.format(company=c))
                        # the late call keeps its thread; later calls get a fresh one
                        pool.shutdown(wait=False)
                        pool = cf.ThreadPoolExecutor(max_workers=1)
                    except Exception as e:  # the model's failure becomes text, as in the reference
                        status.append("error")
                        text.append(ERROR_TEXT.format(msg=e))
                yield pd.DataFrame({"status": status, "text": text})
        finally:
            pool.shutdown(wait=False)

    return call.asNondeterministic()


def generate_insights(requests: DataFrame, cache: DataFrame, complete_fn: Callable[[str], str],
                      timeout_s: float = 60.0, call_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Insight per request row, from the cache when the key is there,
    else from one model call per distinct missing key.

    ``requests`` needs ``key, prompt, company``; ``cache`` is ``key, insight``.
    Returns ``(rows, new_cache_entries)``: rows = requests + ``insight,
    cached``; only successful calls become cache entries (as in the
    reference). The call results are checkpointed to the shared folder, so a
    model is never asked twice for a key, even when a task is retried later
    in the plan. Calls are slow and their prompts small, so the misses are
    dealt out by count, not bytes: to ``call_partitions`` tasks, by default
    one for each core of the cluster.
    """
    # the request set is written once: the model input is then fixed even if
    # a later stage is retried, and the lists are not recomputed per use
    requests = requests.checkpoint()
    wanted = requests.select("key", "prompt", "company").dropDuplicates(["key"])
    # only the cache entries of requested keys are read past the scan: the
    # durable cache grows without bound, the request set does not
    cache = cache.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
    misses = wanted.join(cache, "key", "left_anti")
    misses = misses.repartition(call_partitions or requests.sparkSession.sparkContext.defaultParallelism, "key")
    call = _completion_udf(complete_fn, timeout_s)
    called = misses.select("key", call(F.col("prompt"), F.col("company")).alias("r")).select(
        "key", F.col("r.status").alias("status"), F.col("r.text").alias("text")).checkpoint()
    new_entries = called.filter(F.col("status") == "ok").select("key", F.col("text").alias("insight"))
    hits = cache.select("key", F.col("insight").alias("_hit"))
    rows = (requests.join(hits, "key", "left").join(called.select("key", "text"), "key", "left")
            .withColumn("cached", F.col("_hit").isNotNull())
            .withColumn("insight", F.coalesce(F.col("_hit"), F.col("text")))
            .drop("_hit", "text"))
    return rows, new_entries
