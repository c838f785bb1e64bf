"""Company intake: P2 strip, F1 drop empties, P3 default scheme, W1 keep-first
dedupe, P9/P10 job acknowledgement, G10 submission size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip, with_scheme

QUEUED_TEXT = "Queued for processing"


def normalize_companies(raw: DataFrame, company: str = "company", website: str = "website",
                        order: str = "_ord") -> DataFrame:
    """Strip both fields, drop rows where either is NULL/blank, default the
    scheme and build the case-insensitive dedupe key.

    Output: ``_ord, company, website_url, unique_key``.
    """
    c = ustrip(F.col(company).cast("string"))
    w = ustrip(F.col(website).cast("string"))
    df = raw.select(F.col(order).alias("_ord"), c.alias("company"), w.alias("website"))
    df = df.filter(F.col("company").isNotNull() & F.col("website").isNotNull()
                   & (F.length("company") > 0) & (F.length("website") > 0))
    url = with_scheme(F.col("website"))
    return df.select(
        "_ord", "company", url.alias("website_url"),
        F.concat(F.lower("company"), F.lit(":"), F.lower(url)).alias("unique_key"),
    )


def dedupe_companies(df: DataFrame, key: str = "unique_key", order: str = "_ord") -> DataFrame:
    """Keep the first row (smallest ``order``) per key.

    An aggregate of ``min(struct(order, ...))``: partial aggregation runs
    before the shuffle, so a key holding a large share of the rows sends one
    row per map task.
    """
    others = [c for c in df.columns if c not in (key, order)]
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in others])).alias("_first")
    return df.groupBy(key).agg(first).select(
        F.col(f"_first.{order}").alias(order), *[F.col(f"_first.{c}").alias(c) for c in others], key)


def job_id(submission: str, key_col: str = "unique_key"):
    """P10: deterministic ``job_<sha256>`` of the submission and the key, so a
    retried task produces the same id."""
    return F.concat(F.lit("job_"), F.sha2(F.concat_ws(":", F.lit(submission), F.col(key_col)), 256))


def job_ack(companies: DataFrame, submission: str = "") -> DataFrame:
    """One acknowledgement row per queued company."""
    return companies.select(
        "_ord",
        F.col("company").alias("Company"),
        F.col("website_url").alias("Website"),
        F.lit(QUEUED_TEXT).alias("Processing"),
        job_id(submission).alias("Job ID"),
    )


def submission_summary(ack: DataFrame) -> DataFrame:
    """``status, n_jobs, message``. The id list itself stays in long form
    (``job_ack``) rather than one unbounded array."""
    n = F.count(F.lit(1))
    return ack.agg(
        F.lit("processing").alias("status"),
        n.alias("n_jobs"),
        F.concat(F.lit("Processing "), n.cast("string"), F.lit(" companies")).alias("message"),
    )
