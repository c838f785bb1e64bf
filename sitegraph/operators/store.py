"""Company document store as a log-structured table (``LogStore``), with a
second one as an index from websites to names.

P6 default timestamp, P7 document, A7/A8 upsert (J7 full outer join, S16:
only supplied columns overwrite, an explicit NULL included), G9 counters,
G1 latest per normalised name, F8/L2 lookups, A6/A9 scan and reset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .log_store import LogStore

# A document is found by its name; a list of several parts has one for each.
KEY = "company_name"
KEYS = [KEY, "part"]
DOC_COLUMNS = ["company_name", "website_url", "sitemap_urls", "ai_insights", "last_updated",
               "company_name_normalized", "part"]
DOC_SCHEMA = ("company_name string, website_url string, sitemap_urls array<string>, ai_insights string, "
              "last_updated double, company_name_normalized string, part int")


def company_documents(rows: DataFrame, now: float, company: str = "company", website: str = "website_url",
                      urls: str = "urls", insight: str = "insight") -> DataFrame:
    """P7 (+P5, P6): the stored record of each processed company, with its
    place ``_ord`` in the intake, which orders records of one name."""
    order = ["_ord"] if "_ord" in rows.columns else []
    part = F.col("part") if "part" in rows.columns else F.lit(1)
    return rows.select(
        *order,
        F.col(company).alias("company_name"), F.col(website).alias("website_url"),
        F.col(urls).alias("sitemap_urls"), F.col(insight).alias("ai_insights"),
        F.lit(float(now)).alias("last_updated"), F.lower(F.col(company)).alias("company_name_normalized"),
        part.cast("int").alias("part"))


def prepare_updates(updates: DataFrame, now: float, order: str) -> tuple[DataFrame, list[str]]:
    """A8 preparation: default ``last_updated`` (P6), derive the normalised
    name (P5) and keep the last row per key in batch ``order`` (ordered
    ``max_by``, a partial aggregate). Returns (rows, supplied columns)."""
    u = updates if "part" in updates.columns else updates.withColumn("part", F.lit(1))
    given = F.col("last_updated").cast("double") if "last_updated" in u.columns else F.lit(None).cast("double")
    u = u.withColumn("last_updated", F.coalesce(given, F.lit(float(now)))).withColumn("company_name_normalized", F.lower(F.col(KEY)))
    cols = [c for c in DOC_COLUMNS if c in u.columns]
    last = F.max_by(F.struct(*cols), F.col(order)).alias("_u")
    return u.groupBy(*KEYS).agg(last).select("_u.*"), cols


def upsert(store: DataFrame, updates: DataFrame, supplied: list[str]) -> DataFrame:
    """Update-or-insert by exact ``company_name`` (and part).

    A matched row takes every *supplied* column from the update (NULL
    included) and keeps the rest; an unmatched update is inserted with NULL
    for columns it does not supply. Adds ``_matched``, ``_inserted`` and
    ``_modified`` (matched and some supplied column changed, NULL-safe).
    """
    return _merge(store, updates, supplied)


def _merge(store: DataFrame, updates: DataFrame, supplied: list[str]) -> DataFrame:
    s = store.select(*[F.col(c).alias(f"s_{c}") for c in DOC_COLUMNS], F.lit(True).alias("_in_s"))
    u = updates.select(*[F.col(c).alias(f"u_{c}") for c in supplied], F.lit(True).alias("_in_u"))
    j = s.join(u, [F.col(f"s_{k}") == F.col(f"u_{k}") for k in KEYS], "full_outer")
    in_s = F.coalesce(F.col("_in_s"), F.lit(False))
    in_u = F.coalesce(F.col("_in_u"), F.lit(False))
    out = []
    changed = F.lit(False)
    for c in DOC_COLUMNS:
        if c in supplied:
            out.append(F.when(in_u, F.col(f"u_{c}")).otherwise(F.col(f"s_{c}")).alias(c))
            if c not in KEYS:
                changed = changed | ~F.col(f"s_{c}").eqNullSafe(F.col(f"u_{c}"))
        else:
            out.append(F.col(f"s_{c}").alias(c))
    return j.select(*out, (in_s & in_u).alias("_matched"), (in_u & ~in_s).alias("_inserted"),
                    (in_s & in_u & changed).alias("_modified"))


def upsert_counts(upserted: DataFrame) -> DataFrame:
    """``inserted, modified, matched, total`` (one row; partial aggregation)."""
    return upserted.agg(
        F.count_if("_inserted").alias("inserted"), F.count_if("_modified").alias("modified"),
        F.count_if("_matched").alias("matched"), F.count(F.lit(1)).alias("total"))


def documents(upserted: DataFrame) -> DataFrame:
    return upserted.select(*DOC_COLUMNS)


def latest_per_company(store: DataFrame) -> DataFrame:
    """G1/L1: per normalised name (NULL is one group) the freshest record;
    NULL times sort last and ties go to the smaller ``company_name``.
    A ``min_by`` aggregate: partial aggregation before the shuffle."""
    lu = F.col("last_updated")
    order = F.struct(lu.isNull().alias("n"), (-lu).alias("t"), F.col(KEY).alias("k"))
    best = F.min_by(F.struct(*[F.col(c) for c in DOC_COLUMNS]), order).alias("_d")
    return store.groupBy("company_name_normalized", "part").agg(best).select("_d.*")


def by_freshness(store: DataFrame) -> DataFrame:
    """L1: documents from the newest to the oldest; NULL times last, ties by
    name (a range-partitioned sort)."""
    return store.orderBy(F.col("last_updated").desc_nulls_last(), *KEYS)


def lookup(store: DataFrame, probes: DataFrame, probe_col: str, field: str) -> DataFrame:
    """F8/L2: for each probe value, the first record with ``field == value``
    (ties by ``company_name``), or NULLs. Batch form of ``find_one``."""
    p = probes.select(F.col(probe_col).alias("probe")).dropDuplicates()
    # the store is semi-filtered by the probes before anything is grouped
    s = store.join(p, store[field] == p.probe, "left_semi")
    s = s.select(F.col(field).alias("_v"), F.struct(*[F.col(c) for c in DOC_COLUMNS]).alias("_d"))
    s = s.groupBy("_v").agg(F.min_by("_d", F.struct(*[F.col(f"_d.{k}") for k in KEYS])).alias("_d"))
    return p.join(s, p.probe == s._v, "left").select("probe", F.col("_d").isNotNull().alias("found"), "_d.*")


# --- A6 / A9: versions --------------------------------------------------------

def open_store(spark: SparkSession, root: str, **settings: int) -> LogStore:
    return LogStore(spark, f"{root.rstrip('/')}/documents", KEYS, DOC_SCHEMA, **settings)


def open_index(spark: SparkSession, root: str, **settings: int) -> LogStore:
    """Which names had a document with a website, up to now: entries outlive a
    change of the website, so readers check the document."""
    return LogStore(spark, f"{root.rstrip('/')}/websites", ["website_url", KEY], f"website_url string, {KEY} string", **settings)


def _index(spark: SparkSession, root: str, rows: DataFrame, **settings: int) -> None:
    """Add the websites of ``rows``. Runs before the documents' commit: an
    entry without its document does no harm, a missing entry would."""
    found = rows.where("website_url is not null").select("website_url", KEY).distinct()
    open_index(spark, root, **settings).append(found)


def write_snapshot(df: DataFrame, root: str, version: int | None = None, **settings: int) -> int:
    """A whole new version."""
    df = stored(df, "store-snapshot")
    _index(df.sparkSession, root, df, **settings)
    return open_store(df.sparkSession, root, **settings).replace(df, version)


def scan_store(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All documents of the newest (or a given) version."""
    return open_store(spark, root).read(version)


def reset_store(spark: SparkSession, root: str) -> int:
    """A new, empty version (full refresh, S19)."""
    return open_store(spark, root).replace(spark.createDataFrame([], DOC_SCHEMA))


def upsert_snapshot(spark: SparkSession, root: str, updates: DataFrame, now: float, order: str,
                    version: int | None = None, **settings: int) -> int:
    """A7/A8 end to end: append the batch to the newest version and commit the
    next one (or ``version``, based on the newest before it). The batch's own
    rows are all that is written, but for compaction."""
    u, supplied = prepare_updates(updates, now, order)
    if "website_url" in supplied:
        u = stored(u, "store-updates")
        _index(spark, root, u, **settings)
    return open_store(spark, root, **settings).append(u, version, [*supplied, "part", "company_name_normalized"])


def find(spark: SparkSession, root: str, probes: DataFrame, probe_col: str, field: str) -> DataFrame:
    """F8/L2 on the stored documents, by ``company_name`` or ``website_url``:
    only the buckets of the probed names are read; names of websites come from
    the buckets of the probed websites in the index."""
    p = probes.select(F.col(probe_col).alias("probe")).dropDuplicates()
    docs, names = open_store(spark, root), p
    if field == "website_url":
        index = open_index(spark, root)
        entries = index.read(buckets=index.buckets_of(p, F.col("probe")))
        names = stored(entries.join(p, entries["website_url"] == p["probe"], "left_semi").select(F.col(KEY).alias("probe")).distinct(), "store-names")
    read = docs.read(buckets=docs.buckets_of(names, F.col("probe")))
    if field == "website_url":
        read = read.join(names.select(F.col("probe").alias("_name")), F.col(KEY) == F.col("_name"), "left_semi")
    return lookup(read, p, "probe", field)
