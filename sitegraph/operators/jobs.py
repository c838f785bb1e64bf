"""Job results and progress over a ``jobs`` log
``(job_id, batch_id, seq, status, message, data STRUCT<...>, ts)``: one row per
state that a job took; its state is the one with the highest ``seq``.

F7 complete only, G2 last-write-wins results, P8 output rows, F9/J9 status
lookup, G6 progress, G7/H14 time estimate, G8 queue sizes, A11 JSON.
All are aggregates with partial (map-side) combine, or equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round

OUTPUT_COLUMNS = ["Company", "Website", "Sitemap Complete", "Insight from Prompt"]

# Status words and the progress texts of the page.
COMPLETE, ERROR, QUEUED, NOT_FOUND = "complete", "error", "queued", "not found"
ALL_DONE_TEXT = "All jobs completed! You can now download the results."
DONE_WITH_ERRORS_TEXT = ("Processing complete. Some companies may have errors, but all available results are "
                         "ready for download.")
ERROR_PREFIX = "Worker error: "
ETA_PREFIX = "Estimated time remaining: "


def latest_states(jobs: DataFrame) -> DataFrame:
    """One row per job: its latest state (a ``max_by``, partially aggregated)."""
    rest = [c for c in jobs.columns if c != "job_id"]
    return jobs.groupBy("job_id").agg(F.max_by(F.struct(*rest), "seq").alias("_s")).select("job_id", *[F.col(f"_s.{c}").alias(c) for c in rest])


def outcome_rows(processed: DataFrame, errors: DataFrame) -> DataFrame:
    """Job rows of processed companies: ``complete`` with the output row as
    data, ``error`` with the reason. Input: ``_ord, job_id, batch_id`` and the
    output columns, or ``message``. A company of several parts has a row (and
    a sequence number) for each."""
    data = F.struct(*[F.col(f"`{c}`") for c in OUTPUT_COLUMNS])
    done = processed.select("_ord", "job_id", "batch_id", "part", F.lit(COMPLETE).alias("status"), F.lit(None).cast("string").alias("message"), data.alias("data"))
    kind = done.schema["data"].dataType
    failed = errors.select("_ord", "job_id", "batch_id", F.lit(1).alias("part"), F.lit(ERROR).alias("status"),
                           F.concat(F.lit(ERROR_PREFIX), "message").alias("message"), F.lit(None).cast(kind).alias("data"))
    return done.unionByName(failed)


def output_rows(df: DataFrame, company="company", website="website_url", urls="urls", insight="insight"):
    """The four output columns; the URL list joined with ``", "``. A
    list of several parts has a row for each (``Part``)."""
    part = [F.col("part").alias("Part")] if "part" in df.columns else []
    return df.select(F.col(company).alias("Company"), F.col(website).alias("Website"),
                     F.array_join(F.col(urls), ", ").alias("Sitemap Complete"),
                     F.col(insight).alias("Insight from Prompt"), *part)


def dedupe_results(jobs: DataFrame) -> DataFrame:
    """Complete jobs with data; per exact company the data of the last
    completed job (highest ``seq``), positioned by its first completion."""
    done = jobs.filter((F.col("status") == COMPLETE) & F.col("data").isNotNull())
    g = done.groupBy(F.col("data.Company").alias("_c")).agg(
        F.max_by("data", "seq").alias("_d"), F.min("seq").alias("pos"))
    return g.select("pos", *[F.col(f"_d.`{c}`").alias(c) for c in OUTPUT_COLUMNS])


def status_lookup(jobs: DataFrame, probes: DataFrame, probe_col: str = "job_id") -> DataFrame:
    """The latest state of each probed job id, or ``not found``."""
    p = probes.select(F.col(probe_col).alias("job_id")).dropDuplicates()
    hit = jobs.join(p, "job_id", "left_semi")
    latest = hit.groupBy("job_id").agg(F.max_by(F.struct("status", "message"), "seq").alias("_s"))
    j = p.join(latest, "job_id", "left")
    return j.select("job_id", F.coalesce(F.col("_s.status"), F.lit(NOT_FOUND)).alias("status"),
                    F.col("_s.message").alias("message"))


def _progress_aggs():
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin(COMPLETE, ERROR)).alias("completed"),
        F.coalesce(F.bool_or(F.col("status") == ERROR), F.lit(False)).alias("has_errors"),
    ]


def job_progress(jobs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """G6/H15/H16 per submission: counts, rounded percent and the texts."""
    return progress_columns(latest_states(jobs).groupBy(batch).agg(*_progress_aggs()), batch)


def progress_columns(g: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Percent and texts from ``total, completed, has_errors``."""
    remaining = F.col("total") - F.col("completed")
    pct = F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100).otherwise(F.lit(0.0))
    status_text = (
        F.when((remaining == 0) & F.col("has_errors"), F.lit(DONE_WITH_ERRORS_TEXT))
        .when(remaining == 0, F.lit(ALL_DONE_TEXT))
        .otherwise(F.concat(F.lit("Processing... "), remaining.cast("string"),
                            F.when(remaining == 1, F.lit(" company")).otherwise(F.lit(" companies")),
                            F.lit(" remaining."))))
    return g.select(
        batch, "total", "completed", "has_errors", remaining.alias("remaining"),
        js_round(pct).alias("percent"),
        F.concat(F.lit("Completed: "), F.col("completed").cast("string"), F.lit(" of "),
                 F.col("total").cast("string"), F.lit(" companies")).alias("completed_text"),
        status_text.alias("status_text"))


def eta_text(remaining_s):
    """The estimate text for a remaining time in seconds."""
    minutes = js_round(remaining_s / 60)
    hours = F.floor(remaining_s / 3600)
    h_minutes = js_round((remaining_s % 3600) / 60)

    def unit(n, word):
        return F.concat(n.cast("string"), F.lit(" " + word), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))

    return (F.when(remaining_s < 60, F.lit("Less than a minute"))
            .when(remaining_s < 3600, F.concat(F.lit("About "), unit(minutes, "minute")))
            .otherwise(F.concat(F.lit("About "), unit(hours, "hour"), F.lit(" and "), unit(h_minutes, "minute"))))


def job_eta(jobs: DataFrame, batch: str = "batch_id", ts: str = "ts_s", start: str | None = None,
            now: str | None = None) -> DataFrame:
    """Seconds per finished job × jobs left. ``start``/``now`` default to
    the first and last event time of the submission (epoch seconds)."""
    aggs = _progress_aggs() + [F.min(start or ts).alias("start_s"), F.max(now or ts).alias("now_s")]
    return eta_columns(latest_states(jobs).groupBy(batch).agg(*aggs), batch)


def eta_columns(g: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The estimate from ``total, completed, start_s, now_s``."""
    remaining = F.col("total") - F.col("completed")
    elapsed = F.col("now_s") - F.col("start_s")
    rem_s = elapsed / F.col("completed") * remaining
    text = (F.when(remaining == 0, F.lit(""))
            .when(F.col("completed") == 0, F.lit(ETA_PREFIX + "Calculating..."))
            .otherwise(F.concat(F.lit(ETA_PREFIX), eta_text(rem_s))))
    return g.select(batch, "total", "completed",
                    F.when(F.col("completed") > 0, rem_s).alias("remaining_seconds"), text.alias("eta_text"))


COUNTER_SCHEMA = "batch_id string, total long, completed long, errors long, queued long, first_s double, last_s double"
COUNTER_MERGE = {"total": "sum", "completed": "sum", "errors": "sum", "queued": "sum", "first_s": "min", "last_s": "max"}


def counter_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """G6–G8 by retraction: what the ``new`` states of some jobs change in the
    counters of their submissions (``COUNTER_SCHEMA``). The jobs' ``old``
    states subtract, the new ones add; first and last times only widen."""
    def signed(states: DataFrame, sign: int) -> DataFrame:
        def n(when: Column, name: str) -> Column:
            return F.sum(F.when(when, sign).otherwise(0)).alias(name)

        status = F.col("status")
        return states.groupBy("batch_id").agg(
            n(F.lit(True), "total"), n(status.isin(COMPLETE, ERROR), "completed"), n(status == ERROR, "errors"), n(status == QUEUED, "queued"),
            F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))

    both = signed(new, 1).unionByName(signed(old, -1))
    return both.groupBy("batch_id").agg(*[getattr(F, kind)(c).alias(c) for c, kind in COUNTER_MERGE.items()])


def progress_of(counters: DataFrame) -> DataFrame:
    """G6 of kept counters: one row read per submission."""
    live = counters.where("total > 0").withColumn("has_errors", F.col("errors") > 0)
    return progress_columns(live.select("batch_id", "total", "completed", "has_errors"))


def eta_of(counters: DataFrame) -> DataFrame:
    """G7 of kept counters."""
    return eta_columns(counters.where("total > 0").withColumnsRenamed({"first_s": "start_s", "last_s": "now_s"}))


def queue_sizes_of(counters: DataFrame) -> DataFrame:
    """G8 of kept counters."""
    return counters.agg(F.coalesce(F.sum("queued"), F.lit(0)).alias("queue_size"), F.coalesce(F.sum(F.col("total") - F.col("queued")), F.lit(0)).alias("results_size"))


def queue_sizes(jobs: DataFrame) -> DataFrame:
    """Pending and finished job counts (one row)."""
    return latest_states(jobs).agg(F.count_if(F.col("status") == QUEUED).alias("queue_size"),
                    F.count_if(F.col("status") != QUEUED).alias("results_size"))


def status_json(jobs: DataFrame) -> DataFrame:
    """One JSON document per finished job (the results map holds no
    queued job): ``{"status":…,"data":{…}}`` when complete,
    ``{"status":"error","message":…}`` otherwise."""
    jobs = latest_states(jobs).filter(F.col("status") != QUEUED)
    body = F.when(F.col("status") == COMPLETE, F.to_json(F.struct("status", "data"))).otherwise(
        F.to_json(F.struct("status", "message")))
    return jobs.select("job_id", body.alias("json"))
