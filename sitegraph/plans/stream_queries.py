"""Registered streaming queries: the bound input is staged as files in
ordered chunks, and each chunk is processed by the same streaming query
(same checkpoint, ``availableNow``), as data arriving over time. The final
state read back equals the batch twin, which the oracle checks.

Staging, checkpoints and sinks live in a fresh folder under the session's
shared ``spark.checkpoint.dir`` per run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators.normalize import normalize_companies
from ..session import ensure_checkpoint_dir, stored
from ..streaming import streams as T
from . import bindings as B

CHUNKS = 4


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _ranges(df: DataFrame, order: str, n: int = CHUNKS):
    """Contiguous value ranges of ``order`` (approximate quantiles; every
    row falls in exactly one range)."""
    qs = df.approxQuantile(order, [i / n for i in range(1, n)], 0.001)
    bounds = sorted(set(qs))
    edges = [None] + bounds + [None]
    return [(edges[i], edges[i + 1]) for i in range(len(edges) - 1)]


def _start(spark: SparkSession, start_query, checkpoint: str, first: bool):
    """Start one ``availableNow`` run with state in RocksDB. On the first
    start the state store is sized to the cluster's cores (the count is then
    fixed in the checkpoint); the session settings are restored right after."""
    writer = start_query().option("checkpointLocation", checkpoint).trigger(availableNow=True)
    settings = {"spark.sql.streaming.stateStore.providerClass": T.ROCKSDB}
    if first:
        settings["spark.sql.shuffle.partitions"] = str(max(1, spark.sparkContext.defaultParallelism))
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _chunks(df: DataFrame, order: str, n: int = CHUNKS):
    """The rows of each range of ``order``."""
    for lo, hi in _ranges(df, order, n):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(order) >= lo)
        if hi is not None:
            cond = cond & (F.col(order) < hi)
        yield df.filter(cond)


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def _replay(df: DataFrame, order: str, src: str, start_query, checkpoint: str) -> None:
    for i, part in enumerate(_chunks(df, order)):
        part.write.mode("append").parquet(src)
        _finish(_start(df.sparkSession, start_query, checkpoint, first=(i == 0)))


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Companies arriving as uploaded CSV files, keep-first across
    batches. Uploads name and order their columns differently, so every file
    goes by its own header; file order is intake order."""
    run = _run_dir(spark, "dedupe")
    raw = B.companies_raw(spark, sf).select("company", "website", "_ord")
    src, out = f"{run}/in", f"{run}/out"
    shapes = [("Company", "Website"), ("Home URL", "Organization"), ("Note", "website", "COMPANY")]

    def start():
        return T.company_files(spark, src).writeStream.foreachBatch(T.company_batches(T.dedupe_batch_writer(out)))

    for i, part in enumerate(_chunks(raw, "_ord")):
        names = shapes[i % len(shapes)]
        cells = {"c": F.col("company"), "o": F.col("company"), "w": F.col("website"), "h": F.col("website"), "n": F.lit("x")}
        upload = part.repartitionByRange("_ord").sortWithinPartitions("_ord").select(*[cells[n[0].lower()].alias(n) for n in names])
        # cells keep their blanks: stripping them is the intake's work
        upload.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(f"{src}/upload-{i:04d}")
        _finish(_start(spark, start, f"{run}/ckpt", first=(i == 0)))
    return spark.read.parquet(f"{out}/rows").select("company", "website_url", "unique_key")


def stream_company_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """T5: store updates arriving over time, upserted batch by batch."""
    run = _run_dir(spark, "upsert")
    src, root = f"{run}/in", f"{run}/store"
    T.S.write_snapshot(B.store_snapshot(spark, sf), root, 0)
    updates = B.store_updates(spark, sf)
    schema = updates.schema

    def start():
        return spark.readStream.schema(schema).parquet(src).writeStream.foreachBatch(
            T.upsert_batch_writer(root, B.STORE_NOW, "event_id"))

    _replay(updates, "event_id", src, start, f"{run}/ckpt")
    s = T.S.scan_store(spark, root)
    return s.select("company_name", "website_url", F.array_join("sitemap_urls", ", ").alias("sitemap_complete"),
                    "ai_insights", "last_updated", "company_name_normalized")


def _job_states(spark: SparkSession, sf: str, name: str) -> str:
    """Run the bound job log through the state stream; returns the tables' root."""
    run = _run_dir(spark, name)
    src, out = f"{run}/in", f"{run}/out"
    log = B.jobs(spark, sf).select("job_id", F.col("batch_id").cast("string").alias("batch_id"), "seq", "status", "message", "ts_s")
    schema = log.schema

    def start():
        return T.job_state_query(spark.readStream.schema(schema).parquet(src), out)

    _replay(log, "seq", src, start, f"{run}/ckpt")
    return out


def stream_status(spark: SparkSession, sf: str) -> DataFrame:
    """Job states arriving over time, progress polled from the counters."""
    return J.progress_of(T.counters(spark, _job_states(spark, sf, "status"))).withColumn("batch_id", F.col("batch_id").cast("long"))


def stream_eta(spark: SparkSession, sf: str) -> DataFrame:
    """G7 polled from the counters of that stream."""
    return J.eta_of(T.counters(spark, _job_states(spark, sf, "eta"))).withColumn("batch_id", F.col("batch_id").cast("long"))


def stream_queue_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """G8 polled from the counters of that stream."""
    return J.queue_sizes_of(T.counters(spark, _job_states(spark, sf, "queue")))


def stream_job_status(spark: SparkSession, sf: str) -> DataFrame:
    """Each job is first queued, then reaches its final state later; the
    stream's state keeps the newest one per job."""
    return T.latest_status(spark, _job_states(spark, sf, "jobstatus"))


#: When the uploads of ``stream_dedupe_within`` were sent (minutes), in the order they arrive, and how long a key is kept.
UPLOAD_MINUTES, KEEP_MINUTES = (0, 75, 210, 300, 252, 30, 480, 720), 180


def stream_dedupe_within(spark: SparkSession, sf: str) -> DataFrame:
    """T2 within a watermark: uploads (one per eighth of the events) arrive
    one by one, one of them too late. A company is kept again once its state
    has expired; of an upload's rows of one key the first stays."""
    run = _run_dir(spark, "dedupe-within")
    src, out = f"{run}/in", f"{run}/out"
    uploads = F.array(*[F.lit(m) for m in UPLOAD_MINUTES])
    rows = dedupe_uploads(B.submissions(spark, sf, len(UPLOAD_MINUTES)), uploads)
    rows = stored(rows, "submissions")
    schema = rows.schema

    def start():
        kept = T.keep_first_within(spark.readStream.schema(schema).parquet(src), "sent", f"{KEEP_MINUTES} minutes")
        return kept.select("unique_key", "upload").writeStream.outputMode("append").format("parquet").option("path", out)

    for i in range(len(UPLOAD_MINUTES)):
        rows.where(F.col("upload") == i).write.mode("append").parquet(src)
        _finish(_start(spark, start, f"{run}/ckpt", first=(i == 0)))
    kept = spark.read.schema("unique_key string, upload int").parquet(out)
    first = kept.join(rows, ["unique_key", "upload"]).groupBy("unique_key", "upload").agg(F.min(F.struct("_ord", "company", "website_url")).alias("_f"))
    return first.select("upload", "unique_key", "_f._ord", "_f.company", "_f.website_url")


def dedupe_uploads(raw: DataFrame, minutes) -> DataFrame:
    """Clean the rows of each upload; ``sent`` is the upload's time."""
    sent = F.timestamp_seconds(F.lit(int(B.STORE_NOW)) + F.element_at(minutes, F.col("upload") + 1) * 60)
    clean = normalize_companies(raw.withColumn("_ord", F.struct("_ord", "upload")))
    return clean.select(F.col("_ord._ord").alias("_ord"), F.col("_ord.upload").alias("upload"), "company", "website_url", "unique_key").withColumn("sent", sent)
