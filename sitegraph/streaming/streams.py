"""Structured Streaming forms of the intake, store and job operators.

T1 companies from a CSV directory, T2 keep-first dedupe (for ever, or within a
watermark), T3 latest job states and progress, T5 upsert of finished companies
into the store.

The newest state of every job and the keys within a watermark are kept in
Spark's state store. What must outlive a query or be looked up (documents,
keys kept for ever, job states, counters) are ``LogStore`` tables, to which a
micro-batch appends its own rows. Every sink is idempotent on replay: a
micro-batch commits the version named by its epoch, based on the newest
version before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import store as S
from ..operators.log_store import LogStore
from ..operators.normalize import dedupe_companies, normalize_companies
from ..session import stored
from ..sources.companies import scan_companies

# Fixed value: what the binary file source gives (the content is never read here).
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
KEY_SCHEMA = "unique_key string"
JOB_SCHEMA = "job_id string, batch_id string, seq long, status string, message string, ts_s double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- T1 / T2 -----------------------------------------------------------------

def company_files(spark: SparkSession, source_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """The paths of ``*.csv`` files arriving under ``source_dir``. Only
    paths stream (at most ``files_per_batch`` a micro-batch); the files are
    then read splittably, each by its own header (``scan_companies``)."""
    files = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
             .option("maxFilesPerTrigger", files_per_batch).load(source_dir))
    return files.select("path")


def company_batches(handle: Callable[[DataFrame, int], None], multiline: bool = False) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``company_files`` that hands on the
    companies of the batch's files (``company, website, _ord``)."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())  # bounded by files_per_batch
        if paths:
            handle(scan_companies(batch.sparkSession, paths, multiline), epoch_id)

    return run


def dedupe_batch_writer(out_path: str) -> Callable[[DataFrame, int], None]:
    """Normalise, keep the first row per key within the batch (W1), drop
    keys already kept by an earlier batch, write the rest to
    ``<out_path>/rows/epoch=<id>``."""

    def run(raw: DataFrame, epoch_id: int) -> None:
        spark = raw.sparkSession
        rows = stored(dedupe_companies(normalize_companies(raw)), "intake")
        keys = LogStore(spark, f"{out_path}/keys", ["unique_key"], KEY_SCHEMA)
        base = keys.latest(epoch_id)
        if base is not None:
            rows = rows.join(keys.read(base, keys.buckets_of(rows, version=base)), "unique_key", "left_anti")
        path = f"{out_path}/rows/epoch={epoch_id}"
        rows.write.mode("overwrite").parquet(path)
        keys.append(spark.read.schema(rows.schema).parquet(path).select("unique_key"), epoch_id + 1)

    return run


def keep_first_within(companies: DataFrame, event_time: str, delay: str) -> DataFrame:
    """T2 with state that expires: the first row per key within ``delay`` of
    event time. A key's state goes when the watermark (the greatest event time
    of earlier micro-batches less ``delay``) passes its first row's time plus
    ``delay``; the key may then come again. Rows at or behind the watermark
    are late and dropped. Of rows that come in one micro-batch any may be the
    first, so ``event_time`` should be that of the upload, not of the row."""
    return companies.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["unique_key"])


# --- T5 --------------------------------------------------------------------------

def upsert_batch_writer(store_root: str, now: float, order: str) -> Callable[[DataFrame, int], None]:
    """T5 ``foreachBatch``: upsert the batch; commits version ``epoch + 1``."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        S.upsert_snapshot(batch.sparkSession, store_root, batch, now, order, epoch_id + 1)

    return run


# --- T3 --------------------------------------------------------------------------

def _states(spark: SparkSession, root: str) -> LogStore:
    return LogStore(spark, f"{root}/states", ["job_id"], JOB_SCHEMA)


def _counters(spark: SparkSession, root: str) -> LogStore:
    return LogStore(spark, f"{root}/counters", ["batch_id"], J.COUNTER_SCHEMA, merge=J.COUNTER_MERGE)


def newest_states(log: DataFrame) -> DataFrame:
    """The newest state (highest ``seq``) of every job of a stream of job
    states (``JOB_SCHEMA``): a stateful aggregate, for update mode."""
    rest = [c.split()[0] for c in JOB_SCHEMA.split(", ")][1:]
    return log.groupBy("job_id").agg(F.max_by(F.struct(*rest), "seq").alias("_s")).select("job_id", "_s.*")


def job_state_writer(root: str) -> Callable[[DataFrame, int], None]:
    """The sink of ``newest_states``: appends the changed states to the table
    of states, and what they change in the submissions' counters (G6–G8) to
    the table of counters."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        states, version = _states(spark, root), epoch_id + 1
        new = stored(batch.select(*states.columns), "job-states")
        base = states.latest(epoch_id)
        old = states.read(base, states.buckets_of(new, version=base)).join(new.select("job_id"), "job_id", "left_semi") if base is not None else new.limit(0)
        _counters(spark, root).append(J.counter_changes(new, old), version)
        states.append(new, version)

    return run


def job_state_query(log: DataFrame, root: str):
    """The streaming write (start it with a checkpoint of its own)."""
    return newest_states(log).writeStream.outputMode("update").foreachBatch(job_state_writer(root))


def latest_status(spark: SparkSession, root: str) -> DataFrame:
    return _states(spark, root).read().select("job_id", "status", "message")


def counters(spark: SparkSession, root: str) -> DataFrame:
    """The kept counters: what a poll of progress, estimate or queue reads."""
    return _counters(spark, root).read()
