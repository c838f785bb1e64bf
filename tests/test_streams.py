"""Streaming sinks are idempotent when a micro-batch is replayed."""

import datetime
import uuid

from sitegraph.operators import store as S
from sitegraph.session import ensure_checkpoint_dir
from sitegraph.streaming import streams as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def new_root(spark):
    return f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"


def test_dedupe_replay(spark):
    out = new_root(spark)
    run = T.dedupe_batch_writer(out)
    schema = "company string, website string, _ord long"
    b0 = spark.createDataFrame([("Acme", "acme.com", 1), ("ACME", "acme.com", 2), ("Bolt", "b.com", 3)], schema)
    b1 = spark.createDataFrame([("acme", "ACME.com", 4), ("Cid", "c.com", 5)], schema)
    run(b0, 0)
    run(b1, 1)
    kept = lambda: rows(spark.read.parquet(f"{out}/rows").select("_ord", "company"))
    first = kept()
    run(b1, 1)  # replayed after a failure
    assert kept() == first == [(1, "Acme"), (3, "Bolt"), (5, "Cid")]


def test_upsert_replay(spark):
    root = new_root(spark)
    S.write_snapshot(spark.createDataFrame([("A", "w", ["u"], "old", 1.0, "a", 1)], S.DOC_SCHEMA), root, 0)
    run = T.upsert_batch_writer(root, now=9.0, order="seq")
    b0 = spark.createDataFrame([("A", "x", 1), ("B", "y", 2)], "company_name string, ai_insights string, seq int")
    b1 = spark.createDataFrame([("A", "z", 3)], "company_name string, ai_insights string, seq int")
    run(b0, 0)
    run(b1, 1)
    seen = lambda: rows(S.scan_store(spark, root).select("company_name", "ai_insights", "website_url"))
    first = seen()
    run(b1, 1)
    assert seen() == first == [("A", "z", "w"), ("B", "y", None)]


def run_states(spark, src, root, ckpt):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.ROCKSDB)
    try:
        q = T.job_state_query(spark.readStream.schema(T.JOB_SCHEMA).parquet(src), root).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    q.awaitTermination()


def test_job_states_survive_a_restart(spark):
    root = new_root(spark)
    src, ckpt = f"{root}/in", f"{root}/ckpt"
    batches = [[("j1", "b", 1, "queued", None, 1.0), ("j2", "b", 2, "queued", None, 2.0)],
               [("j1", "b", 9, "complete", None, 3.0), ("j1", "b", 5, "error", "x", 2.5)],
               [("j1", "b", 4, "queued", None, 2.2), ("j3", "b", 10, "queued", None, 4.0)]]  # a state that comes late
    for rows_in in batches:  # each run is a new query on the same checkpoint
        spark.createDataFrame(rows_in, T.JOB_SCHEMA).write.mode("append").parquet(src)
        run_states(spark, src, root, ckpt)
    assert sorted((r.job_id, r.status) for r in T.latest_status(spark, root).collect()) == [("j1", "complete"), ("j2", "queued"), ("j3", "queued")]
    c = T.counters(spark, root).first()
    assert (c.total, c.completed, c.errors, c.queued, c.first_s, c.last_s) == (3, 1, 0, 2, 1.0, 4.0)
    assert spark.read.format("statestore").load(ckpt).count() == 3  # the states are Spark's


def test_job_states_replay(spark):
    root = new_root(spark)
    run = T.job_state_writer(root)
    b0 = spark.createDataFrame([("j1", "b", 1, "queued", None, 0.0), ("j2", "b", 1, "queued", None, 0.0)], T.JOB_SCHEMA)
    b1 = spark.createDataFrame([("j1", "b", 3, "complete", None, 1.0)], T.JOB_SCHEMA)
    for batch, epoch in ((b0, 0), (b1, 1), (b1, 1)):
        run(batch, epoch)
    assert sorted((r.job_id, r.status) for r in T.latest_status(spark, root).collect()) == [("j1", "complete"), ("j2", "queued")]
    p = T.counters(spark, root).first()
    assert (p.total, p.completed) == (2, 1)


def test_keys_within_a_watermark(spark):
    root = new_root(spark)
    at = lambda minute: datetime.datetime(2024, 6, 1) + datetime.timedelta(minutes=minute)
    uploads = [[("a", 0), ("b", 0), ("a", 0)], [("a", 50), ("c", 50)], [("b", 20), ("d", 20)], [("e", 200)], [("a", 210), ("f", 100)]] + [[(f"k{i}", 300 + 90 * i)] for i in range(6)]
    kept, sizes = [], []
    for rows_in in uploads:
        spark.createDataFrame([(k, at(m)) for k, m in rows_in], "unique_key string, sent timestamp").write.mode("append").parquet(f"{root}/in")
        q = T.keep_first_within(spark.readStream.schema("unique_key string, sent timestamp").parquet(f"{root}/in"), "sent", "60 minutes").writeStream.format(
            "parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
        new = [(r.unique_key, (r.sent - at(0)).seconds // 60 + (r.sent - at(0)).days * 1440) for r in spark.read.parquet(f"{root}/out").collect()]
        kept.append(sorted(set(new) - {x for k in kept for x in k}))
        sizes.append(spark.read.format("statestore").load(f"{root}/ckpt").count())
    # "d" is behind no watermark yet (50 - 60), "f" is late (200 - 60), "a" comes again after its time
    assert kept[:5] == [[("a", 0), ("b", 0)], [("c", 50)], [("d", 20)], [("e", 200)], [("a", 210)]]
    assert max(sizes[3:]) <= 3  # state goes with the watermark


def test_uploads_go_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Company,Website\nAcme,a.com\n")
    (tmp_path / "b.csv").write_text("Home URL,Note,Organization\nb.com,x,Bolt\n")
    got = []
    handle = lambda df, epoch: got.extend((r.company, r.website) for r in df.orderBy("_ord").collect())
    q = T.company_files(spark, str(tmp_path)).writeStream.foreachBatch(T.company_batches(handle)).trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "ckpt")).start()
    q.awaitTermination()
    assert got == [("Acme", "a.com"), ("Bolt", "b.com")]
