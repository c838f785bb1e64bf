"""FIXTURES §8: store upsert / latest and job results / progress / ETA."""

import os

from pyspark.sql import functions as F

from sitegraph.operators import jobs as J
from sitegraph.operators import store as S


def store_df(spark, rows):
    return spark.createDataFrame(rows, S.DOC_SCHEMA)


def doc(name, t, insight="i", web="https://w"):
    return (name, web, [web + "/a"], insight, float(t), name.lower(), 1)


def test_upsert_semantics(spark):
    store = store_df(spark, [doc("Acme", 1)])
    ordered = lambda df: df.withColumn("_ord", F.lit(1))
    upd = spark.createDataFrame([("Acme", 2.0, "x"), ("ACME", 3.0, "y")],
                                "company_name string, last_updated double, ai_insights string")
    u, supplied = S.prepare_updates(ordered(upd), now=99.0, order="_ord")
    out = {r.company_name: r for r in S.upsert(store, u, supplied).collect()}
    assert out["Acme"].last_updated == 2.0 and out["Acme"].website_url == "https://w"
    assert out["Acme"]._matched and out["Acme"]._modified
    assert out["ACME"]._inserted and out["ACME"].website_url is None
    counts = S.upsert_counts(S.upsert(store, u, supplied)).first()
    assert (counts.inserted, counts.modified, counts.matched, counts.total) == (1, 1, 1, 2)
    # an explicit NULL supplied overwrites; unchanged values do not count as modified
    nul = spark.createDataFrame([("Acme", 1.0, None)], "company_name string, last_updated double, ai_insights string")
    u2, sup2 = S.prepare_updates(ordered(nul), now=99.0, order="_ord")
    r = S.upsert(store, u2, sup2).first()
    assert r.ai_insights is None and r._modified
    same = spark.createDataFrame([("Acme", 1.0, "i")], "company_name string, last_updated double, ai_insights string")
    u3, sup3 = S.prepare_updates(ordered(same), now=99.0, order="_ord")
    assert not S.upsert(store, u3, sup3).first()._modified
    # missing last_updated defaults to now; last row per key in batch order wins
    batch = spark.createDataFrame([("B", None, "first", 1), ("B", None, "second", 2)],
                                  "company_name string, last_updated double, ai_insights string, seq int")
    u4, sup4 = S.prepare_updates(batch, now=99.0, order="seq")
    r = S.documents(S.upsert(store, u4, sup4)).filter("company_name = 'B'").first()
    assert (r.ai_insights, r.last_updated, r.company_name_normalized) == ("second", 99.0, "b")


def test_latest_per_company(spark):
    rows = [doc("Acme", 2), doc("ACME", 3), doc("acme", 3), doc("Bolt", 1),
            ("Nul", "w", [], "i", None, None, 1), ("Nul2", "w", [], "i", 5.0, None, 1)]
    got = {r.company_name_normalized: r.company_name for r in S.latest_per_company(store_df(spark, rows)).collect()}
    assert got == {"acme": "ACME", "bolt": "Bolt", None: "Nul2"}


def test_lookup(spark):
    store = store_df(spark, [doc("A", 1, web="https://x"), doc("B", 2, web="https://x")])
    probes = spark.createDataFrame([("https://x",), ("https://none",)], "p string")
    got = {r.probe: (r.found, r.company_name) for r in S.lookup(store, probes, "p", "website_url").collect()}
    assert got == {"https://x": (True, "A"), "https://none": (False, None)}


def test_by_freshness(spark):
    rows = [doc("B", 1), doc("A", 3), doc("C", 3), ("N", "w", [], "i", None, "n", 1)]
    assert [r.company_name for r in S.by_freshness(store_df(spark, rows)).collect()] == ["A", "C", "B", "N"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "store")
    S.reset_store(spark, root)
    upd = spark.createDataFrame([("Acme", 1.0, "x", 1)], "company_name string, last_updated double, ai_insights string, seq int")
    S.upsert_snapshot(spark, root, upd, 5.0, "seq")
    S.upsert_snapshot(spark, root, upd.withColumn("ai_insights", F.lit("y")), 5.0, "seq")
    assert S.open_store(spark, root).latest() == 2
    assert [r.ai_insights for r in S.scan_store(spark, root).collect()] == ["y"]
    assert [r.ai_insights for r in S.scan_store(spark, root, 1).collect()] == ["x"] and S.scan_store(spark, root, 0).count() == 0


def names_of(spark, root, probes, field, **settings):
    p = spark.createDataFrame([(x,) for x in probes], "p string")
    return {r.probe: r.company_name for r in S.find(spark, root, p, "p", field).collect()}


def test_find_reads_the_probed_buckets_only(spark, tmp_path):
    root, small = str(tmp_path / "store"), {"bucket_rows": 16, "max_deltas": 2}
    S.write_snapshot(store_df(spark, [doc(f"c{i}", i, web=f"https://w{i % 50}") for i in range(400)]), root, 0, **small)
    store = S.open_store(spark, root, **small)
    assert len(store.manifest(0)["base"]["buckets"]) == 32
    probe = spark.createDataFrame([("c7",)], "p string")
    files = store.read(buckets=store.buckets_of(probe, F.col("p"))).inputFiles()
    assert len(files) == 1 < len(store.read().inputFiles())
    assert names_of(spark, root, ["c7", "C7"], "company_name") == {"c7": "c7", "C7": None}
    assert names_of(spark, root, ["https://w7", "https://none"], "website_url") == {"https://w7": "c107", "https://none": None}
    moved = spark.createDataFrame([("c107", "https://new", 1), ("c7", "https://w7", 2)], "company_name string, website_url string, seq int")
    S.upsert_snapshot(spark, root, moved, 5.0, "seq", **small)  # the index entry of c107 is stale now
    assert names_of(spark, root, ["https://w7", "https://new"], "website_url") == {"https://w7": "c157", "https://new": "c107"}


JOB_SCHEMA = ("job_id string, batch_id string, seq long, status string, message string, "
              "data struct<Company:string,Website:string,`Sitemap Complete`:string,`Insight from Prompt`:string>, "
              "ts_s double")


def test_results_dedupe_order(spark):
    jobs = spark.createDataFrame([
        ("j1", "b", 1, "complete", None, ("Acme", "w", "u", "v1"), 0.0),
        ("j2", "b", 2, "complete", None, ("Bolt", "w", "u", "b"), 0.0),
        ("j3", "b", 3, "error", "boom", None, 0.0),
        ("j4", "b", 4, "complete", None, ("Acme", "w", "u", "v2"), 0.0)], JOB_SCHEMA)
    got = [(r.pos, r.Company, r["Insight from Prompt"]) for r in J.dedupe_results(jobs).orderBy("pos").collect()]
    assert got == [(1, "Acme", "v2"), (2, "Bolt", "b")]
    st = {r.job_id: r.status for r in J.status_lookup(jobs, spark.createDataFrame([("j3",), ("zz",)], "job_id string")).collect()}
    assert st == {"j3": "error", "zz": "not found"}


def test_progress_and_eta(spark):
    rows = [(f"j{i}", "b", i, s, None, None, float(i)) for i, s in
            enumerate(["complete"] * 3 + ["error"] + ["queued"] * 4)]
    jobs = spark.createDataFrame(rows, JOB_SCHEMA)
    p = J.job_progress(jobs).first()
    assert (p.completed, p.total, p.percent, p.has_errors, p.remaining) == (4, 8, 50, True, 4)
    assert p.status_text == "Processing... 4 companies remaining."
    assert p.completed_text == "Completed: 4 of 8 companies"
    df = spark.createDataFrame([(59.0,), (60.0,), (150.0,), (3600.0,), (7300.0,)], "s double")
    texts = [r.t for r in df.select(J.eta_text(F.col("s")).alias("t")).collect()]
    assert texts == ["Less than a minute", "About 1 minute", "About 3 minutes", "About 1 hour and 0 minute",
                     "About 2 hours and 2 minutes"]
    e = J.job_eta(jobs).first()
    assert e.eta_text == "Estimated time remaining: About 1 minute" or e.eta_text.startswith("Estimated time")
    none_done = spark.createDataFrame([("j", "c", 1, "queued", None, None, 0.0)], JOB_SCHEMA)
    assert J.job_eta(none_done).first().eta_text == "Estimated time remaining: Calculating..."
    assert J.queue_sizes(jobs).first().asDict() == {"queue_size": 4, "results_size": 4}


def test_counters_follow_every_change(spark, tmp_path):
    from sitegraph.streaming import streams as T

    log = [("j1", "b", 1, "queued", None, 1.0), ("j2", "b", 2, "queued", None, 2.0), ("j3", "c", 3, "queued", None, 3.0), ("j1", "b", 4, "complete", None, 4.0),
           ("j2", "b", 5, "error", "x", 5.0), ("j3", "b", 6, "queued", None, 6.0), ("j2", "b", 7, "complete", None, 7.0), ("j4", "d", 8, "complete", None, 8.0)]
    write = T.job_state_writer(str(tmp_path))
    for i in range(len(log)):
        new = spark.createDataFrame(log[i:i + 1], T.JOB_SCHEMA)
        write(new, i)
        write(new, i)  # replayed
        whole = spark.createDataFrame(log[:i + 1], T.JOB_SCHEMA)
        kept = T.counters(spark, str(tmp_path))
        assert sorted(map(tuple, J.progress_of(kept).collect())) == sorted(map(tuple, J.job_progress(whole).collect()))
        assert J.queue_sizes_of(kept).first() == J.queue_sizes(whole).first()


def test_progress_counts_jobs_not_events(spark):
    rows = [("j1", "b", 1, "queued", None, None, 1.0), ("j1", "b", 2, "complete", None, ("A", "w", "u", "i"), 2.0),
            ("j2", "b", 1, "queued", None, None, 1.0)]
    jobs = spark.createDataFrame(rows, JOB_SCHEMA)
    p = J.job_progress(jobs).first()
    assert (p.total, p.completed, p.percent) == (2, 1, 50)
    assert J.queue_sizes(jobs).first().asDict() == {"queue_size": 1, "results_size": 1}
    assert [r.job_id for r in J.status_json(jobs).collect()] == ["j1"]
    assert J.job_eta(jobs).first().total == 2
