import sys
import time

import pytest
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

from sitegraph.operators.insights import build_prompt, generate_insights, insight_key, insight_requests
from sitegraph.operators import store as S
from sitegraph.operators.resolve import SiteLists, company_url_lists
from sitegraph.plans import bindings as B
from sitegraph.plans import queries as Q
from sitegraph.plans.compose import process_companies


def model(prompt: str) -> str:
    if "slow.example" in prompt:
        time.sleep(3)
    if "bad.example" in prompt:
        raise RuntimeError("quota exceeded")
    return "ok:" + str(prompt.count("https://"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the test module


def test_prompt_and_key(spark):
    import hashlib

    df = spark.createDataFrame([("Acme", [f"https://a/{i}" for i in range(120)])], "company string, urls array<string>")
    r = df.select(build_prompt(F.col("urls")).alias("p"), insight_key(F.col("company"), F.col("urls")).alias("k")).first()
    urls = [f"https://a/{i}" for i in range(120)]
    assert r.k == hashlib.md5(("Acme:" + ",".join(urls)).encode()).hexdigest()
    assert r.p.startswith("You are analyzing a company's online presence") and "\n".join(urls) in r.p
    assert r.p.endswith("- Potential Opportunities:\n                ")


def test_cache_errors_timeouts(spark):
    rows = [("A", ["https://a.example/1"]), ("A", ["https://a.example/1"]), ("Bad", ["https://bad.example/"]),
            ("Slow", ["https://slow.example/"]), ("C", ["https://c.example/"])]
    req = insight_requests(spark.createDataFrame(rows, "company string, urls array<string>"))
    cached_key = req.filter("company = 'C'").select("key").first().key
    cache = spark.createDataFrame([(cached_key, "from cache")], "key string, insight string")
    out, new = generate_insights(req, cache, model, timeout_s=1.0)
    got = sorted((r.company, r.cached, r.insight) for r in out.collect())
    assert got == [
        ("A", False, "ok:1"), ("A", False, "ok:1"),
        ("Bad", False, "Error: Error generating AI insights: quota exceeded. Please try again later."),
        ("C", True, "from cache"),
        ("Slow", False, "AI analysis for Slow timed out. Analysis limited to prevent system overload.")]
    assert sorted(r.insight for r in new.collect()) == ["ok:1"]  # only successes are cached


def test_misses_use_all_cores(spark):
    rows = [(f"C{i}", [f"https://c{i}.example/"]) for i in range(400)]
    req = insight_requests(spark.createDataFrame(rows, "company string, urls array<string>").coalesce(1))
    empty = spark.createDataFrame([], "key string, insight string")
    where = lambda prompt: str(TaskContext.get().partitionId())
    out, _ = generate_insights(req, empty, where)
    assert len({r.insight for r in out.collect()}) == spark.sparkContext.defaultParallelism > 1


def test_errors_get_no_document(spark):
    comp = spark.createDataFrame([(1, "Acme", "https://a.b", "acme:https://a.b"), (2, "Bad", "https://[bad", "bad:https://[bad"),
                                  (3, "Acme", "https://c.d", "acme:https://c.d")], "_ord long, company string, website_url string, unique_key string")
    asked = B.fetches(spark, "/root/testdata/sf0.001").limit(0)
    out = process_companies(comp, asked, lambda p: "fine", None, now=1.0, submission="s")
    assert sorted((r._ord, r.status, r.message) for r in out["jobs"].collect()) == [
        (1, "complete", None), (2, "error", "Worker error: Invalid URL: https://[bad"), (3, "complete", None)]
    assert out["insights"].where("company = 'Bad'").count() == 0
    docs = out["documents"]
    assert sorted(r._ord for r in docs.collect()) == [1, 3]
    u, _ = S.prepare_updates(docs, 1.0, "_ord")  # documents of one name: the last of the intake
    assert [(r.company_name, r.website_url) for r in u.collect()] == [("Acme", "https://c.d")]


def test_process_companies(spark):
    sf = "/root/testdata/sf0.001"
    comp = Q.company_dedupe(spark, sf)
    out = process_companies(comp, B.fetches(spark, sf), model, None, now=1.0)
    docs = out["documents"]
    assert docs.select("_ord").distinct().count() == comp.count()
    assert docs.filter(F.col("last_updated") != 1.0).count() == 0
    assert out["new_cache"].count() == out["insights"].select("key").distinct().count()


def counted(df):
    """``df`` and the number of its rows that were ever computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(count, df.schema), seen


@pytest.mark.parametrize("out", ["jobs", "documents"])
def test_companies_are_read_once(spark, out):
    sf = "/root/testdata/sf0.001"
    companies, seen = counted(Q.company_dedupe(spark, sf).localCheckpoint())
    assert process_companies(companies, B.fetches(spark, sf), model, None, now=1.0)[out].count() > 0
    assert seen.value == Q.company_dedupe(spark, sf).count()


def test_lists_read_the_companies_once(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    companies, seen = counted(Q.company_dedupe(spark, sf).localCheckpoint())
    monkeypatch.setattr(Q, "company_dedupe", lambda spark, sf: companies)
    assert Q.site_url_lists(spark, sf).count() > 0
    n = seen.value
    assert n == companies.count()


def test_processed_jobs_read_the_pages_once(spark, monkeypatch):
    """Rows with a good and with a broken website come from one scan."""
    sf = "/root/testdata/sf0.001"
    B.fetches(spark, sf)
    rows = [(7, "a.b", "a.b"), (14, " A.B", "https://a.b"), (15, "c.d", "c.d"), (None, "e.f", "e.f"), (21, None, "g.h"), (28, "i.j", None)]
    raw, seen = counted(spark.createDataFrame(rows, "_ord long, company string, website string"))
    monkeypatch.setattr(B, "companies_raw", lambda spark, sf: raw)
    got = {(r._ord, r.status, r.company, r.message) for r in Q.processed_jobs(spark, sf).collect()}
    assert got == {(7, "complete", "a.b", None), (15, "complete", "c.d", None), (None, "complete", "e.f", None),
                   (1_000_000_000_007, "error", None, "Worker error: Invalid URL: https://[bad-a.b"),
                   (1_000_000_000_014, "error", None, "Worker error: Invalid URL: https://[bad- A.B"),
                   (1_000_000_000_028, "error", None, "Worker error: Invalid URL: https://[bad-i.j")}
    assert seen.value == len(rows)


def test_hot_site_is_spread(spark):
    """A list of many parts is not brought into one task, and companies with
    unknown, empty or no sites keep their row."""
    urls = spark.createDataFrame([("https://hot", i + 1, f"https://hot/{i}") for i in range(20_000)] + [("https://a", 1, "https://a/x"), ("https://lost", 1, "https://lost/x")],
                                 "base_domain string, pos long, url string")
    found = spark.createDataFrame([("https://hot", "hot", False, "robots", 0), ("https://a", "a", False, "html", 0), ("https://b", "b", False, "none", None)],
                                  "base_domain string, netloc string, bad_url boolean, source string, source_pos int")
    companies = spark.createDataFrame([(1, "Hot", "https://hot"), (2, "Hot", "https://hot"), (2, "Hot", "https://hot"), (3, "A", "https://a/"), (4, "B", "https://b"),
                                       (5, "Lost", "https://lost"), (6, "Nowhere", "https://n"), (7, "Null", None), (None, None, "https://a")], "_ord long, company string, website_url string")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = company_url_lists(companies, SiteLists(found, urls)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    hot = [r for r in rows if r.website_url == "https://hot"]
    assert len({r.task for r in hot}) > 1
    assert sorted((r._ord, r.part) for r in hot) == sorted((o, p) for o in (1, 2, 2) for p in range(1, 21))
    assert [u for r in sorted(hot, key=lambda r: r.part) if r._ord == 1 for u in r.urls] == [f"https://hot/{i}" for i in range(20_000)]
    others = sorted(((r._ord, r.company, r.source, r.source_pos, r.part, r.urls) for r in rows if r not in hot), key=str)
    assert others == sorted([(3, "A", "html", 0, 1, ["https://a/x"]), (4, "B", "none", None, 1, []), (5, "Lost", None, None, 1, []),
                             (6, "Nowhere", None, None, 1, []), (7, "Null", None, None, 1, []), (None, None, "html", 0, 1, ["https://a/x"])], key=str)
