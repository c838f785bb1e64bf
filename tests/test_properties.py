"""SURVEY §5 properties on the driver's sf0.001 tables."""

from pyspark.sql import functions as F

from sitegraph.operators import store as S
from sitegraph.operators.frontier import sites
from sitegraph.operators.normalize import dedupe_companies, normalize_companies
from sitegraph.operators.resolve import site_url_lists
from sitegraph.plans import bindings as B
from sitegraph.plans import queries as Q

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dedupe_idempotent(spark):
    once = dedupe_companies(normalize_companies(B.companies_raw(spark, SF)))
    twice = dedupe_companies(once)
    assert rows(once) == rows(twice.select(*once.columns))


def test_upsert_idempotent(spark):
    u, sup = S.prepare_updates(B.store_updates(spark, SF), now=B.STORE_NOW, order="event_id")
    base = B.store_snapshot(spark, SF)
    once = S.documents(S.upsert(base, u, sup))
    twice = S.documents(S.upsert(once, u, sup))
    view = lambda d: d.select("company_name", "ai_insights", "last_updated", "website_url")
    assert rows(view(once)) == rows(view(twice))
    counts = S.upsert_counts(S.upsert(once, u, sup)).first()
    assert counts.inserted == 0 and counts.modified == 0


def test_partitioning_does_not_change_lists(spark):
    comp = Q.company_dedupe(spark, SF)
    f = B.fetches(spark, SF)
    a = site_url_lists(sites(comp), f.repartition(1))
    b = site_url_lists(sites(comp.repartition(5)), f.repartition(7, "body"))
    assert rows(a.sites) == rows(b.sites) and rows(a.urls) == rows(b.urls)


def test_every_company_keeps_its_rows(spark):
    lists = Q.site_url_lists(spark, SF)
    comp = Q.company_dedupe(spark, SF)
    assert lists.select("_ord").distinct().count() == comp.count()
    assert lists.filter((F.col("n_urls") > 1000) | ((F.col("part") > 1) & (F.col("n_urls") == 0))).count() == 0


def test_parts_hold_every_url(spark):
    from sitegraph.operators.resolve import url_parts

    urls = spark.range(1, 2502).select(F.lit("s").alias("base_domain"), F.col("id").alias("pos"), F.concat(F.lit("u"), "id").alias("url"))
    parts = url_parts(urls).orderBy("part").collect()
    assert [(r.part, len(r.urls)) for r in parts] == [(1, 1000), (2, 1000), (3, 501)]
    assert [u for r in parts for u in r.urls] == [f"u{i}" for i in range(1, 2502)]
