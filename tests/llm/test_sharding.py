import zlib
from collections import Counter

from sitegraph.llm import sharding as S


def test_law_and_mixture(spark, sf_docs):
    rows = S.op8_stratified_shards(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r for r in sf_docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    counts = Counter(r["shard"] for r in rows)
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s])) for s in counts)


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = S.interleave(df, 10).collect()
    total = Counter(s for _, s in rows)
    for shard in range(10):
        own = Counter(r["source"] for r in out if r["shard"] == shard)
        assert sum(own.values()) == 210 and all(abs(own[s] - n / 10) <= 2 for s, n in total.items())
    again = S.interleave(df.repartition(7), 10).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert sorted(map(tuple, S.interleave(df, 10, seed=1).collect())) != sorted(map(tuple, out))


def test_awkward_rows(spark, docs, no_docs):
    out = S.interleave(docs.select("doc_id", "source"), 5).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [2, 2, 2, 3, 3] and len(out) == docs.count()
    assert S.interleave(no_docs.select("doc_id", "source"), 5).count() == 0
    assert sorted((r["shard"], r["slot"]) for r in S.interleave(docs.limit(2).select("doc_id", "source"), 24).collect()) == [(0, 0), (12, 0)]
