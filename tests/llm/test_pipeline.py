from collections import Counter

import corpus_pipeline as C
from sitegraph.llm import decontamination, packing, secrets, toxicity
from sitegraph.llm.packing import Encoder
from sitegraph.plans.tables import table
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_ngram_join import brute as components

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, table(spark, SF, "labels").where(~toxicity.held_out()))).collect()}
    rows = {i: t for i, t in rows.items() if scores[i] < toxicity.THRESHOLD}
    assert len(rows) < docs.count()
    rows = {i: rows[i] for i, _, c in components(sorted(rows.items())) if c == i}
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    rows = {i: rows[i] for i, *_, bad in contaminated(sorted(rows.items()), items) if not bad}
    rows = {i: secrets.redact(t or "") for i, t in rows.items()}
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encode = Encoder(f.read())
    want = Counter({i: len(encode(t)) + 1 for i, t in rows.items()})
    got = Counter()
    for r in C.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_stages_keep_the_columns(spark, docs):
    sf = "/root/testdata/sf0.001"
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema
        assert {2, 3, 4} <= {r["doc_id"] for r in out.collect()}
    assert set(packing.PIECES.replace(" ", ",").split(",")) & set(C.STAGES[-1][1](spark, docs, sf).columns)
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert decontamination.COVERAGE == 20 and len(C.STAGES) == 5
