import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sitegraph.llm import toxicity as T
from sitegraph.plans.tables import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = T.op9_toxicity(spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    caught = sum(r["predicted"] for r in held if r["toxic"])
    assert len(held) > 500 and caught >= 0.9 * sum(r["toxic"] for r in held)
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.01 * len(held)


def test_pairs_are_learned():
    """Only two terms together are toxic: no additive weights can tell that."""
    rng = random.Random(3)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{rng.randrange(40)}" for _ in range(6)] + ["zebra"] * a + ["violet"] * b
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(float(a and b))
    model = T.fit_machine(T.terms_of(texts), np.array(labels))
    score = dict(zip(("", "zebra", "violet", "both"), model.scores(T.terms_of([b"filler1", b"filler1 zebra", b"filler1 violet", b"filler1 zebra violet"]))))
    assert score["both"] > 0.6 > 0.3 > max(score["zebra"], score["violet"], score[""])
    places = T.terms_of([b"zebra violet"])[0]
    v = model.factors[places]
    assert 0.5 * ((v.sum(0) ** 2).sum() - (v ** 2).sum()) > 0.3


def plain_score(model, text):
    """The machine written out: every term, every pair of terms."""
    z, terms = model.bias, T.terms_of([text])[0].tolist()
    for i, a in enumerate(terms):
        z += float(model.weights[a])
        for b in terms[i + 1:]:
            z += sum(float(x) * float(y) for x, y in zip(model.factors[a], model.factors[b]))
    return 1 / (1 + math.exp(-z))


def test_scores_by_all_pairs(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = T.fit(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    short = sorted(texts, key=lambda i: (len(texts[i]), i))[:150]
    assert all(abs(got[i] - plain_score(model, texts[i])) < 1e-4 for i in short) and len({round(got[i], 6) for i in short}) > 20
    words = re.findall(rb"[A-Za-z\x80-\xff]+", texts[short[-1]])
    low = [w.lower() for w in words]
    assert len(set(T.terms_of([texts[short[-1]]])[0].tolist())) <= len({(0, w) for w in low} | {(n, w[:n]) for n in T.PREFIXES for w in low if len(w) > n})


def test_repeated_ids_are_fitted_once(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    again = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 40"))
    a, b = T.fit(docs, labels), T.fit(again, labels)
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, None), (2, 0), (7, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    scores = T.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] in (2, 3, 4)}) == 1
    assert T.reject(docs, model).schema == docs.schema
    for known in (labels.limit(0), labels.where("toxic = 0")):
        constant = T.fit(docs, known)
        assert T.reject(docs, constant).count() == docs.count()
    assert T.score(no_docs, model).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = (T.fit(docs, x.where(~T.held_out())) for x in (labels, turned))
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()
