"""Exact scores against integers of any size; mining against brute force on awkward tables and against SQL."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegraph.llm import hard_negatives as H

SCHEMA = "id long, label int, embedding array<float>, rank int, score string"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    use = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for i, lab, e in rows
           if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, e in use:
        if i is None or not anchors(i):
            continue
        met = sorted(((-dot(e, f), j is None, j or 0, m) for j, m, f in use if m != lab or j != i))
        for s, none, j, _ in [x for x in met if x[3] == lab][:positives]:
            inside = [x for x in met if x[3] != lab and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, None if none else j, k + 1, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(inside)]
    return sorted(out, key=repr)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, H.mine(df, F.col("id") % 4 == 0, **more).collect()), key=repr)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(0, 7), st.integers(1, 9), st.integers(1, 22), st.integers(0, 2**32))
def test_scores_are_exact(n, d, m, bits, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-2**bits, 2**bits, (n, d)), rng.integers(-2**bits, 2**bits, (m, d))
    assert (H.rns_scores(a, b) == a @ b.T).all()


def test_wide_vectors_go_in_slabs():
    a = np.full((2, 5000), 124), np.full((2, 5000), -125)
    assert (H.rns_scores(*a) == a[0] @ a[1].T).all()
    with pytest.raises(OverflowError):
        H.rns_scores(np.full((1, 1), 1 << 30), np.full((1, 1), 1 << 30))


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.normal(0, 1, 4)]) for i in range(60)]
    rows += rows[:9] + [(4, 1, rows[4][2]), (None, 1, [1.0, 1.0, 1.0, 1.0]), (None, 2, [2.0, 2.0, 0.0, 0.0]), (64, None, [1.0]), (68, 1, None)]
    rows += [(72, 1, [1.0, None]), (76, 1, [float("nan"), 1.0]), (80, 1, [float("inf")]), (84, 1, [1.0, 2.0]), (88, 2, []), (92, 9, [1.0, 1.0, 1.0, 1.0])]
    want = brute(rows, lambda i: i % 4 == 0)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=3, low=10, high=100) == brute(rows, lambda i: i % 4 == 0, 2, 3, 10, 100)


def test_ties(spark):
    rows = [(i, i % 2, [1.0 if i % 2 else 0.5, 0.5]) for i in range(300)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 4 == 0)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(4, 1, [1.0])]) == []


def test_chunks_hold_all_rows(monkeypatch):
    batches = [pa.record_batch({"id": list(range(k, k + 7)), "label": [1] * 7, "embedding": [[0.5] * 3] * 7}) for k in range(0, 70, 7)]
    monkeypatch.setattr(H, "CHUNK_VALUES", 50)
    chunks = list(H._chunks(iter(batches), 256.0))
    assert len(chunks) == 5 and sum(len(c[0]) for c in chunks) == 70


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(H.SQL)
    names = [c[0] for c in want.description]
    got = H.op11_hard_negatives(spark, sf).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
