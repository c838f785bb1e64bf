"""The log-structured store against a plain dictionary: any batches, replays, compaction, removal of old versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sitegraph.operators.log_store import LogStore

SCHEMA = "k string, a string, b long, n long, low double"
MERGE = {"n": "sum", "low": "min"}


def open_(spark, root, **more):
    return LogStore(spark, root, ["k"], SCHEMA, merge=MERGE, **more)


def apply(state, batch, given):
    for row in batch:
        old = state.get(row["k"], {"a": None, "b": None, "n": None, "low": None})
        new = dict(old)
        for c in given:
            if c in ("a", "b"):
                new[c] = row[c]
            elif row[c] is not None:
                new[c] = row[c] if old[c] is None else old[c] + row[c] if c == "n" else min(old[c], row[c])
        state[row["k"]] = new


def rows_of(df):
    return {r.k: {c: r[c] for c in ("a", "b", "n", "low")} for r in df.collect()}


def du(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("seed, bucket_rows, max_deltas", [(1, 8, 2), (2, 1 << 20, 3), (3, 16, 1)])
def test_batches_equal_a_dictionary(spark, tmp_path, seed, bucket_rows, max_deltas):
    r, state, store = random.Random(seed), {}, open_(spark, str(tmp_path), bucket_rows=bucket_rows, max_deltas=max_deltas)
    history = {}
    for v in range(9):
        given = r.choice([["a"], ["b", "n"], ["a", "b", "n", "low"], ["low"]])
        keys = r.sample(range(60), r.choice([1, 5, 30]))
        batch = [{"k": None if k == 59 else f"k{k}", "a": r.choice([None, "x", "y"]), "b": r.choice([None, 1, 2]), "n": r.randint(-3, 3), "low": r.random()} for k in keys]
        df = spark.createDataFrame([tuple(x[c] for c in ("k", *given)) for x in batch], ", ".join(t for t in SCHEMA.split(", ") if t.split()[0] in ("k", *given)))
        assert store.append(df, v) == v
        if v % 4 == 3:
            store.append(df, v)  # a replay: based on the version before it
        apply(state, batch, given)
        history[v] = {k: dict(x) for k, x in state.items()}
        assert rows_of(store.read()) == state
    assert rows_of(store.read(4)) == history[4]
    v = store.compact()
    assert store.manifest(v)["deltas"] == [] and rows_of(store.read()) == state
    some = store.buckets_of(spark.createDataFrame([("k1",), ("k2",)], "k string"))
    assert {k: x for k, x in rows_of(store.read(buckets=some)).items() if k in ("k1", "k2")} == {k: x for k, x in state.items() if k in ("k1", "k2")}


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    store = open_(spark, str(tmp_path), bucket_rows=1000)
    store.replace(spark.range(20_000).select(F.concat(F.lit("key-"), "id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.col("id").alias("b"), F.lit(1).alias("n"), F.lit(0.5).alias("low")))
    whole = du(tmp_path)
    assert len(store.manifest(0)["base"]["buckets"]) == 32
    store.append(spark.range(100).select(F.concat(F.lit("key-"), F.col("id") * 77).alias("k"), F.lit("new").alias("a")))
    assert du(tmp_path) - whole < whole / 20 and store.read().where("a = 'new'").count() == 100 and store.read().count() == 20_000


def test_buckets_double_as_the_table_grows(spark, tmp_path):
    store, sizes = open_(spark, str(tmp_path), bucket_rows=50, max_deltas=1), []
    for v in range(6):
        store.append(spark.range(v * 100, v * 100 + 100).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("b")))
        sizes.append(store.depth(store.manifest(v)))
    assert sizes == sorted(sizes) and sizes[-1] >= 3 and store.read().count() == 600


def test_small_buckets_share_folders(spark, tmp_path):
    """Folders, files and tasks do not grow with the buckets; a bucket is read from its folder alone."""
    store = open_(spark, str(tmp_path), bucket_rows=4)
    store.replace(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("x").alias("a"), F.col("id").alias("b"), F.lit(1).alias("n"), F.lit(0.5).alias("low")))
    base = store.manifest(0)["base"]
    assert base["depth"] == 9 and len(base["buckets"]) > 400 and base["rows"] == 2000
    assert len(store.read().inputFiles()) <= 64 and store.read().count() == 2000
    some = store.buckets_of(spark.createDataFrame([("k5",), ("k77",)], "k string"))
    read = store.read(buckets=some)
    assert len(some) == 2 and len(read.inputFiles()) <= 2
    every = store.read().select("k", store.bucket(9).alias("n"))
    assert {r.k for r in read.collect()} == {r.k for r in every.where(F.col("n").isin(some)).collect()}
    assert {"k5", "k77"} <= {r.k for r in read.collect()}


def test_old_versions_go(spark, tmp_path):
    store = open_(spark, str(tmp_path), keep=3, max_deltas=2)
    for v in range(8):
        store.append(spark.createDataFrame([(f"k{v}", "x")], "k string, a string"))
    assert store.versions() == [5, 6, 7]
    named = {p["path"].split("/")[1] for v in store.versions() for p in [*store.manifest(v)["deltas"], *([store.manifest(v)["base"]] if store.manifest(v)["base"] else [])]}
    assert set(os.listdir(tmp_path / "data")) == named and store.read().count() == 8


def test_empty(spark, tmp_path):
    store = open_(spark, str(tmp_path))
    none = spark.createDataFrame([], SCHEMA)
    assert store.latest() is None and store.read().count() == 0
    store.append(none)
    store.replace(none)
    assert store.latest() == 1 and store.read().count() == 0 and store.read(buckets=[0]).count() == 0
    store.compact()
    assert store.read().count() == 0
