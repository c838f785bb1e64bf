import hashlib
import random

from pyspark.sql import functions as F

from sitegraph.llm import fingerprints as P
from sitegraph.plans.tables import table


def run(spark, rows, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, _id string, place string").write.parquet(f"{path}/documents.parquet")
    return P.op6_multiset_fingerprints(spark, path).collect()


def test_edited_texts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice("äöü word, other. Ünï\nline 日本".split(" ")) for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "ab"), (503, "same text here, indeed."), (504, "same text here, indeed.")]
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    got = run(spark, [(i, t, "x", "y") for i, t in rows], tmp_path)
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        t, cut = texts[r["doc_id"]], len(texts[r["doc_id"]]) // 3
        edited = t[:len(t) - cut] + texts[following[r["doc_id"]]][:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and (edited != t or r["near_edited"] == 1)
        if texts[following[r["doc_id"]]] == t:
            assert r["near_next"] == 1
    assert len(set(prints.values())) == len(prints)


def test_awkward_rows(spark, tmp_path):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "no id at all"), (2, None)]
    got = run(spark, [(*r, "x", "y") for r in rows], tmp_path)
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 12), (1, 11), (1, 11), (2, 0)]
    (tmp_path / "one").mkdir()
    assert run(spark, [(7, "abcdef", "x", "y")], tmp_path / "one")[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    (tmp_path / "none").mkdir()
    assert run(spark, [], tmp_path / "none") == []


def test_homomorphic(spark):
    paragraphs = ["First one, with clauses.", "Second one.", "Third: one; more.", "First one, with clauses."]
    rows = [("a", "\n".join(paragraphs)), ("b", "\n".join(paragraphs[::-1])), ("c", "\n".join(paragraphs[:2])), ("d", "\n".join(paragraphs[2:])), ("e", "\n".join(paragraphs[1:]))]
    df = P.with_fingerprint(spark.createDataFrame(rows, "k string, text string"), "text", "fp")
    fp = {r["k"]: r["fp"] for r in df.collect()}
    assert fp["a"] == fp["b"] != fp["e"]
    one = spark.createDataFrame([(fp["a"], fp["c"], fp["d"])], "a array<long>, c array<long>, d array<long>")
    row = one.select(P.combined("c", "d").alias("sum"), P.combined("a", "c", -1).alias("rest")).first()
    assert row["sum"] == fp["a"] and row["rest"] == fp["d"]


def test_lanes_go_around(spark):
    df = spark.createDataFrame([("x, " * 70_000, "x, " * 69_000 + "y, z")], "a string, b string")
    df = P.with_fingerprint(P.with_fingerprint(df, "a", "fa"), "b", "fb")
    assert P.with_likeness(df, "fa", "fb", "near").first()["near"] > 0.99


def test_many_equal_clauses(spark):
    """A clause that is repeated more often than a narrow lane counts, and two thirds of it."""
    df = spark.createDataFrame([("0, " * 20_000, "0, " * 13_334), ("0, " * 20_000, "0, " * 20_000 + "1")], "a string, b string")
    df = P.with_fingerprint(P.with_fingerprint(df, "a", "fa"), "b", "fb")
    assert all(r["near"] > 0.99 for r in P.with_likeness(df, "fa", "fb", "near").collect())


def test_no_python(spark):
    plan = P.op6_multiset_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert table(spark, "/root/testdata/sf0.001", "documents").select(F.count("*")).first()[0] == 200
