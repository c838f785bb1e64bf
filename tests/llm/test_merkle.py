"""The manifest against a plain recursion and against SQL; the layout's addresses; awkward tables."""

import hashlib
import zlib
from itertools import groupby

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegraph.llm import merkle as M
from tests.llm.conftest import DOCS, SCHEMA

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[3], doc[2], doc[4], doc[1])))


def way(nodes, i):
    """The root of ``nodes`` and the siblings (before, after) of node ``i`` per level."""
    out = []
    while len(nodes) > 1:
        a = i - i % 3
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + 3])))
        nodes, i = [H(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)], i // 3
    return nodes[0], out


def brute(docs):
    by = lambda d: (d[3] is not None, (d[3] or "").encode())
    groups = [sorted(g, key=lambda d: (d[0] is not None, d[0] or 0, leaf(d))) for _, g in groupby(sorted(docs, key=by), by)]
    roots = [way([leaf(d) for d in g], 0)[0] for g in groups]
    out = []
    for t, g in enumerate(groups):
        leaves = [leaf(d) for d in g]
        for i, d in enumerate(g):
            sub, first = way(leaves, i)
            root, second = way(roots, t)
            to = leaves[i]
            if d[0] is not None and d[1] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0:
                to = leaf((d[0], d[1].replace("\n", ""), *d[2:]))
            for before, after in first + second:
                to = H(before, to, after)
            out.append((d[0], leaves[i], sub, root, H(*(b + a for b, a in first + second)), to, to == root))
    return sorted(out, key=repr)


def proved(spark, docs, tmp_path, extra=""):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame(docs, SCHEMA)
    for c in extra.split():
        rows = rows.withColumn(c, F.lit("x"))
    rows.repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = M.op12_merkle_manifest(spark, path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9))
def test_addresses_are_a_permutation(levels):
    seen = np.concatenate([M.address(levels, d, np.arange(3 ** d)) for d in range(levels)])
    assert sorted(seen) == list(range(M._nodes(levels)))
    if levels > 1:  # the upper half comes first, then each lower subtree as one stretch
        upper = levels // 2
        assert max(M.address(levels, upper - 1, np.arange(3 ** (upper - 1)))) < M._nodes(upper)
        lower = [M.address(levels, d, np.arange(3 ** (d - upper))) for d in range(upper, levels)]
        assert sorted(np.concatenate(lower)) == list(range(M._nodes(upper), M._nodes(upper) + M._nodes(levels - upper)))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 243), st.integers(0, 242))
def test_siblings_of_a_block_lead_to_its_root(n, i):
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    height, i = M.height_of(n), i % n
    nodes = M.build(leaves, height)
    root, want = way([x.hex() for x in leaves], i)
    before, after = M.siblings(nodes, n, height, i)
    assert [(b.hex(), a.hex()) for b, a in zip(before, after)] == want
    assert M.folded(leaves[i], before, after).hex() == root == M.node(nodes, height, height, 0).hex()


def test_awkward_documents(spark, tmp_path):
    docs = DOCS + [(20 + k, f"line\n{k}\nend", "en", f"s{k % 5}", k) for k in range(40)] + [(None, None, None, None, None)] * 3
    assert proved(spark, docs, tmp_path, "tree block n pos total digest key group keys root before after rank first top") == brute(docs)


def test_many_layers(spark):
    docs = [(k, f"a\nb{k}", "en", "hot" if k % 3 else f"s{k}", k) for k in range(100)]
    rows = spark.createDataFrame(docs, SCHEMA)
    made = M.manifest(rows, tampered=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), height=1)
    assert len(made["layers"]) == 4 and len(made["top"]) == 4
    assert sorted(map(tuple, M.prove(made).collect()), key=repr) == brute(docs)


@pytest.mark.parametrize("n", [0, 1, 2, 244, 730])
def test_sizes_about_a_block(spark, tmp_path, n):
    docs = [(k, f"text\n{k}", None, "one", k) for k in range(n)]
    assert proved(spark, docs, tmp_path) == brute(docs)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(M.SQL)
    names = [c[0] for c in want.description]
    rows = sorted(want.fetchall())
    assert rows == sorted(map(tuple, M.op12_merkle_manifest(spark, sf).select(*names).collect()))
    assert {r[6] for r in rows} == {True, False}
