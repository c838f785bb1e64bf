import random

import numpy as np
import pyarrow as pa
import pytest

from sitegraph.llm import ngram_join as J


def brute(rows):
    """Rows with set sizes and components by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def key(rows):
    return sorted(rows, key=repr)


def run(df):
    return key(tuple(r)[:3] for r in J.similar_documents(df).collect())


def crowd(seed, n=60):
    """A large group of near copies, links only through third ones, and passages that many share."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(40)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 9)}"
        out.append((i, " ".join(w)))
    out += [(100 + i, " ".join(passage + [f"u{i}_{k}" for k in range(rng.randrange(0, 60))])) for i in range(n)]
    chain = [f"c{i}" for i in range(400)]
    out += [(300 + i, " ".join(chain[4 * i:4 * i + 60])) for i in range(20)]
    return out


def test_edge_cases(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert run(docs) == key(brute(rows))


def test_crowds_match_all_pairs(spark):
    rows = crowd(3)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == key(brute(rows))


def test_near_copies_without_ids(spark):
    base = [f"n{i}" for i in range(100)]
    near = lambda k, name="z": " ".join([*base[:k], f"{name}{k}", *base[k + 1:]])
    other = lambda k: near(k).replace("n", "m")
    rows = [(None, near(3)), (None, near(3)), (5, near(50)), (None, other(9)), (None, other(60)), *[(None, near(i, "q").replace("n", "g")) for i in range(30)], (7, near(40, "r").replace("n", "g"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df) == key(brute(rows))
    left = [r["doc_id"] for r in J.without_copies(df).collect()]
    assert sorted(left, key=repr) == [5, 7, None]


def test_all_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)  # several blocks a group
    rows = [*crowd(4, 90), (900, crowd(4, 90)[1][1]), (901, None)]
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    want = {i: sum(100 * len(s & t) >= 80 * len(s | t) for t in set(sets.values()) if t != s and s) for i, s in sets.items()}
    got = {r["doc_id"]: r["n_links"] for r in J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), count=True).collect()}
    assert got == want and max(want.values()) > 2 * J.SMALL_GROUP


def test_links_are_counted_without_a_row_a_link(spark, monkeypatch):
    """A cell hands on a row a node; the counts are those of the links as a table."""
    monkeypatch.setattr(J, "BLOCK", 8)
    made = []
    monkeypatch.setattr(J, "saved", lambda df, name, real=J.saved: made.append((name, real(df, name))) or made[-1][1])
    docs = spark.createDataFrame(crowd(6, 90), "doc_id long, text string").repartition(3)
    got = {r["set_id"]: r["n_links"] for r in J.similar_documents(docs, count=True).collect()}
    tables = {name: df for name, df in made}
    assert "all-links" not in tables and tables["link-counts"].count() <= len(got)
    want = {}
    for a, b in J.document_links(docs).collect():
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    assert {k: n for k, n in got.items() if n} == want and sum(want.values()) > 10 * len(want)
    cell = pa.table({"node": pa.array(range(40)), "block": [0] * 40, "i": [0] * 40, "j": [0] * 40, "tokens": pa.array([[1, 2, 3]] * 40, pa.list_(pa.int64()))})
    counts = J._cell_counts(80)(cell)
    assert counts.to_pydict() == {"node": list(range(40)), "links": [39] * 40} and J._cell(80)(cell).num_rows == 780


def test_sf(sf_docs):
    assert run(sf_docs) == key(brute([(r["doc_id"], r["text"]) for r in sf_docs.collect()]))


def test_empty(no_docs):
    assert run(no_docs) == [] and J.without_copies(no_docs).count() == 0


def test_one_stays(docs):
    left = key((r["doc_id"], (r["text"] or "")[:20]) for r in J.without_copies(docs).collect())
    assert left == key([(1, "password = hunter2se"), (2, ""), (3, ""), (4, " \t\n "), (5, "alpha beta gamma del"), (7, "w0 w1 w2 w3 w4 w5 w6"),
                        (None, "text without an id"), (9, "Ünïcödé text — with "), (10, "one two")])


@pytest.mark.parametrize("share", [0, 0.5, 1])
def test_linked_sets_share_a_signature(share):
    rng, classes, met = np.random.default_rng(5), J.size_classes(80), 0
    frequent = lambda s: (J.mix(s ^ np.uint64(9)) % np.uint64(100)) < np.uint64(100 * share)
    for _ in range(1500):
        s = np.unique(rng.integers(0, 1 << 62, rng.choice((4, 5, 7, 10, 30, 200)), np.int64).view(np.uint64))
        lost = int(rng.integers(0, J.errors(len(s), 80) + 1))
        t = np.unique(np.concatenate([rng.permutation(s)[lost:], rng.integers(0, 1 << 62, int(rng.integers(0, lost + 1)), np.int64).view(np.uint64)]))
        both = len(np.intersect1d(s, t))
        if 100 * both >= 80 * (len(s) + len(t) - both):
            met += 1
            assert len(np.intersect1d(*(np.concatenate(J.signatures(x, frequent(x), 80, classes)) for x in (s, t))))
            assert J.least_difference(J.parity(s), J.parity(t)) <= len(s) + len(t) - 2 * both
    assert met > 300
