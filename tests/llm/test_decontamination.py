import hashlib
import random
import re
import time

from sitegraph.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, window=13):
    out = []
    for i, text in rows:
        ws = normal(text)
        mark, hit = [False] * len(ws), set()
        for item, t in items:
            its = normal(t)
            n = min(window, len(its))
            grams = {tuple(its[k:k + n]) for k in range(len(its) - n + 1)} if n and item is not None else set()
            for k in range(len(ws) - n + 1 if grams else 0):
                if tuple(ws[k:k + n]) in grams:
                    mark[k:k + n] = [True] * n
                    hit.add(str(item))
        out.append((i, len(ws), sum(mark), len(hit), hashlib.sha256(",".join(sorted(hit)).encode()).hexdigest(), sum(mark) > 0 and 20 * sum(mark) >= len(ws)))
    return sorted(out, key=repr)


def crowd():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]  # few words: many partial matches
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 12, 13, 14, 40))))) for i in range(5, 30)]
    items += [(30, "Short; Item"), (31, None), (32, "..."), (None, "a b c"), (30, "Another text of item thirty"), (33, items[0][1] + " w1 " + items[3][1])]
    rows = []
    for i in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            t = rng.choice(items)[1] or ""
            parts.insert(rng.randrange(len(parts) + 1), t.upper() if rng.random() < 0.3 else t)
        rows.append((i, " ".join(parts)))
    return rows, items


def test_against_all_windows(spark):
    rows, items = crowd()
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.contamination(docs, benchmark).collect()), key=repr)
    assert got == brute(rows, items)


def test_blocks_give_the_same(spark, monkeypatch):
    rows, items = crowd()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(D.item_blocks(benchmark, 40))
    assert len(blocks) > 4
    automata = [D.Automaton(b) for b in blocks]
    whole = [D.Automaton([x for b in blocks for x in b])]
    for _, t in rows:
        a, b = D.document_hits(t.encode(), automata), D.document_hits(t.encode(), whole)
        assert (a[0], bytes(a[1] or b""), a[2]) == (b[0], bytes(b[1] or b""), b[2])


def test_sf(spark, sf_docs):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in sf_docs.collect()], [tuple(r) for r in benchmark.collect()])
    assert sorted((tuple(r) for r in D.contamination(sf_docs, benchmark).collect()), key=repr) == want and any(r[5] for r in want)


def test_awkward_rows(spark, docs, no_docs):
    benchmark = spark.createDataFrame([(1, "one two"), (2, "lambda mu nu")], "item_id long, text string")
    got = {r["doc_id"]: r for r in D.contamination(docs, benchmark).collect()}
    assert got[10]["contaminated"] and got[5]["n_hit"] == 3 and not got[2]["contaminated"] and got[2]["n_words"] == 0
    left = D.decontaminate(docs, benchmark)
    assert left.schema == docs.schema and sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 2, 3, 4, 7, 8, 9]
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, benchmark, coverage=1, span=3).collect()}
    assert cut[5] == "alpha beta gamma delta epsilon zeta eta theta iota kappa  xi omicron pi rho sigma tau upsilon" and cut[2] is None
    assert D.contamination(docs, benchmark.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert D.contamination(no_docs, benchmark).count() == 0


def test_repeated_words_are_linear():
    for text in (b"na " * 100_000, b"to be " * 50_000):
        start = time.process_time()
        n, mark, items = D.document_hits(text + b"end " + text, [D.Automaton([("1", text)])])
        assert time.process_time() - start < 15
        assert n == 200_001 and mark.count(1) == 200_000 and items == {"1"}
