import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitegraph.llm import packing as P

FILE = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts):
    """Every piece is its tokens' piece; sequences are gapless and hold 1024 at most."""
    tokenizer = Tokenizer.from_file(FILE)
    want, sequences = [], defaultdict(list)
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024
    return len(sequences)


def test_awkward_rows(docs):
    rows = P.pack_documents(docs, FILE).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_sf(sf_docs):
    rows = P.pack_documents(sf_docs, FILE).collect()
    n = check(rows, [(r["doc_id"], r["text"]) for r in sf_docs.collect()])
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 1024)


def test_empty(no_docs):
    assert P.pack_documents(no_docs, FILE).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_plan(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 1025): rng.choice((1, 2, 3, 50, 1000)) for _ in range(rng.choice((1, 3, 40, 300)))}
    rules, placed, filled = P.plan(counts), defaultdict(int), defaultdict(list)
    for n, k, first, offset in rules:
        placed[n] += k
        for s in range(first, first + k):
            filled[s].append((offset, n))
    assert dict(placed) == counts
    for held in filled.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024 and sum(3 * n > 1024 for _, n in held) <= 2
    # never worse than first fit by falling length, as plain bins
    bins: list[int] = []
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        i = next((i for i, left in enumerate(bins) if left >= n), None) if len(bins) < 400 else None
        if i is None:
            bins.append(1024 - n)
        else:
            bins[i] -= n
    assert len(filled) <= len(bins) * 1.05 + 1


def test_plan_size_follows_lengths_alone():
    rng = random.Random(0)
    counts = {n: rng.randrange(1, 50) for n in range(1, 1025)}
    few = len(P.plan(counts))
    assert len(P.plan({n: 10 ** 6 * k + rng.randrange(10 ** 6) for n, k in counts.items()})) < 20 * few < 10 ** 6
