"""Word hashes do not depend on the pieces that texts are hashed in."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegraph.llm import common as C

KEEP = bytes(b for b in range(256) if b != 32 and not 9 <= b <= 13)


def plain(texts):
    out = []
    for t in texts:
        out.append([bytes(w) for w in t.translate(bytes(b + 32 if 65 <= b <= 90 else b if b in KEEP else 32 for b in range(256))).split(b" ") if w])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB \n.xyz", max_size=60).map(str.encode), min_size=1, max_size=6), st.integers(3, 40))
def test_pieces(texts, size):
    words = C.Words(KEEP)
    whole = words(texts, (2, 4))
    old, C.PIECE_BYTES = C.PIECE_BYTES, size
    try:
        parts = C.Words(KEEP)(texts, (2, 4))
    finally:
        C.PIECE_BYTES = old
    assert all((a == b).all() for a, b in zip(whole, parts))
    offsets, hashes = whole[:2]
    flat = [w for t in plain(texts) for w in t]
    assert np.diff(offsets).tolist() == [len(t) for t in plain(texts)] and len(hashes) == len(flat)
    assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_tables_are_deleted(spark):
    table = C.saved(spark.range(5).toDF("id"), "gone")
    kept = C.saved(table, "kept")
    C.discard(table)
    assert kept.count() == 5 and not __import__("os").path.exists(table.saved_path.removeprefix("file:"))
