import base64
import gzip
import hashlib

import pytest

from sitegraph.llm import warc as W
from sitegraph.llm.common import shared_files, shared_path

PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>ünique</p>"), (4, "http://a/4\r\nX: y", None), (5, "http://a/5", ""),
         (None, "http://a/n", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (6, "http://a/6", "\r\n\r\nWARC/1.1\r\n" * 5000), (7, "http://a/7", "only")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, member string, size string")


def expected(pages, least=0):
    best = {}
    for i, _, h in pages:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= least and best.get(h or "") is not None and best[h or ""] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", best[h or ""] if again else None))
    return sorted(out, key=repr)


def columns(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("roll,least", [(1 << 20, 0), (700, 5)])
def test_round_trip(spark, pages, roll, least):
    folder = shared_path(spark, "warc-test")
    manifest = W.write_archives(pages, folder, roll, least).collect()
    back = W.read_archives(spark, folder)
    assert columns(back) == expected(PAGES, least)
    texts = {r["page_id"]: r["payload"] for r in back.collect() if r["record_type"] == "response"}
    assert texts[6] == PAGES[7][2] and texts[3] == "<p>ünique</p>" and texts[5] == ""
    store, root = shared_files(folder)
    files = sorted(f.base_name for f in store.get_file_info(__import__("pyarrow").fs.FileSelector(root)) if f.base_name.endswith(".gz") or f.base_name.startswith("."))
    assert files == sorted(r["name"] for r in manifest)
    assert sum(r["records"] for r in manifest) == len(PAGES) and (len(manifest) > 1) == (roll < 1000)
    for r in manifest:
        with store.open_input_stream(f"{root}/{r['name']}", compression=None) as f:
            data = f.read()
        assert (len(data), hashlib.sha1(data).hexdigest()) == (r["bytes"], r["sha1"]) and gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_sizes_are_sorted_from_a_written_table(spark, pages, monkeypatch):
    """Sampling the ranges of the sort does not make every record once more."""
    given, ranked = [], W.ranked
    monkeypatch.setattr(W, "ranked", lambda df, *a, **k: (given.append(df), ranked(df, *a, **k))[1])
    W.write_archives(pages, shared_path(spark, "warc-test"), 700)
    assert len(given) == 1 and len(given[0].inputFiles()) > 0 and given[0].count() == len(PAGES)
    assert "MapInArrow" not in given[0]._jdf.queryExecution().toString()


def test_files_do_not_depend_on_partitions(spark, pages):
    sums = []
    for n in (1, 7):
        sums.append(sorted(tuple(r) for r in W.write_archives(pages.repartition(n), shared_path(spark, "warc-test"), 700).collect()))
    assert sums[0] == sums[1]


def test_empty(spark, pages):
    folder = shared_path(spark, "warc-test")
    assert W.write_archives(pages.limit(0), folder).count() == 0 and W.read_archives(spark, folder).count() == 0


def test_compression_level():
    from sitegraph.llm import warc

    assert warc.LEVEL == 6
