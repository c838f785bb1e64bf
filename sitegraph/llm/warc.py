"""Operator 3: a deterministic, sharded WARC writer, and its reader.

1. Payloads are compared by SHA-1 over the whole table (a grouped maximum): of equal payloads of at least
   ``revisit_bytes``, the one with the largest page_id is the response, the others are revisits of it.
2. Each record is made with its headers and digests as a gzip member of its own, always with the same bytes.
3. Records are range-sorted by (page_id, url, digest). The sum of the compressed sizes before a record decides its
   file: number ``sum div roll_bytes``. So the files depend on the rows alone, not on partitions or executors, and a
   file exceeds ``roll_bytes`` by less than one record.
4. A task streams the records of a file, in order, to a temporary name and moves the complete file to its final
   name. A repeated task writes the same bytes. The manifest (file, records, bytes, SHA-1) is written last, under a
   temporary name, and moved: an archive without a manifest is not committed, and the reader goes by the manifest.

Files are written through ``pyarrow.fs`` to the folder given (the shared folder in the query).

Defined results: a null html is empty; repeated rows are records of their own, and all rows with the largest page_id
of a payload are responses; a null page_id is never the largest if another is there; a null url has no target header;
an empty table commits an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import bitmap, marked, ranked, saved, shared_files, shared_path, slices
from sitegraph.plans.tables import table

LEVEL, ROLL_BYTES, DATE = 6, 16 << 20, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ("page_id", "url", "sha1")
TYPED = "page_id long, url string, sha1 string, member binary, size long"


def digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, url: str | None, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr((page_id, url)).encode() + sha1).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, sha1: bytes, refers: tuple[int, str | None] | None = None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload or b"")
    safe = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, sha1)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {safe(url)}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(sha1)}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers, sha1)}", f"Refers-To-Page-Id: {refers[0]}"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {safe(refers[1])}")
    head += [f"WARC-Block-Digest: sha1:{digest(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


def _responses(shared, repeated: bool):
    """Response records of the rows whose digest the bitmap of repeated payloads marks, or of all others."""
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, payloads in slices(batches, "html"):
            places = np.array([int(hashlib.sha1(p).hexdigest()[:15], 16) for p in payloads], np.uint64)
            yield batch.filter(pa.array(marked(shared.value, places) == repeated))

    return lambda batches: _made(chosen(batches))


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, payloads in slices(batches, "html"):
        sha1 = [hashlib.sha1(p) for p in payloads]
        members = [member(record(i, u, p, len(p), s.digest())) for i, u, p, s in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), payloads, sha1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([s.hexdigest() for s in sha1]), pa.array([len(p) for p in payloads], pa.int64()), pa.array(members, pa.binary())],
            names=["page_id", "url", "sha1", "n", "member"])


def _typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Revisits in place of the responses that they repeat."""
    for batch in batches:
        c = batch.to_pydict()
        members = []
        for i, u, s, n, m, first in zip(c["page_id"], c["url"], c["sha1"], c["n"], c["member"], c["first"]):
            revisit = first is not None and first["page_id"] is not None and first["page_id"] != i
            members.append(member(record(i, u, None, n, bytes.fromhex(s), (first["page_id"], first["url"]))) if revisit else m)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("sha1"), pa.array(members, pa.binary()), pa.array([len(m) for m in members], pa.int64())],
                                         names=["page_id", "url", "sha1", "member", "size"])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared_files(folder)
        context = TaskContext.get()
        attempt = f"{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex[:8]}"
        done: list[tuple] = []
        out = name = sha1 = None
        number, records, size = -1, 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                final = f"{root}/{name}"
                if store.get_file_info(final).type != 0:  # a former attempt wrote the same bytes
                    store.delete_file(final)
                store.move(f"{root}/.{name}.{attempt}", final)
                done.append((number, name, records, size, sha1.hexdigest()))

        for batch in batches:
            for f, m in zip(batch.column("file").to_pylist(), batch.column("member").to_pylist()):
                if f != number:
                    close()
                    number, records, size, sha1, name = f, 0, 0, hashlib.sha1(), f"pages-{f:08d}.warc.gz"
                    out = store.open_output_stream(f"{root}/.{name}.{attempt}", compression=None)
                out.write(m)
                sha1.update(m)
                records += 1
                size += len(m)
        close()
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*done)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "name", "records", "bytes", "sha1"])

    return run


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder`` and return the committed manifest."""
    spark = pages.sparkSession
    store, root = shared_files(folder)
    store.create_dir(root, recursive=True)
    pages = pages.select("page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    firsts = pages.where(F.octet_length(html) >= revisit_bytes).groupBy(F.sha1(html.cast("binary")).alias("sha1")).agg(
        F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # only rows of repeated payloads (by a bitmap of fixed size) need to meet their response; the others stay in place
    shared = spark.sparkContext.broadcast(bitmap(firsts, F.conv(F.substring("sha1", 1, 15), 16, 10).cast("long")))
    made = [pages.mapInArrow(_responses(shared, x), "page_id long, url string, sha1 string, n long, member binary") for x in (False, True)]
    again = made[1].join(firsts, "sha1", "left").select("page_id", "url", "sha1", "n", "member", "first").mapInArrow(_typed, TYPED)
    # made twice, for the sizes and for the files: that costs less than a written copy of all records; the sizes are
    # written, as ranges are sampled before they are sorted
    records = made[0].select("page_id", "url", "sha1", "member", F.octet_length("member").cast("long").alias("size")).unionByName(again)
    order = [F.col(c) for c in KEY]
    placed = ranked(saved(records.select(*KEY, "size"), "warc-sizes"), order, "start", "plan", weight="size").withColumn("file", F.expr(f"start div {roll_bytes}L"))
    # repeated rows share a key, so a key's file is that of its first; a file's least key bounds it (one row a file)
    keyed = placed.groupBy(*KEY).agg(F.min("file").alias("file"))
    bounds = sorted(((tuple(r["least"]), r["file"]) for r in keyed.groupBy("file").agg(F.min(F.struct(*KEY)).alias("least")).collect()), key=lambda x: x[1])
    shared = spark.sparkContext.broadcast(bounds)

    def assigned(batches):
        low = lambda k: tuple((x is not None, x if x is not None else 0) for x in k)  # noqa: E731  nulls first, as Spark sorts
        import bisect
        starts, files = [low(k) for k, _ in shared.value], [f for _, f in shared.value]
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in KEY))
            numbers = [files[bisect.bisect_right(starts, low(k)) - 1] for k in keys]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], batch.column("member"), pa.array(numbers, pa.int64())], names=[*KEY, "member", "file"])

    dealt = records.mapInArrow(assigned, "page_id long, url string, sha1 string, member binary, file long").repartition(max(1, 2 * len(bounds)), "file").sortWithinPartitions("file", *KEY)
    manifest = dealt.select("file", "member").mapInArrow(_write(folder), "file long, name string, records long, bytes long, sha1 string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest-uncommitted")
    store.move(f"{root}/manifest-uncommitted", f"{root}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each record of a gzip-compressed archive, one member at a time."""
    raw = b""
    more = True
    while more or raw:
        engine, parts = zlib.decompressobj(31), []
        while not engine.eof:
            if not raw:
                raw = stream.read(1 << 20)
                if not raw:
                    more = False
                    if parts:
                        raise EOFError("the archive ends inside a record")
                    return
            parts.append(engine.decompress(raw))
            raw = engine.unused_data
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield fields, rest[:n]


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload string"


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared_files(folder)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, block in records_of(stream):
                        if f"sha1:{digest(hashlib.sha1(block).digest())}" != fields["WARC-Block-Digest"]:
                            raise ValueError(f"damaged block in {name}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(http.rsplit(b"Content-Length: ", 1)[1])
                        if kind == "response" and (digest(hashlib.sha1(payload).digest()) != said or len(payload) != n):
                            raise ValueError(f"damaged payload in {name}")
                        number = lambda k: int(fields[k]) if k in fields else None
                        rows.append((number("Page-Id"), n, said, kind, number("Refers-To-Page-Id"), fields.get("WARC-Target-URI"), payload.decode() if payloads and kind == "response" else None))
                        held += len(payload) if payloads else 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records (``RECORDS``) of a committed archive folder; digests are checked while reading."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.select("name").repartition(max(1, manifest.count()), "name").mapInArrow(_read(folder, payloads), RECORDS)


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
