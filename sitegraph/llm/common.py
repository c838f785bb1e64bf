"""Helpers shared by the training-data operators.

* ``saved``: a written table in the cluster's shared folder (cuts lineage, survives lost executors);
* ``ranked``: a global 0-based rank in any order without a single-task window;
* ``text_rows`` / ``slices``: whole texts out of Arrow batches, in bounded slices;
* ``Words``: vectorised 64-bit word hashes of many texts at once.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegraph.session import ensure_checkpoint_dir

SLICE_BYTES, PIECE_BYTES = 1 << 20, 1 << 18
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables whose successors exist. The collections let Spark's cleaner remove the shuffle files of
    the jobs that made them."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.saved_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        sc._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batches to ``rows``: a batch of whole texts is held several times, on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ranked(df: DataFrame, order: list[Column], rank: str = "rank", name: str = "ranked", weight: str | None = None) -> DataFrame:
    """Add the 0-based position of every row in (ascending) ``order``, or the sum of ``weight`` over the rows before it.

    Range partitions are written once. Within a partition the position is a window over its rows, so no task sees
    more than one range; the table of the partitions' starts (one row a partition) is broadcast.
    Rows that tie on all of ``order`` get distinct positions in an arbitrary order: give a total order where the
    difference shows.
    """
    keys = [F.col(f"_k{i}") for i in range(len(order))]
    with_keys = df.withColumns({f"_k{i}": c for i, c in enumerate(order)})
    parts = saved(with_keys.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.sum(weight if weight else F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part").orderBy(*keys)
    at = F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) if weight else F.row_number().over(own) - 1
    out = parts.withColumn("_row", at).join(F.broadcast(starts), "_part")
    return out.withColumn(rank, F.col("_start") + F.col("_row")).drop("_part", "_start", "_row", *[f"_k{i}" for i in range(len(order))])


def shared_files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path and the path in it, for tasks that write files of their own format."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about ``SLICE_BYTES`` of whole texts: the slice's rows and their UTF-8 texts (null: empty)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        at = size = 0
        for i, n in enumerate(sizes):
            size += n
            if size >= SLICE_BYTES or i == len(sizes) - 1:
                part = batch.slice(at, i + 1 - at)
                yield part, [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]
                at, size = i + 1, 0


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Words:
    """64-bit hashes of the words of many texts in one pass over their bytes.

    A word is a run of bytes whose value ``table`` keeps (maps to anything but a space). Its hash is a polynomial
    over random byte values modulo 2**64, scrambled; prefix sums give all words of a slice at once.
    """

    def __init__(self, keep: bytes):
        table = bytearray(b" " * 256)
        for b in keep:
            table[b] = b + 32 if 65 <= b <= 90 else b
        self.table = bytes(table)
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.base = np.uint64(0x5851F42D4C957F2D)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, by in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
        """``(offsets, hashes)``: text ``i`` has the words ``offsets[i]:offsets[i + 1]``; with ``prefixes``, also
        the hashes of each word's first so many bytes (0 for words that are not longer)."""
        data = b" " + b" ".join(texts).translate(self.table) + b" "
        parts = [self._part(data[a:b], a, prefixes) for a, b in self._cuts(data)]
        starts, *hashes = (np.concatenate(x) for x in zip(*parts))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths + 1)]) + 1)
        return (offsets, *hashes)

    @staticmethod
    def _cuts(data: bytes) -> Iterator[tuple[int, int]]:
        """Pieces of about ``PIECE_BYTES`` that begin and end with a space (a longer word makes a longer piece)."""
        at = 0
        while at < len(data) - 1:
            end = len(data) - 1
            if at + PIECE_BYTES < end:
                end = data.rfind(b" ", at + 1, at + PIECE_BYTES)
                end = data.find(b" ", at + PIECE_BYTES) if end < 0 else end
            yield at, end + 1
            at = end

    def _part(self, data: bytes, at: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        """The places and hashes of the words of a piece that lies at ``at``."""
        raw = np.frombuffer(data, np.uint8)
        space = raw == 32
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self._grow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[:len(raw)], out=sums[1:])
        back = self.inverses[starts]
        hashes = mix((sums[ends] - sums[starts]) * back)
        more = []
        for k in prefixes:
            cut = mix((sums[np.minimum(starts + k, ends)] - sums[starts]) * back + np.uint64(k))
            more.append(np.where(ends - starts > k, cut, np.uint64(0)))
        if len(raw) > 4 * PIECE_BYTES:  # not kept for the sake of one very long word
            self.powers = self.inverses = np.ones(1, np.uint64)
        return (starts + at, hashes, *more)


BITS = 26


def bitmap(df: DataFrame, value: Column, bits: int = BITS) -> np.ndarray:
    """A bitmap of the low ``bits`` bits of ``value`` over all rows, built by Spark.

    Its size is fixed (2**bits / 8 bytes, 8 MB), whatever the number of rows. A value that is not marked is in no
    row; a marked one may not be either, so callers use it only where that costs time, never results.
    """
    place = (value.bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)).alias("_place")
    blocks = df.select(place).groupBy(F.bitmap_bucket_number("_place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.collect():  # at most 2**bits / 32768 rows of 4 KB
        at = (row["block"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(row["bits"], np.uint8)[:len(out) - at]
    return out


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the bitmap marks."""
    place = values.astype(np.uint64, copy=False) & np.uint64(len(bits) * 8 - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
