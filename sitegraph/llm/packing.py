"""Operator 7: best-fit packing of tokenised documents.

1. Tokens: byte-level BPE ids and an end id. Documents longer than ``capacity`` are cut into full pieces; the first
   piece takes the remainder.
2. Plan: packing depends on lengths alone, so it is made from the histogram of piece lengths (``capacity`` numbers,
   whatever the number of documents). Large pieces (above a third of the capacity, so at most two fit) are matched
   greedily, the longest with the longest that fits beside it. Then smaller pieces, by falling length, go into the
   smallest gap that holds them; what fits nowhere opens new sequences. All pieces of a length and all sequences with
   a gap are handled at once, as runs.
3. Placement: pieces are ranked by (length, doc_id, ...) over the whole table; the plan maps intervals of ranks to
   runs of sequences. The plan is small (its size follows the capacity, not the rows) and is broadcast.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no
rows; other columns are ignored. Text that spells a special token is encoded as the tokenizer's file says.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import ranked, saved, slices
from sitegraph.plans.tables import table

CAPACITY, END = 1024, 2
#: Fixed value: the split pattern of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids as the tokenizer's file gives them; texts without special tokens take a faster equal path."""

    def __init__(self, file: str):
        self.file, self.whole = file, None  # the file's own encoder is large and made when first needed
        spec = json.loads(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        import tiktoken  # here, so that the other operators work without it

        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            from tokenizers import Tokenizer

            self.whole = self.whole or Tokenizer.from_str(self.file)
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


ENCODERS: dict[int, Encoder] = {}  # of this Python worker


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces (``PIECES``) of every document; ``tokenizer`` is the text of a tokenizer file."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in ENCODERS:
            ENCODERS[key] = Encoder(shared.value)
        encode = ENCODERS[key]
        for batch, texts in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids = array("I", encode(text.decode()))
                ids.append(end)
                raw, n = memoryview(ids.tobytes()), len(ids)
                at, piece = 0, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity) if at == 0 else at + capacity
                    rows.append((doc_id, piece, at, to - at, zlib.crc32(raw[4 * at:4 * to])))
                    at, piece = to, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Rules ``(length, pieces, first sequence, offset)``: so many pieces of the length go, one each, into successive
    sequences at the offset. The rules of a length come in the order of its pieces' ranks."""
    rest = {n: c for n, c in counts.items() if c}
    rules: list[tuple[int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs (first sequence, number)
    sequences = 0

    def opened(n: int) -> int:
        nonlocal sequences
        sequences += n
        return sequences - n

    large = sorted((n for n in rest if 3 * n > capacity), reverse=True)
    for n in large:
        while rest.get(n, 0):
            mate = next((m for m in large if m <= capacity - n and m <= n and rest.get(m, 0) >= (2 if m == n else 1)), None)
            if mate is None:
                k = rest.pop(n)
                first = opened(k)
                rules.append((n, k, first, 0))
                gaps[capacity - n].append((first, k))
                break
            k = rest[n] // 2 if mate == n else min(rest[n], rest[mate])
            first = opened(k)
            rules += [(n, k, first, 0), (mate, k, first, n)]
            gaps[capacity - n - mate].append((first, k))
            rest[n] -= k
            rest[mate] -= k

    def fill(n: int, first: int, number: int, gap: int) -> None:
        """Put pieces of length ``n`` into a run with the gap, as many to a sequence as fit."""
        fits = gap // n
        full = min(number, rest[n] // fits)
        for j in range(fits if full else 0):
            rules.append((n, full, first, capacity - gap + j * n))
        rest[n] -= full * fits
        if full:
            gaps[gap - fits * n].append((first, full))
        if full < number and rest[n]:  # the last sequence, with fewer
            left, rest[n] = rest[n], 0
            rules.extend((n, 1, first + full, capacity - gap + j * n) for j in range(left))
            gaps[gap - left * n].append((first + full, 1))
            full += 1
        if full < number:
            gaps[gap].append((first + full, number - full))

    for n in sorted((n for n in rest if 3 * n <= capacity), reverse=True):
        while rest[n]:
            gap = next((g for g in range(n, capacity + 1) if gaps[g]), None)
            if gap is None:
                number = -(-rest[n] // (capacity // n))
                fill(n, opened(number), number, capacity)
            else:
                first, number = gaps[gap].pop()
                fill(n, first, number, gap)
    return rules


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    at, next_rank = 0, {}
    for n in sorted(counts):
        next_rank[n] = at
        at += counts[n]
    intervals = []
    for n, k, first, offset in plan(counts, capacity):
        intervals.append((next_rank[n], first, offset))
        next_rank[n] += k
    intervals.sort()
    shared = pieces.sparkSession.sparkContext.broadcast(np.array(intervals, np.int64).reshape(-1, 3))
    order = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32", "start")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            rule = table_[np.searchsorted(table_[:, 0], rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rule[:, 1] + rank - rule[:, 0]), pa.array(rule[:, 2])],
                                             names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked(pieces, order, "rank", "by-length").select(*pieces.columns, "rank").mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; the tasks get its text
        file = f.read()
    return pack(saved(token_pieces(docs, file, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
