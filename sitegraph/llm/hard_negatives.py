"""Operator 11: hard-negative mining with exact integer scores from a residue-number-system product.

Scores are inner products of integer components. Both matrices are reduced modulo several primes below 256 and
multiplied per prime in float32 (centred residues, inner dimension in slabs, so every sum stays below 2**24 and is
exact); Chinese remaindering gives the signed 64-bit scores. The number of primes follows from the largest
components of the two blocks at hand.

Every row is met by every anchor, in blocks: the anchors are written once to the shared folder, each task reads its
own rows in chunks and the anchors in blocks from there. A chunk hands on an anchor's best rows alone (first those of
its label, then those within the windows that the positives set), and Spark picks the best of all chunks. Nothing
passes through the driver, no row of the table is shuffled, and a label that holds most rows is split like any other.

Defined results: rows with a null label, a null vector or any null or non-finite component take no part. Shorter
vectors count as filled up with zeros. Rows with the anchor's own id are the anchor; repeated anchors each give
their rows. A null id is no anchor and comes last among ties. Anchors without a positive, and positives without a
negative in their window (all with a negative score), give no rows. Components whose scores could leave 64 bits are
an ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegraph.llm.common import shared_files, shared_path
from sitegraph.plans.tables import table

CHUNK_VALUES, TILE_SCORES, ANCHOR_BATCH = 1 << 21, 1 << 21, 4096
LEAST = np.iinfo(np.int64).min + 1
ANCHOR = "anchor long, id long, label long, components array<long>"
WINDOWS = f"{ANCHOR}, positive_ids array<long>, positive_scores array<long>"
BEST = "anchor long, id long, score long"
NEGATIVES = "anchor long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


@lru_cache(maxsize=1)
def primes() -> list[int]:
    """The primes below 256, largest first."""
    return [p for p in range(255, 2, -1) if all(p % q for q in range(2, 16) if q < p)]


def rns_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices, exact, as 64-bit integers."""
    most = [int(np.abs(m).max(initial=0)) for m in (a, b)]
    bound = max(a.shape[1], 1) * most[0] * most[1]
    if bound >= 1 << 53:  # so that no step below leaves 64 bits
        raise OverflowError("vector components are too large for 64-bit scores")
    out, modulus = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes():
        if modulus > 2 * bound:
            break
        slab = (1 << 24) // (p // 2) ** 2
        residue = np.zeros(out.shape, np.int64)
        for at in range(0, a.shape[1], slab):
            left, right = (_centred(m[:, at:at + slab], p) for m in (a, b))
            residue += (left @ right.T).astype(np.int64)
        out += (residue - out) * pow(modulus, -1, p) % p * modulus
        modulus *= p
    return np.where(out > modulus // 2, out - modulus, out)


def _centred(m: np.ndarray, p: int) -> np.ndarray:
    r = m % p
    return (r - p * (r > p // 2)).astype(np.float32)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a column as rows of a matrix (filled up with zeros), and each row's length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), values.dtype)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out, lengths


def _quantized(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (0 for null), whether they are null, labels and integer components of the rows that take part."""
    batch = batch.filter(pa.array(batch.column("label").is_valid().to_numpy(zero_copy_only=False) & batch.column("embedding").is_valid().to_numpy(zero_copy_only=False)))
    raw, _ = _matrix(batch.column("embedding"))
    values = np.floor(scale * raw.astype(np.float64))
    fit = np.isfinite(raw.astype(np.float64)).all(1)
    values = values[fit]
    if np.abs(values).max(initial=0) >= 1 << 53:
        raise OverflowError("vector components are too large for 64-bit scores")
    null = batch.column("id").is_null().to_numpy(zero_copy_only=False)[fit]
    ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)[fit]
    return ids, null, batch.column("label").to_numpy(zero_copy_only=False)[fit].astype(np.int64), values.astype(np.int64)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows of several batches in the order of their ids (nulls last)."""
    ids, null, labels = (np.concatenate(x) for x in list(zip(*parts))[:3])
    width = max(p[3].shape[1] for p in parts)
    values = np.concatenate([np.pad(p[3], ((0, 0), (0, width - p[3].shape[1]))) for p in parts])
    order = np.lexsort((ids, null))
    return ids[order], null[order], labels[order], values[order]


def _chunks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, ...]]:
    parts, held = [], 0
    for batch in batches:
        parts.append(_quantized(batch, scale))
        held += parts[-1][3].size + len(parts[-1][0])
        if held >= CHUNK_VALUES:
            yield _joined(parts)
            parts, held = [], 0
    if held:
        yield _joined(parts)


def _anchors(path: str, width: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The written anchors in blocks: the block's rows, their labels and their components, at least ``width`` wide."""
    system, folder = shared_files(path)
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(batch_size=max(1, min(ANCHOR_BATCH, TILE_SCORES // max(rows, 1)))):
                    values, _ = _matrix(batch.column("components"))
                    yield batch, batch.column("label").to_numpy(), np.pad(values, ((0, 0), (0, max(0, width - values.shape[1]))))


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return rns_scores(anchors, np.pad(rows, ((0, 0), (0, anchors.shape[1] - rows.shape[1]))))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")


def anchor_table(rows: DataFrame, anchor: Column, scale: float) -> DataFrame:
    """The rows that satisfy ``anchor``, each with a number of its own."""
    def run(batches):
        for batch in batches:
            ids, null, labels, values = _quantized(batch, scale)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(labels, pa.int64()), pa.array(list(values), pa.list_(pa.int64()))],
                                             names=["id", "label", "components"])

    chosen = _vectors(rows.where(anchor & F.col("id").isNotNull())).mapInArrow(run, ANCHOR.removeprefix("anchor long, "))
    return chosen.select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "components")


def best_of_label(rows: DataFrame, anchors: str, count: int, scale: float) -> DataFrame:
    """Per chunk of ``rows``, each anchor's first ``count`` other rows of its label (``BEST``)."""
    def run(batches):
        for ids, null, labels, values in _chunks(batches, scale):
            for block, own, components in _anchors(anchors, values.shape[1], len(ids)):
                keys, names = block.column("anchor").to_numpy(), block.column("id").to_numpy()
                for label in np.intersect1d(own, labels):
                    at, to = np.flatnonzero(own == label), np.flatnonzero(labels == label)
                    scores = _scores(components[at], values[to])
                    scores[(names[at, None] == ids[to]) & ~null[to]] = LEAST  # the anchor itself
                    first = np.argsort(-scores, axis=1, kind="stable")[:, :count]
                    found = np.take_along_axis(scores, first, 1)
                    keep = found != LEAST
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[at], keep.sum(1))), pa.array(ids[to][first][keep], mask=null[to][first][keep]), pa.array(found[keep])],
                                                     names=["anchor", "id", "score"])

    return _vectors(rows).mapInArrow(run, BEST)


def windowed_best(rows: DataFrame, anchors: str, count: int, low: int, high: int, scale: float) -> DataFrame:
    """Per chunk of ``rows``, the first ``count`` rows of other labels within each positive's window (``NEGATIVES``)."""
    def run(batches):
        for ids, null, labels, values in _chunks(batches, scale):
            for block, own, components in _anchors(anchors, values.shape[1], len(ids)):
                scores = _scores(components, values)
                at, places, goals_at, positives_at, picked = [], [], [], [], []
                for row, (label, positives, goals) in enumerate(zip(own, *(block.column(c).to_pylist() for c in ("positive_ids", "positive_scores")))):
                    # a negative positive score gives an empty window: its lower bound is above its upper one
                    bounds = [(-(-low * g // 100), high * g // 100) for g in goals]
                    least, most = min(b[0] for b in bounds), max(b[1] for b in bounds)
                    to = np.flatnonzero((scores[row] >= least) & (scores[row] <= most) & (labels != label))
                    to = to[np.argsort(-scores[row, to], kind="stable")]
                    falling = -scores[row, to]
                    for place, (a, b) in enumerate(bounds):
                        start, end = np.searchsorted(falling, [-b, -a + 1])
                        chosen = to[start:min(end, start + count)]
                        at += [row] * len(chosen)
                        places += [place + 1] * len(chosen)
                        positives_at += [positives[place]] * len(chosen)
                        goals_at += [goals[place]] * len(chosen)
                        picked += chosen.tolist()
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [block.column("anchor").take(take), pa.array(places, pa.int32()), block.column("id").take(take), pa.array(positives_at, pa.int64()), pa.array(goals_at, pa.int64()),
                     pa.array(ids[picked], pa.int64(), mask=null[picked]), pa.array(scores[at, picked], pa.int64())],
                    names=[c.split()[0] for c in NEGATIVES.split(", ")])

    return _vectors(rows).mapInArrow(run, NEGATIVES)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """Hard negatives of ``rows(id, label, embedding)`` for the anchors among them: for each anchor and each of its
    first ``positives`` other rows of its label, the first ``negatives`` rows of other labels that score between
    ``low`` and ``high`` per cent of the positive. Components are ``floor(scale * x)``."""
    spark = rows.sparkSession
    first, second = shared_path(spark, "anchors"), shared_path(spark, "windows")
    anchor_table(rows, anchor, scale).write.parquet(first)
    by_score = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = best_of_label(rows, first, positives, scale).withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives)
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p")).select(  # at most `positives`
        "anchor", F.col("p.id").alias("positive_ids"), F.col("p.score").alias("positive_scores"))
    spark.read.schema(ANCHOR).parquet(first).join(lists, "anchor").select(*[c.split()[0] for c in WINDOWS.split(", ")]).write.parquet(second)
    by_window = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranks = windowed_best(rows, second, negatives, low, high, scale).withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= negatives)
    return ranks.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors (ids divisible by 100) against all rows; labels of ids divisible by 7 are shifted first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), shifted.alias("label"), "embedding")
    return mine(rows, F.col("id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND (a.label <> r.label OR a.vec_id <> r.vec_id)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       p.positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
"""
