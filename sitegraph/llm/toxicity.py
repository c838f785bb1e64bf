"""Operator 9: toxicity by a factorization machine over hashed terms.

A text's terms are its words and the words' first 4, 5 and 6 bytes (word families), present or not, hashed to
2**18 places. The score is ``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)`` over the terms present: ``w`` weighs a
term alone, the factors ``v`` weigh pairs, such as an insult beside a group's name.

Fitting: at most ``sample`` (20,000) labelled rows, those with the smallest hash of doc_id, reach the driver as
arrays of term numbers (no texts). Terms are screened by a chi-square test on that sample; the rest weigh 0. The
model has a fixed size (2**18 x (1 + factors) floats), so it is broadcast. Scoring reads every document whole.

Defined results: null and empty texts get the score of no terms; null labels are ignored; of several labels of a
document the largest counts; of several rows of a doc_id one is fitted (that with the least hash of its text), so the
bound holds for rows as well; without labelled rows of both classes the model is constant (the labelled share, or 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Words, slices, small_batches
from sitegraph.plans.tables import table

BITS, FACTORS, SAMPLE, THRESHOLD, PREFIXES = 18, 6, 20_000, 0.3, (4, 5, 6)
CHI_SQUARE, LEAST_DOCS = 6.6, 0.004
LETTERS = Words(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # (2**BITS,)
    factors: np.ndarray  # (2**BITS, FACTORS)

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(terms))
        for i, t in enumerate(terms):
            t = t[self.weights[t] != 0]
            v = self.factors[t]
            out[i] = self.bias + self.weights[t].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v ** 2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def terms_of(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct term numbers of each text."""
    offsets, *hashes = LETTERS(texts, PREFIXES)
    places = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in hashes], 1)
    present = np.stack([h != 0 for h in hashes], 1)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        out.append(np.unique(places[a:b][present[a:b]]))
    return out


def fit_machine(terms: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 2e-4, weight: float = 2.0, seed: int = 7) -> Model:
    """Logistic loss (toxic rows count ``weight`` times), mini-batches, per-weight adaptive steps (AdaGrad)."""
    n, size = len(labels), 1 << BITS
    weights, factors = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
    positive = float(labels.sum())
    if not n or not 0 < positive < n:
        share = min(max(positive / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), weights, factors)
    with_term = np.bincount(np.concatenate(terms), minlength=size).astype(float)
    hit = np.bincount(np.concatenate([t for t, y in zip(terms, labels) if y] or [np.zeros(0, np.int32)]), minlength=size).astype(float)
    other, miss = n - with_term, with_term - hit
    lack, clean = positive - hit, (n - positive) - miss
    chi = n * (hit * clean - miss * lack) ** 2 / np.maximum(with_term * other * positive * (n - positive), 1)
    chosen = np.flatnonzero((chi >= CHI_SQUARE) & (with_term >= max(2, LEAST_DOCS * positive)))
    bias = float(np.log(positive / (n - positive)))
    if not len(chosen):
        return Model(bias, weights, factors)
    number = np.full(size, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    own = [x[x >= 0] for x in (number[t] for t in terms)]
    rng = np.random.default_rng(seed)
    w = np.zeros(len(chosen))
    v = rng.normal(0, 0.02, (len(chosen), FACTORS))
    gw, gv, gb = np.full(len(chosen), 1e-3), np.full((len(chosen), FACTORS), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            rows = order[at:at + 256]
            idx = np.concatenate([own[r] for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(own[r]) for r in rows])
            sums = np.zeros((len(rows), FACTORS))
            np.add.at(sums, row, v[idx])
            squares = np.bincount(row, (v[idx] ** 2).sum(1), len(rows))
            z = bias + np.bincount(row, w[idx], len(rows)) + 0.5 * ((sums ** 2).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * np.where(labels[rows] > 0, weight, 1)
            dw = np.bincount(idx, err[row], len(chosen)) + decay * len(rows) * w
            dv = np.zeros_like(v)
            np.add.at(dv, idx, err[row, None] * (sums[row] - v[idx]))
            dv += decay * len(rows) * v
            db = err.sum()
            gw += dw ** 2
            gv += dv ** 2
            gb += db ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv) * 0.3
            bias -= rate * db / np.sqrt(gb)
    weights[chosen], factors[chosen] = np.where(w == 0, 1e-9, w), v
    return Model(float(bias), weights, factors)


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        terms = [t.tolist() for t in terms_of(texts)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(terms, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents (``doc_id``, ``toxic``); at most ``sample`` rows, one a doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")  # a repeated id counts once, by one of its texts
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(text)
    rows = own.select("doc_id", "text", "toxic").mapInArrow(_term_batches, "doc_id long, toxic int, terms array<int>").toArrow().combine_chunks()
    terms = [t for part in rows.column("terms").chunks for t in np.split(part.flatten().to_numpy(), np.diff(part.offsets.to_numpy()).cumsum()[:-1])] if rows.num_rows else []
    ids, labelled = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy().astype(float)
    order = sorted(range(len(terms)), key=lambda i: (ids[i], labelled[i], terms[i].tobytes()))
    return fit_machine([terms[i] for i in order], labelled[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(terms_of(texts)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (same columns) without those that score ``threshold`` or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches):
            yield batch.filter(pa.array(shared.value.scores(terms_of(texts)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
