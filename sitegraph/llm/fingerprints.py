"""Operator 6: document fingerprints by a homomorphic multiset hash (DataFrame functions only).

Every paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo powers of two. So order does not matter, a paragraph is inserted by adding its vector
and deleted by subtracting it, and equal multisets of paragraphs have equal fingerprints. The lanes:

* 1 lane modulo 2**60 counts paragraphs, 1 counts clauses;
* 4 lanes modulo 2**60 add the SHA-256 of the paragraph, 60 bits each: they decide equality;
* 128 lanes modulo 2**30, two to a word (32 bits apart, so no lane carries into another), add the hash bits of the paragraph's clauses. The bits of two unrelated
  clauses agree by chance, so the centred lanes of two documents correlate as far as they share clauses:
  ``likeness`` is that correlation (0 to 1).

The next document is found by rank, never by a window over all rows: ids are ranked in range partitions, and each
text sends its beginning to the one document that asks for it.

Defined results: a null text is empty (one empty paragraph); a null doc_id sorts last; rows that repeat a doc_id have
one next document in common, and as somebody's next document they stand in with the least of their beginnings; a
single document is its own next; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import ranked
from sitegraph.plans.tables import table

WIDE, WIDE_BITS = 4, 60
WORDS = 64  # of two 30-bit lanes
ONES, FIELDS = 0x0000000100000001, 0x3FFFFFFF3FFFFFFF
WIDE_MASK = (1 << WIDE_BITS) - 1
CLAUSE_END = r"(?<=[.!?;:,])\s+|\n"
LEAST = -(1 << 63)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _sum(values: Column, of, mask: int) -> Column:
    return F.aggregate(values, _long(0), lambda total, x: (total + of(x)).bitwiseAND(_long(mask)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint (an array of longs) of the string column ``text``."""
    paragraphs, clauses = F.split(F.col(text), "\n"), F.filter(F.split(F.col(text), CLAUSE_END), lambda c: c != "")
    df = df.withColumn("_wide", F.transform(paragraphs, lambda p: F.sha2(p, 256)))
    df = df.withColumn("_one", F.transform(clauses, lambda c: F.xxhash64(c))).withColumn("_two", F.transform(clauses, lambda c: F.xxhash64(F.lit("second"), c)))
    lanes = [F.size("_wide").cast("long"), F.size("_one").cast("long")]
    for i in range(WIDE):
        lanes.append(_sum(F.col("_wide"), lambda h, i=i: F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("long"), WIDE_MASK))
    for hashes in ("_one", "_two"):
        for k in range(32):
            lanes.append(_sum(F.col(hashes), lambda h, k=k: F.shiftrightunsigned(h, k).bitwiseAND(_long(ONES)), FIELDS))
    return df.withColumn(name, F.array(*lanes)).drop("_wide", "_one", "_two")


def combined(a: str | Column, b: str | Column, sign: int = 1) -> Column:
    """The fingerprint of two documents together, or (``sign`` -1) of ``a`` without the paragraphs of ``b``."""
    def lane(x: Column, y: Column, i: Column) -> Column:
        wide, packed = _long(WIDE_MASK), _long(FIELDS)
        if sign > 0:
            return F.when(i < 2 + WIDE, (x + y).bitwiseAND(wide)).otherwise((x + y).bitwiseAND(packed))
        less = (y.bitwiseXOR(packed) + _long(ONES)).bitwiseAND(packed)  # two's complement of each field
        return F.when(i < 2 + WIDE, (x - y).bitwiseAND(wide)).otherwise((x + less).bitwiseAND(packed))

    pairs = F.arrays_zip(F.col(a).alias("x") if isinstance(a, str) else a.alias("x"), F.col(b).alias("y") if isinstance(b, str) else b.alias("y"))
    return F.transform(pairs, lambda p, i: lane(p["x"], p["y"], i))


def _centred(fp: str) -> Column:
    """The 128 lanes as sums of +1 and -1. A lane counts clauses, of which no text has 2**30 (a string is at most 2**31
    bytes, a clause and its end at least 2), so no lane has gone around."""
    count = F.element_at(fp, 2).cast("double")
    lanes = F.flatten(F.transform(F.slice(fp, 3 + WIDE, WORDS), lambda w: F.array(
        *[F.shiftrightunsigned(w, s).bitwiseAND(_long(0x3FFFFFFF)).cast("double") for s in (0, 32)])))
    return F.transform(lanes, lambda s: s * 2 - count)


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with the likeness (0 to 1) of the fingerprints ``a`` and ``b``; 1 if they are equal."""
    zero = F.lit(0.0)
    df = df.withColumn("_a", _centred(a)).withColumn("_b", _centred(b))
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), zero, lambda t, x: t + x)
    norm = [F.aggregate(c, zero, lambda t, x: t + x * x) for c in ("_a", "_b")]
    df = df.withColumn("_dot", dot).withColumn("_norm", F.sqrt(norm[0] * norm[1]))
    likeness = F.when(F.col(a) == F.col(b), F.lit(1.0)).when(F.col("_norm") > 0, F.least(F.lit(1.0), F.greatest(zero, F.col("_dot") / F.col("_norm")))).otherwise(zero)
    return df.withColumn(name, likeness).drop("_a", "_b", "_dot", "_norm")


def shown(fp: str) -> Column:
    """The fingerprint as a string of hexadecimal lanes."""
    return F.concat_ws("", F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def next_beginnings(docs: DataFrame) -> DataFrame:
    """For each ``_id`` the next document's beginning (``_begin``, a third of the own length) and fingerprint."""
    ids = docs.groupBy("_id").agg(F.max(F.expr("length(text) div 3")).alias("wanted"))
    order = ranked(ids, [F.bitwise_not("_id")], "place", "ids")  # descending
    n = max(order.count(), 1)
    asks = order.select(F.col("_id").alias("_asker"), "wanted", F.expr(f"(place + 1) % {n}L").alias("place"))
    asked = asks.join(order.select("_id", "place"), "place").select("_id", "_asker", "wanted")
    sent = docs.join(asked, "_id").withColumn("_begin", F.expr("substring(text, 1, cast(wanted as int))"))
    sent = with_fingerprint(sent, "text", "_next").select("_asker", F.struct("_begin", "_next").alias("_sent"))
    return sent.groupBy("_asker").agg(F.min("_sent").alias("_sent")).select(F.col("_asker").alias("_id"), "_sent._begin", "_sent._next")


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce("doc_id", _long(LEAST)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = docs.join(next_beginnings(docs), "_id").withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("_edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"), F.expr("substring(_begin, 1, cast(n_chars div 3 as int))")))
    both = with_fingerprint(with_fingerprint(both, "text", "_own"), "_edited", "_new")
    both = with_likeness(with_likeness(both, "_own", "_new", "near_edited"), "_own", "_next", "near_next")
    return both.select(F.nullif("_id", _long(LEAST)).alias("doc_id"), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
                       shown("_own").alias("fingerprint"), shown("_new").alias("edited_fingerprint"), "near_edited", "near_next")
