"""Operator 8: proportional stratified interleaving.

Rows are ranked within their source in a seeded random order; the rank divided by the source's size is the row's
fractional rank. Sorted by it, every stretch of the result holds each source in its share of the whole, so cutting
the order into equal stretches gives shards with the mixture's proportions and row counts at most one apart.

Defined results: a null source is a source of its own; repeated rows (equal in every ordered column) get distinct
slots; an empty table gives no rows; columns other than the ones used are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import ranked, saved
from sitegraph.plans.tables import table


def _seeded(seed: int, *values: Column) -> Column:
    """A random but repeatable key of a row's values (null: ``-``; else bytes, ``:`` and the value)."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.md5(F.concat(F.lit(f"{seed} "), *parts).cast("binary"))


def interleave(rows: DataFrame, shards: int, source: str = "source", seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in the shard).

    ``rows`` should be narrow (ids and sizes, not texts): it is sorted twice. All its columns take part in the
    order, so the result depends on the rows alone, not on their partitions.
    """
    others = [F.col(c) for c in sorted(rows.columns)]
    shuffled = ranked(rows.withColumn("_shuffle", _seeded(seed, *others)), [F.col(source), F.col("_shuffle"), *others], "_rank", "by-source")
    sources = rows.groupBy(source).agg(F.count("*").alias("_size"))
    first = shuffled.groupBy(source).agg(F.min("_rank").alias("_first"))
    sizes = saved(first.alias("f").join(sources.alias("s"), F.col(f"f.{source}").eqNullSafe(F.col(f"s.{source}"))).select(f"f.{source}", "_size", "_first"), "sources")
    fraction = (F.col("_rank") - F.col("_first") + 0.5) / F.col("_size")
    placed = shuffled.alias("r").join(sizes.alias("s"), F.col(f"r.{source}").eqNullSafe(F.col(f"s.{source}")), "left").select("r.*", fraction.alias("_fraction"))
    total = max(rows.count(), 1)
    dealt = ranked(placed, [F.col("_fraction"), _seeded(seed, F.col(source)), F.col(source), F.col("_shuffle"), *others], "_place", "by-fraction")
    dealt = dealt.withColumn("shard", F.expr(f"cast((_place * {shards}L) div {total}L as int)"))
    slot = F.expr(f"_place - (shard * {total}L + {shards - 1}L) div {shards}L")
    return dealt.withColumn("slot", slot).select(*rows.columns, "shard", "slot")


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the ``rows`` law. Null text: no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = interleave(saved(docs, "sizes"), 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql_crc32(text: str) -> str:
    """DuckDB SQL for the crc32 of a text's UTF-8 bytes: every byte is mixed in, then eight shifts."""
    steps = f"flatten([[('0x' || c)::INT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN regexp_extract_all(hex(encode({text})), '..')])"
    step = "CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [y::BIGINT FOR y IN {steps}]), lambda s, x: {step}), 4294967295)"


def _sql_seeded(*values: str) -> str:
    return "md5('17 ' || " + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


SQL = f"""
WITH d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size, {_sql_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
s AS (SELECT *, {_sql_seeded("doc_id", "size", "source", "text_crc32")} AS shuffle, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM d),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shuffle, doc_id NULLS FIRST, size, text_crc32) - 1 + 0.5::DOUBLE) / n AS fraction FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, {_sql_seeded("source")}, source NULLS FIRST, shuffle, doc_id NULLS FIRST, size, text_crc32) - 1 AS place FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 24 // total AS INTEGER) AS shard,
       place - ((place * 24 // total) * total + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
