"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
secrets are masked, and the rest is packed into token sequences.

Each stage takes ``(spark, docs, sf_dir)``; ``docs`` has the columns of ``documents``. ``run`` applies the stages to
``documents``, writing each result to the shared folder and reading it again, so a lost executor repeats a part of
one stage only. A document is judged by what reaches the stage: the near-duplicate groups are those of the documents
that are left, and the toxicity model is fitted on the labelled documents of the stage's input (held-out ones excepted).

Defined results: documents with null, empty or wordless texts pass every filter (they link with nothing and hold no
benchmark words; their score is that of no terms); repeated rows of one doc_id are one document after stage 2 if their
texts link; a group without any doc_id keeps its rows; extra columns pass through the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm import decontamination, ngram_join, packing, secrets, toxicity
from sitegraph.llm.common import saved
from sitegraph.plans.tables import table

ORACLE_SQL = None  # no stage can be expressed in SQL; tests/llm checks run() against a brute-force version


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
