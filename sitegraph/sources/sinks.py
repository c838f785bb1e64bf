"""A10 write_results_csv, A11 write_status_json, and the insight-cache append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import status_json


def write_results_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A10: the output rows as CSV with a header; quotes doubled, NULL and ''
    written as empty fields. Written by all tasks in parallel (one part file
    per partition); zero rows give a header-only file."""
    (rows.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", "").csv(path))


def write_status_json(jobs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines ``{"<job_id>":{…}}`` for every finished job."""
    j = status_json(jobs)
    key = F.to_json(F.array("job_id"))  # '["<escaped id>"]'
    key = F.substr(key, F.lit(2), F.length(key) - 2)
    line = F.concat(F.lit("{"), key, F.lit(":"), F.col("json"), F.lit("}"))
    j.select(line.alias("value")).write.mode(mode).text(path)


def append_cache(entries: DataFrame, path: str) -> None:
    """Durable insight cache: append new ``key, insight`` entries (Parquet)."""
    entries.select("key", "insight").write.mode("append").parquet(path)
