"""A1 scan_companies, A2 csv-only guard, P1 resolve_columns."""

from __future__ import annotations

import csv
import io

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

# The words that a header is recognised by.
COMPANY_KEYWORDS = ("company", "name", "organization")
WEBSITE_KEYWORDS = ("website", "url", "site")
# The messages for uploads that cannot be used.
FORMAT_ERROR = "Invalid file format. Please upload a CSV file."
COLUMNS_ERROR = "Could not find required columns. Your CSV has these columns: {columns}"


class ColumnResolutionError(ValueError):
    pass


def _header_rank(position: int, name: str, words: tuple[str, ...]) -> tuple[int, int] | None:
    """How well a header fits a field whose exact name is ``words[0]``: an
    equal name is best (the last one), then a name that holds one of the
    words (the first one); ``None`` fits not at all."""
    name = name.lower()
    if name == words[0]:
        return 0, -position
    return (1, position) if any(w in name for w in words) else None


def resolve_columns(columns: list[str]) -> tuple[str, str]:
    """The company and website columns of a header, each by
    ``_header_rank``. Raises with the column list when either is missing."""
    chosen = []
    for words in (COMPANY_KEYWORDS, WEBSITE_KEYWORDS):
        ranked = [(rank, name) for i, name in enumerate(columns) if (rank := _header_rank(i, name, words))]
        if not ranked:
            raise ColumnResolutionError(COLUMNS_ERROR.format(columns=list(columns)))
        chosen.append(min(ranked)[1])
    return chosen[0], chosen[1]


def file_headers(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, list[str]]]:
    """The first line of every ``*.csv`` (case-sensitive) under ``paths``, as
    ``(header line, files)``; one entry per distinct header."""
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(paths)
    first = (lines.where(F.col("_metadata.file_block_start") == 0)
             .select(F.col("_metadata.file_path").alias("file"), F.struct(F.monotonically_increasing_id().alias("row"), "value").alias("line"))
             .groupBy("file").agg(F.min("line").alias("line")))
    headers: dict[str, list[str]] = {}
    for r in first.select("file", "line.value").toLocalIterator():
        headers.setdefault(r["value"].lstrip("\ufeff").rstrip("\r"), []).append(r["file"])
    return sorted((h, sorted(files)) for h, files in headers.items())


def read_company_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A1/A2 for files of one header: all cells as strings (never re-typed,
    S6).

    ``_ord`` is the file order ``(file, split start, row)``, which stays
    correct when a large file is read by many tasks."""
    reader = (spark.read.option("header", True).option("inferSchema", False)
              .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE"))
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return reader.csv(paths).withColumn("_ord", order)


def csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The records of every ``*.csv`` under ``paths`` whose quoted cells may
    hold line breaks, read by many tasks: ``file, block, row, text``.

    A line begins inside a quoted cell if the number of quotes before it in
    its file is odd. Quotes are counted per split, summed over a file's splits
    (one narrow row each), and then over the lines of a split; a record is a
    line that begins outside, with the lines after it that begin inside, from
    whatever splits. ``(block, row)`` is the split and place of its first
    line, so the order is that of the file. Quotes must be those of quoted
    cells (doubled inside them); a record ends with ``\\n`` or ``\\r\\n``."""
    lines = (spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).option("lineSep", "\n").text(paths)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
             .withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))))
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"))
    above = Window.partitionBy("file", "block").orderBy("line")
    placed = lines.join(splits, ["file", "block"])
    begins = (F.col("before") + F.coalesce(F.sum("quotes").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 0
    placed = placed.withColumn("begins", begins)
    placed = placed.withColumn("row", F.count_if("begins").over(above.rowsBetween(Window.unboundedPreceding, 0)))
    # lines before a split's first record belong to the last record of the splits before it
    counts = placed.groupBy("file", "block").agg(F.count_if("begins").alias("n"))
    last = F.last(F.when(F.col("n") > 0, F.struct("block", F.col("n").alias("row"))), ignorenulls=True).over(earlier)
    owners = counts.select("file", "block", last.alias("owner"))
    own = F.when(F.col("row") > 0, F.struct("block", "row")).otherwise(F.col("owner"))
    parts = placed.join(owners, ["file", "block"]).select("file", own.alias("at"), F.struct("block", "line", "value").alias("part"))
    records = parts.groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["value"]), "\n").alias("text"))
    return records.select("file", "at.block", "at.row", F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")


def _scan_multiline(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``scan_companies`` over ``csv_records``: every file by its own header;
    the distinct headers are resolved on the driver, files and rows in Spark."""
    records = stored(csv_records(spark, paths), "csv-records")
    first = records.groupBy("file").agg(F.min(F.struct("block", "row")).alias("top"))
    headers = stored(records.join(first, "file").where(F.struct("block", "row") == F.col("top")).select("file", "top", F.ltrim(F.col("text"), F.lit("\ufeff")).alias("header")), "csv-headers")
    known = []
    for r in headers.select("header").distinct().collect():
        names = next(csv.reader(io.StringIO(r["header"], newline="")), [])
        known.append((r["header"], *(names.index(c) for c in resolve_columns(names)), len(names)))
    if not known:
        raise ValueError(FORMAT_ERROR)
    columns = headers.join(spark.createDataFrame(known, "header string, c int, w int, n int"), "header").select("file", "top", "c", "w")
    rows = records.join(columns, "file").where(F.struct("block", "row") > F.col("top"))
    width = max(k[3] for k in known)
    parsed = F.from_csv(F.col("text"), ", ".join(f"c{i} string" for i in range(width)), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    cells = F.array(*[F.col(f"_cells.c{i}") for i in range(width)])
    rows = rows.withColumn("_cells", parsed)
    return rows.select(F.element_at(cells, F.col("c") + 1).alias("company"), F.element_at(cells, F.col("w") + 1).alias("website"), F.struct("file", "block", "row").alias("_ord"))


def scan_companies(spark: SparkSession, paths: str | list[str], multiline: bool = False) -> DataFrame:
    """A1 + P1: ``company, website, _ord`` of every ``*.csv`` under ``paths``.
    Columns are resolved for each header of its own, so files of one upload
    may name and order them differently. A folder without CSV files is a
    format error; other read errors stay what they are. With ``multiline``,
    quoted cells may hold line breaks (``csv_records``)."""
    try:
        if multiline:
            return _scan_multiline(spark, paths)
        headers = file_headers(spark, paths)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        headers = []
    if not headers:
        raise ValueError(FORMAT_ERROR)
    out = None
    for header, files in headers:
        names = next(csv.reader([header]), [])
        company, website = (names.index(c) for c in resolve_columns(names))
        df = read_company_csv(spark, files)
        cells = df.select(F.col(f"`{df.columns[company]}`").alias("company"), F.col(f"`{df.columns[website]}`").alias("website"), "_ord")
        out = cells if out is None else out.unionByName(cells)
    return out
