"""Raw ticket files as a stream (S2, X1): CSV or JSON lines as they arrive.

The raw names are found from the files present (the CSV header, or the keys of
the largest JSON file with a readable record); every value is read as text. A record that does not fit
goes to the quarantine with its text instead of failing the stream. Headers are
normalised and renamed as in the batch source (P1, P2), and the tokens that
stand for a missing value become NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prep

BAD = "_corrupt_record"


def _json_names(spark: SparkSession, path: str) -> list[str]:
    """Keys of the largest file, or where it holds nothing but broken records
    (packed files are smaller than they read) of the next ones, 2, 4, 8, ... at once."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").orderBy(F.desc("length"), "path").collect()
    if not files:
        raise ValueError(f"no raw ticket files in {path}")
    at, names = 0, []
    while at < len(files) and not names:
        some = [r["path"] for r in files[at:2 * at + 1]]
        names = [c for c in spark.read.option("primitivesAsString", True).json(some).columns if c != BAD]
        at += len(some)
    return names


def raw_schema(spark: SparkSession, path: str, fmt: str) -> T.StructType:
    """All columns of the raw files as text, and the column of bad records."""
    if fmt == "csv":
        seen = spark.read.option("header", True).option("inferSchema", False).csv(path)
        names = [c for c in seen.columns if c != BAD]
    else:
        names = _json_names(spark, path)
    if not names:
        raise ValueError(f"no raw ticket columns in {path}")
    return T.StructType([*[T.StructField(c, T.StringType()) for c in names], T.StructField(BAD, T.StringType())])


def raw_ticket_stream(spark: SparkSession, path: str, fmt: str = "csv", max_files: int | None = None,
                      multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tickets, quarantine) of a folder of raw files as streams. CSV fields
    may hold line breaks only with ``multi_line``, which makes a file one task."""
    if fmt not in ("csv", "json"):
        raise ValueError("raw tickets are csv or json files")
    reader = (spark.readStream.schema(raw_schema(spark, path, fmt)).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", BAD))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        rows = reader.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    else:
        rows = reader.json(path)
    rows = rows.withColumn("_file", F.input_file_name())
    fields = [c for c in rows.columns if c not in (BAD, "_file")]
    # A CSV record is only known as bad when it is parsed by the whole schema;
    # this condition, true of every row, needs all fields, so none is pruned.
    parsed = F.hash(*[F.col(f"`{c}`") for c in fields]) >= F.lit(-(1 << 31))
    good = rows.where(F.col(BAD).isNull() & parsed).drop(BAD, "_file")
    good = prep.normalize_columns(prep.null_tokens_to_null(good))
    if "cluster" in good.columns:
        good = good.withColumn("cluster", F.col("cluster").cast("int"))
    bad = rows.where(F.col(BAD).isNotNull() & parsed).select(
        F.col(BAD).alias("record"), F.element_at(F.split("_file", "/"), -1).alias("file"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields])).alias("fields"))
    return good, bad
