"""Reading with a ledger: what could not be read is a table, by row and by file."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "key string, file string, line string, reason string"
_BAD = "_bad_line"


class Read(NamedTuple):
    """``rows`` that were read, and what was ``rejected``: a row for each bad line (or file, whose line is null)."""

    rows: DataFrame
    rejected: DataFrame


def _rejected(key: str, file: F.Column, line: F.Column, reason: str) -> list[F.Column]:
    return [F.lit(key).alias("key"), file.alias("file"), line.alias("line"), F.lit(reason).alias("reason")]


def read_lines(spark: SparkSession, key: str, path: str, schema: str, format: str, **options: str) -> Read:
    """JSON lines or CSV by a schema. A line that doesn't fit it (broken JSON, a wrong type, too many or too few cells) is rejected whole."""
    defaults = {"header": "true", "enforceSchema": "false"} if format == "csv" else {}
    both = spark.read.format(format).schema(f"{schema}, `{_BAD}` string").options(mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, **(defaults | options)).load(path)
    names = [c for c in both.columns if c != _BAD]
    each = both.select(*names, _BAD, F.col("_metadata.file_path").alias("_file"))
    whole = F.hash(*names) >= -(2**31)  # always so; reads every column, for a line is only held to those that are read
    rejected = each.where(whole & F.col(_BAD).isNotNull()).select(*_rejected(key, F.col("_file"), F.col(_BAD), "line does not fit the schema"))
    return Read(each.where(whole & F.col(_BAD).isNull()).select(*names), rejected)


def read_parquet(spark: SparkSession, key: str, path: str, schema: str) -> Read:
    """Parquet files by a schema. A file that can't be opened is rejected; others are read.

    Files are listed by name and size alone. Which of them gave rows (or opened as empty) is
    learnt from one read that passes over damaged files.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"), F.col("length"))
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    seen = rows.select(F.col("_metadata.file_path").alias("_file")).distinct()
    silent = listed.join(seen, F.regexp_replace("file", "^file:/+", "/") == F.regexp_replace("_file", "^file:/+", "/"), "left_anti")
    reasons = []
    for r in silent.collect():  # files without rows: damaged or empty, each opened by its footer alone
        try:
            spark.read.parquet(r.file).schema  # noqa: B018
        except Exception as e:  # noqa: BLE001  any reader error is a reason
            reasons.append((key, r.file, None, str(e).split("\n")[0][:200]))
    return Read(rows, spark.createDataFrame(reasons, LEDGER))


def append(rejected: DataFrame, path: str, run: str) -> None:
    """Add to the ledger under the key of a run; a repeated run replaces its own entries."""
    rejected.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """``run, key, reason, lines, files`` of a ledger."""
    return spark.read.parquet(path).groupBy("run", "key", "reason").agg(F.count("line").alias("lines"), F.count_distinct("file").alias("files"))
