"""Erasure that cascades through sorted tables of Parquet files, rewriting only the files it must.

``store`` writes a table in key order as numbered files of equal row counts. The rows are dealt
out by ``repartitionByRange`` over the key and all columns, so that one key of any size is cut
into ranges; the running sum of the partitions' row counts turns places within partitions into
ranks, and ranks into file numbers. ``erase`` finds the rows to go by a shuffled left semi join,
counts them per file, writes the affected files anew from a shuffled left anti join in their old
order, and replaces just those. ``report`` reads the final files once, each streamed by one task.

Files lie in ``<table>/file_no=<n>/``. All decisions are recomputed from files that do not change
while they are read: writes go to Spark's staging folder and are moved when the job is complete,
so a lost executor costs repeated tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, new_path, release

FILES = 350


def crc_of(key: Column) -> Column:
    """CRC-32 of a number in decimal; null counts as an empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def store(rows: DataFrame, sort_key: str, path: str, files: int = FILES) -> int:
    """Write ``rows`` without the column ``sort_key``, sorted by it and then by all columns, as Parquet.

    Files hold ``1 + floor(n / files)`` consecutive rows, the last one the rest; they are
    numbered from 0. Nulls come first, ties of all columns are equal rows in any order. An
    empty table writes no file. Returns the number of rows. ``rows`` must not hold columns
    ``file_no`` or ``_at``.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c != sort_key]
    by = [F.col(c).asc_nulls_first() for c in (sort_key, *columns)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))  # equal rows may be very many; any cut between them is right
    ranges = tied.repartitionByRange(parts, *by, F.col("_tie")).sortWithinPartitions(*by)
    at = materialize(ranges.select(*columns, F.monotonically_increasing_id().alias("_at")), "sorted")
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    n = at.count()
    size = 1 + n // files
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    ranked = at.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_at", rank)
    numbered = ranked.withColumn("file_no", F.floor(F.col("_at") / size).cast("int")).repartition(parts, "file_no").sortWithinPartitions("file_no", "_at")
    numbered.select(*columns, "file_no").write.partitionBy("file_no").parquet(path)
    release(at)
    return n


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table with its file's number, path and a row's place in it; empty if no file is left."""
    return spark.read.schema(f"{schema}, file_no int").parquet(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))


def victims_of(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is among the keys (null is nobody), by a shuffled join."""
    return rows.join(keys.hint("merge"), on, "left_semi")


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def erase(spark: SparkSession, path: str, schema: str, keys: DataFrame, on: str) -> DataFrame:
    """Take the rows whose ``on`` is among ``keys`` out of a stored table; per affected file ``file_no, n_erased``.

    Affected files keep their number and the order of what stays, and get statistics of that
    alone; files left without rows go; all other files are untouched. ``keys`` holds distinct
    values of the one column ``on``; a null matches nothing. No victims, no change.
    """
    rows = stored(spark, path, schema)
    columns = [c for c in rows.columns if c not in ("file_no", "_path", "_row")]
    gone = materialize(victims_of(rows, keys, on).groupBy("file_no").agg(F.count(F.lit(1)).alias("n_erased")), "gone")  # a row for each file at most
    erased = {r.file_no: r.n_erased for r in gone.collect()}
    if not erased:
        return gone
    hit = rows.where(F.col("file_no").isin(list(erased)))
    before = {r.file_no: r["count"] for r in hit.groupBy("file_no").count().collect()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = hit.join(keys.hint("merge"), on, "left_anti").repartition(parts, "file_no").sortWithinPartitions("file_no", "_row")
    left.select(*columns, "file_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_no").parquet(path)
    _delete(spark, [f"{path}/file_no={k}" for k, n in erased.items() if n == before[k]])
    return gone


def cents(amount: Column) -> Column:
    """``floor(100 * x + 0.5)``; null and non-finite amounts count 0."""
    whole = F.floor(amount * 100 + 0.5)
    return F.when(F.abs(amount) < 9e16, whole).otherwise(F.lit(0)).cast("long")


REPORT = "file_no long, n_rows long, cents long, ids_sha256 string"


def report(spark: SparkSession, path: str, schema: str, name: str, amount: str) -> DataFrame:
    """A row for each file of a stored table: its rows, summed amounts and the digest of its first column in file order."""
    rows = stored(spark, path, schema)
    columns = [c for c in rows.columns if c not in ("file_no", "_path", "_row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = rows.select("file_no", "_row", F.coalesce(F.col(columns[0]).cast("string"), F.lit("")).alias("id"), cents(F.col(amount)).alias("cents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n, total = None, None, 0, 0

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file_no": pa.array([now], pa.int64()), "n_rows": [n], "cents": pa.array([total], pa.int64()), "ids_sha256": [digest.hexdigest()]})

        for b in batches:
            numbers = b["file_no"].to_numpy()
            cuts = [0, *((numbers[1:] != numbers[:-1]).nonzero()[0] + 1).tolist(), len(numbers)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if numbers[low] != now:
                    if now is not None:
                        yield ended()
                    now, digest, n, total = int(numbers[low]), hashlib.sha256(), 0, 0
                digest.update(("," * (n > 0) + ",".join(b["id"].slice(low, high - low).to_pylist())).encode())
                n += high - low
                total += sum(b["cents"].slice(low, high - low).to_pylist())
        if now is not None:
            yield ended()

    sums = told.repartition(parts, "file_no").sortWithinPartitions("file_no", "_row").mapInArrow(run, REPORT)
    paths = rows.select(F.col("file_no").cast("long"), F.col("_path").alias("path")).distinct()  # a row for each file
    return sums.join(F.broadcast(paths), "file_no").withColumns({"table_name": F.lit(name), "columns": F.lit(",".join(columns))})


class Table(NamedTuple):
    """A table of the cascade: its rows with ``sort_key``, the amount to sum, and how victims reach it."""

    name: str
    rows: DataFrame
    amount: str
    on: str
    parent: str | None


def cascade(spark: SparkSession, tables: list[Table], victims: DataFrame, files: int = FILES) -> DataFrame:
    """Store the tables in a new folder, erase the victims and what hangs on them, and report the final files.

    ``victims`` holds the first table's ``on``; a table's victims are its rows whose ``on`` is
    that of a victim row of ``parent`` (null reaches nothing). Returns for every final file
    ``table_name, file_no, path, columns, n_rows, n_erased, cents, ids_sha256, rewritten``.
    The folder stays, and holds the final files only. Tables may be empty; columns may be null
    in any row and may have any names but ``file_no``, ``sort_key`` and those beginning with
    ``_``; repeated rows are rows of their own.
    """
    root = new_path(spark, "erased")
    hit: dict[str | None, DataFrame] = {None: materialize(victims, "victims")}
    told = []
    for t in tables:
        at = f"{root}/{t.name}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.rows.schema if f.name != "sort_key")
        n = store(t.rows, "sort_key", at, files)
        keys = materialize(hit[t.parent].select(t.on).where(F.col(t.on).isNotNull()).distinct(), "keys")
        if further := list(dict.fromkeys(x.on for x in tables if x.parent == t.name)):
            hit[t.name] = materialize(victims_of(stored(spark, at, schema), keys, t.on).select(*further), "reached")
        if n:
            gone = erase(spark, at, schema, keys, t.on).select(F.col("file_no").cast("long"), "n_erased")
            told.append(report(spark, at, schema, t.name, t.amount).join(F.broadcast(gone), "file_no", "left"))
    if not told:
        return spark.createDataFrame([], "table_name string, file_no long, path string, columns string, n_rows long, n_erased long, cents long, ids_sha256 string, rewritten boolean")
    out = reduce(DataFrame.unionByName, told)
    return out.select("table_name", "file_no", "path", "columns", "n_rows", F.coalesce("n_erased", F.lit(0)).alias("n_erased"), "cents", "ids_sha256", F.col("n_erased").isNotNull().alias("rewritten"))


def most_clicked(clients: DataFrame, clicks: DataFrame) -> DataFrame:
    """The ``master_id`` whose clients together have most clicks; the smallest on a tie, even at 0; none without masters."""
    own = clients.where("master_id is not null").select("master_id", "client_id").distinct()
    seen = clicks.where("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    per = own.join(seen, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    best = F.max(F.struct("n", (-F.col("master_id")).alias("minus"), "master_id"))["master_id"]
    return per.agg(best.alias("master_id")).where("master_id is not null")


def shop_cascade(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, modulo: int = 400, files: int = FILES) -> DataFrame:
    """Erase the masters whose CRC-32 is divisible by ``modulo``, and the one with most clicks, from a shop's tables.

    All four tables are sorted by the CRC-32 of a client's id. A line has the client of its
    sale: of a repeated sale_id the smallest one, of none an empty string. Victims are the
    clients rows of these masters, the clicks and sales of these clients and the lines of
    these sales.
    """
    spark = clients.sparkSession
    keyed = lambda df: df.withColumn("sort_key", crc_of(F.col("client_id")))
    owner = sales.where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("_owner"))
    lines = sale_lines.join(owner.hint("merge"), "sale_id", "left").select(*sale_lines.columns, crc_of(F.col("_owner")).alias("sort_key"))
    by_rule = clients.where((crc_of(F.col("master_id")) % modulo == 0) & F.col("master_id").isNotNull()).select("master_id").distinct()
    masters = by_rule.unionByName(most_clicked(clients, clicks)).distinct()
    owned = materialize(lines, "lines")
    tables = [
        Table("clients", keyed(clients), "balance", "master_id", None),
        Table("clicks", keyed(clicks), "value", "client_id", "clients"),
        Table("sales", keyed(sales), "total", "client_id", "clients"),
        Table("sale_lines", owned, "amount", "sale_id", "sales"),
    ]
    out = cascade(spark, tables, masters, files)
    release(owned)
    return out
