"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

The index is a set of runs. A run holds the 128-bit hash of lines and the smallest
document that has each; no hash is in two runs. It is a table of sorted buckets, as many as
the session has shuffle partitions, so a join reads it in order without moving or sorting
it. Batches come in ascending order of ``doc_id``; there are more of them as lines grow, by
the logarithm. A batch reduces its lines to one row per hash (a partial aggregate, so a
line that fills a third of the corpus stays one row per task), which are shuffled and
sorted once and merge-joined to each run in turn; hashes that no run has become a new run
of level 0. When a level has ``fanout`` runs they are compacted, bucket by bucket, into one
run of the next level, so after n batches there are O(fanout * log n) runs.
"""

from __future__ import annotations

import math
import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, release, settings

MIN_CHARS = 10
BLANKS = " \t\n\x0b\x0c\r"
_IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lower-cased (other letters stay)."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.lower(bare)
    return F.when(F.octet_length(bare) == F.char_length(bare), plain).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


class LineRuns:
    """The levelled index. Its tables lie in the session's shared checkpoint folder and have
    a catalogue entry (which is where Spark keeps buckets) until ``close``."""

    def __init__(self, spark: SparkSession, fanout: int = 2) -> None:
        self.spark = spark
        self.fanout = fanout
        initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        self.buckets = int(initial or spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame, *split: str) -> str:
        name = f"tamarack_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, name)
        writer = rows.write.format("parquet").option("path", self.paths[name]).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        (writer.partitionBy(*split) if split else writer).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        table = self.spark.table(name)
        release(table)
        self.spark.sql(f"DROP TABLE {name}")
        del self.paths[name]

    def _fresh(self, name: str) -> DataFrame:
        """The rows of a run: what its batch had anew."""
        return self.spark.table(name).where("fresh").select("h1", "h2", "owner")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def ingest(self, keyed: DataFrame) -> DataFrame:
        """Add a batch of ``h1, h2, doc_id, pos`` rows; returns its dropped ``doc_id, pos``.

        Every document of the batch must come after all earlier ones by ``doc_id``. Levels
        that are full are compacted first.
        """
        self._compact()
        # one file in a bucket is read in its order
        with settings(self.spark, {_IN_ORDER: "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
            keys = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
            owner = F.lit(None).cast("long")
            for i, run in enumerate(self.runs()):
                known = self._fresh(run).withColumnRenamed("owner", f"_owner{i}")
                keys = keys.join(known.hint("merge"), ["h1", "h2"], "left")
                owner = F.coalesce(owner, F.col(f"_owner{i}"))
            keys = keys.select("h1", "h2", "first", "last", owner.alias("known"))
            run = self._write(keys.select("h1", "h2", F.coalesce("known", "first").alias("owner"), (F.col("first") < F.col("last")).alias("many"), F.col("known").isNull().alias("fresh")), "fresh")
        self.levels[0].append(run)
        # read as plain files: lines of a hot key must be split over tasks, not follow the buckets
        plain = self.spark.read.schema(self.spark.table(run).schema).parquet(self.paths[run])
        repeated = plain.where("not fresh or many").select("h1", "h2", "owner")
        out = materialize(keyed.join(repeated, ["h1", "h2"]).where("doc_id <> owner").select("doc_id", "pos"), "dropped")
        return out

    def _merge(self, one: str, two: str) -> str:
        """One run of two, bucket by bucket; both are dropped."""
        with settings(self.spark, {_IN_ORDER: "true"}):
            left, right = self._fresh(one).withColumnRenamed("owner", "_one"), self._fresh(two).withColumnRenamed("owner", "_two")
            rows = left.join(right.hint("merge"), ["h1", "h2"], "full")
            out = self._write(rows.select("h1", "h2", F.coalesce("_one", "_two").alias("owner"), F.lit(True).alias("fresh")), "fresh")
        for run in (one, two):
            self._drop(run)
        return out

    def _compact(self) -> None:
        for at in range(len(self.levels)):
            if len(self.levels[at]) >= self.fanout:
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(reduce(self._merge, self.levels[at]))
                self.levels[at] = []

    def close(self) -> None:
        for run in self.runs():
            self._drop(run)
        self.levels = [[]]


def batches_for(documents: int) -> int:
    """Four batches up to a million documents, and one more for each doubling."""
    return 4 + max(0, math.ceil(math.log2(max(1, documents) / 1e6)))


def dedup_lines(docs: DataFrame, batches: int | None = None, fanout: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop repeated lines: ``doc_id, n_lines, n_dropped, kept_text`` per document.

    A line whose key has at least 10 code points and occurs in at least two documents is
    dropped from all but the smallest ``doc_id`` that has it (which keeps every copy).
    Other lines stay in place, joined by newlines. A null or empty text is one empty line;
    a text may lose all its lines and become empty. Columns named in ``carry`` are passed
    on, others are ignored whatever their names; an empty table gives an empty result.
    ``doc_id`` must be unique.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    wide = docs.select("doc_id", "text", *carry)
    batches = batches or batches_for(docs.count())
    cuts = texts.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = reduce(lambda a, c: a + F.when(F.col("doc_id") > c, 1).otherwise(0), cuts, F.lit(0))
    key = F.col("key")
    keyed = (
        texts.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .where(F.char_length("line") >= MIN_CHARS)
        .select("doc_id", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length(key) >= MIN_CHARS)
        .select("doc_id", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), batch.alias("batch"))
    )
    path = new_path(spark, "lines")
    keyed.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(keyed.schema).parquet(path)
    index = LineRuns(spark, fanout)
    try:
        dropped = [index.ingest(stored.where(F.col("batch") == i).drop("batch")) for i in range(len(cuts) + 1)]
    finally:
        index.close()
    gone = reduce(DataFrame.unionByName, dropped).groupBy("doc_id").agg(F.collect_list("pos").alias("gone"))
    none = F.array().cast("array<int>")
    joined = wide.join(gone.withColumnRenamed("gone", "_gone"), "doc_id", "left").select(
        "doc_id", split_lines(F.col("text")).alias("_lines"), F.coalesce("_gone", none).alias("_gone"), *carry
    )
    # array_except hashes its second argument, so a text of many lines costs its length
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.size("_gone") == 0, F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i + 1)), "\n")
    )
    n_lines, n_dropped = (F.size(c).cast("long") for c in ("_lines", "_gone"))
    return joined.select("doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), text.alias("kept_text"), *carry)
