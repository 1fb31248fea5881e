"""Shared plumbing of the corpus operators: scratch tables, column hygiene, exact distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests, a laptop) a temporary folder is
    made and set; on a cluster it would lie on the disk of one machine, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tamarack-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        root = _OWN[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/tamarack/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str = "rank", buckets: int = 1024) -> DataFrame:
    """Exact 0-based rank of each row in its group, without gathering a group in one task.

    The order is by a hash bucket of ``order`` and then by ``order`` itself, so a rank is
    reproducible. Rows are counted by (group, bucket); a running sum over these counts (at
    most groups x buckets rows) gives each bucket's first rank, and only the rows of one
    bucket are sorted together. ``order`` must identify a row within its group.
    """
    hashed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = hashed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    first = counts.select(
        *group,
        "_bucket",
        (F.sum("_rows").over(Window.partitionBy(*group).orderBy("_bucket")) - F.col("_rows")).alias("_first"),
    )
    inner = hashed.withColumn("_pos", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) - 1)
    joined = inner.join(first, [*group, "_bucket"])
    return joined.withColumn(out, F.col("_first") + F.col("_pos")).drop("_bucket", "_first", "_pos")


def slices(n: int, size: int) -> Iterator[tuple[int, int]]:
    for start in range(0, n, size):
        yield start, min(n, start + size)
