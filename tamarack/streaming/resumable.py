"""Slow scoring as a stream of files: a killed run goes on where it stopped, and no row is scored twice.

The input is dealt once to files of about equal row counts. A stream takes some of them at a
time; each micro-batch is written to a folder of its own number, over what an interrupted
attempt may have left there, and only then does the stream's checkpoint pass it. The number of a
batch and the files in it are fixed in the checkpoint before it runs, so a repeated batch holds
the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import is_done


def deal(df: DataFrame, key: str, path: str, parts: int) -> None:
    """Write the input as ``parts`` files by a hash of ``key``, once: one scan whatever the number of parts."""
    if not is_done(df.sparkSession, path):
        df.repartition(parts, F.xxhash64(key)).write.mode("overwrite").parquet(path)


def run(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], path: str, files: int = 1) -> int:
    """Work on all files of ``source`` that are not yet done, ``files`` at a time; the number of batches of this run.

    ``work`` must treat rows independently. Results are under ``path/out``, batch by batch, and
    marks of what is done under ``path/marks``. Files that come later are taken by the next run.
    """
    done = []

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        done.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def results(spark: SparkSession, path: str) -> DataFrame:
    """All rows scored so far, with the number of their batch."""
    return spark.read.parquet(f"{path}/out")


def scored(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str, parts: int = 16, files: int = 1) -> DataFrame:
    """Deal ``df``, work on what is not done, and return all results without the batch number.

    A restart with the same ``path`` reads the dealt files again, not ``df``. An empty table gives
    an empty result.
    """
    spark = df.sparkSession
    deal(df, key, f"{path}/in", parts)
    run(spark, f"{path}/in", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), work, path, files)
    return results(spark, path).drop("batch")
