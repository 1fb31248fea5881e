"""Finding run folders and the newest readable file of every table, each on its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Found(NamedTuple):
    """A table, whether it is live, and the file it was read from."""

    table: DataFrame
    live: bool
    file: str | None


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``run, table, file, changed``: files ``<root>/run_*/<glob>``, their run folders, names without ending and times of change.

    ``glob`` is a path pattern below a run, as ``tables/*.csv``. No file is opened.
    """
    df = spark.read.format("binaryFile").load(f"{root}/run_*/{glob}").select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"))
    run = F.regexp_extract("file", r"/(run_[^/]*)/", 1)
    return df.select(run.alias("run"), F.regexp_extract("file", r"/([^/]+?)(\.[^./]*)?$", 1).alias("table"), "file", "changed")


def newest_first(found: DataFrame) -> list[tuple[str, str]]:
    """(run, file) from the newest to the oldest run; a run is as old as its newest file, ties by name."""
    per = found.groupBy("run").agg(F.max("changed").alias("_run_changed"))
    ordered = found.join(per, "run").orderBy(F.desc("_run_changed"), F.desc("run"), F.desc("changed"), F.desc("file"))
    return [(r.run, r.file) for r in ordered.select("run", "file").collect()]  # one table's files


def metrics_file(spark: SparkSession, root: str, run: str, preferred: str = "in_domain", name: str = "metrics_main.csv") -> str | None:
    """The metrics of a run: of the preferred dataset, else the newest of any dataset, else none."""
    try:
        found = files(spark, root, f"evaluation/*/{name}").where(F.col("run") == run).collect()
    except PySparkException:  # no such file
        return None
    own = [r for r in found if r.file.split("/")[-2] == preferred]
    return max(own or found, key=lambda r: (r.changed, r.file)).file if found else None


def csv_reader(spark: SparkSession, path: str) -> DataFrame:
    """A CSV report with a header; an empty or headless file is an error."""
    df = spark.read.option("header", "true").option("inferSchema", "true").option("mode", "FAILFAST").csv(path)
    if not df.columns:
        raise ValueError(f"no header in {path}")
    df.write.format("noop").mode("overwrite").save()  # every cell is read, so damage shows here
    return df


def json_reader(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of any number of lines; fields missing in one are null."""
    return spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)


def load_tables(spark: SparkSession, root: str, tables: Iterable[str], fallback: Callable[[str], DataFrame], read: Callable[[SparkSession, str], DataFrame] = csv_reader, glob: str = "tables/*.csv") -> dict[str, Found]:
    """For each table the file of the newest run that can be read, else the fallback; one damaged file costs no other table."""
    try:
        found = files(spark, root, glob)
        found.limit(1).collect()
    except PySparkException:  # no run at all
        found = None
    out = {}
    for name in tables:
        out[name] = Found(fallback(name), False, None)
        for _, file in newest_first(found.where(F.col("table") == name)) if found is not None else ():
            try:
                out[name] = Found(read(spark, file), True, file)
                break
            except (PySparkException, Py4JJavaError, ValueError):
                continue
    return out


def merged_json(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """JSON documents of all runs by a path pattern, with merged schemas, their run and their time of change."""
    df = json_reader(spark, f"{root}/run_*/{glob}")
    return df.select("*", F.regexp_extract("_metadata.file_path", r"/(run_[^/]*)/", 1).alias("_run"), F.col("_metadata.file_modification_time").alias("_changed"))
