"""Corpus sources: readers, schema normalisation, dataset registry, run discovery."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, fixed


@dataclass
class DatasetSpec:
    """Where a dataset is and how it counts."""

    key: str
    path: str
    format: str = "parquet"
    role: str = "in_domain"
    label: int | None = None
    options: dict[str, str] = field(default_factory=dict)


def read_any(spark: SparkSession, spec: DatasetSpec, schema: str | None = None) -> DataFrame:
    """Read parquet, json, csv, orc or text (one row per file) by any path Spark can open."""
    if spec.format == "text":
        return spark.read.text(spec.path, wholetext=True).withColumnRenamed("value", "text")
    reader = spark.read.format(spec.format).options(**({"header": "true"} if spec.format == "csv" else {}) | spec.options)
    return (reader.schema(schema) if schema else reader).load(spec.path)


def load_registry(spark: SparkSession, specs: Iterable[DatasetSpec], order: str | None = None, cap: int | None = None) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """All readable datasets as one corpus table with a ``dataset`` column, and the skipped ones with their errors."""
    out, skipped = None, []
    for spec in specs:
        try:
            df = read_any(spark, spec)
            if cap is not None and order:
                df = head_cap(df, order, cap)
            rows = normalize(df, spec.key, ordinal=order, default_label=spec.label or 0).withColumn("dataset", F.lit(spec.key)).withColumn("role", F.lit(spec.role))
        except (AnalysisException, ValueError) as e:
            skipped.append((spec.key, str(e).split("\n")[0]))
            continue
        out = rows if out is None else out.unionByName(rows)
    return out, skipped


def first_readable(spark: SparkSession, paths: Iterable[str]) -> DataFrame | None:
    """The first of several paths (test, train, validation) that can be read."""
    for p in paths:
        try:
            return spark.read.parquet(p)
        except AnalysisException:
            continue
    return None


def head_cap(df: DataFrame, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows by ``order`` (a top-k, no full sort)."""
    return df.orderBy(order).limit(cap)


def text_column(df: DataFrame) -> str:
    """The first known text column, else the first string column."""
    names = [c for c in fixed.TEXT_COLUMNS if c in df.columns]
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not (names or strings):
        raise ValueError("no text column")
    return (names or strings)[0]


def label_column(df: DataFrame) -> str | None:
    return next((c for c in fixed.LABEL_COLUMNS if c in df.columns), None)


def normalize(df: DataFrame, name: str, ordinal: str | None = None, default_label: int = 0) -> DataFrame:
    """Rows as ``id, text, label, meta``: id is ``<name>:<ordinal>``, meta all other columns as strings.

    Columns are chosen once from the schema, so every row is read alike (a row whose chosen
    column is blank falls back to the other text columns). Without an ``ordinal`` column a
    unique, not consecutive, number is used. Labels outside 0 and 1 become the default.
    """
    text, label = text_column(df), label_column(df)
    candidates = [text, *(c for c in fixed.TEXT_COLUMNS if c in df.columns and c != text)]
    number = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    value = F.col(label) if label else F.lit(None)
    if label and df.schema[label].dataType.simpleString() in ("double", "float"):
        value = F.when(~F.isnan(value), value.cast("long"))
    if label and df.schema[label].dataType.simpleString() == "boolean":
        value = value.cast("int")
    rest = [c for c in df.columns if c not in (text, label, ordinal)]
    meta = F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))) if rest else F.create_map().cast("map<string,string>")
    return df.select(
        F.concat(F.lit(f"{name}:"), number.cast("string")).alias("id"),
        F.coalesce(coerce.first_text([F.col(c) for c in candidates]), F.lit("")).alias("text"),
        coerce.label_or_default(coerce.coerce_label(value), default_label).alias("label"),
        meta.alias("meta"),
    )


def texts_only(df: DataFrame, cap: int | None = None, order: str | None = None) -> DataFrame:
    """Text of every row; a row without any text column is written out as JSON."""
    if cap is not None and order:
        df = head_cap(df, order, cap)
    names = [c for c in fixed.TEXT_COLUMNS if c in df.columns]
    names += [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in names]
    whole = F.to_json(F.struct(*df.columns))
    return df.select((F.coalesce(coerce.first_text([F.col(c) for c in names]), whole) if names else whole).alias("text"))


def union_labeled(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)), allowMissingColumns=True)


def latest_run(spark: SparkSession, root: str) -> str | None:
    """The newest ``run_*`` folder below ``root``, by modification time, then name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/run_*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    runs = [(s.getModificationTime(), s.getPath().toString()) for s in found or [] if s.isDirectory()]
    return max(runs)[1] if runs else None


def with_fallback(read: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """A table and whether it is live; the fallback where it cannot be read."""
    try:
        return read(), True
    except AnalysisException:
        return fallback(), False
