"""Sinks: tables, logs, LaTeX, archives, resume marks."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "run_id string, started string, ended string, stage string, dataset string, model string, status string, metric string, path string"
EVENT = "timestamp_iso string, run_id string, event_type string, start_time_iso string, end_time_iso string, detail map<string,string>"


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` is for small reports only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append to a JSON-lines event log."""
    events.write.mode("append").json(path)


def append_registry(spark: SparkSession, rows: Iterable[tuple], path: str) -> None:
    """Append to the run registry; every part has the header."""
    spark.createDataFrame(list(rows), REGISTRY).write.mode("append").csv(path, header=True)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether an earlier run finished writing here."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write unless already done, then read back: restart-safe stages."""
    spark = df.sparkSession
    if not is_done(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def latex_escape(c: F.Column) -> F.Column:
    c = F.regexp_replace(c, r"\\", r"\\textbackslash{}")
    c = F.regexp_replace(c, r"([&%$#_])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(c, "~", r"\\textasciitilde{}"), r"\^", r"\\textasciicircum{}")


def latex_rows(df: DataFrame) -> DataFrame:
    """One booktabs line per row: cells escaped and joined, numbers to three places, missing as --."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.coalesce(F.format_string("%.3f", c) if kinds[c] in ("double", "float") else latex_escape(F.col(c).cast("string")), F.lit("--"))
    shown = lambda c: F.when(F.col(c).isNull(), "--").otherwise(cell(c))
    return df.select(F.concat(F.concat_ws(" & ", *map(shown, df.columns)), F.lit(" \\\\")).alias("line"))


def latex_table(df: DataFrame, caption: str, label: str) -> str:
    """A whole booktabs table of a small report."""
    lines = [r["line"] for r in latex_rows(df).collect()]
    head = " & ".join(c.replace("_", "\\_") for c in df.columns) + " \\\\"
    body = "\n".join(lines)
    return f"\\begin{{table}}[t]\n\\centering\n\\caption{{{caption}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n\\toprule\n{head}\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}\n"


def zip_files(paths: Iterable[str], root: str, target: str) -> list[str]:
    """Zip local report files once each, named relative to ``root``; missing files are left out."""
    seen: dict[Path, str] = {}
    for p in paths:
        full = Path(p).resolve()
        if full.is_file() and full not in seen:
            seen[full] = str(full.relative_to(Path(root).resolve())) if full.is_relative_to(Path(root).resolve()) else full.name
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for full, name in seen.items():
            z.write(full, name)
    return list(seen.values())


def metrics_json(df: DataFrame, key: str) -> str:
    """A small metric table as one JSON object by ``key``."""
    return json.dumps({r[key]: {c: r[c] for c in df.columns if c != key} for r in df.collect()}, indent=2, sort_keys=True)


def methods_markdown(values: dict[str, object]) -> str:
    """The methods paragraph of a report from its settings."""
    return "## Methods\n\n" + "\n".join(f"- **{k}**: {v}" for k, v in values.items()) + "\n"


def export(df: DataFrame, kind: str, path: str, caption: str = "", label: str = "") -> None:
    """A small report as ``csv`` or ``tex``; other kinds raise."""
    if kind == "csv":
        write_csv(df, path, single=True)
    elif kind == "tex":
        text = df.sparkSession.createDataFrame([(latex_table(df, caption, label),)], "value string")
        text.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    else:
        raise ValueError(f"no export as {kind!r}; there are csv and tex")


def in_parts(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str, parts: int = 16) -> DataFrame:
    """Slow work on a table, part by part: a restart goes on after the parts that were written.

    Rows are dealt to ``parts`` files in one scan, and each is a batch of a stream; ``work``
    must treat rows independently.
    """
    from ..streaming.resumable import scored

    return scored(df, work, path, key, parts)
