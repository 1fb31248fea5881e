"""``python -m tamarack.cli``: canonicalise one text from an argument, a file or standard input."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__
from .functions.canonical import canonicalize


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamarack", description="Canonicalise hostile text.")
    p.add_argument("text", nargs="?", help="the text; without it and --file, standard input is read")
    p.add_argument("--file", help="read the text from a UTF-8 file")
    p.add_argument("--json", action="store_true", help="print all fields as JSON")
    p.add_argument("--trace", action="store_true", help="print the steps that changed the text to standard error")
    p.add_argument("--version", action="version", version=f"tamarack {__version__}")
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    text = Path(args.file).read_text(encoding="utf-8") if args.file else args.text if args.text is not None else sys.stdin.read()
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    row = canonicalize(spark.createDataFrame([(text,)], "text string")).first()["canonical_result"].asDict(True)
    if args.trace:
        print("\n".join(row["trace"]), file=sys.stderr)
    print(json.dumps(row, ensure_ascii=False) if args.json else row["canonical"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
