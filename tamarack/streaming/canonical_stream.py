"""Canonicalisation and rule scores over streams (beyond the reference, which has none).

All text functions are stateless row functions, so they run on a stream as written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, features


def score_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """Add the canonical text, its rule score and probability to a streaming table."""
    out = canonical.canonicalize(stream, text)
    low = F.col("canonical_result.lowercase")
    return out.withColumn("rule_score", features.rule_score(low)).withColumn("prob", features.regex_heuristic_score(low))


def flagged_by_window(events: DataFrame, ts: str = "ts", width: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Events per window and type, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def read_conversations(spark: SparkSession, path: str, schema: str = "conv_id long, turn long, role string, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
