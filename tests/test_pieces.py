"""Arrow functions go through a batch in pieces."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tamarack.functions import canonical, features, pieces
from tamarack.operators import integrity


def test_pieces_are_small(spark):
    rows = spark.range(0, 1000, 1, 1)
    size = pieces.in_pieces(lambda values: pa.array([len(values)] * len(values)), LongType())
    got = rows.select("id", size(F.col("id")).alias("n")).orderBy("id").collect()
    assert [r.n for r in got] == [256] * 768 + [232] * 232


def test_text_functions_work_in_pieces(spark, monkeypatch):
    """None of them makes Python objects of more than a few hundred texts at once."""
    assert max(len(canonical._unwrapped(["a", None])), len(integrity._majority([["a"], []]))) == 2
    docs = spark.range(0, 600, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("Ab "), (F.col("id") % 5).cast("int"))).alias("text"))
    t = F.col("text")
    out = docs.select("id", "text", canonical.unwrap(t).alias("u"), features.engineered_features(t)["n_chars"].alias("n")).orderBy("id").collect()
    assert all(r.u.canonical == r.text and r.n == len((r.text or "").strip()) for r in out)
