"""Small document tables with nulls, empty and long texts, repeats and clashing column names."""

import pandas as pd

EXTRA = ("key", "rep", "members", "rank", "bucket", "length", "lines", "gone", "tokens")


def table(spark, texts, ids=None, **more):
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("extra"))
    return df


def rows(df, key="doc_id"):
    pdf = df.toPandas()
    return pdf.sort_values([c for c in ([key] if isinstance(key, str) else key)]).reset_index(drop=True)


def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")
