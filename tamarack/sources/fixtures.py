"""Made-up result tables for demonstrations, the same on every machine.

Numbers are hashes of the seed and the row's names, stretched to a likely range; they say
nothing about any detector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ("HG_ALPHA_seed1", "HG_BETA_seed1", "regex_rules", "tfidf_logreg")
TRANSFORMS = ("none", "casing", "homoglyph", "whitespace")
ABLATIONS = ("full_model", "no_rules", "no_embedding", "no_features")
LANGUAGES = ("en", "de", "es", "fr")


def _made_up(low: float, high: float, seed: int, name: str, *keys: str) -> Column:
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(10_000)) / 10_000
    return F.round(low + u * (high - low), 4).alias(name)


def tables(spark: SparkSession, seed: int = 1337) -> dict[str, DataFrame]:
    """Eight tables by name: what a dashboard shows where no run is found."""
    one = lambda values, c: spark.createDataFrame([(v,) for v in values], f"{c} string")
    models = one(MODELS, "model")
    by = lambda values, c: models.select("*", F.explode(F.array(*map(F.lit, values))).alias(c))
    v = lambda low, high, name, *keys: _made_up(low, high, seed, name, "model", *keys)
    return {
        "main_results": models.select("model", v(0.8, 0.99, "auroc"), v(0.7, 0.98, "auprc"), v(0.2, 0.9, "recall_at_1pctfpr"), v(0.5, 0.99, "threshold_1pctfpr")),
        "robustness": by(TRANSFORMS, "transform").select("model", "transform", v(0.6, 0.99, "auroc", "transform"), v(0.5, 0.98, "auprc", "transform")),
        "ablation": by(ABLATIONS, "ablation").where("model like 'HG%'").select("model", "ablation", v(0.7, 0.99, "auroc", "ablation")),
        "calibration": models.select("model", v(0.01, 0.2, "ece"), v(0.02, 0.2, "brier")),
        "fairness": by(LANGUAGES, "lang").select("model", "lang", v(0.3, 0.95, "recall", "lang")),
        "overdefense": models.select("model", v(0.0, 0.3, "overdef_fpr")),
        "latency": models.select("model", v(0.5, 30.0, "latency_ms")),
        "curves": by(("0.0", "0.01", "0.1", "0.5", "1.0"), "fpr").select("model", F.col("fpr").cast("double").alias("fpr"), F.pow(F.col("fpr").cast("double"), v(0.05, 0.6, "bend")).alias("tpr")),
    }
