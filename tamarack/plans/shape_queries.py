"""Queries over table shapes: products, back-filled columns, ordered look-ups, tags, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import curves, reports
from .base import _TRANSFORMS_SQL, PREDS, TRANSFORMS, preds, query, table

_PURPOSE = "CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 'Main training set' WHEN 1 THEN 'Jailbreak probes' WHEN 2 THEN 'NotInject benign' ELSE 'held out' END"
_SLUG = "CASE CAST(doc_id % 3 AS INTEGER) WHEN 0 THEN 'no_rules' WHEN 1 THEN 'only_rules' ELSE 'full_model' END"


@query("SELECT doc_id, CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 'train' WHEN 1 THEN 'jailbreak' WHEN 2 THEN 'overdefense' ELSE 'eval' END AS kind, CASE CAST(doc_id % 3 AS INTEGER) WHEN 0 THEN 'Without Rules' WHEN 1 THEN 'Only Rules' ELSE 'Full Model' END AS label FROM documents")
def purpose_and_label(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", coerce.purpose_type(F.expr(_PURPOSE)).alias("kind"), coerce.ablation_label(F.expr(_SLUG)).alias("label"))


@query(f"WITH {PREDS}, {_TRANSFORMS_SQL}, n AS (SELECT model, lang, count(*) AS rows_to_score FROM preds GROUP BY 1, 2) SELECT model, lang, transform, rows_to_score FROM n CROSS JOIN transforms")
def config_product(spark: SparkSession, d: str) -> DataFrame:
    """Every detector and language of the predictions under every condition, with the rows to score."""
    found = preds(spark, d).groupBy("model", "lang").agg(F.count(F.lit(1)).alias("rows_to_score"))
    return found.select("model", "lang", F.explode(F.array(*(F.lit(t) for t, _ in TRANSFORMS))).alias("transform"), "rows_to_score")


@query(f"WITH {PREDS} SELECT model, row_id, CASE WHEN row_id % 3 = 0 THEN -1.0 ELSE CAST(row_id AS DOUBLE) END AS filled, CAST(NULL AS DOUBLE) AS latency FROM preds")
def backfill_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Text to numbers with a default, and a column that the table lacks."""
    raw = preds(spark, d).select("model", "row_id", F.when(F.col("row_id") % 3 == 0, "n/a").otherwise(F.col("row_id").cast("string")).alias("v"))
    rows = raw.select("model", "row_id", F.coalesce(F.col("v").try_cast("double"), F.lit(-1.0)).alias("filled"))
    return reports.backfill(rows, ["filled", "latency"])


@query(f"WITH {PREDS}, o(model, place) AS (VALUES ('regex_rules', 1), ('HG_BETA_seed1', 2)) SELECT model, round(avg(p), 6) AS mean_p, CAST(coalesce(max(place), 1000000000) AS INTEGER) AS place FROM preds LEFT JOIN o USING (model) GROUP BY model")
def order_by_list(spark: SparkSession, d: str) -> DataFrame:
    """The models of the predictions, ranked by a given list; names not on it come last."""
    means = preds(spark, d).groupBy("model").agg(F.round(F.avg("p"), 6).alias("mean_p"))
    order = F.broadcast(spark.createDataFrame([("regex_rules", 1), ("HG_BETA_seed1", 2)], "model string, place int"))  # two rows
    return means.join(order, "model", "left").select("model", "mean_p", F.coalesce("place", F.lit(1_000_000_000)).alias("place"))


@query(f"WITH {PREDS} SELECT model, round(max(CASE WHEN lang = 'en' THEN m END), 6) AS en, round(max(CASE WHEN lang = 'fr' THEN m END), 6) AS fr, round(max(CASE WHEN lang = 'de' THEN m END), 6) AS de FROM (SELECT model, lang, avg(p) AS m FROM preds GROUP BY 1, 2) GROUP BY model")
def pivot_condition(spark: SparkSession, d: str) -> DataFrame:
    out = preds(spark, d).groupBy("model").pivot("lang", ["en", "fr", "de"]).agg(F.avg("p"))
    return out.select("model", *(F.round(c, 6).alias(c) for c in ("en", "fr", "de")))


@query(
    f"WITH {PREDS}, t AS (SELECT model, lang, p, sum(y) AS pos, sum(1 - y) AS neg FROM preds GROUP BY 1, 2, 3), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS n_pos, sum(neg) OVER g AS n_neg FROM t WINDOW w AS (PARTITION BY model, lang ORDER BY p DESC), g AS (PARTITION BY model, lang)) "
    "SELECT model, lang, round(CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN coalesce(max(CASE WHEN fp / CAST(n_neg AS DOUBLE) <= 0.01 THEN tp / CAST(n_pos AS DOUBLE) END), 0.0) END, 6) AS recall, CAST(max(n_pos) AS BIGINT) AS n_pos FROM c GROUP BY 1, 2"
)
def recall_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Recall at one false alarm in a hundred, within each language."""
    t = curves.score_table(preds(spark, d), ["model", "lang"]).groupBy("model", "lang")
    return t.agg(F.round(curves.recall_at_fpr_roc(), 6).alias("recall"), F.max("n_pos").alias("n_pos"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, CAST(max(epoch_us(ts)) - min(epoch_us(ts)) AS BIGINT) AS span_us FROM events GROUP BY event_type")
def event_summary(spark: SparkSession, d: str) -> DataFrame:
    """The event log by type: counts, mean values and spans."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), (F.max(micros) - F.min(micros)).alias("span_us"))
