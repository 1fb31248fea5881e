"""Report tables with fixed columns, the naming decision and the nested metrics document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import perturb
from ..operators import curves, reports, resampling
from ..operators.scratch import kept
from . import metric_queries as own
from .base import AP_SQL, AUROC_SQL, PREDS, R6, documents, preds, query, robust_preds
from .registry import ORACLE_SQL

_NO = "CAST(NULL AS DOUBLE) AS"
_END = "CAST(NULL AS VARCHAR) AS note"


@query(
    f"{own._RESULTS}, {own._ROBUST_ROWS}, "
    f"ra AS (SELECT model, transform, {AUROC_SQL} AS auroc, {AP_SQL} AS auprc, coalesce(max(CASE WHEN CAST(fp AS DOUBLE) / n_neg <= 0.01 THEN CAST(tp AS DOUBLE) / n_pos END), 0.0) AS low FROM rc GROUP BY 1, 2), "
    "rr AS (SELECT model, transform, count(*) AS n, sum(CASE WHEN y = 1 AND p >= threshold THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p >= threshold THEN 1 ELSE 0 END) AS fp, sum(y) AS pos FROM robust JOIN (SELECT model, threshold FROM results) USING (model) GROUP BY 1, 2) "
    "SELECT model, transform, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(CASE WHEN tp + fp + pos > 0 THEN 2.0 * tp / (tp + fp + pos) ELSE 0.0 END, 6) AS f1, round(CASE WHEN pos > 0 THEN CAST(tp AS DOUBLE) / pos ELSE 0.0 END, 6) AS recall, "
    f"round(low, 6) AS recall_at_1pctfpr, {_NO} latency_s_per_sample, CAST(n AS DOUBLE) AS n, {_END} FROM ra JOIN rr USING (model, transform)"
)
def robustness_table(spark: SparkSession, d: str) -> DataFrame:
    """Every model under every transform, at the threshold that the validation rows gave it."""
    by = ["model", "transform"]
    scores = kept(curves.score_counts(robust_preds(spark, d), by), "scores")  # a row for each distinct score: all cells are read off these
    tuned = kept(curves.tuned_threshold(preds(spark, d), ["model"], rule="roc"), "thresholds")
    hit = F.col("p") >= F.col("threshold")
    over = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(f"_{c}")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    cells = curves.cumulated(scores, by).join(tuned, "model").groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), curves.auroc().alias("auroc"), curves.average_precision().alias("auprc"), curves.recall_at_fpr_roc(0.01).alias("recall_at_1pctfpr"),
        over("pos"), over("neg"), F.max("n_pos").alias("_all"),
    )
    tp, fp, pos = F.col("_pos"), F.col("_neg"), F.col("_all")
    cells = cells.withColumn("f1", ratio(2 * tp, tp + fp + pos)).withColumn("recall", ratio(tp, pos))
    return reports.report_table(cells.select(*by, "n", *(R6(F.col(c)).alias(c) for c in ("auroc", "auprc", "f1", "recall", "recall_at_1pctfpr"))), "robustness")


@query(f"SELECT model, overdef_fpr AS overdef_fpr_at_thr, CAST(n AS DOUBLE) AS n, {_NO} latency_s_per_sample, {_NO} throughput_samples_per_s, {_END} FROM ({ORACLE_SQL['overdefense_fpr']})")
def overdefense_table(spark: SparkSession, d: str) -> DataFrame:
    return reports.report_table(own.overdefense_fpr(spark, d).withColumnRenamed("overdef_fpr", "overdef_fpr_at_thr"), "overdefense")


@query(
    f"SELECT model, tpr AS recall_at_in_domain_thr, fpr AS fpr_at_in_domain_thr, auroc, auprc, CAST(n_harmful + n_benign AS DOUBLE) AS n, {_NO} latency_s_per_sample, {_NO} throughput_samples_per_s, {_END} FROM ({ORACLE_SQL['jailbreak_rates']})"
)
def jailbreak_table(spark: SparkSession, d: str) -> DataFrame:
    rates = own.jailbreak_rates(spark, d).withColumnsRenamed({"tpr": "recall_at_in_domain_thr", "fpr": "fpr_at_in_domain_thr"})
    return reports.report_table(rates.withColumn("n", F.col("n_harmful") + F.col("n_benign")), "jailbreak")


@query(
    "SELECT model, a.worst AS worst_lang, a.worst_recall AS worst_lang_recall, a.gap AS lang_recall_gap, b.worst AS worst_len, b.worst_recall AS worst_len_recall, b.gap AS len_recall_gap, "
    f"{_END} FROM ({ORACLE_SQL['fairness_gap']}) a JOIN ({ORACLE_SQL['fairness_length_gap']}) b USING (model)"
)
def fairness_table(spark: SparkSession, d: str) -> DataFrame:
    side = lambda df, k: df.select("model", F.col("worst").alias(f"worst_{k}"), F.col("worst_recall").alias(f"worst_{k}_recall"), F.col("gap").alias(f"{k}_recall_gap"))
    return reports.report_table(side(own.fairness_gap(spark, d), "lang").join(side(own.fairness_length_gap(spark, d), "len"), "model"), "fairness")


@query(
    f"WITH {PREDS}, {own._VERSUS}, x AS (SELECT arg_max(model, (auroc, model)) FILTER (WHERE starts_with(model, 'HG_')) AS chosen, arg_max(model, (auroc, model)) FILTER (WHERE NOT starts_with(model, 'HG_')) AS baseline, "
    "max(auroc) FILTER (WHERE starts_with(model, 'HG_')) AS chosen_auroc, max(auroc) FILTER (WHERE NOT starts_with(model, 'HG_')) AS baseline_auroc FROM a), "
    "f AS (SELECT CASE WHEN j.model = x.chosen THEN 'baseline is reference' ELSE 'chosen is reference' END AS basis, b01 + b10 > 0 AND power(abs(b01 - b10) - 1, 2) / CAST(greatest(1, b01 + b10) AS DOUBLE) > 3.841459 AS differs FROM j, x WHERE (j.model = x.chosen AND j.reference = x.baseline) OR (j.model = x.baseline AND j.reference = x.chosen)) "
    "SELECT chosen, baseline, round(chosen_auroc, 6) AS chosen_auroc, round(baseline_auroc, 6) AS baseline_auroc, coalesce((SELECT basis FROM f), 'no test') AS basis, coalesce((SELECT differs FROM f), false) AND chosen_auroc > baseline_auroc AS beats_baseline FROM x"
)
def naming(spark: SparkSession, d: str) -> DataFrame:
    """Whether the best own model may be called better than the best other one, by the paired tests at hand."""
    tests = own._against_best(preds(spark, d)).select("model", "reference", resampling.chi2_p_value(F.col("chi2")).alias("p_value"))
    got = reports.naming(own._results(spark, d).select("model", "auroc"), tests, F.col("model").startswith("HG_"))
    return got.select("chosen", "baseline", R6(F.col("chosen_auroc")).alias("chosen_auroc"), R6(F.col("baseline_auroc")).alias("baseline_auroc"), "basis", "beats_baseline")


@query()
def metrics_document(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document of the report tables and the naming decision."""
    frames = {"main_results": own.results_table(spark, d), "fairness": fairness_table(spark, d), "overdefense": overdefense_table(spark, d)}
    return reports.metrics_document(frames, naming(spark, d), {"tuned_on": "val", "target_fpr": 0.01})


@query()
def perturb_swapcase_unicode(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", perturb.casing_unicode(F.col("text")).alias("perturbed"))
