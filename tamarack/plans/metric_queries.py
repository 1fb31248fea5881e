"""Queries over predictions: curves, calibration, tests, fairness, rankings, reshaping."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import coerce, features, perturb
from ..operators import calibration, curves, integrity, reports, resampling, vectors
from ..operators.scratch import kept
from .base import _TRANSFORMS_SQL, AP_SQL, AUROC_SQL, PREDS, R6, ROBUST, curve_sql, documents, lit, preds, prompts, query, robust_preds, table

_CURVE = f"WITH {PREDS}, {curve_sql('model')}"


# --- curves -----------------------------------------------------------------------
@query(f"{_CURVE} SELECT model, round({AUROC_SQL}, 6) AS auroc FROM c GROUP BY model")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return curves.score_table(preds(spark, d), ["model"]).groupBy("model").agg(R6(curves.auroc()).alias("auroc"))


@query(f"{_CURVE} SELECT model, round({AP_SQL}, 6) AS auprc FROM c GROUP BY model")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return curves.score_table(preds(spark, d), ["model"]).groupBy("model").agg(R6(curves.average_precision()).alias("auprc"))


@query(f"{_CURVE}, r AS (SELECT model, p, CAST(tp AS DOUBLE) / n_pos AS tpr, CAST(tp AS DOUBLE) / (tp + fp) AS pr FROM c), l AS (SELECT *, lag(tpr, 1, 0.0) OVER w AS t0, lag(pr, 1, 1.0) OVER w AS p0 FROM r WINDOW w AS (PARTITION BY model ORDER BY p DESC)) SELECT model, round(sum((tpr - t0) * (pr + p0) / 2), 6) AS pr_area FROM l GROUP BY model")
def trapezoid_pr_area(spark: SparkSession, d: str) -> DataFrame:
    return curves.trapezoid_pr_area(preds(spark, d), ["model"]).select("model", R6(F.col("pr_area")).alias("pr_area"))


_CELLS = "CAST(sum(CASE WHEN y = 1 AND p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN y = 0 AND p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN y = 0 AND p < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN y = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn"


@query(f"WITH {PREDS} SELECT model, {_CELLS} FROM preds GROUP BY model")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return curves.confusion(preds(spark, d), ["model"])


_PRF = "round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"


@query(f"WITH {PREDS}, x AS (SELECT model, {_CELLS} FROM preds GROUP BY model) SELECT model, {_PRF} FROM x")
def prf_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    return curves.prf(preds(spark, d), ["model"]).select("model", *(R6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


_FIRST = "t AS (SELECT model, arg_max(p, p) AS p, arg_max(pos, p) AS pos, arg_max(neg, p) AS neg, max(n_pos) AS n_pos, max(n_neg) AS n_neg FROM c GROUP BY model)"


@query(f"{_CURVE}, {_FIRST} SELECT model, round(CASE WHEN CAST(neg AS DOUBLE) / n_neg <= 0.01 THEN p ELSE 1.0 END, 6) AS threshold, round(CASE WHEN CAST(neg AS DOUBLE) / n_neg <= 0.01 THEN CAST(pos AS DOUBLE) / n_pos ELSE 0.0 END, 6) AS recall FROM t")
def recall_at_fpr_first(spark: SparkSession, d: str) -> DataFrame:
    threshold, recall = curves.first_threshold()
    return curves.score_table(preds(spark, d), ["model"]).groupBy("model").agg(R6(threshold).alias("threshold"), R6(recall).alias("recall"))


@query(
    f"WITH {PREDS}, w AS (SELECT *, sum(1 - y) OVER (PARTITION BY model ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING) AS fp, row_number() OVER (PARTITION BY model ORDER BY p DESC, row_id) AS rn, sum(1 - y) OVER (PARTITION BY model) AS n_neg, sum(y) OVER (PARTITION BY model) AS n_pos FROM preds), "
    "t AS (SELECT model, arg_max(p, rn) AS tau FROM w WHERE CAST(fp AS DOUBLE) / n_neg <= 0.01 GROUP BY model) "
    "SELECT w.model, round(max(tau), 6) AS threshold, round(CAST(sum(CASE WHEN p >= tau THEN y ELSE 0 END) AS DOUBLE) / max(n_pos), 6) AS recall FROM w LEFT JOIN t USING (model) GROUP BY w.model"
)
def recall_at_fpr_cum(spark: SparkSession, d: str) -> DataFrame:
    return curves.recall_at_fpr_cum(preds(spark, d), ["model"]).select("model", R6(F.col("threshold")).alias("threshold"), R6(F.col("recall")).alias("recall"))


@query(f"{_CURVE} SELECT model, round(coalesce(max(CASE WHEN CAST(fp AS DOUBLE) / n_neg <= 0.01 THEN CAST(tp AS DOUBLE) / n_pos END), 0.0), 6) AS recall FROM c GROUP BY model")
def recall_at_fpr_roc(spark: SparkSession, d: str) -> DataFrame:
    return curves.score_table(preds(spark, d), ["model"]).groupBy("model").agg(R6(curves.recall_at_fpr_roc()).alias("recall"))


@query(f"{_CURVE} SELECT model, round(p, 6) AS p, round(CAST(fp AS DOUBLE) / n_neg, 6) AS fpr, round(CAST(tp AS DOUBLE) / n_pos, 6) AS tpr, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision FROM c")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return curves.roc_points(preds(spark, d), ["model"]).select("model", *(R6(F.col(c)).alias(c) for c in ("p", "fpr", "tpr", "precision")))


@query(f"{_CURVE}, s AS (SELECT *, row_number() OVER w AS k, lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2 FROM c WINDOW w AS (PARTITION BY model ORDER BY p DESC)) SELECT model, round(p, 6) AS p, round(CAST(fp AS DOUBLE) / n_neg, 6) AS fpr, round(CAST(tp AS DOUBLE) / n_pos, 6) AS tpr, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision FROM s WHERE k = 1 OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg")
def roc_points_thin(spark: SparkSession, d: str) -> DataFrame:
    return curves.roc_points_thin(preds(spark, d), ["model"]).select("model", *(R6(F.col(c)).alias(c) for c in ("p", "fpr", "tpr", "precision")))


@query(f"{_CURVE}, {_FIRST} " + " UNION ALL ".join(f"SELECT model, {t} AS target, round(CASE WHEN CAST(neg AS DOUBLE) / n_neg <= {t} THEN CAST(pos AS DOUBLE) / n_pos ELSE 0.0 END, 6) AS recall FROM t" for t in (0.01, 0.05, 0.1)))
def operating_points(spark: SparkSession, d: str) -> DataFrame:
    targets = (0.01, 0.05, 0.1)
    got = curves.score_table(preds(spark, d), ["model"]).groupBy("model").agg(*(curves.first_threshold(t)[1].alias(f"r{i}") for i, t in enumerate(targets)))
    each = F.array(*(F.struct(F.lit(t).alias("target"), R6(F.col(f"r{i}")).alias("recall")) for i, t in enumerate(targets)))
    return got.select("model", F.explode(each).alias("e")).select("model", "e.target", "e.recall")


# --- calibration and tests --------------------------------------------------------
@query(f"WITH {PREDS} SELECT model, round(avg((p - y) * (p - y)), 6) AS brier FROM preds GROUP BY model")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return preds(spark, d).groupBy("model").agg(R6(curves.brier()).alias("brier"))


def _ece_sql(conf: str) -> str:
    bins = " + ".join(f"CAST({conf} >= CAST({i} AS DOUBLE) / 15 AS INTEGER)" for i in range(1, 15))
    return f"WITH {PREDS}, b AS (SELECT model, {bins} AS bin, count(*) AS n, avg({conf}) AS c, avg(CASE WHEN CAST(p >= 0.5 AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS a FROM preds GROUP BY 1, 2) SELECT model, round(sum(n * abs(a - c)) / CAST(sum(n) AS DOUBLE), 6) AS ece FROM b GROUP BY model"


@query(_ece_sql("p"))
def ece_main(spark: SparkSession, d: str) -> DataFrame:
    return curves.ece_main(preds(spark, d), ["model"]).select("model", R6(F.col("ece")).alias("ece"))


@query(_ece_sql("greatest(p, 1 - p)"))
def ece_confidence(spark: SparkSession, d: str) -> DataFrame:
    return curves.ece_confidence(preds(spark, d), ["model"]).select("model", R6(F.col("ece")).alias("ece"))


_TUNED = "vg AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM preds WHERE split = 'val' GROUP BY model, p), vs AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS fp, sum(neg) OVER (PARTITION BY model) AS n_neg FROM vg), tuned AS (SELECT model, CASE WHEN arg_max(neg, p) / CAST(greatest(1, max(n_neg)) AS DOUBLE) <= 0.01 THEN max(p) ELSE 1.0 END AS first_thr, coalesce(min(CASE WHEN fp / CAST(greatest(1, n_neg) AS DOUBLE) <= 0.01 THEN p END), 1.0) AS roc_thr FROM vs GROUP BY model)"
_TESTS = "tests AS (SELECT * FROM preds WHERE split = 'test'), " + curve_sql("model", "tests").replace("g AS", "tg AS").replace("c AS", "tc AS").replace("FROM g)", "FROM tg)")
_VERSUS = f"{_TUNED}, {_TESTS}, a AS (SELECT model, {AUROC_SQL} AS auroc FROM tc GROUP BY model), r AS (SELECT arg_max(model, (auroc, model)) AS reference FROM a), k AS (SELECT model, row_id, CAST(p >= first_thr AS INTEGER) = y AS ok FROM tests JOIN tuned USING (model)), j AS (SELECT a.model, r.reference, CAST(sum(CASE WHEN a.ok AND NOT b.ok THEN 1 ELSE 0 END) AS BIGINT) AS b01, CAST(sum(CASE WHEN NOT a.ok AND b.ok THEN 1 ELSE 0 END) AS BIGINT) AS b10 FROM k a CROSS JOIN r JOIN k b ON b.model = r.reference AND a.row_id = b.row_id WHERE a.model <> r.reference GROUP BY 1, 2)"


def _tuned(p: DataFrame, rule: str = "first") -> DataFrame:
    """The rows of the test split with their model's threshold, chosen on the other."""
    return p.where("split = 'test'").join(curves.tuned_threshold(p, ["model"], rule=rule), "model")


def _against_best(p: DataFrame) -> DataFrame:
    rows = _tuned(p)
    area = curves.score_table(rows, ["model"]).groupBy("model").agg(curves.auroc().alias("auroc"))
    best = area.agg(F.max_by("model", F.struct(F.coalesce("auroc", F.lit(-1.0)), "model")).alias("reference"))
    return curves.mcnemar(rows, "model", area.select("model").join(F.broadcast(best)))  # one row


@query(f"WITH {PREDS}, {_VERSUS} SELECT *, round(CASE WHEN b01 + b10 > 0 THEN power(abs(b01 - b10) - 1, 2) / CAST(b01 + b10 AS DOUBLE) ELSE 0.0 END, 6) AS chi2 FROM j")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return _against_best(preds(spark, d)).withColumn("chi2", R6(F.col("chi2")))


@query()
def mcnemar_p_values(spark: SparkSession, d: str) -> DataFrame:
    out = _against_best(preds(spark, d)).withColumn("p_value", R6(resampling.chi2_p_value(F.col("chi2"))))
    return out.withColumn("marker", coerce.significance_marker(F.col("p_value")))


_BOOT = 200
_REPS = f"""WITH {PREDS},
keys AS (SELECT DISTINCT row_id FROM preds),
drawn AS (
  SELECT row_id, rep, CAST('0x' || substr(md5('1337:' || row_id || ':' || (rep // 8)), 1 + 4 * (rep % 8), 4) AS INTEGER) AS u
  FROM keys, range({_BOOT}) r(rep)),
w AS (SELECT row_id, rep, {" + ".join(f"CAST(u >= {b} AS INTEGER)" for b in resampling.BOUNDS)} AS w FROM drawn),
s AS (SELECT model, rep, p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM preds JOIN w USING (row_id) GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp, sum(pos) OVER x AS n_pos, sum(neg) OVER x AS n_neg FROM s
      WINDOW v AS (PARTITION BY model, rep ORDER BY p DESC), x AS (PARTITION BY model, rep)),
reps AS (
  SELECT model, rep, {AUROC_SQL} AS auroc, sum(CAST(pos AS DOUBLE) / n_pos * tp / greatest(tp + fp, 1)) AS auprc,
         max(CASE WHEN fp <= 0.01::DOUBLE * n_neg THEN CAST(tp AS DOUBLE) / n_pos ELSE 0 END) AS recall,
         2 * CAST(sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) AS DOUBLE) / (max(n_pos) + sum(CASE WHEN p >= 0.5 THEN pos + neg ELSE 0 END)) AS f1
  FROM c GROUP BY model, rep)"""


@query(f"{_REPS} SELECT model, " + ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_{e}" for m in resampling.METRICS for e, q in (("low", 0.025), ("high", 0.975))) + " FROM reps GROUP BY model")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    out = resampling.bootstrap_ci(preds(spark, d), ["model"], _BOOT)
    return out.select("model", *(R6(F.col(c)).alias(c) for c in out.columns if c != "model"))


_PAIRED = ", ".join(f"round(quantile_cont(a.{m} - b.{m}, 0.025), 6) AS {m}_diff_low, round(quantile_cont(a.{m} - b.{m}, 0.975), 6) AS {m}_diff_high, round(avg(CAST(round(a.{m} - b.{m}, 9) > 0 AS INTEGER)), 6) AS {m}_wins" for m in resampling.METRICS)


@query(f"{_REPS} SELECT a.model, b.model AS reference, {_PAIRED} FROM reps a JOIN reps b USING (rep) WHERE b.model = 'regex_rules' AND a.model <> b.model GROUP BY 1, 2")
def bootstrap_paired(spark: SparkSession, d: str) -> DataFrame:
    """Every model against the rules, on resamples that all of them share."""
    p = preds(spark, d)
    out = resampling.bootstrap_paired(resampling.replicates(p, ["model"], _BOOT), p.select("model", F.lit("regex_rules").alias("reference")).distinct())
    return out.select("model", "reference", *(R6(F.col(c)).alias(c) for c in out.columns if c not in ("model", "reference")))


@query()
def bootstrap_poisson(spark: SparkSession, d: str) -> DataFrame:
    return resampling.poisson_bootstrap(preds(spark, d), ["model"], n_boot=20)


@query()
def best_calibration(spark: SparkSession, d: str) -> DataFrame:
    return calibration.best_calibration(preds(spark, d), ["model"])


@query(f"WITH {PREDS}, b AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM preds) SELECT model, row_id, round(1 / (1 + exp(-(ln(q / (1 - q)) + CASE WHEN y = 1 THEN -0.25 ELSE 0.25 END))), 6) AS probed, round(1 / (1 + exp(-ln(q / (1 - q)) / 1.7)), 6) AS scaled FROM b")
def logit_probe(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return preds(spark, d).select("model", "row_id", R6(perturb.logit_probe(p, F.col("y"))).alias("probed"), R6(calibration.apply_temperature(p, F.lit(1.7))).alias("scaled"))


@query(
    f"WITH {PREDS}, b AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM preds), s AS (SELECT model, y, p FROM preds), s2 AS (SELECT model, y, round(1 / (1 + exp(-(ln(q / (1 - q)) + CASE WHEN y = 1 THEN -0.25 ELSE 0.25 END))), 9) AS p FROM b), "
    + curve_sql("model", "s") + ", " + curve_sql("model", "s2").replace("g AS", "g2 AS").replace("c AS", "c2 AS").replace("FROM g)", "FROM g2)")
    + f", a AS (SELECT model, {AUROC_SQL} AS v, {AP_SQL} AS w FROM c GROUP BY model), a2 AS (SELECT model, {AUROC_SQL} AS v, {AP_SQL} AS w FROM c2 GROUP BY model) SELECT model, round(a2.v - a.v, 5) AS delta_auroc, round(a2.w - a.w, 5) AS delta_auprc FROM a JOIN a2 USING (model)"
)
def probe_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Change of the areas when every score is moved against its label."""
    p = preds(spark, d)
    moved = p.withColumn("p", F.round(perturb.logit_probe(F.col("p"), F.col("y")), 9))
    two = p.select("model", "y", "p", F.lit("a").alias("v")).unionByName(moved.select("model", "y", "p", F.lit("b").alias("v")))
    m = curves.score_table(two, ["model", "v"]).groupBy("model", "v").agg(curves.auroc().alias("auroc"), curves.average_precision().alias("auprc"))
    diff = lambda c: (F.max(F.when(F.col("v") == "b", F.col(c))) - F.max(F.when(F.col("v") == "a", F.col(c))))
    return m.groupBy("model").agg(F.round(diff("auroc"), 5).alias("delta_auroc"), F.round(diff("auprc"), 5).alias("delta_auprc"))


# --- rates and groups -------------------------------------------------------------
@query(f"WITH {PREDS}, {_TUNED} SELECT model, round(max(first_thr), 6) AS threshold, round(avg(CASE WHEN y = 1 THEN CAST(p >= first_thr AS INTEGER) END), 6) AS recall, round(avg(CASE WHEN y = 0 THEN CAST(p >= first_thr AS INTEGER) END), 6) AS realized_fpr FROM preds JOIN tuned USING (model) WHERE split = 'test' GROUP BY model")
def recall_at_tuned_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Recall on the test split at the threshold that the validation split gives a model."""
    recall, fpr = curves.rates(F.col("threshold"))
    return _tuned(preds(spark, d)).groupBy("model").agg(R6(F.max("threshold")).alias("threshold"), R6(recall).alias("recall"), R6(fpr).alias("realized_fpr"))


@query(f"WITH {PREDS}, {_TUNED} SELECT model, count(*) AS n, round(avg(CASE WHEN p >= first_thr THEN 1.0 ELSE 0.0 END), 6) AS overdef_fpr FROM preds JOIN tuned USING (model) WHERE split = 'test' AND y = 0 GROUP BY model")
def overdefense_fpr(spark: SparkSession, d: str) -> DataFrame:
    """Benign rows flagged at a model's tuned threshold."""
    benign = _tuned(preds(spark, d)).where("y = 0")
    return benign.groupBy("model").agg(F.count(F.lit(1)).alias("n"), R6(F.avg((F.col("p") >= F.col("threshold")).cast("double"))).alias("overdef_fpr"))


@query(f"{_CURVE}, t AS (SELECT * FROM (VALUES (0.001), (0.01), (0.05), (0.1)) v(target)), x AS (SELECT model, target, min(CASE WHEN CAST(fp AS DOUBLE) / n_neg <= target THEN p END) AS thr FROM c CROSS JOIN t GROUP BY 1, 2) SELECT x.model, CAST(target AS DOUBLE) AS target, round(coalesce(max(thr), 1.0), 6) AS threshold, round(avg(CASE WHEN p >= coalesce(thr, 1.0) THEN 1.0 ELSE 0.0 END), 6) AS overdef_fpr FROM x JOIN preds USING (model) WHERE y = 0 GROUP BY 1, 2")
def overdef_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Over-defence at the lowest thresholds within four target rates."""
    p = preds(spark, d)
    each = F.explode(F.array(*(F.lit(t) for t in (0.001, 0.01, 0.05, 0.1))))
    t = curves.score_table(p, ["model"]).withColumn("target", each)
    thr = t.groupBy("model", "target").agg(F.coalesce(F.min(F.when(F.try_divide(F.col("fp"), F.col("n_neg")) <= F.col("target"), F.col("p"))), F.lit(1.0)).alias("threshold"))
    rate = F.avg((F.col("p") >= F.col("threshold")).cast("double"))
    return p.where("y = 0").join(thr, "model").groupBy("model", "target", R6(F.col("threshold")).alias("threshold")).agg(R6(rate).alias("overdef_fpr"))


@query(
    f"WITH {PREDS}, {_TUNED}, {_TESTS}, area AS (SELECT model, round({AUROC_SQL}, 6) AS auroc, round({AP_SQL}, 6) AS auprc FROM tc GROUP BY model) "
    "SELECT model, round(avg(CASE WHEN y = 1 THEN CAST(p >= roc_thr AS INTEGER) END), 6) AS tpr, round(avg(CASE WHEN y = 0 THEN CAST(p >= roc_thr AS INTEGER) END), 6) AS fpr, "
    "CAST(sum(y) AS BIGINT) AS n_harmful, CAST(sum(1 - y) AS BIGINT) AS n_benign, max(auroc) AS auroc, max(auprc) AS auprc FROM tests JOIN tuned USING (model) JOIN area USING (model) GROUP BY model"
)
def jailbreak_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates at a model's tuned threshold, and its areas, on other rows than those it was tuned on."""
    rows = _tuned(preds(spark, d), "roc")
    tpr, fpr = curves.rates(F.col("threshold"))
    rates = rows.groupBy("model").agg(R6(tpr).alias("tpr"), R6(fpr).alias("fpr"), F.sum("y").alias("n_harmful"), F.sum(1 - F.col("y")).alias("n_benign"))
    areas = curves.score_table(rows, ["model"]).groupBy("model").agg(R6(curves.auroc()).alias("auroc"), R6(curves.average_precision()).alias("auprc"))
    return rates.join(areas, "model")


def _gap_sql(group: str) -> str:
    return f"WITH {PREDS}, q AS (SELECT model, {group} AS g, count(*) AS n, CASE WHEN sum(y) > 0 THEN CAST(sum(CASE WHEN y = 1 AND p >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) / sum(y) ELSE 0.0 END AS r FROM preds GROUP BY 1, 2 HAVING count(*) >= 25), w AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY r, n DESC, g) AS rn, count(*) OVER (PARTITION BY model) AS kk FROM q) SELECT m.model, coalesce(max(CASE WHEN rn = 1 AND kk >= 2 THEN g END), '') AS worst, round(max(CASE WHEN rn = 1 AND kk >= 2 THEN r END), 6) AS worst_recall, round(coalesce(CASE WHEN max(kk) >= 2 THEN max(r) - min(r) END, 0.0), 6) AS gap FROM models m LEFT JOIN w USING (model) GROUP BY m.model"


@query(_gap_sql("lang"))
def fairness_gap(spark: SparkSession, d: str) -> DataFrame:
    return curves.fairness_gap(preds(spark, d), ["model"], "lang").select("model", "worst", R6(F.col("worst_recall")).alias("worst_recall"), R6(F.col("gap")).alias("gap"))


@query(_gap_sql("CASE WHEN n_chars < 50 THEN '<50' WHEN n_chars < 150 THEN '50-149' WHEN n_chars < 400 THEN '150-399' WHEN n_chars < 800 THEN '400-799' ELSE '800+' END"))
def fairness_length_gap(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    bins = F.when(n < 50, "<50").when(n < 150, "50-149").when(n < 400, "150-399").when(n < 800, "400-799").otherwise("800+")
    return curves.fairness_gap(preds(spark, d).withColumn("bin", bins), ["model"], "bin").select("model", "worst", R6(F.col("worst_recall")).alias("worst_recall"), R6(F.col("gap")).alias("gap"))


_ROBUST_CURVE = f"WITH {ROBUST}, {curve_sql('model, transform')}"
_GRID = f"grid AS (SELECT model, transform, {AUROC_SQL} AS auroc, {AP_SQL} AS auprc FROM c GROUP BY model, transform)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return curves.score_table(robust_preds(spark, d), ["model", "transform"]).groupBy("model", "transform").agg(curves.auroc().alias("auroc"), curves.average_precision().alias("auprc"))


@query(f"{_ROBUST_CURVE}, {_GRID} SELECT model, transform, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM grid")
def robustness_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("model", "transform", R6(F.col("auroc")).alias("auroc"), R6(F.col("auprc")).alias("auprc"))


@query(f"{_ROBUST_CURVE}, {_GRID} SELECT g.model, g.transform, round(coalesce(b.auroc, g.auroc) - g.auroc, 6) AS auroc_drop FROM grid g LEFT JOIN grid b ON b.model = g.model AND b.transform = 'none'")
def robust_drop(spark: SparkSession, d: str) -> DataFrame:
    return reports.robust_drop(_grid(spark, d)).select("model", "transform", R6(F.col("auroc_drop")).alias("auroc_drop"))


@query(f"{_ROBUST_CURVE}, {_GRID} SELECT transform, round(avg(auroc), 6) AS mean_auroc, CAST(row_number() OVER (ORDER BY avg(auroc), transform) AS INTEGER) AS place FROM grid GROUP BY transform")
def hardest_transform(spark: SparkSession, d: str) -> DataFrame:
    per = _grid(spark, d).groupBy("transform").agg(F.avg("auroc").alias("m"))
    return reports.placed(per, [F.col("m"), F.col("transform")]).select("transform", R6(F.col("m")).alias("mean_auroc"), "place")


@query(f"{_ROBUST_CURVE}, {_GRID} SELECT model, " + ", ".join(f"round(avg(CASE WHEN transform = {lit(t)} THEN auroc END), 6) AS {t}" for t in ("none", "casing", "homoglyph", "whitespace")) + " FROM grid GROUP BY model")
def pivot_robustness(spark: SparkSession, d: str) -> DataFrame:
    out = _grid(spark, d).groupBy("model").pivot("transform", ["none", "casing", "homoglyph", "whitespace"]).agg(F.avg("auroc"))
    return out.select("model", *(R6(F.col(c)).alias(c) for c in out.columns[1:]))


@query(f"{_ROBUST_CURVE}, {_GRID}, w AS (SELECT model, max(CASE WHEN transform = 'none' THEN auroc END) AS clean, max(CASE WHEN transform = 'homoglyph' THEN auroc END) AS perturbed FROM grid GROUP BY model) SELECT model, round(clean / perturbed, 6) AS fold_change, round(sqrt(clean * perturbed), 6) AS geometric_mid FROM w")
def fold_change(spark: SparkSession, d: str) -> DataFrame:
    out = _grid(spark, d).groupBy("model").pivot("transform", ["none", "homoglyph"]).agg(F.first("auroc"))
    return out.select("model", R6(F.col("none") / F.col("homoglyph")).alias("fold_change"), R6(F.sqrt(F.col("none") * F.col("homoglyph"))).alias("geometric_mid"))


# --- rankings and headlines -------------------------------------------------------
_SCORES = f"{_CURVE}, m AS (SELECT model, {AUROC_SQL} AS auroc, coalesce(max(CASE WHEN CAST(fp AS DOUBLE) / n_neg <= 0.01 THEN CAST(tp AS DOUBLE) / n_pos END), 0.0) AS recall FROM c GROUP BY model), o AS (SELECT model, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS od FROM preds WHERE y = 0 GROUP BY model), v AS (SELECT split_part(model, '_seed', 1) AS variant, avg(auroc) AS auroc, avg(recall) AS recall FROM m GROUP BY 1), vo AS (SELECT split_part(model, '_seed', 1) AS variant, avg(od) AS od FROM o GROUP BY 1)"


def _models(spark: SparkSession, d: str) -> DataFrame:
    return curves.score_table(preds(spark, d), ["model"]).groupBy("model").agg(curves.auroc().alias("auroc"), curves.recall_at_fpr_roc().alias("recall"))


def _overdef(spark: SparkSession, d: str) -> DataFrame:
    return preds(spark, d).where("y = 0").groupBy("model").agg(F.avg((F.col("p") >= 0.5).cast("double")).alias("od"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    v = coerce.parse_variant(F.col("model")).alias("variant")
    mean = _models(spark, d).groupBy(v).agg(F.avg("auroc").alias("auroc"), F.avg("recall").alias("recall"))
    return mean.join(_overdef(spark, d).groupBy(v).agg(F.avg("od").alias("od")), "variant", "left")


@query(f"{_SCORES} SELECT variant, round(auroc, 6) AS auroc, round(recall, 6) AS recall FROM v")
def variant_mean(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select("variant", R6(F.col("auroc")).alias("auroc"), R6(F.col("recall")).alias("recall"))


@query(f"{_SCORES} SELECT variant, round(auroc, 6) AS auroc, round(od, 6) AS overdef_fpr FROM v LEFT JOIN vo USING (variant)")
def variant_overdef_join(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select("variant", R6(F.col("auroc")).alias("auroc"), R6(F.col("od")).alias("overdef_fpr"))


@query(f"{_SCORES} SELECT variant, CAST(row_number() OVER (ORDER BY coalesce(auroc, -1) DESC, coalesce(recall, -1) DESC, od, variant) AS INTEGER) AS place FROM v LEFT JOIN vo USING (variant)")
def variant_rank(spark: SparkSession, d: str) -> DataFrame:
    return reports.variant_rank(_variants(spark, d)).select("variant", "place")


@query(f"{_SCORES}, b AS (SELECT split_part(model, '_seed', 1) AS variant, model, auroc, row_number() OVER (PARTITION BY split_part(model, '_seed', 1) ORDER BY auroc DESC, model) AS rn FROM m) SELECT variant, model, round(auroc, 6) AS auroc FROM b WHERE rn = 1")
def best_per_variant(spark: SparkSession, d: str) -> DataFrame:
    return reports.best_of(_models(spark, d).withColumn("variant", coerce.parse_variant(F.col("model"))), "variant", "auroc").select("variant", "model", R6(F.col("auroc")).alias("auroc"))


@query(f"{_SCORES} SELECT model, round(auroc, 6) AS auroc FROM m ORDER BY m.auroc DESC, model LIMIT 3")
def topk_models(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d).orderBy(F.desc("auroc"), "model").limit(3).select("model", R6(F.col("auroc")).alias("auroc"))


@query(f"{_SCORES} SELECT max(auroc) FILTER (WHERE model LIKE 'HG\\_%' ESCAPE '\\') AS x, arg_max(model, auroc) FILTER (WHERE model LIKE 'HG\\_%' ESCAPE '\\') AS best_hybrid, arg_max(model, auroc) FILTER (WHERE NOT model LIKE 'HG\\_%' ESCAPE '\\') AS best_other, round(max(auroc) FILTER (WHERE model LIKE 'HG\\_%' ESCAPE '\\') - max(auroc) FILTER (WHERE NOT model LIKE 'HG\\_%' ESCAPE '\\'), 6) AS delta FROM m".replace("max(auroc) FILTER (WHERE model LIKE 'HG\\_%' ESCAPE '\\') AS x, ", ""))
def headline_delta(spark: SparkSession, d: str) -> DataFrame:
    return reports.headline(_models(spark, d)).select("best_hybrid", "best_other", R6(F.col("delta")).alias("delta"))


@query(f"{_SCORES} SELECT m.model, split_part(m.model, '_seed', 1) AS variant, regexp_replace(m.model, '_seed[0-9]+$', '') AS base, CASE WHEN lower(m.model) LIKE 'hg\\_%' ESCAPE '\\' THEN 'hybrid' WHEN lower(m.model) LIKE 'sota::%' OR contains(lower(m.model), 'deberta') THEN 'sota' ELSE 'baseline' END AS type, CASE WHEN m.model LIKE 'HG\\_%' ESCAPE '\\' THEN 'Hybrid ' || regexp_extract(m.model, '^HG_([A-Z_]+?)_seed([0-9]+)$', 1) || ' (seed ' || regexp_extract(m.model, '^HG_([A-Z_]+?)_seed([0-9]+)$', 2) || ')' ELSE m.model END AS friendly FROM m")
def model_names(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("model")
    return _models(spark, d).select("model", coerce.parse_variant(m).alias("variant"), coerce.strip_seed(m).alias("base"), coerce.model_type(m).alias("type"), coerce.friendly_name(m).alias("friendly"))


@query(f"{_SCORES}, l AS (SELECT model, auroc * 0.9 AS latency FROM m), med AS (SELECT median(latency) AS md FROM l) SELECT model, round(CASE WHEN md < 1 THEN latency * 1000 ELSE latency END, 4) AS latency_ms FROM l, med")
def latency_unit_fix(spark: SparkSession, d: str) -> DataFrame:
    rows = _models(spark, d).select("model", (F.col("auroc") * 0.9).alias("latency"))
    return reports.seconds_to_ms(rows, "latency").select("model", F.round("latency", 4).alias("latency_ms"))


@query(f"WITH {PREDS} SELECT model, row_id, CASE WHEN p >= 0.6 THEN 'HIGH RISK' WHEN p >= 0.35 THEN 'SUSPICIOUS' ELSE 'LIKELY BENIGN' END AS band, CASE WHEN least(p * (0.3 + 0.5 * 0.9) * 1.3, 1.0) >= 0.5 THEN 'WOULD FLAG' WHEN least(p * (0.3 + 0.5 * 0.9) * 1.3, 1.0) >= 0.25 THEN 'uncertain' ELSE 'likely pass' END AS flag FROM preds")
def risk_band(spark: SparkSession, d: str) -> DataFrame:
    e = coerce.estimated_detection(F.col("p"), F.lit(0.3), F.lit(0.9))
    return preds(spark, d).select("model", "row_id", coerce.risk_band(F.col("p")).alias("band"), coerce.detection_band(e).alias("flag"))


@query(f"WITH {PREDS} SELECT model, row_id, CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS marker, CAST(p >= 0.5 AS INTEGER) AS decision FROM preds")
def sig_marker(spark: SparkSession, d: str) -> DataFrame:
    return preds(spark, d).select("model", "row_id", coerce.significance_marker(F.col("p")).alias("marker"), (F.col("p") >= 0.5).cast("int").alias("decision"))


@query(f"WITH {PREDS}, {_TUNED} SELECT model, lang, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, round(avg(CASE WHEN y = 1 THEN CAST(p >= roc_thr AS INTEGER) END), 6) AS recall_at_thr, round(avg(CASE WHEN y = 0 THEN CAST(p >= roc_thr AS INTEGER) END), 6) AS realized_fpr FROM preds JOIN tuned USING (model) WHERE split = 'test' GROUP BY 1, 2")
def threshold_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds chosen on one split, applied to each language of the other."""
    recall, fpr = curves.rates(F.col("threshold"))
    return _tuned(preds(spark, d), "roc").groupBy("model", "lang").agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"), R6(recall).alias("recall_at_thr"), R6(fpr).alias("realized_fpr"))


@query(f"{_ROBUST_CURVE}, {_GRID} SELECT transform, min(model) AS first_model, round_even(avg(auroc), 4) AS mean, round_even(stddev_samp(auroc), 4) AS std FROM grid GROUP BY transform")
def corpus_agg(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).groupBy("transform").agg(F.min("model").alias("first_model"), F.bround(F.avg("auroc"), 4).alias("mean"), F.bround(F.stddev_samp("auroc"), 4).alias("std"))


_ABL = f"{_SCORES}, ab AS (SELECT 'no_rules' AS ablation, 'HG_ALPHA_seed1' AS model, max(auroc) FILTER (WHERE model = 'HG_BETA_seed1') AS auroc FROM m UNION ALL SELECT 'only_transformer', 'HG_ALPHA_seed1', max(auroc) FILTER (WHERE model = 'regex_rules') FROM m), fm AS (SELECT coalesce((SELECT auroc FROM m WHERE model = 'HG_ALPHA_seed1'), (SELECT max(auroc) FROM ab)) AS f) SELECT ablation, CASE ablation WHEN 'no_rules' THEN 'Without Rules' WHEN 'only_transformer' THEN 'Only Transformer' ELSE 'Full Model' END AS label, round(f - auroc, 6) AS auroc_drop FROM (SELECT * FROM ab UNION ALL SELECT 'full_model', 'HG_ALPHA_seed1', f FROM fm) u, fm"


@query(_ABL)
def ablation_drop(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    pick = lambda name, ab: m.where(F.col("model") == name).select(F.lit(ab).alias("ablation"), F.lit("HG_ALPHA_seed1").alias("model"), "auroc")
    out = reports.ablation_drop(pick("HG_BETA_seed1", "no_rules").unionByName(pick("regex_rules", "only_transformer")), m)
    return out.select("ablation", coerce.ablation_label(F.col("ablation")).alias("label"), R6(F.col("auroc_drop")).alias("auroc_drop"))


_GAPS = "wide AS (SELECT lang AS worst_lang, model, round(avg(p), 6) AS lang_recall_gap, CASE WHEN avg(n_chars) > 2000 THEN '800+' ELSE '<50' END AS worst_len, round(avg(p) / 2, 6) AS len_recall_gap FROM preds GROUP BY lang, model)"


@query(f"WITH {PREDS}, {_GAPS} SELECT model, 'lang: ' || worst_lang AS grp, lang_recall_gap AS gap FROM wide UNION ALL SELECT model, 'len: ' || worst_len, len_recall_gap FROM wide")
def unpivot_fairness(spark: SparkSession, d: str) -> DataFrame:
    worst_len = F.when(F.avg("n_chars") > 2000, "800+").otherwise("<50")
    wide = preds(spark, d).groupBy(F.col("lang").alias("worst_lang"), "model").agg(R6(F.avg("p")).alias("lang_recall_gap"), worst_len.alias("worst_len"), R6(F.avg("p") / 2).alias("len_recall_gap"))
    return reports.unpivot_fairness(wide)


@query(f"{_CURVE} SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY p DESC) - 1 AS INTEGER) AS i, round(CAST(fp AS DOUBLE) / n_neg, 6) AS fpr, round(CAST(tp AS DOUBLE) / n_pos, 6) AS tpr FROM c")
def explode_curves(spark: SparkSession, d: str) -> DataFrame:
    """Curves are packed by score bucket, so no array holds a model's whole curve."""
    pts = curves.roc_points(preds(spark, d), ["model"]).withColumn("part", -F.floor(curves.cell(F.col("p")) / 1024))
    packed = pts.groupBy("model", "part").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("o"), R6(F.col("fpr")).alias("fpr"), R6(F.col("tpr")).alias("tpr")))).alias("a"))
    before = F.sum(F.size("a")).over(Window.partitionBy("model").orderBy("part")) - F.size("a")
    packed = packed.select("model", before.cast("int").alias("first"), F.transform("a", lambda x: x["fpr"]).alias("fpr"), F.transform("a", lambda x: x["tpr"]).alias("tpr"))
    return reports.explode_curves(packed)


@query(f"WITH {PREDS} SELECT CAST(count(DISTINCT model) AS BIGINT) AS n_models, round(avg(CASE WHEN p >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS saturated, CAST(count(DISTINCT lang) AS BIGINT) AS n_langs FROM preds")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return preds(spark, d).agg(F.countDistinct("model").alias("n_models"), R6(F.avg((F.col("p") >= 0.9).cast("double"))).alias("saturated"), F.countDistinct("lang").alias("n_langs"))


# --- report tables ----------------------------------------------------------------
_ECE_TESTS = "eb AS (SELECT model, " + " + ".join(f"CAST(p >= CAST({i} AS DOUBLE) / 15 AS INTEGER)" for i in range(1, 15)) + " AS bin, count(*) AS n, avg(p) AS conf, avg(CASE WHEN CAST(p >= 0.5 AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS acc FROM tests GROUP BY 1, 2), ee AS (SELECT model, sum(n * abs(acc - conf)) / CAST(sum(n) AS DOUBLE) AS ece FROM eb GROUP BY model)"
_RESULTS = (
    f"WITH {PREDS}, {_TUNED}, {_TESTS}, {_ECE_TESTS}, area AS (SELECT model, {AUROC_SQL} AS auroc, {AP_SQL} AS auprc FROM tc GROUP BY model), "
    "cell AS (SELECT model, max(roc_thr) AS threshold, count(*) AS n, sum(CASE WHEN y = 1 AND p >= roc_thr THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p >= roc_thr THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p < roc_thr THEN 1 ELSE 0 END) AS fn, sum(1 - y) AS n_neg, avg((p - y) * (p - y)) AS brier FROM tests JOIN tuned USING (model) GROUP BY model), "
    "results AS (SELECT model, split_part(model, '_seed', 1) AS variant, n, auroc, auprc, threshold, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall, "
    "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, CAST(fp AS DOUBLE) / n_neg AS realized_fpr, brier, ece FROM cell JOIN area USING (model) JOIN ee USING (model))"
)
_NUMBERS = ("auroc", "auprc", "threshold", "precision", "recall", "f1", "realized_fpr", "brier", "ece")


def _results(spark: SparkSession, d: str) -> DataFrame:
    return reports.results_table(_tuned(preds(spark, d), "roc"), ["model"]).withColumn("variant", coerce.parse_variant(F.col("model")))


@query(f"{_RESULTS} SELECT model, variant, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUMBERS) + " FROM results")
def results_table(spark: SparkSession, d: str) -> DataFrame:
    """All numbers of a model on the test split, at the threshold that the other split gave it."""
    return _results(spark, d).select("model", "variant", "n", *(R6(F.col(c)).alias(c) for c in _NUMBERS))


_BEST = {"auroc": 1, "auprc": 1, "recall": 1, "f1": 1, "brier": -1, "ece": -1, "realized_fpr": -1}


@query(f"{_RESULTS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, arg_{'max' if up > 0 else 'min'}(model, (round({m}, 9), model)) AS model, round({'max' if up > 0 else 'min'}({m}), 6) AS value FROM results" for m, up in _BEST.items()))
def best_per_metric(spark: SparkSession, d: str) -> DataFrame:
    """The best model by each metric; of equals the last name where more is better, the first where less is."""
    return reports.best_per_metric(_results(spark, d).select("model", *(F.round(m, 9).alias(m) for m in _BEST)), _BEST).withColumn("value", R6(F.col("value")))


@query(f"{_RESULTS} SELECT variant, count(*) AS seeds, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0.0), 6) AS {m}_std" for m in ("auroc", "recall", "ece")) + " FROM results GROUP BY variant")
def variant_spread(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation over the seeds of a variant; 0 for a single seed."""
    return reports.spread(_results(spark, d), "variant", ("auroc", "recall", "ece"))


@query(
    f"WITH {ROBUST}, {curve_sql('model, transform')}, k AS (SELECT model, transform, coalesce(max(CASE WHEN CAST(fp AS DOUBLE) / n_neg <= 0.05 THEN CAST(tp AS DOUBLE) / n_pos END), 0.0) AS recall FROM c GROUP BY 1, 2), "
    "w AS (SELECT model, max(CASE WHEN transform = 'homoglyph' THEN recall END) AS perturbed, max(CASE WHEN transform = 'none' THEN recall END) AS canonical FROM k GROUP BY model), "
    "f AS (SELECT *, CASE WHEN perturbed > 0 AND canonical / perturbed > 1.05 AND canonical / perturbed < 1000 THEN canonical / perturbed END AS fold FROM w) "
    "SELECT model, round(perturbed, 6) AS perturbed, round(canonical, 6) AS canonical, round(fold, 6) AS fold, coalesce(model = (SELECT arg_max(model, (round(fold, 9), model)) FROM f WHERE fold IS NOT NULL), false) AS headline FROM f"
)
def recall_fold(spark: SparkSession, d: str) -> DataFrame:
    """How much recall comes back between two conditions, within limits, and the model where most does."""
    t = curves.score_table(robust_preds(spark, d), ["model", "transform"]).groupBy("model", "transform").agg(curves.recall_at_fpr_roc(0.05).alias("recall"))
    wide = t.groupBy("model").pivot("transform", ["homoglyph", "none"]).agg(F.first("recall")).select("model", F.col("homoglyph").alias("perturbed"), F.col("none").alias("canonical"))
    out = reports.recall_fold(wide, low=1.05)
    return out.select("model", *(R6(F.col(c)).alias(c) for c in ("perturbed", "canonical", "fold")), "headline")


_BY_VARIANT = "grid AS (SELECT model, transform, {} AS auroc FROM rc GROUP BY model, transform), rb AS (SELECT split_part(model, '_seed', 1) AS variant, avg(auroc) FILTER (WHERE transform <> 'none') AS robust FROM grid GROUP BY 1)".format(AUROC_SQL)
_ROBUST_ROWS = f"{_TRANSFORMS_SQL}, robust AS ({ROBUST.split('preds AS (', 1)[1]}, " + curve_sql("model, transform", "robust").replace("g AS (", "rg AS (", 1).replace("c AS (SELECT", "rc AS (SELECT").replace("FROM g)", "FROM rg)")


@query(
    f"{_RESULTS}, {_ROBUST_ROWS}, {_BY_VARIANT}, own AS (SELECT variant, avg(auroc) AS auroc, avg(recall) AS recall, avg(realized_fpr) AS od, avg(ece) AS ece FROM results GROUP BY 1) "
    "SELECT variant, round(auroc, 6) AS auroc, round(recall, 6) AS recall, round(od, 6) AS od, round(robust, 6) AS robust, CAST(row_number() OVER (ORDER BY auroc DESC, recall DESC, od, robust DESC, variant) AS INTEGER) AS place FROM own LEFT JOIN rb USING (variant)"
)
def robust_variant_rank(spark: SparkSession, d: str) -> DataFrame:
    """Variants by their test results and, joined to these, their mean area under perturbation."""
    v = coerce.parse_variant(F.col("model")).alias("variant")
    rows = _results(spark, d).groupBy("variant").agg(F.avg("auroc").alias("auroc"), F.avg("recall").alias("recall"), F.avg("realized_fpr").alias("od"))
    robust = _grid(spark, d).where("transform <> 'none'").groupBy(v).agg(F.avg("auroc").alias("robust"))
    return reports.variant_rank(rows.join(robust, "variant", "left")).select("variant", *(R6(F.col(c)).alias(c) for c in ("auroc", "recall", "od", "robust")), "place")


@query(
    f"WITH {ROBUST}, {curve_sql('model, transform')}, {_GRID}, drops AS (SELECT g.model, g.transform, g.auroc, b.auroc - g.auroc AS lost FROM grid g JOIN grid b ON b.model = g.model AND b.transform = 'none' WHERE g.transform <> 'none') "
    "SELECT (SELECT arg_min(transform, (round(m, 9), transform)) FROM (SELECT transform, avg(auroc) AS m FROM drops GROUP BY 1)) AS hardest_transform, (SELECT arg_max(model, (round(m, 9), model)) FROM (SELECT model, avg(auroc) AS m FROM drops GROUP BY 1)) AS most_robust_model, "
    "(SELECT arg_max(model, (round(lost, 9), model)) FROM drops) AS largest_drop_model, round((SELECT max(lost) FROM drops), 6) AS largest_drop, round((SELECT avg(auroc) FROM drops), 6) AS mean_auroc"
)
def robustness_headline(spark: SparkSession, d: str) -> DataFrame:
    """Hardest transform, most robust model, largest drop and mean area under perturbation."""
    out = reports.robustness_headline(reports.robust_drop(_grid(spark, d)))
    return out.select("hardest_transform", "most_robust_model", "largest_drop_model", R6(F.col("largest_drop")).alias("largest_drop"), R6(F.col("mean_auroc")).alias("mean_auroc"))


_SPLIT10 = "SELECT doc_id, CASE WHEN rn <= ceil(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || ':1337'), doc_id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels)"


@query(_SPLIT10)
def stratified_tenth(spark: SparkSession, d: str) -> DataFrame:
    """The form of the split without validation rows."""
    return integrity.stratified_split(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", test=0.1, val=0.0).select("doc_id", "split")


# --- integrity --------------------------------------------------------------------
_HASH = "md5(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS text_hash FROM documents")
def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", integrity.text_hash(F.col("text")).alias("text_hash"))


@query(f"SELECT min(doc_id) AS doc_id, {_HASH} AS text_hash FROM documents GROUP BY 2")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return integrity.exact_dedup(table(spark, d, "documents")).select("doc_id", "text_hash")


@query(f"SELECT count(*) AS n_before, count(DISTINCT {_HASH}) AS n_after, count(*) - count(DISTINCT {_HASH}) AS n_removed FROM documents")
def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.dedup_report(table(spark, d, "documents"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_BEGINNING = f"tok AS (SELECT doc_id, unnest(list_slice({_WORDS}, 1, 256)) AS token FROM documents), "
_WHOLE = f"tok AS (SELECT doc_id, unnest({_WORDS}) AS token FROM documents), "
_VOTES = (
    "b AS (SELECT doc_id, unnest(range(64)) AS i, md5(token) AS h FROM tok), "
    "v AS (SELECT doc_id, i, sum(CASE WHEN (CAST(('0x' || substr(h, CAST(1 + 8 * (i // 32) AS INTEGER), 8)) AS BIGINT) >> CAST(31 - i % 32 AS BIGINT)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM b GROUP BY 1, 2), "
    "sim AS (SELECT doc_id, CAST(sum(CASE WHEN s >= 0 THEN CASE WHEN i = 0 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(power(2, 63 - i) AS HUGEINT) END ELSE 0 END) AS BIGINT) AS simhash FROM v GROUP BY doc_id UNION ALL SELECT doc_id, CAST(-1 AS BIGINT) FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]'))"
)
_SIM = _BEGINNING + _VOTES


@query(f"WITH {_SIM} SELECT doc_id, simhash FROM sim")
def simhash(spark: SparkSession, d: str) -> DataFrame:
    return integrity.simhash64(documents(spark, d))


@query(f"WITH {_WHOLE}{_VOTES}, cl AS (SELECT simhash, min(doc_id) AS rep, count(*) AS n FROM sim GROUP BY simhash) SELECT x.rep AS a, y.rep AS b, CAST(bit_count(xor(x.simhash, y.simhash)) AS INTEGER) AS distance, x.n AS n_a, y.n AS n_b, CASE WHEN x.rep = y.rep THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS pairs FROM cl x JOIN cl y ON (x.rep < y.rep OR x.rep = y.rep AND x.n > 1) AND ((x.simhash >> 48) & 65535) = ((y.simhash >> 48) & 65535) WHERE bit_count(xor(x.simhash, y.simhash)) <= 3")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of fingerprints of whole texts; those of ``simhash`` and ``near_dup_members`` are of the first 256 words."""
    return integrity.near_dup_pairs(integrity.simhash64(documents(spark, d), most=None))


@query(f"WITH {_SIM} SELECT doc_id, min(doc_id) OVER (PARTITION BY simhash) AS rep FROM sim")
def near_dup_members(spark: SparkSession, d: str) -> DataFrame:
    return integrity.near_dup_members(integrity.simhash64(documents(spark, d)))


_SPLIT = "r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || ':1337'), doc_id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels), sp AS (SELECT doc_id, toxic, CASE WHEN rn <= ceil(n * 0.15) THEN 'test' WHEN rn <= ceil(n * 0.15) + ceil(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM r)"


@query(f"WITH {_SPLIT} SELECT doc_id, toxic, split FROM sp")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return integrity.stratified_split(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query(
    f"WITH {_SPLIT}, h AS (SELECT split, md5(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS h FROM sp JOIN documents USING (doc_id)), "
    "u AS (SELECT h, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a, max(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS b, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS c FROM h GROUP BY h) "
    "SELECT CAST(coalesce(sum(a * b), 0) AS BIGINT) AS train_val, CAST(coalesce(sum(a * c), 0) AS BIGINT) AS train_test, CAST(coalesce(sum(b * c), 0) AS BIGINT) AS val_test FROM u"
)
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    split = integrity.stratified_split(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id")
    rows = split.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("text_hash", integrity.text_hash(F.col("text")))
    return integrity.leakage(rows)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS a, row_number() OVER (ORDER BY doc_id DESC) AS b FROM documents) SELECT doc_id, CASE WHEN b <= 50 THEN 'test' WHEN a <= 80 THEN 'train' ELSE 'unused' END AS split FROM r")
def tail_split(spark: SparkSession, d: str) -> DataFrame:
    return integrity.tail_split(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 80)


@query("SELECT count(*) AS n_shared FROM (SELECT DISTINCT trim(text) FROM documents INTERSECT SELECT DISTINCT trim(text) FROM benchmark)")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t: table(spark, d, t).select(F.trim("text").alias("t")).distinct()
    return side("documents").intersect(side("benchmark")).agg(F.count(F.lit(1)).alias("n_shared"))


# --- vectors, events, unions ------------------------------------------------------
_DOT = "list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE)))"
_KNN = lambda where, name: f"{name} AS (SELECT q.vec_id AS query_id, b.vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS rank FROM embeddings q JOIN embeddings b ON {where} WHERE q.label % 3 = 2)"


def _bank(spark: SparkSession, d: str, k: int) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("label") % 3 == k).select("vec_id", F.col("embedding").alias("bv"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("label") % 3 == 2).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


@query(f"WITH {_KNN('b.label % 3 = 0', 'k')} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 5) AS score FROM k WHERE rank <= 5")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn_topk(_asked(spark, d), _bank(spark, d, 0)).withColumn("score", F.round("score", 5))


_RAV = f"WITH {_KNN('b.label % 3 = 0', 'k')}, {_KNN('b.label % 3 = 1', 'n')}, a AS (SELECT query_id, max(score) AS ma, avg(score) AS va, stddev_pop(score) AS sa FROM k WHERE rank <= 5 GROUP BY 1), z AS (SELECT query_id, max(score) AS mb, avg(score) AS vb, stddev_pop(score) AS sb FROM n WHERE rank <= 5 GROUP BY 1)"


def _rav(spark: SparkSession, d: str) -> DataFrame:
    q = _asked(spark, d)
    return vectors.retrieval_features(vectors.knn_topk(q, _bank(spark, d, 0)), vectors.knn_topk(q, _bank(spark, d, 1)))


@query(f"{_RAV} SELECT query_id, round(ma, 5) AS attack_max, round(va, 5) AS attack_mean, round(sa, 5) AS attack_std, round(mb, 5) AS benign_max, round(vb, 5) AS benign_mean, round(sb, 5) AS benign_std, round(ma - mb, 5) AS margin FROM a JOIN z USING (query_id)")
def retrieval_features(spark: SparkSession, d: str) -> DataFrame:
    f = _rav(spark, d)
    return f.select("query_id", *(F.round(c, 5).alias(c) for c in f.columns[1:]))


@query(f"{_RAV} SELECT query_id, round(greatest(0.4, CASE WHEN ma - mb >= 0.10 THEN 0.9 ELSE 0.0 END), 6) AS p FROM a JOIN z USING (query_id)")
def veto_gate(spark: SparkSession, d: str) -> DataFrame:
    return _rav(spark, d).select("query_id", R6(vectors.veto(F.lit(0.4), F.col("margin"))).alias("p"))


@query("WITH a AS (SELECT max(ts) AS t FROM events) SELECT event_id, CAST(abs(epoch_us(ts) - epoch_us(t)) // 1000000 AS BIGINT) AS seconds FROM events, a WHERE abs(epoch_us(ts) - epoch_us(t)) <= 7200000000")
def closest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events within two hours of the last one."""
    e = table(spark, d, "events").select("event_id", "ts")
    last = e.agg(F.max("ts").alias("t"))
    return reports.within(e, last, "ts", "t").select("event_id", F.floor("seconds").cast("long").alias("seconds"))


@query("SELECT doc_id AS id, text, CAST(1 AS INTEGER) AS label FROM documents UNION ALL SELECT item_id, text, 0 FROM benchmark")
def union_labeled(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.corpus import union_labeled as union

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return union(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query(f"{_SCORES}, f AS (SELECT CASE WHEN model LIKE 'HG\\_%' ESCAPE '\\' THEN 1 ELSE 0 END AS hybrid, count(*) AS n, round(max(auroc), 6) AS best FROM m GROUP BY 1) SELECT CAST(hybrid AS INTEGER) AS hybrid, n, best FROM f")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    hybrid = F.col("model").startswith("HG_").cast("int").alias("hybrid")
    return _models(spark, d).groupBy(hybrid).agg(F.count(F.lit(1)).alias("n"), R6(F.max("auroc")).alias("best"))


@query(f"{_SCORES}, {_VERSUS} SELECT m.model, round(m.auroc, 6) AS auroc, CASE WHEN b01 + b10 > 0 AND power(abs(b01 - b10) - 1, 2) / CAST(b01 + b10 AS DOUBLE) > 3.841459 THEN 'differs' ELSE '' END AS versus_best FROM m LEFT JOIN j USING (model)")
def main_table(spark: SparkSession, d: str) -> DataFrame:
    """Main results with a default for models that have no test."""
    differs = F.when(F.col("chi2") > 3.841459, "differs").otherwise("")
    tests = _against_best(preds(spark, d)).select("model", differs.alias("versus_best"))
    return _models(spark, d).join(tests, "model", "left").select("model", R6(F.col("auroc")).alias("auroc"), F.coalesce("versus_best", F.lit("")).alias("versus_best"))


@query()
def latex_table(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import latex_rows

    return latex_rows(_models(spark, d).orderBy(F.desc("auroc"), "model").select("model", F.round("auroc", 3).alias("auroc"), F.round("recall", 3).alias("recall")))


# --- models -----------------------------------------------------------------------
@query()
def tfidf_logreg(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import models

    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("row_id"), "text", F.col("toxic").alias("label"))
    rows = models.worded(rows)
    model = models.tfidf_logreg(split=False).fit(rows.where("row_id % 10 >= 3"))
    return models.probabilities(model, rows.where("row_id % 10 < 3")).select("row_id", "label", F.round("p", 4).alias("p"))


@query()
def retrieval_logreg(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval features, logistic regression and the veto; fitted on seven rows of ten, applied to the others."""
    from ..operators import models

    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("label") % 2).cast("int").alias("label"))
    f = kept(_rav(spark, d).join(own, "query_id"), "retrieval")  # read by every pass of the fit
    model = models.features_logreg([c for c in f.columns if c not in ("query_id", "label")]).fit(f.where("query_id % 10 >= 3"))
    scored = models.probabilities(model, f.where("query_id % 10 < 3"))
    return scored.select("query_id", F.round(vectors.veto(F.col("p"), F.col("margin")), 4).alias("p"))


@query()
def rules_and_features_mlp(spark: SparkSession, d: str) -> DataFrame:
    """Engineered features and rule score into a small perceptron."""
    from ..operators import models

    cols = features.engineered_features(F.col("text"))
    rows = prompts(spark, d).select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("label"), features.rule_score(F.col("text")).alias("rules"), *(c.cast("double").alias(k) for k, c in cols.items()))
    model = models.features_mlp(["rules", *cols], hidden=(8,)).fit(rows)
    return models.probabilities(model, rows).select("doc_id", "label", (F.col("p") >= 0.5).cast("int").alias("decision"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    cols = features.engineered_features(F.col("text"))
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.select(F.col("doc_id").alias("row_id"), "text", F.col("toxic").alias("label"), features.rule_score(F.col("text")).alias("rules"), *(c.cast("double").alias(k) for k, c in cols.items()))


_TRAIN, _HELD = "row_id % 10 >= 3", "row_id % 10 < 3"  # the split of ``preds``


@query()
def tfidf_svm_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Margins mapped to probabilities by three folds of the training rows; the rows scored are in neither."""
    from ..operators import models

    rows = models.worded(_labelled(spark, d).select("row_id", "text", "label"))
    model = models.cross_calibrated(models.tfidf_svm(size=2000, split=False), rows.where(_TRAIN))
    return models.probabilities(model, rows.where(_HELD)).select("row_id", "label", F.round("p", 4).alias("p"))


@query()
def ensemble_stack(spark: SparkSession, d: str) -> DataFrame:
    """Rule score and embedding in a stacked regression."""
    from ..operators import models

    rows = kept(_labelled(spark, d), "rows")  # read by every pass of the fit
    model = models.detector("ensemble").fit(rows.where(_TRAIN))
    return models.probabilities(model, rows.where(_HELD)).select("row_id", "label", F.round("p", 4).alias("p"))


@query()
def multifeature_mlp(spark: SparkSession, d: str) -> DataFrame:
    """Embedding and engineered features in a perceptron."""
    from ..operators import models

    rows = kept(_labelled(spark, d), "rows")  # read by every pass of the fit
    columns = [c for c in rows.columns if c not in ("row_id", "text", "label", "rules")]
    model = models.detector("multifeature_mlp", columns=columns, size=64, hidden=(16, 8)).fit(rows.where(_TRAIN))
    return models.probabilities(model, rows.where(_HELD)).select("row_id", "label", (F.col("p") >= 0.5).cast("int").alias("decision"))


@query()
def search_logreg(spark: SparkSession, d: str) -> DataFrame:
    """Settings of the word model, ranked on held-out rows."""
    from ..operators import models

    rows = models.worded(_labelled(spark, d).select("row_id", "text", "label"))
    grid = [{"size": 500, "reg": reg} for reg in (1e-3, 1e-1)]
    return models.search(partial(models.tfidf_logreg, split=False), grid, rows.where(_TRAIN), rows.where(_HELD)).select("trial", "settings", F.round("auprc", 4).alias("auprc"), F.round("auroc", 4).alias("auroc"))
