"""Threshold curves and the metrics read off them, for many models at once.

Input is a prediction table with integer ``y``, double ``p`` and grouping columns ``by``
(dataset, model, transform ...). Rows are first reduced to one per distinct score, so ties
are exact, and sums run over scores in two levels: over at most a million score cells, and
inside a cell. Cells are of equal width in log odds, so that the scores of a saturated model,
near 0 and 1, are spread over many. A single model of any size never sorts in one task. Null ``p``, NaN
``p`` and null ``y`` rows take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed

CELLS, REACH = 1 << 20, 40.0


def usable(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("y").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p"))


def score_table(preds: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct score, from high to low: ``pos, neg``, running ``tp, fp`` and totals ``n_pos, n_neg``."""
    return cumulated(score_counts(preds, by), by)


def score_counts(preds: DataFrame, by: list[str]) -> DataFrame:
    """``pos, neg`` per distinct score ``p``."""
    return usable(preds).groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def cell(p: Column) -> Column:
    """Number of a score's cell, which never falls as the score rises."""
    odds = F.when(p <= 0, -REACH).when(p >= 1, REACH).otherwise(F.log(F.try_divide(p, 1 - p)))
    return F.floor((F.greatest(F.lit(-REACH), F.least(F.lit(REACH), odds)) + REACH) / (2 * REACH) * CELLS).cast("int")


def cumulated(scores: DataFrame, by: list[str]) -> DataFrame:
    """A score table from ``pos`` and ``neg`` per distinct score."""
    scores = scores.withColumn("_b", cell(F.col("p")))
    buckets = scores.groupBy(*by, "_b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    down, whole = Window.partitionBy(*by).orderBy(F.desc("_b")), Window.partitionBy(*by)
    above = buckets.select(
        *by, "_b",
        (F.sum("bp").over(down) - F.col("bp")).alias("ap"), (F.sum("bn").over(down) - F.col("bn")).alias("an"),
        F.sum("bp").over(whole).alias("n_pos"), F.sum("bn").over(whole).alias("n_neg"),
    )
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc("p"))
    joined = scores.join(above, [*by, "_b"])
    tp, fp = F.col("ap") + F.sum("pos").over(inside), F.col("an") + F.sum("neg").over(inside)
    return joined.select(*by, "p", "pos", "neg", tp.alias("tp"), fp.alias("fp"), "n_pos", "n_neg")


def _both(value: Column) -> Column:
    """A value that needs both classes."""
    return F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), value)


def auroc() -> Column:
    """Tie-aware Mann-Whitney area, to aggregate a score table; null with one class."""
    wins = F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2))
    return _both(F.try_divide(wins, F.max("n_pos") * F.max("n_neg")))


def average_precision() -> Column:
    return _both(F.sum(F.try_divide(F.col("pos"), F.col("n_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))))


def recall_at_fpr_roc(target: float = 0.01) -> Column:
    """Best recall among thresholds whose false-positive rate is within the target."""
    within = F.when(F.try_divide(F.col("fp"), F.col("n_neg")) <= target, F.try_divide(F.col("tp"), F.col("n_pos")))
    return _both(F.coalesce(F.max(within), F.lit(0.0)))


def first_threshold(target: float = 0.01) -> tuple[Column, Column]:
    """Threshold and recall at the first score, from the top, within the target: the top score or none."""
    top = F.max_by(F.struct("p", "pos", "neg", "n_pos", "n_neg"), F.col("p"))
    fine = top["neg"] / F.greatest(top["n_neg"], F.lit(1)) <= target
    recall = F.when(top["n_pos"] > 0, top["pos"] / top["n_pos"]).otherwise(0.0)
    return F.when(fine, top["p"]).otherwise(1.0), F.when(fine, recall).otherwise(0.0)


def curve_metrics(preds: DataFrame, by: list[str]) -> DataFrame:
    """AUROC, average precision and the two score-level recalls of each group."""
    threshold, recall = first_threshold()
    return score_table(preds, by).groupBy(*by).agg(
        auroc().alias("auroc"), average_precision().alias("auprc"), recall_at_fpr_roc().alias("recall_roc"), recall.alias("recall_first"), threshold.alias("threshold_first")
    )


def recall_at_fpr_cum(preds: DataFrame, by: list[str], target: float = 0.01, key: str = "row_id") -> DataFrame:
    """Row-wise cumulative form: the last row, by falling score, at which the running
    false-positive rate is within the target sets the threshold; recall counts all rows at
    or over it, so ties may push the realised rate over the target. Tied rows go by ``key``.
    Columns ``threshold, recall``; null with one class, recall 0 where no row qualifies.

    Running counts at a score bound those of its rows, so only the rows of one tied score
    per group - the first whose negatives would pass the target - are looked at singly.
    """
    scores = score_table(preds, by)
    limit = F.floor(F.lit(target) * F.col("n_neg"))
    exact = F.when(F.try_divide(limit + 1, F.col("n_neg")) <= target, limit + 1).otherwise(limit)
    marked = scores.withColumn("allowed", exact).withColumn("before", F.col("fp") - F.col("neg"))
    whole = marked.where("fp <= allowed").groupBy(*by).agg(F.min("p").alias("low"))
    split = marked.where("fp > allowed and before <= allowed").select(*by, F.col("p").alias("edge"), (F.col("allowed") - F.col("before")).alias("left"))
    lead = usable(preds).join(split, by).where("p = edge").groupBy(*by, "edge", "left").agg(F.min_by("y", key).alias("lead"))
    takes = lead.where("left > 0 or lead = 1").select(*by, F.col("edge").alias("low2"))
    groups = scores.groupBy(*by).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    tau = groups.join(whole, by, "left").join(takes, by, "left").withColumn("threshold", F.coalesce("low2", "low"))
    hit = scores.join(tau.select(*by, "threshold"), by).where("p >= threshold").groupBy(*by).agg(F.sum("pos").alias("hits"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return tau.join(hit, by, "left").select(
        *by, F.when(both, F.col("threshold")).alias("threshold"), F.when(both, F.coalesce("hits", F.lit(0)) / F.col("n_pos")).alias("recall")
    )


def roc_points(preds: DataFrame, by: list[str]) -> DataFrame:
    t = score_table(preds, by)
    return t.select(*by, "p", F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"), F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def roc_points_thin(preds: DataFrame, by: list[str]) -> DataFrame:
    """``by, p, fpr, tpr, precision`` of the points where the curve bends, and of both ends.

    A point goes if the step to it and the step from it add the same numbers of either class:
    the area under what stays is that of the whole curve. The next step of a cell's last
    score is the first one of the next cell that has scores.
    """
    t = score_table(preds, by).withColumn("_b", cell(F.col("p")))
    step = F.struct("pos", "neg")
    firsts = t.groupBy(*by, "_b").agg(F.max_by(step, "p").alias("_first"))
    coming = firsts.select(*by, "_b", F.lead("_first").over(Window.partitionBy(*by).orderBy(F.desc("_b"))).alias("_coming"))
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc("p"))
    after = F.coalesce(F.lead(step).over(inside), F.col("_coming"))
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    bends = t.join(coming, [*by, "_b"]).withColumn("_after", after).where(first | F.col("_after").isNull() | (F.col("_after") != step))
    tp, fp = F.col("tp"), F.col("fp")
    return bends.select(*by, "p", F.try_divide(fp, F.col("n_neg")).alias("fpr"), F.try_divide(tp, F.col("n_pos")).alias("tpr"), (tp / (tp + fp)).alias("precision"))


def trapezoid_pr_area(preds: DataFrame, by: list[str]) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from (0, 1)."""
    t = score_table(preds, by)
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")  # the point before: all higher scores
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    return t.groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), F.col("n_pos")) * (precision + before) / 2).alias("pr_area"))


def tuned_threshold(preds: DataFrame, by: list[str], target: float = 0.01, rule: str = "first", split: str = "split", use: str = "val") -> DataFrame:
    """``by, threshold``: a threshold for each group, chosen on one split to be carried to another.

    By ``first`` it is the top score if that keeps the false-positive rate within the
    target, by ``roc`` the lowest score that does; 1 where no score does.
    """
    t = score_table(preds.where(F.col(split) == use), by)
    if rule == "first":
        return t.groupBy(*by).agg(first_threshold(target)[0].alias("threshold"))
    within = F.when(F.try_divide(F.col("fp"), F.greatest("n_neg", F.lit(1))) <= target, F.col("p"))
    return t.groupBy(*by).agg(F.coalesce(F.min(within), F.lit(1.0)).alias("threshold"))


def rates(threshold: Column) -> tuple[Column, Column]:
    """Recall and realised false-positive rate at a threshold, to aggregate predictions; null without such rows."""
    hit = (F.col("p") >= threshold).cast("int")
    return F.avg(F.when(F.col("y") == 1, hit)), F.avg(F.when(F.col("y") == 0, hit))


def confusion(preds: DataFrame, by: list[str], threshold: Column | float = 0.5) -> DataFrame:
    hit = (F.col("p") >= threshold).cast("int")
    cell = lambda y, h: F.sum(F.when((F.col("y") == y) & (hit == h), 1).otherwise(0)).cast("long")
    return usable(preds).groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))


def prf(preds: DataFrame, by: list[str], threshold: Column | float = 0.5) -> DataFrame:
    """Precision, recall and F1 at a threshold; 0 where undefined."""
    c = confusion(preds, by, threshold)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def brier() -> Column:
    return F.avg(F.pow(F.col("p") - F.col("y"), 2))


def _bin(v: Column, bins: int) -> Column:
    """The number of inner bounds i/bins at or under a value."""
    out = F.lit(0)
    for i in range(1, bins):
        out = out + (v >= i / bins).cast("int")
    return out


def _ece(preds: DataFrame, by: list[str], conf: Column, right: Column, bins: int) -> DataFrame:
    rows = usable(preds).select(*by, conf.alias("conf"), right.alias("right"))
    per = rows.groupBy(*by, _bin(F.col("conf"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("c"), F.avg("right").alias("a"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def ece_main(preds: DataFrame, by: list[str], bins: int = fixed.ECE_BINS) -> DataFrame:
    """Bins on p, against the accuracy of thresholding at one half (confident negatives look badly calibrated)."""
    return _ece(preds, by, F.col("p"), ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double"), bins)


def ece_confidence(preds: DataFrame, by: list[str], bins: int = fixed.ECE_BINS) -> DataFrame:
    """The usual form: bins on the confidence of the predicted class."""
    return _ece(preds, by, F.greatest("p", 1 - F.col("p")), ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double"), bins)


def fairness_gap(preds: DataFrame, by: list[str], group: str, threshold: Column | float = 0.5, least: int = fixed.MIN_GROUP) -> DataFrame:
    """Worst group and recall gap over groups of at least ``least`` rows; an empty name, null and 0 with fewer than two."""
    hits = F.sum(F.when((F.col("y") == 1) & (F.col("p") >= threshold), 1).otherwise(0))
    pos = F.sum("y")
    per = usable(preds).groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.when(pos > 0, hits / pos).otherwise(0.0).alias("recall")).where(F.col("n") >= least)
    worst = F.min_by(group, F.struct("recall", -F.col("n"), group))
    many = F.count(F.lit(1)) >= 2
    got = per.groupBy(*by).agg(
        F.when(many, worst).otherwise("").alias("worst"), F.when(many, F.min("recall")).alias("worst_recall"), F.when(many, F.max("recall") - F.min("recall")).otherwise(0.0).alias("gap")
    )
    out = preds.select(*by).distinct().join(got, by, "left")
    return out.select(*by, F.coalesce("worst", F.lit("")).alias("worst"), "worst_recall", F.coalesce("gap", F.lit(0.0)).alias("gap"))


def mcnemar(preds: DataFrame, model: str, reference: DataFrame, key: str = "row_id") -> DataFrame:
    """Each model against its reference (columns ``model, reference``): discordant counts and corrected chi-square.

    ``b01`` counts rows where only the model errs not, ``b10`` rows where only the reference
    errs not. Each model decides at its own ``threshold`` (a column), or at 0.5 without one.
    """
    threshold = F.col("threshold") if "threshold" in preds.columns else F.lit(0.5)
    right = usable(preds).select(model, key, ((F.col("p") >= threshold).cast("int") == F.col("y")).alias("ok"))
    a = right.join(reference, model).where(F.col(model) != F.col("reference"))
    b = right.select(F.col(model).alias("reference"), key, F.col("ok").alias("ref_ok"))
    n01 = F.sum(F.when(F.col("ok") & ~F.col("ref_ok"), 1).otherwise(0)).cast("long")
    n10 = F.sum(F.when(~F.col("ok") & F.col("ref_ok"), 1).otherwise(0)).cast("long")
    got = a.join(b, ["reference", key]).groupBy(model, "reference").agg(n01.alias("b01"), n10.alias("b10"))
    total = F.col("b01") + F.col("b10")
    chi2 = F.when(total > 0, F.pow(F.abs(F.col("b01") - F.col("b10")) - 1, 2) / total).otherwise(0.0)
    return got.withColumn("chi2", chi2)
