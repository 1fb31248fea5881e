"""Rankings, headline comparisons and table reshaping over small metric tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import curves
from .scratch import kept


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``place`` from 1. For summary tables of one row per model or group."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def variant_rank(df: DataFrame, key: str = "variant") -> DataFrame:
    """Rank by AUROC, recall (missing counts -1), over-defence, robustness and latency; last by name.

    Columns ``auroc, recall, od`` and, where present, ``robust, latency``. Missing costs
    count as the largest known, or a huge number if none is known.
    """
    low = lambda c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(-1.0)), F.lit(-1.0))
    high = lambda c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None)), F.max(F.nanvl(F.col(c).try_cast("double"), F.lit(None))).over(Window.partitionBy(F.lit(1))), F.lit(1e9))
    order = [F.desc("_auroc"), F.desc("_recall")]
    df = df.withColumn("_auroc", low("auroc")).withColumn("_recall", low("recall"))
    for c, cost in (("od", True), ("robust", False), ("latency", True)):
        if c in df.columns:
            df = df.withColumn(f"_{c}", high(c) if cost else low(c))
            order.append(F.asc(f"_{c}") if cost else F.desc(f"_{c}"))
    out = placed(df, [*order, F.asc(key)])
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def best_of(df: DataFrame, group: str, by: str, key: str = "model") -> DataFrame:
    """The row of each group with the largest ``by`` (missing counts -1), ties to the smaller ``key``."""
    w = Window.partitionBy(group).orderBy(F.desc(F.coalesce(by, F.lit(-1.0))), key)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def headline(df: DataFrame) -> DataFrame:
    """Best hybrid and best other model by AUROC, and their difference."""
    hybrid = F.col("model").startswith("HG_")
    side = lambda c: (F.max_by("model", F.when(c, F.col("auroc"))), F.max(F.when(c, F.col("auroc"))))
    (a, x), (b, y) = side(hybrid), side(~hybrid)
    return df.agg(a.alias("best_hybrid"), b.alias("best_other"), (x - y).alias("delta"))


def results_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """Size, areas, the decision metrics at each group's own ``threshold`` (a column), Brier score and calibration error."""
    hit, y = F.col("p") >= F.col("threshold"), F.col("y")
    cell = lambda label, flagged: F.sum(((y == label) & (hit == flagged)).cast("long"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    counts = curves.usable(rows).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("threshold").alias("threshold"), cell(1, True).alias("_tp"), cell(0, True).alias("_fp"), cell(1, False).alias("_fn"), F.sum(1 - y).alias("_neg"), curves.brier().alias("brier")
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    areas = curves.score_table(rows, by).groupBy(*by).agg(curves.auroc().alias("auroc"), curves.average_precision().alias("auprc"))
    out = counts.join(areas, by).join(curves.ece_main(rows, by), by)
    return out.select(
        *by, "n", "auroc", "auprc", "threshold", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(fp, F.col("_neg")).alias("realized_fpr"), "brier", "ece",
    )


def best_per_metric(df: DataFrame, metrics: Mapping[str, int], key: str = "model") -> DataFrame:
    """``metric, key, value``: where each metric is largest (direction 1, ties to the last key) or least (-1, to the first)."""
    long = df.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(m).cast("double").alias("value")) for m, up in metrics.items()))).alias("e"))
    by = F.struct(F.col("e.value"), F.col(key))
    top, low = F.max(F.when((F.col("e.up") > 0) & F.col("e.value").isNotNull(), by)), F.min(F.when((F.col("e.up") < 0) & F.col("e.value").isNotNull(), by))
    got = long.groupBy(F.col("e.metric").alias("metric")).agg(F.coalesce(top, low).alias("best"))
    return got.select("metric", F.col(f"best.{key}").alias(key), F.col("best.value").alias("value"))


def spread(df: DataFrame, group: str, metrics: tuple[str, ...], digits: int = 6) -> DataFrame:
    """Number of seeds, and mean and sample deviation (0 for one seed) of each metric."""
    each = [F.round(f, digits).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg(m)), ("std", F.coalesce(F.stddev_samp(m), F.lit(0.0))))]
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("seeds"), *each)


def recall_fold(wide: DataFrame, low: float = 1.5, high: float = 1000.0, key: str = "model") -> DataFrame:
    """Add ``fold``, canonical over perturbed recall where it lies between the limits, and ``headline`` for the largest."""
    ratio = F.try_divide(F.col("canonical"), F.col("perturbed"))
    out = wide.withColumn("fold", F.when((F.col("perturbed") > 0) & (ratio > low) & (ratio < high), ratio))
    top = out.where("fold is not null").agg(F.max(F.struct(F.round("fold", 9), F.col(key).alias("name"))).alias("_top"))
    return out.join(F.broadcast(top)).withColumn("headline", F.coalesce(F.col(key) == F.col("_top.name"), F.lit(False))).drop("_top")  # one row


def robustness_headline(drops: DataFrame) -> DataFrame:
    """One row from a table of ``model, transform, auroc, auroc_drop``: what is hardest, who stands best, who loses most."""
    rows = drops.where(F.col("transform") != "none")
    mean = lambda c: rows.groupBy(F.col(c).alias("name")).agg(F.round(F.avg("auroc"), 9).alias("m"))
    hard = mean("transform").agg(F.min(F.struct("m", "name")).alias("x")).select(F.col("x.name").alias("hardest_transform"))
    best = mean("model").agg(F.max(F.struct("m", "name")).alias("x")).select(F.col("x.name").alias("most_robust_model"))
    lost = rows.agg(F.max(F.struct(F.round("auroc_drop", 9), "model")).alias("x"), F.max("auroc_drop").alias("largest_drop"), F.avg("auroc").alias("mean_auroc"))
    one = [hard, best, lost.select(F.col("x.model").alias("largest_drop_model"), "largest_drop", "mean_auroc")]
    return reduce(lambda a, b: a.join(F.broadcast(b)), one)  # one row each


def robust_drop(grid: DataFrame) -> DataFrame:
    """AUROC lost against the untransformed run of the same model; 0 where there is none."""
    base = F.max(F.when(F.col("transform") == "none", F.col("auroc"))).over(Window.partitionBy("model"))
    return grid.withColumn("auroc_drop", F.coalesce(base, F.col("auroc")) - F.col("auroc"))


def ablation_drop(ablations: DataFrame, main: DataFrame) -> DataFrame:
    """Add the ``full_model`` row where missing, and each row's drop from it.

    The full model's AUROC is its row in ``main``, else the largest among the ablations.
    """
    first = ablations.agg(F.min("model").alias("model"), F.max("auroc").alias("top"), F.max((F.col("ablation") == "full_model").cast("int")).alias("has"))
    full = first.join(main.select("model", F.col("auroc").alias("known")), "model", "left").select("model", "has", F.coalesce("known", "top").alias("full"))
    rows = ablations.unionByName(full.where("has = 0").select(F.lit("full_model").alias("ablation"), "model", F.col("full").alias("auroc")), allowMissingColumns=True)
    return rows.join(F.broadcast(full.select("full"))).withColumn("auroc_drop", F.col("full") - F.col("auroc")).drop("full")


def seconds_to_ms(df: DataFrame, column: str) -> DataFrame:
    """Multiply a latency column by 1000 if its median is under 1."""
    median = df.agg(F.median(column).alias("_m"))
    value = F.when(F.col("_m") < 1, F.col(column) * 1000).otherwise(F.col(column))
    return df.join(F.broadcast(median)).withColumn(column, value).drop("_m")


def unpivot_fairness(wide: DataFrame) -> DataFrame:
    """Long form of worst-group columns: ``model, grp, gap``."""
    pair = lambda k: F.struct(F.concat(F.lit(f"{k}: "), F.coalesce(F.when(F.col(f"worst_{k}") != "", F.col(f"worst_{k}")), F.lit(k))).alias("grp"), F.col(f"{k}_recall_gap").alias("gap"))
    kinds = [k for k in ("lang", "len") if f"{k}_recall_gap" in wide.columns]
    return wide.select("model", F.explode(F.array(*map(pair, kinds))).alias("e")).select("model", "e.grp", "e.gap")


def explode_curves(df: DataFrame) -> DataFrame:
    """Curve arrays to one row per point: ``model, i, fpr, tpr``; a part of a curve begins at its ``first``, if it has one."""
    first = F.col("first") if "first" in df.columns else F.lit(0)
    return df.select("model", first.alias("first"), F.posexplode(F.arrays_zip("fpr", "tpr")).alias("i", "z")).select("model", (F.col("first") + F.col("i")).alias("i"), "z.fpr", "z.tpr")


def within(df: DataFrame, anchors: DataFrame, ts: str, anchor: str, seconds: int = 7200) -> DataFrame:
    """Rows within ``seconds`` of an anchor. Both sides meet in time buckets of that width, so
    this is an equi-join with at most three buckets per anchor and not a product."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = F.floor(micros(ts) / (seconds * 1_000_000))
    near = anchors.withColumn("_b", F.explode(F.array(*(F.floor(micros(anchor) / (seconds * 1_000_000)) + i for i in (-1, 0, 1)))))
    gap = F.abs(micros(ts) - micros(anchor)) / 1_000_000
    return df.withColumn("_b", bucket).join(near, "_b").drop("_b").withColumn("seconds", gap).where(F.col("seconds") <= seconds)


def or_placeholder(df: DataFrame, note: str) -> DataFrame:
    """The table with its own schema, or one row of nulls that says in ``note`` why it is empty.

    ``note`` is a column of both forms (null in the first), so the schema does not depend on the data.
    """
    if not df.isEmpty():
        return df.withColumn("note", F.lit(None).cast("string"))
    return df.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema), F.lit(note).alias("note"))


def backfill(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Add the named columns where missing, as nulls."""
    return df.select("*", *(F.lit(None).cast(kind).alias(c) for c in columns if c not in df.columns))


# The columns of the report tables, in order.
REPORT_COLUMNS = {
    "jailbreak": "model recall_at_in_domain_thr fpr_at_in_domain_thr auroc auprc n latency_s_per_sample throughput_samples_per_s",
    "robustness": "model transform auroc auprc f1 recall recall_at_1pctfpr latency_s_per_sample n",
    "overdefense": "model overdef_fpr_at_thr n latency_s_per_sample throughput_samples_per_s",
    "calibration": "model ece brier temp_T ece_temp_scaled brier_temp_scaled n_test",
    "fairness": "model worst_lang worst_lang_recall lang_recall_gap worst_len worst_len_recall len_recall_gap",
    "ablation": "model ablation auroc auprc f1 precision recall threshold_1pctfpr latency_s_total",
}
_TEXT_COLUMNS = {"model", "transform", "worst_lang", "worst_len", "ablation"}


def report_table(df: DataFrame, kind: str, note: str = "no results; see the notes of the run") -> DataFrame:
    """A table in the columns of its kind: texts and doubles, missing ones null, further ones left out.

    Without rows it is one row whose texts are N/A and whose ``note`` says why; ``note`` is
    null otherwise. Ablations with a ``status`` other than ok are left out.
    """
    if kind == "ablation" and "status" in df.columns:
        df = df.where("status = 'ok'")
    names = REPORT_COLUMNS[kind].split()
    kinds = {c: "string" if c in _TEXT_COLUMNS else "double" for c in names}
    own = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    out = or_placeholder(kept(own, f"{kind}_table"), note)  # computed once, not again to see whether it has rows
    shown = lambda c: F.when(F.col("note").isNotNull(), F.lit("N/A")).otherwise(F.col(c)) if kinds[c] == "string" else F.col(c)
    return out.select(*(shown(c).alias(c) for c in names), "note")


def naming(main: DataFrame, tests: DataFrame, own: Column, level: float = 0.05) -> DataFrame:
    """One row: the best own model, the best other one, and whether the first may be called better.

    ``main`` holds ``model, auroc``, ``tests`` one row per tested pair (``model, reference,
    p_value``). The pair may be tested in either direction; it must differ at ``level`` and
    the own area be larger. Without a test nothing is claimed; without another model (N/A is
    none) the own one stands, and ``basis`` says so. Of equal areas the last name is taken.
    """
    real = main.where(F.upper("model") != "N/A").withColumn("_own", own)
    by = F.struct(F.coalesce("auroc", F.lit(-1.0)), "model")
    side = lambda c: (F.max_by("model", F.when(c, by)), F.max(F.when(c, F.col("auroc"))))
    (chosen, x), (baseline, y) = side(F.col("_own")), side(~F.col("_own"))
    pair = real.agg(chosen.alias("chosen"), x.alias("chosen_auroc"), baseline.alias("baseline"), y.alias("baseline_auroc"))
    to = (F.col("model") == F.col("chosen")) & (F.col("reference") == F.col("baseline"))
    back = (F.col("model") == F.col("baseline")) & (F.col("reference") == F.col("chosen"))
    some = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)) == 1
    found = tests.join(F.broadcast(pair)).agg(some(to).alias("_to"), some(back).alias("_back"), F.max(F.when(to, F.col("p_value"))).alias("_p"), F.max(F.when(back, F.col("p_value"))).alias("_q"))
    none, tested = F.col("baseline").isNull(), F.col("_to") | F.col("_back")
    p = F.when(F.col("_to"), F.col("_p")).when(F.col("_back"), F.col("_q"))
    basis = F.when(none, "no baseline").when(F.col("_to"), "baseline is reference").when(F.col("_back"), "chosen is reference").otherwise("no test")
    better = tested & (p < level) & (F.col("chosen_auroc") > F.col("baseline_auroc"))
    one = pair.join(F.broadcast(found))  # one row each
    return one.select("chosen", "baseline", "chosen_auroc", "baseline_auroc", p.alias("p_value"), basis.alias("basis"), (none & F.col("chosen").isNotNull() | F.coalesce(better, F.lit(False))).alias("beats_baseline"))


def metrics_document(frames: Mapping[str, DataFrame], chosen: DataFrame, settings: Mapping[str, object]) -> DataFrame:
    """One row, ``document``: settings, the naming decision and all rows of the named report tables as nested JSON.

    For tables of one row per model and group; rows stand in the order of their columns.
    ``topline`` holds the chosen model's rows of the tables that name models.
    """
    keep = {"ignoreNullFields": "false"}
    rows = lambda df, c: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(c))
    out = chosen.select(F.struct(*(F.lit(v).alias(k) for k, v in settings.items())).alias("config"), F.struct(*chosen.columns).alias("selection"))
    for name, df in frames.items():
        out = out.join(F.broadcast(rows(df, name)))  # one row each
    mine = [n for n, df in frames.items() if "model" in df.columns]
    top = F.struct(*(F.filter(n, lambda r: r["model"] == F.col("selection.chosen")).alias(n) for n in mine))
    return out.select(F.to_json(F.struct("config", "selection", F.struct(*frames).alias("tables"), top.alias("topline")), keep).alias("document"))


def naming_decision(auroc: float, baseline: float, p_value: float | None) -> dict[str, object]:
    """Whether a variant may be called better: a significant test and a larger AUROC; no test, no claim."""
    better = p_value is not None and p_value < 0.05 and auroc > baseline
    return {"beats_baseline": better, "reason": "no test" if p_value is None else f"p={p_value:.4g}, delta={auroc - baseline:+.4f}"}


# What a report file is, by a part of its name, else by the columns that it must have.
_KIND_BY_NAME = (
    ("main_results", "main_results"), ("ablation", "ablation"), ("robust", "robustness"), ("calibration", "calibration"), ("fairness", "fairness"), ("jailbreak", "jailbreak"),
    ("overdef", "overdefense"), ("sanit", "sanitization"), ("variant_selection", "variant_selection"), ("selection_rank", "variant_selection"),
)
_KIND_BY_COLUMNS = (
    ("threshold_1pctfpr recall_at_1pctfpr", "main_results"), ("ablation", "ablation"), ("transform auroc auprc", "robustness"),
    ("ece brier", "calibration"), ("worst_lang worst_len", "fairness"), ("sanitize_mode", "sanitization"),
)


def table_kind(file_name: str, columns: list[str]) -> str:
    """The kind of a report table: its name decides, then its columns; ``generic`` if neither tells."""
    low, have = file_name.lower(), {c.lower() for c in columns}
    by_name = (kind for part, kind in _KIND_BY_NAME if part in low)
    by_columns = (kind for need, kind in _KIND_BY_COLUMNS if have.issuperset(need.split()))
    return next(by_name, None) or next(by_columns, "generic")


def is_placeholder(df: DataFrame) -> bool:
    """Whether a table only says why it has no results: by its ``note``, or by models named n/a in at most three rows."""
    if "note" not in df.columns:
        return False
    says = F.max(F.lower("note").rlike("unavailable|not loaded|run section|placeholder|see section"))
    none = F.max(F.lower(F.col("model").cast("string")).contains("n/a")) if "model" in df.columns else F.lit(False)
    got = df.agg(F.coalesce(says, F.lit(False)).alias("says"), (F.coalesce(none, F.lit(False)) & (F.count(F.lit(1)) <= 3)).alias("none")).first()
    return bool(got["says"] or got["none"])


def selection(ranked: DataFrame, key: str = "variant") -> DataFrame:
    """The chosen variant as JSON: the first place, and all places in order."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("place", key))), lambda x: x[key])  # one row a variant
    return ranked.agg(rows.alias("order")).select(F.to_json(F.struct(F.element_at("order", 1).alias("selected"), "order")).alias("selection"))
