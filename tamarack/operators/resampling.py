"""Bootstrap intervals with resamples that all models share, and p-values.

A row's weight in a replicate is Poisson(1), read from the MD5 of seed, row key and replicate:
it depends on nothing else, so every model sees the same resample wherever its rows lie, and
differences between models are paired. A replicate is never listed row by row. Rows are dealt
to score ranges, and a range is up to three segments: its first score, its last score, and
what lies between. Segments add up their weights for all replicates at once, and running sums
over segments give what lies above each. A score that fills many ranges is one segment, for
which these sums are enough; the rows between are read once more, with what lies above them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from . import curves
from .scratch import kept

#: A 16-bit draw u gives as many as there are bounds at or under it: floor(65536 * P(X <= k)) of a Poisson variable of mean 1.
BOUNDS = [math.floor(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]
PER_DIGEST = 8


def weights(keys: list[object], n_boot: int, seed: int) -> np.ndarray:
    """A row of ``n_boot`` weights for each key: the 16-bit groups of the MD5 of ``seed:key:block``, eight to a block."""
    blocks = range(-(-n_boot // PER_DIGEST))
    raw = b"".join(md5(f"{seed}:{k}:{b}".encode()).digest() for k in keys for b in blocks)
    draws = np.frombuffer(raw, ">u2").reshape(len(keys), -1)[:, :n_boot]
    return np.searchsorted(BOUNDS, draws, side="right").astype(np.int64)


METRICS = ("auroc", "auprc", "recall", "f1")


def replicates(preds: DataFrame, by: list[str], n_boot: int = 200, seed: int = 1337, key: str = "row_id", target: float = 0.01, batch: int = 4096) -> DataFrame:
    """``by, rep`` and AUROC, average precision, best recall within a false-positive rate of ``target``, and F1 at one half.

    Rows of like ``key`` have like weights in every group of ``by``. Tied scores count as ties.
    Null where a replicate holds one class only; F1 is 0 without a hit. Null and NaN scores and
    null labels take no part. A group or a score of any size is read in ranges, ``batch`` rows
    at a time; only sums by range and replicate are brought together.
    """
    parts = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = curves.usable(preds).select(*by, F.col(key).cast("string").alias("_key"), "y", "p")
    dealt = rows.repartitionByRange(parts, *by, F.desc("p"), F.xxhash64("_key")).withColumn("_range", F.spark_partition_id())
    dealt = kept(dealt.sortWithinPartitions(*by, F.desc("p")), "ranges")
    ends = dealt.groupBy(*by, "_range").agg(F.max("p").alias("_first"), F.min("p").alias("_last"))  # a row for each range and group
    between = (F.col("p") < F.col("_first")) & (F.col("p") > F.col("_last"))
    dealt = dealt.join(ends, [*by, "_range"]).select(*by, "_key", "y", "p", F.when(between, F.col("_first")).otherwise(F.col("p")).alias("_from"), between.alias("_between"))
    names = [*by, "_from", "_between"]
    kinds = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in names)
    counted = ("pos", "neg", "tp5", "fp5")

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k, part in pdf.groupby(names, dropna=False, sort=False):
                total = np.zeros((4, n_boot), np.int64)
                for at in range(0, len(part), batch):
                    cut = part.iloc[at : at + batch]
                    w, y, hit = weights(cut["_key"].tolist(), n_boot, seed), cut["y"].to_numpy(), cut["p"].to_numpy() >= 0.5
                    for i, mask in enumerate((y == 1, y == 0, (y == 1) & hit, (y == 0) & hit)):
                        total[i] += w[mask].sum(0)
                yield pd.DataFrame([[*k, *(x.tolist() for x in total)]], columns=[*names, *counted])

    arrays = ", ".join(f"{c} array<long>" for c in counted)
    each = dealt.mapInPandas(sums, f"{kinds}, {arrays}").select(*names, F.posexplode(F.arrays_zip(*counted)).alias("rep", "s"))
    each = each.groupBy(*names, "rep").agg(*(F.sum(f"s.{c}").alias(c) for c in counted))  # a row for each segment and replicate
    down, all_ = Window.partitionBy(*by, "rep").orderBy(F.desc("_from"), "_between"), Window.partitionBy(*by, "rep")
    above = each.select(
        *names, "rep", "pos", "neg",
        (F.sum("pos").over(down) - F.col("pos")).alias("tp"), (F.sum("neg").over(down) - F.col("neg")).alias("fp"),
        *(F.sum(c).over(all_).alias(n) for c, n in (("pos", "n_pos"), ("neg", "n_neg"), ("tp5", "tp5"), ("fp5", "fp5"))),
    )
    above = kept(above, "above")
    fields = ("tp", "fp", "n_pos", "n_neg")
    carried = above.where("_between").groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("rep", *fields))).alias("above"))  # as many as there are replicates
    carried = carried.select(*names, *(F.col("above")[c].alias(c) for c in fields))

    def walk(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", ascending=False, kind="stable")
        tp, fp, n_pos, n_neg = (np.array(carry[c].iloc[0], np.int64) for c in fields)
        wins, ap, best = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)
        p = pdf["p"].to_numpy()
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        ends = np.r_[starts[1:], len(p)]
        k = 0
        while k < len(starts):
            last = max(k, int(np.searchsorted(ends, starts[k] + batch, side="right")) - 1)  # whole scores, about a batch of rows
            pos, neg = np.zeros((last - k + 1, n_boot), np.int64), np.zeros((last - k + 1, n_boot), np.int64)
            for low in range(starts[k], ends[last], batch):
                cut = pdf.iloc[low : min(ends[last], low + batch)]
                w = weights(cut["_key"].tolist(), n_boot, seed)
                at = np.searchsorted(starts[k : last + 1], np.arange(low, low + len(cut)), side="right") - 1
                y = cut["y"].to_numpy()[:, None]
                np.add.at(pos, at, w * y)
                np.add.at(neg, at, w * (1 - y))
            up_pos, up_neg = tp + np.cumsum(pos, 0), fp + np.cumsum(neg, 0)
            wins += (pos * (n_neg - up_neg + neg / 2)).sum(0)
            ap += (pos * up_pos / np.maximum(up_pos + up_neg, 1)).sum(0)
            best = np.maximum(best, np.where(up_neg <= target * n_neg, up_pos, 0).max(0))
            tp, fp, k = up_pos[-1], up_neg[-1], last + 1
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in names), wins.tolist(), ap.tolist(), best.tolist()]], columns=[*names, "wins", "ap", "best"])

    walked = dealt.where("_between").groupBy(*names).cogroup(carried.groupBy(*names)).applyInPandas(walk, f"{kinds}, wins array<double>, ap array<double>, best array<double>")
    inner = walked.select(*by, F.posexplode(F.arrays_zip("wins", "ap", "best")).alias("rep", "s")).select(*by, "rep", "s.*")
    up_pos, up_neg = F.col("tp") + F.col("pos"), F.col("fp") + F.col("neg")
    single = above.where("not _between").select(
        *by, "rep", (F.col("pos") * (F.col("n_neg") - up_neg + F.col("neg") / 2)).alias("wins"), (F.col("pos") * up_pos / F.greatest(up_pos + up_neg, F.lit(1))).alias("ap"),
        F.when(up_neg <= F.lit(target) * F.col("n_neg"), up_pos).otherwise(0).cast("double").alias("best"),
    )
    parts_of = inner.unionByName(single).groupBy(*by, "rep").agg(F.sum("wins").alias("wins"), F.sum("ap").alias("ap"), F.max("best").alias("best"))
    whole = above.groupBy(*by, "rep").agg(*(F.first(c).alias(c) for c in ("n_pos", "n_neg", "tp5", "fp5")))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    of = lambda c: F.when(both, c)
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    f1 = F.when(F.col("tp5") > 0, 2 * F.col("tp5") / (n_pos + F.col("tp5") + F.col("fp5"))).otherwise(0.0)
    return parts_of.join(whole, [*by, "rep"]).select(
        *by, "rep", of(F.try_divide("wins", n_pos * n_neg)).alias("auroc"), of(F.try_divide("ap", n_pos)).alias("auprc"), of(F.try_divide("best", n_pos)).alias("recall"), of(f1).alias("f1")
    )


def intervals(reps: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """``<metric>_low, <metric>_high`` of each group over its replicates."""
    ends = [F.percentile(m, q).alias(f"{m}_{e}") for m in METRICS for e, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2))]
    return reps.groupBy(*by).agg(*ends)


def bootstrap_ci(preds: DataFrame, by: list[str], n_boot: int = 200, seed: int = 1337, key: str = "row_id") -> DataFrame:
    """2.5 and 97.5 percentiles of AUROC, average precision, recall at 1 % false positives and F1."""
    return intervals(replicates(preds, by, n_boot, seed, key), by)


def bootstrap_paired(reps: DataFrame, reference: DataFrame, model: str = "model", level: float = 0.95) -> DataFrame:
    """Intervals of each model's difference to its reference (columns ``model, reference``) over shared replicates.

    ``<metric>_diff_low, _diff_high``, and ``<metric>_wins``: the share of replicates in which
    the model is ahead. Replicates without a value on either side take no part.
    """
    a = reps.join(reference, model).where(F.col(model) != F.col("reference"))
    b = reps.select(F.col(model).alias("reference"), "rep", *(F.col(m).alias(f"_{m}") for m in METRICS))
    both = a.join(b, ["reference", "rep"])
    told = []
    for m in METRICS:
        gap = F.col(m) - F.col(f"_{m}")
        told += [F.percentile(gap, (1 - level) / 2).alias(f"{m}_diff_low"), F.percentile(gap, (1 + level) / 2).alias(f"{m}_diff_high"), F.avg((F.round(gap, 9) > 0).cast("int")).alias(f"{m}_wins")]
    return both.groupBy(model, "reference").agg(*told)


def poisson_bootstrap(preds: DataFrame, by: list[str], n_boot: int = 50, seed: int = 7) -> DataFrame:
    """2.5 and 97.5 percentiles of AUROC and average precision by Poisson weights, for models of any size.

    Rows are first counted by score and label. The weight of such a group of c rows in a
    replicate is Poisson(c), the sum of its rows' Poisson(1) weights; it is drawn from a
    generator seeded by group, score and label, so draws need no order and no task holds a
    model. Replicates are score tables of their own.
    """
    counts = curves.usable(preds).groupBy(*by, "p", "y").agg(F.count(F.lit(1)).alias("rows")).withColumn("_seed", F.xxhash64(*by, "p", "y", F.lit(seed)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                many = np.stack([np.random.default_rng([s & (2**63 - 1), int(s < 0)]).poisson(n, n_boot) for s, n in zip(part["_seed"], part["rows"], strict=True)])
                i, rep = np.nonzero(many)
                out = part.iloc[i][[*by, "p", "y"]].reset_index(drop=True)
                yield out.assign(rep=rep.astype("int32"), w=many[i, rep].astype("int64"))

    schema = ", ".join([f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in (*by, "p", "y")] + ["rep int", "w long"])
    drawn = counts.mapInPandas(draw, schema)
    scores = drawn.groupBy(*by, "rep", "p").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"))
    per = curves.cumulated(scores, [*by, "rep"]).groupBy(*by, "rep").agg(curves.auroc().alias("auroc"), curves.average_precision().alias("auprc"))
    ends = [F.percentile(m, q).alias(f"{m}_{e}") for m in ("auroc", "auprc") for e, q in (("low", 0.025), ("high", 0.975))]  # n_boot values a group
    return per.groupBy(*by).agg(*ends)


@F.pandas_udf(DoubleType())
def chi2_p_value(chi2: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return chi2.map(lambda x: None if x is None or x != x else math.erfc(math.sqrt(x / 2)))
