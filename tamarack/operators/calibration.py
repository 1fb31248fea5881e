"""Calibration maps fitted on sums over distinct scores, for many models of any size at once.

Input are score tables: a row for each distinct score ``p`` of a group, with the numbers ``pos``
and ``neg`` of its labels. No group is gathered:

* Temperature and Platt maps need sums only. ``fit_maps`` reads the scores once for each round
  and advances all of them together: a bracket of 24 temperatures narrows elevenfold, a Newton
  step of the Platt map is taken or halved, and plain gradient steps of a temperature go as far
  as an interpolation of the slope through twelve points around it is exact.
* The isotonic map pools adjacent violators in each of a number of score ranges, and then where
  two ranges meet, round after round, until no ranges meet in the wrong order.
* Maps with knots are looked up by merging knots and scores in ranges, with the knots before and
  after a range carried from its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from . import curves
from .scratch import kept

CLIP, DESCENT_CLIP = 1e-7, 1e-6
LOW, HIGH, POINTS = 0.05, 10.0, 24
RATE, STEPS, FLOOR = 0.05, 200, 0.05
NODES, REACH = 12, 0.125  # slopes in [t (1 - REACH), t (1 + REACH)], interpolated: 1e-12 or better, the nearest pole is t away
PRIOR = 1e-6  # of the Platt slope
_PLACES = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_WEIGHTS = (-1.0) ** np.arange(NODES) * np.sin((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def score_counts(preds: DataFrame, by: list[str]) -> DataFrame:
    """A row for each distinct score of a group; null and NaN scores and null labels take no part."""
    return curves.usable(preds).groupBy(*by, "p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def logit(p: Column, clip: float = CLIP) -> Column:
    c = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.log(c / (1 - c))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _sums() -> list[Column]:
    """What one round needs of a score table joined with the state of its groups."""
    pos, neg, n = F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    z, soft = logit(F.col("p")), logit(F.col("p"), DESCENT_CLIP)
    losses = []
    for j in range(POINTS):
        q = sigmoid(z / (F.col("low") + (F.col("high") - F.col("low")) * (j / (POINTS - 1))))
        losses.append(F.sum(-(pos * F.log(q + CLIP) + neg * F.log(1 - q + CLIP))))
    slopes = []
    for place in _PLACES.tolist():
        t = F.col("cool") * (1 + REACH * place)
        slopes.append(F.sum((n * sigmoid(soft / t) - pos) * (-soft / (t * t))))
    line = F.col("try_a") * z + F.col("try_b")
    q = sigmoid(line)
    loss = F.sum(n * (F.greatest(line, F.lit(0.0)) + F.log1p(F.exp(-F.abs(line)))) - pos * line)
    curve = n * q * (1 - q)
    platt = [loss, F.sum((n * q - pos) * z), F.sum(n * q - pos), F.sum(curve * z * z), F.sum(curve * z), F.sum(curve)]
    return [F.array(*losses).alias("losses"), F.array(*slopes).alias("slopes"), F.array(*platt).alias("platt"), F.sum(n).alias("n")]


def _cooled(t: float, step: int, slopes: np.ndarray) -> tuple[float, int, bool]:
    """Gradient steps from ``t`` while they stay where the interpolated slope holds; new t, steps done, whether ended."""
    nodes, low, high = t * (1 + REACH * _PLACES), t * (1 - REACH), t * (1 + REACH)
    while step < STEPS:
        if not low <= t <= high:
            return t, step, False
        gap = t - nodes
        exact = np.flatnonzero(gap == 0)
        slope = slopes[exact[0]] if len(exact) else (_WEIGHTS / gap @ slopes) / (_WEIGHTS / gap).sum()
        new = max(FLOOR, t - RATE * slope)
        if abs(new - t) < 1e-6:
            return t, step, True
        t, step = new, step + 1
    return t, step, True


def _advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state of each group after a round; a row is all there is of a group here."""
    for pdf in batches:
        rows = pdf.to_dict("records")
        for r in rows:
            k = int(np.argmin(r["losses"]))
            width = (r["high"] - r["low"]) / (POINTS - 1)
            r["high"], r["low"] = min(r["high"], r["low"] + (k + 1) * width), max(r["low"], r["low"] + (k - 1) * width)
            if not r["cooled"]:
                r["cool"], r["steps"], r["cooled"] = _cooled(r["cool"], r["steps"], np.array(r["slopes"]) / max(1.0, r["n"]))
            if not r["fitted"]:
                loss, ga, gb, haa, hab, hbb = r["platt"]
                loss += PRIOR / 2 * r["try_a"] ** 2
                step = np.array([r["step_a"], r["step_b"]])
                if loss > r["loss"] and np.abs(step).max() > 1e-12:
                    step = step / 2
                else:
                    r["a"], r["b"], r["loss"] = r["try_a"], r["try_b"], loss
                    small = r["newton"] > 0 and np.abs(step).max() < 1e-9
                    r["newton"] += 1
                    r["fitted"] = bool(small or r["newton"] > 50)
                    step = np.linalg.solve([[haa + PRIOR, hab], [hab, hbb + 1e-9]], [ga + PRIOR * r["a"], gb])
                r["step_a"], r["step_b"] = map(float, step)
                r["try_a"], r["try_b"] = r["a"] - r["step_a"], r["b"] - r["step_b"]
        yield pd.DataFrame(rows, columns=pdf.columns).drop(columns=["losses", "slopes", "platt", "n"])


_STATE = {
    "low": LOW, "high": HIGH, "cool": 1.0, "steps": 0, "cooled": False,
    "a": 1.0, "b": 0.0, "try_a": 1.0, "try_b": 0.0, "step_a": 0.0, "step_b": 0.0, "loss": float("inf"), "newton": 0, "fitted": False,
}


def fit_maps(scores: DataFrame, by: list[str]) -> DataFrame:
    """``by, temperature, temperature_descent, a, b`` of each group of a score table.

    ``temperature`` has the least negative log-likelihood in [0.05, 10]; ``temperature_descent``
    is where at most 200 gradient steps of rate 0.05 from 1 end (the step that would move it
    less than 1e-6 is not taken); ``a, b`` are slope and offset of a logistic fit on logits,
    nearly without penalty. Groups of one class have maps at the ends of what is allowed.
    """
    state = kept(scores.select(*by).distinct().select(*by, *(F.lit(v).alias(c) for c, v in _STATE.items())), "state")
    scores, sums = kept(scores, "scores"), _sums()
    for _ in range(STEPS + 10):
        fresh = scores.join(state, by).groupBy(*by, *_STATE).agg(*sums)
        state = kept(fresh.mapInPandas(_advance, state.schema), "state")
        if state.where(~F.col("cooled") | ~F.col("fitted") | (F.col("high") - F.col("low") > 1e-8)).isEmpty():
            break
    return state.select(*by, ((F.col("low") + F.col("high")) / 2).alias("temperature"), F.col("cool").alias("temperature_descent"), "a", "b")


def apply_temperature(p: Column, t: Column) -> Column:
    return sigmoid(logit(p, DESCENT_CLIP) / t)


# --- isotonic regression --------------------------------------------------------------
def _pool(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[list[float]]:
    """Adjacent violators pooled: blocks ``lo, hi, sum, weight`` in order."""
    out: list[list[float]] = []
    for block in zip(lo, hi, total, weight, strict=True):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


_BLOCK = ["lo", "hi", "total", "weight"]


def _pooled(df: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Pool the blocks of each group of keys in one task; a block stays in the range ``keep`` where it begins."""

    columns = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        out = pd.DataFrame(_pool(*(pdf[c].to_numpy() for c in _BLOCK)), columns=_BLOCK)
        begins = pdf[keep].to_numpy()[np.searchsorted(pdf["lo"].to_numpy(), out["lo"].to_numpy())]
        return out.assign(**({c: pdf[c].iloc[0] for c in keys} | {keep: begins}))[columns]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def isotonic_blocks(scores: DataFrame, by: list[str], together: int = 4) -> DataFrame:
    """Blocks of the non-decreasing least-squares fit of each group: ``by, lo, hi, total, weight``.

    Scores are dealt to ranges of like sizes and pooled there. Ranges whose neighbours meet in
    the wrong order are then pooled ``together`` at a time, with other borders in each round;
    what is pooled over a border leaves fewer and shorter ranges. Rounds end when no two
    neighbours violate the order, which is the fit.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = scores.repartitionByRange(parts, *by, "p").select(
        *by, F.spark_partition_id().alias("_range"), F.col("p").alias("lo"), F.col("p").alias("hi"), F.col("pos").cast("double").alias("total"), (F.col("pos") + F.col("neg")).cast("double").alias("weight")
    )
    blocks = kept(_pooled(kept(ranges, "ranges"), [*by, "_range"], "_range"), "blocks")
    line = Window.partitionBy(*by).orderBy("_range")
    for turn in range(1000):
        first, last = (f(F.struct("lo", "total", "weight"), F.col("lo")) for f in (F.min_by, F.max_by))
        ends = blocks.groupBy(*by, "_range").agg(first.alias("first"), last.alias("last"))  # a row for each range
        ends = ends.withColumn("_place", F.row_number().over(line)).withColumn("_before", F.lag("last").over(line))
        wrong = F.coalesce(F.col("_before.total") * F.col("first.weight") >= F.col("first.total") * F.col("_before.weight"), F.lit(False))
        ends = kept(ends.select(*by, "_range", wrong.alias("_wrong"), F.floor((F.col("_place") + turn % 2 * (together // 2)) / together).alias("_team")), "ends")
        if ends.where("_wrong").isEmpty():
            return blocks.drop("_range")
        in_team = F.max(F.col("_wrong")).over(Window.partitionBy(*by, "_team"))  # also where the wrong border is to the team before: no harm
        teams = blocks.join(ends.withColumn("_busy", in_team).drop("_wrong"), [*by, "_range"])
        busy = _pooled(teams.where("_busy").drop("_busy"), [*by, "_team"], "_range")
        blocks = kept(busy.drop("_team").unionByName(teams.where("not _busy").drop("_busy", "_team")), "blocks")
    raise RuntimeError("ranges did not settle")


def look_up(scores: DataFrame, blocks: DataFrame, by: list[str], column: str = "p", out: str = "q") -> DataFrame:
    """Add the isotonic map of ``column``: a block's mean inside it, straight lines between blocks, the end blocks' means outside.

    Scores and blocks are merged in ranges; what lies before and after a range comes from the
    ranges beside it. Null where a group has no block.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in scores.columns if c not in by]
    knot = F.struct("lo", "hi", (F.col("total") / F.col("weight")).alias("v"))
    left = scores.select(*by, F.col(column).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_row"), F.lit(None).cast("struct<lo:double,hi:double,v:double>").alias("_knot"))
    right = blocks.select(*by, F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), knot.alias("_knot"))
    dealt = kept(left.unionByName(right).repartitionByRange(parts, *by, "_at").withColumn("_range", F.spark_partition_id()), "merged")
    up, down = Window.partitionBy(*by).orderBy("_range"), Window.partitionBy(*by).orderBy(F.desc("_range"))
    others = (Window.unboundedPreceding, -1)
    ends = dealt.where("_knot is not null").groupBy(*by, "_range").agg(F.max_by("_knot", "_at").alias("_last"), F.min_by("_knot", "_at").alias("_first"))
    ranges = dealt.select(*by, "_range").distinct().join(ends, [*by, "_range"], "left")  # a row for each range
    carried = ranges.select(*by, "_range", F.last("_last", True).over(up.rowsBetween(*others)).alias("_past"), F.last("_first", True).over(down.rowsBetween(*others)).alias("_coming"))
    one = Window.partitionBy(*by, "_range")
    before = F.last("_knot", True).over(one.orderBy("_at", "_kind"))
    after = F.last("_knot", True).over(one.orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(*others))  # a frame that grows from one end costs a step a row
    rows = dealt.withColumns({"_b": before, "_a": after}).where("_kind = 1").join(carried, [*by, "_range"])
    rows = rows.withColumns({"_b": F.coalesce("_b", "_past"), "_a": F.coalesce("_a", "_coming")})
    b, a, at = F.col("_b"), F.col("_a"), F.col("_at")
    between = b["v"] + (a["v"] - b["v"]) * (at - b["hi"]) / (a["lo"] - b["hi"])
    q = F.when(b.isNull(), a["v"]).when((at <= b["hi"]) | a.isNull(), b["v"]).otherwise(between)
    return rows.select(*by, *(F.col("_row")[c].alias(c) for c in rest), q.alias(out))


# --- the choice -----------------------------------------------------------------------
def _quality(scores: DataFrame, by: list[str], q: str) -> DataFrame:
    """Standard calibration error and Brier score of mapped scores ``q``, by groups."""
    v, n = F.col(q), F.col("pos") + F.col("neg")
    conf = F.greatest(v, 1 - v)
    right = F.when(v >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    per = scores.groupBy(*by, curves._bin(conf, fixed.ECE_BINS).alias("_bin")).agg(
        F.sum(n).alias("n"), F.sum(n * conf).alias("c"), F.sum(right).alias("r"), F.sum(F.col("pos") * F.pow(1 - v, 2) + F.col("neg") * F.pow(v, 2)).alias("s")
    )
    return per.groupBy(*by).agg((F.sum(F.abs(F.col("r") - F.col("c"))) / F.sum("n")).alias("ece"), (F.sum("s") / F.sum("n")).alias("brier"))


METHODS = ("isotonic", "platt", "temperature")


def best_calibration(preds: DataFrame, by: list[str], split: str = "split") -> DataFrame:
    """Temperature, Platt and isotonic maps fitted on ``val``, the best of them by the standard
    calibration error there (ties: by name), and that error and the Brier score before and after, on
    ``val`` and on ``test``. Groups without ``val`` rows are left out; without ``test`` rows they have nulls there.
    """
    scores = kept(score_counts(preds.where(F.col(split).isin("val", "test")), [*by, split]), "all_scores")
    val = scores.where(F.col(split) == "val").drop(split)
    maps = fit_maps(val, by)
    isotonic = look_up(scores, isotonic_blocks(val, by), by, out="isotonic").join(maps, by)
    mapped = isotonic.select(*by, split, "p", "pos", "neg", "isotonic", sigmoid(F.col("a") * logit(F.col("p")) + F.col("b")).alias("platt"), sigmoid(logit(F.col("p")) / F.col("temperature")).alias("temperature"))
    each = [F.struct(F.lit(m).alias("method"), F.col(c).alias("q")) for m, c in (("none", "p"), *((m, m) for m in METHODS))]
    long = mapped.select(*by, split, "pos", "neg", F.explode(F.array(*each)).alias("m")).select(*by, split, "pos", "neg", "m.method", "m.q")
    quality = kept(_quality(long, [*by, split, "method"], "q"), "quality")
    chosen = quality.where((F.col(split) == "val") & (F.col("method") != "none")).groupBy(*by).agg(F.min(F.struct("ece", "method"))["method"].alias("best"))
    told = quality.join(chosen, by).where(F.col("method").isin("none") | (F.col("method") == F.col("best")))
    cell = lambda s, raw, c: F.max(F.when((F.col(split) == s) & ((F.col("method") == "none") if raw else (F.col("method") == F.col("best"))), F.col(c)))
    cells = [cell(s, raw, c).alias(f"{s}_{c}" + ("" if raw else "_best")) for s in ("val", "test") for c in ("ece", "brier") for raw in (True, False)]
    out = told.groupBy(*by, F.col("best").alias("method")).agg(*cells)
    return out.join(maps.select(*by, "temperature", "temperature_descent", "a", "b"), by)
