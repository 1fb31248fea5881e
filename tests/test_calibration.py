"""Distributed calibration against plain numpy forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamarack.operators import calibration

from . import kernels


def models():
    rng = np.random.default_rng(7)
    z = rng.normal(0, 2, 6000)
    y = (rng.random(6000) < kernels.sigmoid(z)).astype(int)
    out = {
        "sharp": (y, kernels.sigmoid(3 * z)),
        "ties": (y, np.round(kernels.sigmoid(0.5 * z), 2)),
        "saturated": (y, np.where(rng.random(6000) < 0.7, 1 - 1e-4 * rng.random(6000), kernels.sigmoid(z))),
        "falling": (1 - y, np.round(kernels.sigmoid(z), 3)),
        "rising": ((np.arange(3000) >= 1500).astype(int), np.arange(3000) / 3000),
        "steps": ((np.arange(4000) // 7 % 2 ^ (np.arange(4000) > 2000)).astype(int), np.arange(4000) / 4001),
        "small": (np.array([0, 1, 1]), np.array([0.2, 0.2, 0.9])),
        "ends": (np.array([0, 1, 0, 1, 1]), np.array([0.0, 0.0, 1.0, 1.0, 1.0])),
    }
    return out


@pytest.fixture(scope="module")
def preds(spark):
    rows = [pd.DataFrame({"model": m, "split": np.where(np.arange(len(y)) % 3 == 2, "test", "val"), "y": y, "p": p}) for m, (y, p) in models().items()]
    df = spark.createDataFrame(pd.concat(rows), "model string, split string, y int, p double")
    odd = spark.createDataFrame([("sharp", "val", None, 0.5), ("sharp", "val", 1, None), ("sharp", "test", 0, float("nan"))], df.schema)
    return df.unionByName(odd).repartition(5)


def halves():
    for m, (y, p) in models().items():
        test = np.arange(len(y)) % 3 == 2
        yield m, y[~test], p[~test], y[test], p[test]


def test_maps(spark, preds):
    scores = calibration.score_counts(preds.where("split = 'val'"), ["model"])
    got = {r.model: r for r in calibration.fit_maps(scores, ["model"]).collect()}
    for m, y, p, _, _ in halves():
        r = got[m]
        assert r.temperature_descent == pytest.approx(kernels.temperature_by_descent(y, p), rel=1e-9), m
        assert r.temperature == pytest.approx(kernels.temperature_by_search(y, p), rel=1e-5, abs=1e-6), m
        if m not in ("rising", "small"):  # the two sides can be parted there, so that the slope only meets its slight penalty
            assert (r.a, r.b) == pytest.approx(kernels.platt(y, p), rel=1e-7, abs=1e-9), m


def test_isotonic(spark, preds):
    scores = calibration.score_counts(preds.where("split = 'val'"), ["model"])
    blocks = calibration.isotonic_blocks(scores, ["model"], together=2)
    got = blocks.toPandas().sort_values("lo")
    for m, y, p, _, _ in halves():
        xs, ys = kernels.isotonic(y, p)
        mine = got[got.model == m]
        at = np.searchsorted(mine.lo.to_numpy(), xs, side="right") - 1
        assert np.abs((mine.total / mine.weight).to_numpy()[at] - ys).max() < 1e-12, m
        assert (mine.hi.to_numpy()[at] >= xs).all()
    asked = spark.createDataFrame([(m, float(q), i) for m in models() for i, q in enumerate(np.r_[-0.5, np.linspace(0, 1, 101), 1.5])] + [("none", 0.5, 0)], "model string, p double, i int")
    out = calibration.look_up(asked, blocks, ["model"]).toPandas().sort_values("i")
    assert out[out.model == "none"].q.isna().all()
    for m, y, p, _, _ in halves():
        mine = out[out.model == m]
        assert np.abs(mine.q.to_numpy() - np.interp(mine.p, *kernels.isotonic(y, p))).max() < 1e-12, m


def test_best(spark, preds):
    got = {r.model: r for r in calibration.best_calibration(preds, ["model"]).collect()}
    for m, y, p, w, q in halves():
        r = got[m]
        t, (a, b), knots = r.temperature, (r.a, r.b), kernels.isotonic(y, p)
        maps = {
            "temperature": lambda x, t=t: kernels.sigmoid(kernels.logits(x, 1e-7) / t),
            "platt": lambda x, a=a, b=b: kernels.sigmoid(a * kernels.logits(x, 1e-7) + b),
            "isotonic": lambda x, k=knots: np.interp(x, *k),
        }
        errors = {k: kernels.ece_std(y, f(p)) for k, f in maps.items()}
        assert errors[r.method] == pytest.approx(min(errors.values()), abs=1e-9), m
        best = maps[r.method]
        want = {"val_ece": kernels.ece_std(y, p), "val_ece_best": errors[r.method], "test_ece": kernels.ece_std(w, q), "test_ece_best": kernels.ece_std(w, best(q)), "val_brier": ((p - y) ** 2).mean(), "test_brier_best": ((best(q) - w) ** 2).mean()}
        for k, v in want.items():
            assert r[k] == pytest.approx(v, abs=1e-9), (m, k)


def test_no_group_in_one_worker(preds):
    """A model is spread over ranges before any Python sees its scores."""
    scores = calibration.score_counts(preds.where("split = 'val' and model = 'sharp'"), ["model"])
    ranges = scores.repartitionByRange(4, "model", "p").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 4
