"""Hand-made metric tables with ties, one class, equal scores and empty groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.operators import curves, integrity, reports, resampling, vectors
from tamarack.plans.registry import QUERIES

from . import kernels

ROWS = [("a", 0, 1, 0.9), ("a", 1, 0, 0.9), ("a", 2, 1, 0.4), ("a", 3, 0, 0.1), ("one", 0, 1, 0.5), ("one", 1, 1, 0.7), ("same", 0, 1, 0.5), ("same", 1, 0, 0.5)]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(ROWS, "model string, row_id long, y int, p double")


def by_model(df):
    return {r["model"]: r for r in df.collect()}


def test_areas(preds):
    got = by_model(curves.curve_metrics(preds, ["model"]))
    assert got["a"].auroc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert got["a"].auprc == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert got["one"].auroc is None and got["same"].auroc == pytest.approx(0.5)
    assert got["a"].threshold_first == 1.0 and got["a"].recall_first == 0.0


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 500), np.round(rng.random(500), 2)
    df = spark.createDataFrame([("m", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "model string, row_id long, y int, p double")
    got = curves.curve_metrics(df, ["model"]).first()
    assert got.auroc == pytest.approx(kernels.auroc(y, p)) and got.auprc == pytest.approx(kernels.auprc(y, p))
    assert curves.prf(df, ["model"]).first().f1 == pytest.approx(kernels.f1(y, p))
    assert curves.ece_confidence(df, ["model"]).first().ece == pytest.approx(kernels.ece_std(y, p))
    ci = resampling.bootstrap_ci(df, ["model"], 50).first()
    assert ci.auroc_low <= got.auroc <= ci.auroc_high
    order = np.lexsort((np.arange(500), -p))
    for target in (0.01, 0.1, 0.5):
        fpr = np.cumsum(1 - y[order]) / (1 - y).sum()
        ok = np.flatnonzero(fpr <= target)
        row = curves.recall_at_fpr_cum(df, ["model"], target).first()
        tau = p[order][ok[-1]] if len(ok) else None
        assert row.threshold == tau and row.recall == pytest.approx(y[p >= tau].sum() / y.sum() if tau is not None else 0.0)


def test_thin_curves(spark):
    """Collinear points go as in one sequential pass, and the area stays, also where scores are saturated."""
    rng = np.random.default_rng(2)
    models = {
        "steps": (np.arange(300) // 30 % 2, np.arange(300) / 300), "ties": (rng.integers(0, 2, 300), np.round(rng.random(300), 1)), "one": (np.array([0, 1]), np.array([0.5, 0.5])),
        "saturated": (rng.integers(0, 2, 300), 1 - 10.0 ** -rng.uniform(1, 15, 300)), "outside": (np.arange(9) % 2, np.arange(9) - 4.0),
    }
    rows = [(m, int(a), float(b)) for m, (y, p) in models.items() for a, b in zip(y, p, strict=True)]
    got = curves.roc_points_thin(spark.createDataFrame(rows, "model string, y int, p double"), ["model"]).toPandas()
    for m, (y, p) in models.items():
        xs = np.unique(p)[::-1]
        pos, neg = (np.array([((p == x) & (y == k)).sum() for x in xs]) for k in (1, 0))
        keep = [i for i in range(len(xs)) if i in (0, len(xs) - 1) or (pos[i], neg[i]) != (pos[i + 1], neg[i + 1])]
        mine = got[got.model == m].sort_values("p", ascending=False)
        assert mine.p.tolist() == xs[keep].tolist(), m
        area = np.trapezoid(np.r_[0, mine.tpr], np.r_[0, mine.fpr])
        assert area == pytest.approx(kernels.auroc(y, p)), m


def test_fairness_and_mcnemar(preds, spark):
    assert by_model(curves.fairness_gap(preds, ["model"], "model"))["a"].worst == ""
    ref = spark.createDataFrame([("one", "same")], "model string, reference string")
    got = curves.mcnemar(preds, "model", ref).first()
    assert (got.b01, got.b10, got.chi2) == (1, 0, 0.0)
    p = spark.createDataFrame([(0.0,), (3.841459,)], "chi2 double").select(resampling.chi2_p_value(F.col("chi2"))).collect()
    assert p[0][0] == 1.0 and p[1][0] == pytest.approx(0.05, abs=1e-5)


def test_near_dup_pairs(spark):
    rows = [(1, 0), (2, 1), (3, 7), (4, 15), (5, 0), (6, -1), (7, -2), (8, 0)]
    hashes = spark.createDataFrame(rows, "doc_id long, simhash long")
    members = {}
    for r in integrity.near_dup_members(hashes).collect():
        members.setdefault(r.rep, []).append(r.doc_id)
    got = []
    for r in integrity.near_dup_pairs(hashes).collect():
        each = {(min(x, y), max(x, y), r.distance) for x in members[r.a] for y in members[r.b] if x != y}
        assert (r.n_a, r.n_b, r.pairs) == (len(members[r.a]), len(members[r.b]), len(each))
        got += each
    want = sorted((a, b, bin((x ^ y) & (2**64 - 1)).count("1")) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if (x >> 48) == (y >> 48) and bin((x ^ y) & (2**64 - 1)).count("1") <= 3)
    assert sorted(got) == want


def test_split_sizes(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {(r.y, r.split): r["count"] for r in integrity.stratified_split(df, "y", "doc_id").groupBy("y", "split").count().collect()}
    assert got == {(0, "test"): 135, (0, "val"): 135, (0, "train"): 630, (1, "test"): 15, (1, "val"): 15, (1, "train"): 70}


def test_reports(spark):
    df = spark.createDataFrame([("x", 0.9, None, 0.1), ("y", 0.9, 0.5, None), ("z", None, 0.9, 0.0)], "variant string, auroc double, recall double, od double")
    assert [r.variant for r in reports.variant_rank(df).orderBy("place").collect()] == ["y", "x", "z"]
    empty = reports.or_placeholder(df.where("auroc > 2"), "none")
    assert empty.first().note == "none" and empty.first().variant is None and empty.schema.names == reports.or_placeholder(df, "none").schema.names
    assert [f.dataType for f in empty.schema][:4] == [f.dataType for f in df.schema]
    assert reports.naming_decision(0.9, 0.8, None)["beats_baseline"] is False


def test_knn_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)]  # many ties
    v = spark.createDataFrame([*rows, (60, None)], "vec_id long, bv array<double>")
    q = v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("bv").alias("qv"))
    want = [(i, r + 1, j, s) for i, x in rows[:5] for r, (s, j) in enumerate(sorted(((float(np.dot(x, y)), j) for j, y in rows), key=lambda t: (-t[0], t[1]))[:5])]
    assert sorted(map(tuple, vectors.knn_topk(q, v).collect())) == want
    monkeypatch.setattr(vectors, "SHARD", 7)
    monkeypatch.setattr(vectors, "BLOCK", 2)
    assert sorted(map(tuple, vectors.knn_topk(q, v).collect())) == want
    assert vectors.knn_topk(q, v.where("vec_id > 99")).count() == 0


def test_tuned_threshold(spark):
    rows = [("m", "val", 0, 0.2), ("m", "val", 0, 0.4), ("m", "val", 1, 0.6), ("m", "val", 1, 0.9), ("n", "val", 0, 0.8), ("n", "val", 1, 0.7), ("m", "test", 1, 0.65), ("m", "test", 0, 0.95)]
    df = spark.createDataFrame(rows, "model string, split string, y int, p double")
    first = {r.model: r.threshold for r in curves.tuned_threshold(df, ["model"]).collect()}
    low = {r.model: r.threshold for r in curves.tuned_threshold(df, ["model"], rule="roc").collect()}
    assert first == {"m": 0.9, "n": 1.0} and low == {"m": 0.6, "n": 1.0}
    recall, fpr = curves.rates(F.lit(0.6))
    assert tuple(df.where("split = 'test'").agg(recall, fpr).first()) == (1.0, 1.0)


def weighted(y, p, w, target=0.01):
    """Metrics of one replicate, by repeating rows."""
    i = np.repeat(np.arange(len(y)), w)
    y, p = y[i], p[i]
    if len(set(y)) < 2:
        return None
    order = np.argsort(-p, kind="stable")
    ends = np.r_[p[order][1:] != p[order][:-1], True]
    tp, fp = np.cumsum(y[order])[ends], np.cumsum(1 - y[order])[ends]
    return kernels.auroc(y, p), kernels.auprc(y, p), max([0, *tp[fp <= target * (1 - y).sum()]]) / y.sum(), kernels.f1(y, p)


@pytest.mark.parametrize("batch", [7, 4096])
def test_replicates(spark, batch):
    """Every replicate is that of repeated rows, also where one score fills many ranges."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    models = {"ties": np.round(rng.random(400), 1), "one": np.full(400, 0.5), "hot": np.where(rng.random(400) < 0.6, 1.0, rng.random(400)), "fine": np.clip(0.5 + 0.3 * (y - 0.5) + rng.normal(0, 0.2, 400), 0, 1)}
    rows = [(m, i, int(a), float(b)) for m, p in models.items() for i, (a, b) in enumerate(zip(y, p, strict=True))] + [("small", 0, 1, 0.3), ("small", 1, 0, 0.3), ("null", 1, None, 0.3)]
    df = spark.createDataFrame(rows, "model string, row_id long, y int, p double")
    out = resampling.replicates(df, ["model"], 11, seed=3, target=0.1, batch=batch)
    got = {(r.model, r.rep): (r.auroc, r.auprc, r.recall, r.f1) for r in out.collect()}
    w = resampling.weights(list(range(400)), 11, 3)
    assert w.mean() == pytest.approx(1, abs=0.05) and w.var() == pytest.approx(1, abs=0.1)
    for m, p in models.items():
        for rep in range(11):
            assert got[m, rep] == pytest.approx(weighted(y, p, w[:, rep], 0.1)), (m, rep)
    for rep in range(11):
        want = weighted(np.array([1, 0]), np.array([0.3, 0.3]), w[:2, rep], 0.1)
        assert got["small", rep] == (pytest.approx(want) if want else (None,) * 4)
    assert {m for m, _ in got} == {*models, "small"}


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 1500)
    a, b = (np.round(np.clip(0.5 + s * (y - 0.5) + rng.normal(0, 0.2, 1500), 0, 1), 2) for s in (0.2, 0.26))
    df = spark.createDataFrame([(m, i, int(u), float(v)) for m, p in (("a", a), ("b", b)) for i, (u, v) in enumerate(zip(y, p, strict=True))], "model string, row_id long, y int, p double")
    reps = resampling.replicates(df, ["model"], 100)
    ci = {r.model: r for r in resampling.intervals(reps, ["model"]).collect()}
    assert ci["a"].auroc_low < kernels.auroc(y, a) < ci["a"].auroc_high and ci["b"].auprc_low < kernels.auprc(y, b) < ci["b"].auprc_high
    drawn = [kernels.auroc(y[i], a[i]) for i in (rng.integers(0, 1500, 1500) for _ in range(200))]
    assert ci["a"].auroc_high - ci["a"].auroc_low == pytest.approx(np.subtract(*np.percentile(drawn, [97.5, 2.5])), rel=0.4)
    pair = resampling.bootstrap_paired(reps, spark.createDataFrame([("b", "a"), ("a", "a")], "model string, reference string")).collect()
    assert [r.model for r in pair] == ["b"] and pair[0].auroc_diff_low < kernels.auroc(y, b) - kernels.auroc(y, a) < pair[0].auroc_diff_high
    score_wise = {r.model: r for r in resampling.poisson_bootstrap(df, ["model"], 100).collect()}
    assert score_wise["a"].auroc_high - score_wise["a"].auroc_low == pytest.approx(ci["a"].auroc_high - ci["a"].auroc_low, rel=0.4)
    again = resampling.intervals(resampling.replicates(df.repartition(7), ["model"], 100), ["model"]).orderBy("model").collect()
    assert again[0].asDict() == pytest.approx(ci["a"].asDict())


def test_knn_copies_and_odd_numbers(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(40)] + [(i, [1.0] * 5) for i in range(40, 90)] + [(90, [float("nan")] * 5), (91, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, bv array<double>")
    q = v.where("vec_id < 3 or vec_id = 40").select(F.col("vec_id").alias("query_id"), F.col("bv").alias("qv"))
    pairs = q.join(v).select("query_id", "vec_id", vectors.dot(F.col("qv"), F.col("bv")).alias("score"))
    each = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    want = sorted((r.query_id, r.rank, r.vec_id, str(r.score)) for r in pairs.withColumn("rank", each).where("rank <= 5").collect())
    got = lambda: sorted((r.query_id, r.rank, r.vec_id, str(r.score)) for r in vectors.knn_topk(q, v).collect())
    assert got() == want
    monkeypatch.setattr(vectors, "SHARD", 20)
    assert got() == want


def test_knn_product_is_blocked():
    """A block's scores come from matrix products over stripes of queries: far less time than a pass for each dimension."""
    rng = np.random.default_rng(5)
    q, v = rng.standard_normal((600, 8)), rng.standard_normal((3000, 8))
    rows, columns, score = vectors._nearest(q, v, 5)
    full = q @ v.T
    want = np.argsort(-full, axis=1, kind="stable")[:, :5]
    assert (columns.reshape(600, 5) == want).all() and np.abs(score - full[rows, columns]).max() < 1e-12
    assert vectors._firsts(np.array([[1.0], [2.0], [1.0], [1.0]]), 2).tolist() == [0, 1, 2]


def test_retrieval_features_are_kept_for_the_fit(spark, sf_dir):
    plan = QUERIES["retrieval_logreg"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan
