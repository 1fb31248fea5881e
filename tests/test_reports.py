"""Report tables on small frames, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from tamarack import cli
from tamarack.functions import perturb
from tamarack.operators import reports
from tamarack.plans import registry  # noqa: F401  (loads the queries)
from tamarack.plans import report_queries as Q


def named(spark, main, tests):
    m = spark.createDataFrame(main, "model string, auroc double")
    t = spark.createDataFrame(tests, "model string, reference string, p_value double")
    return reports.naming(m, t, F.col("model").startswith("HG_")).first().asDict()


def test_naming(spark):
    main = [("HG_A", 0.9), ("HG_B", 0.95), ("x", 0.93), ("y", None), ("n/a", 0.99)]
    to, back = [("HG_B", "x", 0.01), ("HG_A", "x", 0.5)], [("x", "HG_B", 0.01), ("y", "HG_B", 0.5)]
    got = named(spark, main, to)
    assert (got["chosen"], got["baseline"], got["p_value"], got["basis"], got["beats_baseline"]) == ("HG_B", "x", 0.01, "baseline is reference", True)
    got = named(spark, main, back)
    assert (got["p_value"], got["basis"], got["beats_baseline"]) == (0.01, "chosen is reference", True)
    assert not named(spark, main, [("HG_B", "x", 0.06)])["beats_baseline"]
    assert not named(spark, main, [("HG_B", "x", None)])["beats_baseline"]
    assert not named(spark, [("HG_B", 0.9), ("x", 0.9)], to)["beats_baseline"]
    for tests in ([], to[1:], to[:1] * 2):  # none, another pair, one told twice
        assert (named(spark, main, tests)["basis"], named(spark, main, tests)["beats_baseline"]) == ("no test", False)
    got = named(spark, main[:2] + main[4:], [])
    assert (got["baseline"], got["basis"], got["beats_baseline"]) == (None, "no baseline", True)
    assert not named(spark, [], [])["beats_baseline"]


def test_report_table(spark):
    df = spark.createDataFrame([("a", "none", 0.5, 3, "ok"), ("b", "none", 0.25, 4, "failed")], "model string, ablation string, auroc double, x int, status string")
    got = reports.report_table(df, "ablation").collect()
    assert [r.asDict() for r in got] == [dict.fromkeys(reports.REPORT_COLUMNS["ablation"].split()) | {"model": "a", "ablation": "none", "auroc": 0.5, "note": None}]
    for kind in reports.REPORT_COLUMNS:
        empty = reports.report_table(df.where("model = 'none of them'"), kind, "not run")
        row = empty.first()
        assert empty.count() == 1 and (row["model"], row["note"]) == ("N/A", "not run")
        assert empty.dtypes == reports.report_table(df, kind).dtypes


def test_metrics_document(spark, sf_dir):
    got = json.loads(Q.metrics_document(spark, sf_dir).first()["document"])
    assert set(got) == {"config", "selection", "tables", "topline"} and got["config"] == {"tuned_on": "val", "target_fpr": 0.01}
    main = {r["model"]: r.asDict() for r in Q.own.results_table(spark, sf_dir).collect()}
    assert {r["model"]: r for r in got["tables"]["main_results"]} == main
    best = got["selection"]["chosen"]
    assert best == max((m for m in main if m.startswith("HG_")), key=lambda m: (main[m]["auroc"], m))
    assert got["topline"]["main_results"] == [main[best]] and [r["model"] for r in got["topline"]["fairness"]] == [best]
    assert all(r["note"] is None for r in got["tables"]["overdefense"])


def test_swapcase_of_all_letters(spark, sf_dir):
    texts = [None, "", "abC", "Straße ÀÉ ñ", "Привет", "ǅ ⓐ ª 1", "İI", "Δδ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(perturb.casing_unicode(F.col("text"))).collect()] == [t and t.swapcase() for t in texts]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["perturbed"] for r in Q.perturb_swapcase_unicode(spark, sf_dir).collect()}
    assert got == {i: t and t.swapcase() for i, t in docs.items()}


def test_version(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and capsys.readouterr().out.startswith("tamarack ")


def test_report_tables_are_computed_once(spark, sf_dir):
    """What a report table is made of is read from written rows, not planned again for the test of emptiness."""
    plan = Q.robustness_table(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
