import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tamarack.functions import coerce
from tamarack.operators import models, reports
from tamarack.sources import corpus, fixtures, sinks
from tamarack.streaming import canonical_stream


def test_normalize_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(0, "hi", "malicious", "x"), (1, " ", "7", "fallback"), (2, None, None, None)], "n int, prompt string, label string, input string")
    rows = corpus.normalize(df, "set", ordinal="n").orderBy("id").collect()
    assert [(r.id, r.text, r.label) for r in rows] == [("set:0", "hi", 1), ("set:1", "fallback", 0), ("set:2", "", 0)]
    df.write.parquet(str(tmp_path / "a"))
    specs = [corpus.DatasetSpec("a", str(tmp_path / "a")), corpus.DatasetSpec("gone", str(tmp_path / "b"))]
    out, skipped = corpus.load_registry(spark, specs, order="n")
    assert out.count() == 3 and [k for k, _ in skipped] == ["gone"]
    assert corpus.first_readable(spark, [str(tmp_path / "b"), str(tmp_path / "a")]).count() == 3
    live = corpus.with_fallback(lambda: spark.read.parquet(str(tmp_path / "b")), lambda: df)
    assert live[1] is False and live[0].count() == 3
    assert {r.text for r in corpus.texts_only(df).collect()} == {"hi", "fallback", '{"n":2}'}


def test_runs_and_sinks(spark, tmp_path):
    for n in ("run_1", "run_2"):
        (tmp_path / n).mkdir()
    assert corpus.latest_run(spark, str(tmp_path)).rstrip("/").endswith("run_2")
    assert corpus.latest_run(spark, str(tmp_path / "run_1")) is None
    df = spark.createDataFrame([("a_b", 0.5), ("c", None)], "model string, auroc double")
    assert [r.line for r in sinks.latex_rows(df).collect()] == ["a\\_b & 0.500 \\\\", "c & -- \\\\"]
    assert "\\toprule" in sinks.latex_table(df, "c", "l")
    path = str(tmp_path / "once")
    sinks.write_once(df, path)
    assert sinks.is_done(spark, path) and sinks.write_once(df.limit(0), path).count() == 2
    sinks.append_registry(spark, [("r",) + ("x",) * 8], str(tmp_path / "reg"))
    sinks.append_registry(spark, [("s",) + ("x",) * 8], str(tmp_path / "reg"))
    assert spark.read.csv(str(tmp_path / "reg"), header=True).count() == 2
    (tmp_path / "f.txt").write_text("x")
    names = sinks.zip_files([str(tmp_path / "f.txt")] * 2 + [str(tmp_path / "no")], str(tmp_path), str(tmp_path / "z.zip"))
    assert names == ["f.txt"] == zipfile.ZipFile(tmp_path / "z.zip").namelist()
    assert json.loads(sinks.metrics_json(df, "model"))["c"]["auroc"] is None


def test_stream(spark, sf_dir, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(40).write.parquet(src)
    out = canonical_stream.score_stream(canonical_stream.read_conversations(spark, src))
    q = out.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("scored").count() == 40


def test_fixtures_and_kinds(spark):
    one, two = fixtures.tables(spark), fixtures.tables(spark)
    assert len(one) == 8
    for name, df in one.items():
        assert sorted(df.collect()) == sorted(two[name].collect())
        assert reports.table_kind("x.csv", df.columns) == (name if name in ("main_results", "robustness", "ablation", "calibration") else "generic")
        assert reports.table_kind(f"{name}.csv", []) == (name if name not in ("latency", "curves") else "generic")
    assert reports.table_kind("Variant_Selection.csv", []) == "variant_selection" and reports.table_kind("a", ["WORST_LANG", "worst_len"]) == "fairness"
    main = one["main_results"]
    empty = reports.or_placeholder(main.where("auroc > 2"), "table unavailable: no run")
    assert reports.is_placeholder(empty) and not reports.is_placeholder(reports.or_placeholder(main, "x")) and not reports.is_placeholder(main)
    names = dict(main.select("model", coerce.friendly_name(F.col("model"), {"regex_rules": "Rules"}).alias("n")).collect())
    assert names["regex_rules"] == "Rules" and names["HG_ALPHA_seed1"] == "Hybrid ALPHA (seed 1)" and names["tfidf_logreg"] == "tfidf_logreg"
    ranked = reports.placed(main.withColumnRenamed("model", "variant"), [F.desc("auroc"), F.col("variant")])
    chosen = json.loads(reports.selection(ranked).first()[0])
    assert chosen["selected"] == chosen["order"][0] == ranked.where("place = 1").first().variant and len(chosen["order"]) == 4


def test_exports_and_parts(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "id * 0.5D as half")
    sinks.export(df, "csv", str(tmp_path / "c"))
    sinks.export(df.limit(2), "tex", str(tmp_path / "t"), "cap", "tab:x")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 40
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert "\\caption{cap}" in text and "0.500" in text
    with pytest.raises(ValueError):
        sinks.export(df, "png", str(tmp_path / "p"))
    calls = []

    def work(part):
        calls.append(1)
        return part.withColumn("twice", F.col("half") * 2)

    first = sinks.in_parts(df, work, str(tmp_path / "w"), "id", parts=3)
    assert sorted(r.id for r in first.collect()) == list(range(40)) and all(r.twice == r.id for r in first.collect())
    assert len(calls) == 3
    again = sinks.in_parts(df, work, str(tmp_path / "w"), "id", parts=3)
    assert len(calls) == 3 and again.count() == 40


def test_saved_detector(spark, tmp_path):
    rows = spark.createDataFrame([(i, "bad words here" if i % 3 == 0 else f"fine text {i % 5}", int(i % 3 == 0)) for i in range(60)], "row_id long, text string, label int")
    model = models.detector("tfidf_logreg", size=50).fit(rows)
    models.save(model, str(tmp_path / "m"), {"size": 50})
    back, config = models.load(str(tmp_path / "m"))
    assert config == {"size": 50}
    p = lambda m: [round(r.p, 9) for r in models.probabilities(m, rows).orderBy("row_id").collect()]
    assert p(model) == p(back) and p(model)[0] > 0.5 > p(model)[1]
    common = rows.select(F.lit("same words").alias("text"), "label", "row_id")
    weights = models.Pipeline(stages=models._ngrams(10)).fit(common).transform(common).first().features
    assert weights.numNonzeros() == 3  # a term of every document keeps weight 1
    zero = models.ablate(spark.createDataFrame([(1.0, 2.0, 3)], "a double, b double, k int"), "constant_prior", {"rules": ["a"], "features": ["b"]}).first()
    assert tuple(zero) == (0.0, 0.0, 3)
    with pytest.raises(ValueError):
        models.detector("none")
