"""Runs that stop and go on, input that can't be read, and runs found by their files."""

import json
import os
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tamarack.operators import models
from tamarack.sources import ledger, runs
from tamarack.streaming import resumable


def test_a_killed_run_goes_on(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "cast(id as string) as text")
    path, seen, fail = str(tmp_path / "w"), [], [True]

    def work(batch):
        ids = [r.id for r in batch.collect()]
        if fail[0] and len(seen) == 2:
            batch.withColumn("score", F.lit(-1)).write.mode("overwrite").parquet(f"{path}/out/batch=2")  # an attempt that was cut off
            raise RuntimeError("killed")
        seen.append(ids)
        return batch.withColumn("score", F.length("text"))

    with pytest.raises(StreamingQueryException):
        resumable.scored(df, work, path, "id", parts=5)
    assert len(seen) == 2
    fail[0] = False
    out = resumable.scored(df, work, path, "id", parts=5)
    assert sorted(i for ids in seen for i in ids) == list(range(60))
    assert sorted((r.id, r.score) for r in out.collect()) == [(i, len(str(i))) for i in range(60)]
    assert resumable.scored(df, work, path, "id", parts=5).count() == 60 and len(seen) == 5
    more = spark.range(60, 64).selectExpr("id", "cast(id as string) as text")
    more.coalesce(1).write.mode("append").parquet(f"{path}/in")
    assert resumable.scored(df, work, path, "id", parts=5).count() == 64 and len(seen) == 6


def test_back_off_and_one_client_a_worker(spark):
    waits, calls = [], []

    def failing(text):
        calls.append(text)
        if len(calls) < 4:
            raise OSError
        return "yes"

    assert models.asked(failing, "t", tries=5, pause=1, longest=3, sleep=waits.append) == "yes" and waits == [1, 2, 3]
    assert models.asked(lambda t: 1 / 0, "t", tries=3, pause=1, sleep=waits.append) == "" and waits[3:] == [1, 2]
    made = []
    assert models.per_worker("k", lambda: made.append(1) or 5) == models.per_worker("k", lambda: made.append(1)) == 5 and made == [1]

    def client():
        return lambda text: "bad" if "x" in text else json.dumps({"probability": 0.9, "label": "malicious"})

    got = models.judged(spark.createDataFrame([("a",), ("x",), (None,)], "text string"), client, pause=0).collect()
    assert all(0 <= r.p <= 1 for r in got) and len(got) == 3


SCHEMA = "id int, text string"


def test_ledger(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"id": 1, "text": "x"}\n{"id": 2, "text"\n{"id": "three", "text": "y"}\n')
    (tmp_path / "j" / "b.json").write_text('{"id": 4}\nnot json\n')
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("id,text\n1,x\ntwo,y\n3,z,extra\n4,w\n")
    good = tmp_path / "p"
    spark.createDataFrame([(1, "x"), (2, None)], SCHEMA).coalesce(1).write.parquet(str(good))
    spark.createDataFrame([], SCHEMA).coalesce(1).write.mode("append").parquet(str(good))
    (good / "broken.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    (good / "short.parquet").write_bytes(b"x")
    j, c, p = ledger.read_lines(spark, "j", str(tmp_path / "j"), SCHEMA, "json"), ledger.read_lines(spark, "c", str(tmp_path / "c"), SCHEMA, "csv"), ledger.read_parquet(spark, "p", str(good), SCHEMA)
    assert sorted(r.id for r in j.rows.collect()) == [1, 4] and sorted(r.id for r in c.rows.collect()) == [1, 4] and p.rows.count() == 2
    assert sorted(r.line for r in j.rejected.collect()) == sorted(['{"id": 2, "text"', '{"id": "three", "text": "y"}', "not json"])
    assert sorted(r.line for r in c.rejected.collect()) == ["3,z,extra", "two,y"]
    assert sorted(os.path.basename(r.file) for r in p.rejected.collect()) == ["broken.parquet", "short.parquet"] and all(r.reason for r in p.rejected.collect())
    at = str(tmp_path / "ledger")
    for run in ("r1", "r2", "r1"):
        for_run = j.rejected.unionByName(c.rejected).unionByName(p.rejected)
        ledger.append(for_run if run == "r1" else for_run.where("key = 'c'"), at, run)
    told = {(r.run, r.key): (r.lines, r.files) for r in ledger.counts(spark, at).groupBy("run", "key").agg(F.sum("lines").alias("lines"), F.sum("files").alias("files")).collect()}
    assert told == {("r1", "j"): (3, 2), ("r1", "c"): (2, 1), ("r1", "p"): (0, 2), ("r2", "c"): (2, 1)}


def test_runs(spark, tmp_path):
    def put(run, name, text, age):
        path = tmp_path / run / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (1_700_000_000 - age,) * 2)

    put("run_a", "tables/main.csv", "model,auroc\nm,0.5\n", 300)
    put("run_a", "tables/fairness.csv", "model,gap\nm,0.1\n", 300)
    put("run_b", "tables/main.csv", "model,auroc\nm,0.7\n", 200)
    put("run_b", "tables/fairness.csv", 'model,gap\n"m,0.2\nx', 200)
    put("run_c", "tables/fairness.csv", "", 100)
    put("run_c", "tables/main.csv", "model,auroc\nm,0.6,7,8\n", 100)
    put("run_b", "evaluation/other/metrics_main.csv", "a\n1\n", 10)
    put("run_b", "evaluation/in_domain/metrics_main.csv", "a\n1\n", 20)
    put("run_c", "evaluation/x/metrics_main.csv", "a\n1\n", 20)
    put("run_c", "evaluation/y/metrics_main.csv", "a\n1\n", 5)
    put("run_a", "meta.json", '{\n "seed": 1,\n "x": 2\n}', 300)
    put("run_b", "meta.json", '[{"seed": 3, "y": "z"}]', 200)
    demo = spark.createDataFrame([("demo", 0.0)], "model string, auroc double")
    got = runs.load_tables(spark, str(tmp_path), ["main", "fairness", "ablation"], lambda name: demo)
    assert got["main"].live and "/run_b/" in got["main"].file and got["main"].table.first().auroc == 0.7
    assert not got["ablation"].live and got["ablation"].table.first().model == "demo"
    assert got["fairness"].live and "/run_a/" in got["fairness"].file
    assert "/in_domain/" in runs.metrics_file(spark, str(tmp_path), "run_b") and "/y/" in runs.metrics_file(spark, str(tmp_path), "run_c")
    assert runs.metrics_file(spark, str(tmp_path), "run_a") is None and runs.metrics_file(spark, str(tmp_path / "run_a"), "run_a") is None
    assert not runs.load_tables(spark, str(tmp_path / "none"), ["main"], lambda name: demo)["main"].live
    merged = {r["_run"]: r for r in runs.merged_json(spark, str(tmp_path), "meta.json").collect()}
    assert (merged["run_a"].seed, merged["run_a"].y, merged["run_b"].x, merged["run_b"].y) == (1, None, None, "z") and merged["run_a"]["_changed"] < merged["run_b"]["_changed"]


def test_halving(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.pmod(F.xxhash64("id"), F.lit(100)) / 60.0).alias("a"))
    train, held = rows.where("row_id % 4 > 0"), rows.where("row_id % 4 = 0 or row_id % 4 = 1")
    fits = []

    def build(reg, columns):
        fits.append(reg)
        return models.Pipeline(stages=[*models._scaled([columns]), models.LogisticRegression(regParam=reg, maxIter=10)])

    space = {"reg": ("log", 1e-4, 10.0), "columns": ("choice", "a")}
    told = models.halving_search(build, space, train, held, str(tmp_path / "s"), trials=4, eta=2).collect()
    assert len(fits) == len(told) == 7 and [r.rung for r in told] == [0, 0, 0, 0, 1, 1, 2] and {r.share for r in told} == {0.25, 0.5, 1.0}
    assert [json.loads(r.settings) for r in told[:4]] == [models.drawn(space, 1337, t) for t in range(4)]
    again = models.halving_search(build, space, train, held, str(tmp_path / "s"), trials=4, eta=2).collect()
    assert again == told and len(fits) == 7
    shutil.rmtree(tmp_path / "s" / "2-{}".format(told[-1].trial))
    assert models.halving_search(build, space, train, held, str(tmp_path / "s"), trials=4, eta=2).collect() == told and len(fits) == 8
