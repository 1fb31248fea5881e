from pyspark.sql import functions as F

from corpus_pipeline import STAGES, run
from tamarack.llm import toxicity
from tamarack.llm.common import materialize

from .helpers import rows, table
from .test_linededup import brute as line_brute
from .test_minhash import brute as near_brute
from .test_mixing import brute as mix_brute
from .test_packing import check as pack_check
from .test_packing import direct


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    got = {}
    for name, stage in STAGES:
        before = rows(docs)
        docs = materialize(stage(spark, docs, sf_dir), name)
        after = rows(docs)
        if name != "packing":
            assert docs.columns == columns
        got[name] = (before, after)
    before, after = got["toxicity"]
    grammar = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert list(after.doc_id) == [i for i, t in zip(before.doc_id, before.text) if grammar.score(t) < 0.5]
    before, after = got["line_dedup"]
    want = line_brute(list(zip(before.doc_id, before.text)))
    assert {r.doc_id: r.text for r in after.itertuples()} == {i: w[2] for i, w in want.items()}
    assert all(after.n_chars == after.text.str.len())
    before, after = got["minhash"]
    assert list(after.doc_id) == sorted(i for i, w in near_brute(list(zip(before.doc_id, before.text))).items() if i == w[1])
    before, after = got["mixing"]
    from tamarack.llm.queries import MIX_WEIGHTS

    tokens = {t or "": len(ids) - 1 for t, ids in zip(before.text, direct(before.text))}
    assert set(after.doc_id) == {i for i, _ in mix_brute(list(zip(before.doc_id, before.text, before.lang, before.source)), MIX_WEIGHTS, 0.8, 1, tokens.get)}
    before, after = got["packing"]
    pack_check(after, list(zip(before.doc_id, direct(before.text))))


def test_run(spark, sf_dir):
    assert run(spark, sf_dir).count() > 0


def test_odd_rows_and_columns(spark, sf_dir):
    texts = [None, "", "a line of some text\nb", "a line of some text\nb", "word " * 3000, "x"]
    docs = table(spark, texts)
    for c in ("n_lines", "n_dropped", "kept_text", "component_id", "kept", "score", "_lines", "epoch", "domain", "sequence_id"):
        docs = docs.withColumn(c, F.lit("extra"))
    columns = docs.columns
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == columns and docs.where("kept_text = 'extra'").count() == docs.count() > 0
    empty = table(spark, texts).where("doc_id < 0")
    for name, stage in STAGES:
        empty = materialize(stage(spark, empty, sf_dir), name)
        assert empty.count() == 0
