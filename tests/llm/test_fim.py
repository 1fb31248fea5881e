import hashlib
import random
import re

import duckdb
import numpy as np

from tamarack.llm import fim
from tamarack.llm.queries import OP12_SQL, op12_fim

from .helpers import rows, table

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digits = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def cases():
    rng = random.Random(3)
    bits = ["word", "a", "Z", "é", "ß", "\n", "\r", " ", "  ", "12", "<", "<P", "S>", "\U0001f600", "\x00", "́", "[", "`", "{", "@"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    return texts + [None, "", "a", ".", "x<P>y", "x<S>y<M>", "<", "same text here", "same text here", "w" * 70_000, "a, " * 50_000, "\n" * 9_999]


def test_transform_is_brute_force_on_odd_texts(spark):
    texts = cases()
    docs = table(spark, texts).withColumnRenamed("rank", "low").withColumnRenamed("bucket", "h1").withColumnRenamed("key", "n")
    out = rows(fim.transform(docs).withColumn("back", fim.restore()))
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r = out.loc[i]
        n, form, pre, mid, output = brute(i, t)
        assert (r.n, r.form, r.output, r.back) == (n, form, output, t or "")
        assert (None if form == "plain" else (pre, mid)) == (None if r.prefix_chars != r.prefix_chars else (r.prefix_chars, r.middle_chars))
    assert set(out.form) == {"plain", "psm", "spm"}


def test_runs_find_every_cut():
    texts = [t or "" for t in cases()[:150]] + ["", ""]
    runs = fim.encode(texts)
    before = runs.units_before()
    for i, t in enumerate(texts):
        units = UNIT.findall(t)
        assert before[i + 1] - before[i] == len(units)
        got = runs.offsets(before[i] + np.arange(len(units) + 1)) - runs.text_start[i]
        assert got.tolist() == [sum(map(len, units[:k])) for k in range(len(units) + 1)]


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(OP12_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = rows(op12_fim(spark, sf_dir))
    assert len(got) == len(want)
    for c in want.columns:
        assert got[c].astype(object).where(got[c].notna(), None).tolist() == want[c].astype(object).where(want[c].notna(), None).tolist(), c
    assert (got.restored_sha256 == [hashlib.sha256((t or "").encode()).hexdigest() for t in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toPandas().text]).all()


def test_empty_table_and_null_id(spark):
    assert fim.transform(table(spark, ["x"]).where("doc_id < 0")).count() == 0
    assert fim.transform(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first().n == 5
