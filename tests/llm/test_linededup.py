import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tamarack.llm.linededup import LineRuns, dedup_lines
from tamarack.llm.queries import op1_line_dedup

from .helpers import documents, rows, table

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    seen = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(seen[key(x)]) < 2 or min(seen[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_edges(spark):
    long = "\n".join(f"line number {i} of a long text" for i in range(3000))
    texts = ["Same Line Here\nb", " same line here\t\nSAME LINE HERE", None, "", long, long + "\nsame line herÉ", "same line heré\nsame line herÉ", "short\nshort", "\n\n", "0123456789\r", "0123456789"]
    docs = list(enumerate(texts))
    got = rows(dedup_lines(table(spark, texts), batches=3, fanout=2))
    want = brute(docs)
    for r in got.itertuples():
        assert (r.n_lines, r.n_dropped, r.kept_text) == want[r.doc_id]


def test_batches_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = rows(dedup_lines(docs, batches=1)), rows(dedup_lines(docs, batches=7, fanout=3))
    assert a.equals(b)


def test_whole_table(spark, sf_dir):
    d = documents(sf_dir)
    want = brute(list(zip(d.doc_id, d.text)))
    for r in rows(op1_line_dedup(spark, sf_dir)).itertuples():
        n, gone, text = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())


def test_empty_table_and_native_plan(spark):
    df = table(spark, ["x"]).where("doc_id < 0")
    assert dedup_lines(df).count() == 0
    plan = dedup_lines(table(spark, ["a line of text\nb", "a line of text"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_carry(spark):
    got = rows(dedup_lines(table(spark, ["a line of text", "a line of text"]), carry=("lang", "key")))
    assert list(got.lang) == ["en", "en"] and list(got.kept_text) == ["a line of text", ""]
    assert dedup_lines(table(spark, ["x"])).select(F.col("n_lines")).first()[0] == 1


def test_runs_are_read_in_place_and_in_order(spark, monkeypatch):
    """A batch's plan shuffles and sorts its own keys once and no run; compaction moves nothing."""
    plans, write = [], LineRuns._write

    def noted(self, rows, *split):
        plans.append((len(self.runs()), rows._jdf.queryExecution().executedPlan().toString()))
        return write(self, rows, *split)

    monkeypatch.setattr(LineRuns, "_write", noted)
    lines = spark.range(4000).selectExpr("id as doc_id", "xxhash64(id % 1500) h1", "xxhash64(id % 1500, 1) h2", "0 as pos")
    index = LineRuns(spark, fanout=2)
    dropped = [index.ingest(lines.where(f"doc_id div 1000 = {i}")).count() for i in range(4)]
    assert dropped == [0, 500, 1000, 1000]
    assert [len(level) for level in index.levels] == [2, 1]
    rows = [r for run in index.runs() for r in index._fresh(run).collect()]
    assert len(rows) == 1500 and all(r.owner < 1500 for r in rows)
    index.close()
    batches = [p for n, p in plans if "LeftOuter" in p]
    assert len(batches) == 3
    for plan in batches:
        assert len(re.findall(r"\bExchange\b", plan)) == 1
        assert len(re.findall(r"- \*?(?:\(\d+\) )?Sort \[", plan)) == 1 and "Bucketed: true" in plan
    compaction = [p for n, p in plans if "FullOuter" in p]
    assert compaction and all("Exchange" not in p and "Sort [" not in p for p in compaction)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tamarack_run")]
