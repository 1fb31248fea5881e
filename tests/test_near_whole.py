"""Near pairs of whole texts against plain Python and DuckDB."""

import hashlib
import re
from collections import Counter

import duckdb

from tamarack.plans.registry import ORACLE_SQL, QUERIES


def fingerprint(text, most=None):
    votes = [0] * 64
    for w, n in Counter(re.findall(r"\w+", (text or "").lower())[:most]).items():
        h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
        votes = [v + (n if h >> 63 - i & 1 else -n) for i, v in enumerate(votes)]
    return sum(1 << 63 - i for i, v in enumerate(votes) if v >= 0)


def test_near_pairs_of_whole_texts(spark, tmp_path):
    """Words behind the first 256 count, in several pieces and blocks of words, by code and SQL; ``simhash`` keeps to the first."""
    same, some = " ".join(f"w{i}" for i in range(256)), [" ".join(f"{c}{i}" for i in range(300)) for c in "xyz"]
    texts = [same, f"{same} {some[0]}", f"{same} {some[1]}", f"{same} {some[1]}", f"{some[0]} " * 3 + some[2], f"{some[2]} " + f"{some[0]} " * 3, some[2] + " été" * 70_000, None, ""]
    texts += [f"¿{i % 40}! {some[i % 3]}" for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want, first = [fingerprint(t) for t in texts], [fingerprint(t, 256) for t in texts]
    reps = {h: want.index(h) for h in want}
    n = Counter(want)
    far = lambda a, b: bin(a ^ b).count("1")
    close = {(reps[a], reps[b], far(a, b), n[a], n[b], n[a] * n[b]) for a in n for b in n if reps[a] < reps[b] and a >> 48 == b >> 48 and far(a, b) <= 3}
    own = {(reps[a], reps[a], 0, k, k, k * (k - 1) // 2) for a, k in n.items() if k > 1}
    assert want[0] != want[1] != want[2] == want[3] and want[4] == want[5] and first[0] == first[2] and first[4] != first[5]
    got = sorted(tuple(r) for r in QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect())
    assert got == sorted(close | own)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL["near_dup_pairs"]).fetchall())
    assert [r.simhash % 2**64 for r in QUERIES["simhash"](spark, str(tmp_path)).orderBy("doc_id").collect()] == first
