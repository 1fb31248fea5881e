import math

import numpy as np
import pytest

from tamarack.llm import maxscore

from .helpers import rows


def brute(vectors, queries, k):
    out = []
    ints = {i: [math.floor(64 * float(x)) for x in v] for i, v in vectors.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in queries:
        if q in ints:
            s = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, vectors, queries, k=20):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors.items()], "vec_id long, embedding array<float>, label int, v string")
    got = rows(maxscore.search(df, df.where(df.vec_id.isin(list(queries))), k), ["query_id", "rank"])
    return [tuple(int(x) for x in r) for r in got.itertuples(index=False)]


def test_edges(spark):
    rng = np.random.default_rng(1)
    vectors = {i: [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)] for i in range(60)}
    vectors |= {i: vectors[3] for i in range(60, 100)}  # ties
    vectors |= {100: None, 101: [float("nan")] + [0.0] * 7, 102: [float("inf")] + [0.0] * 7, 103: [None] + [0.0] * 7, 104: [0.0] * 8, 105: [], -5: vectors[0]}
    queries = [0, 3, 60, 99, 100, 101, 104, 105, -5]
    assert run(spark, vectors, queries) == brute(vectors, queries, 20)


def test_few_and_none(spark):
    assert run(spark, {1: [1.0, 2.0]}, [1]) == []
    assert run(spark, {1: [1.0, 2.0], 2: [-1.0, 0.5]}, [1]) == [(1, 1, 2, -64 * 64 + 128 * 32)]
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.search(df, df).count() == 0


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r.vec_id: list(r.embedding) for r in df.toPandas().itertuples()}
    queries = [i for i in vectors if i % 20 == 0]
    got = rows(maxscore.search(df, df.where("vec_id % 20 = 0")), ["query_id", "rank"])
    assert [tuple(int(x) for x in r) for r in got.itertuples(index=False)] == brute(vectors, queries, 20)


@pytest.mark.parametrize("seed", range(12))
def test_kernel(seed, monkeypatch):
    """Every exit of the kernel: early and late, small and huge numbers."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(maxscore, "ROWS", int(rng.integers(20, 300)))
    n, width, k = int(rng.integers(1, 900)), int(rng.integers(1, 70)), int(rng.integers(1, 25))
    scale = [8, 64, 3 * 10**7][seed % 3]
    x = (rng.normal(0, 1, (n, width)) * scale * rng.random(width) ** (seed % 4 * 3)).astype(np.int64)
    x[rng.integers(0, n, n // 3)] = x[0]
    ids = rng.permutation(n).astype(np.int64)
    q = np.arange(0, n, 7)
    got = list(zip(*(a.tolist() for a in maxscore.top_k(x[q], ids[q], x, ids, k))))
    want = []
    for i in q:
        s = sorted((-sum(int(a) * int(b) for a, b in zip(x[i], x[j])), int(ids[j])) for j in range(n) if j != i)
        want += [(int(ids[i]), j, -v) for v, j in s[:k]]
    assert sorted(got) == sorted(want)


def share_read(x, k=20, queries=100):
    tally = {}
    ids = np.arange(len(x))
    got = list(zip(*(a.tolist() for a in maxscore.top_k(x[:queries], ids[:queries], x, ids, k, tally))))
    want = []
    for i in range(queries):
        s = x @ x[i]
        want += [(i, int(j), int(s[j])) for j in np.lexsort((ids, -s)) if j != i][:k]
    assert sorted(got) == sorted(want)
    return tally["read"] / tally["cells"]


def test_lists_are_skipped_where_bounds_help():
    rng = np.random.default_rng(3)
    sparse = np.zeros((6000, 200), np.int64)  # a few terms each, some of them rare
    for row in sparse:
        row[(rng.random(6) ** 2 * 200).astype(int)] = rng.integers(1, 50, 6)
    assert share_read(sparse) < 0.2
    centres = rng.normal(0, 40, (12, 64))
    assert share_read((centres[rng.integers(0, 12, 6000)] + rng.normal(0, 6, (6000, 64))).astype(np.int64)) < 0.7
    falling = (rng.normal(0, 60, (6000, 64)) * 0.9 ** np.arange(64)).astype(np.int64)
    assert share_read(falling) < 0.7
