import random

import pytest
from pyspark.sql import functions as F

from tamarack.llm import ngramjoin
from tamarack.llm.queries import op13_ngram_join

from .helpers import documents, rows, table
from .test_minhash import edited, shingles


def brute(docs, num=80, den=100):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for a in ids:
        for b in {b for s in sets[a] for b in holders[s] if b > a}:
            A, B = sets[a], sets[b]
            if den * len(A & B) >= num * len(A | B):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(got, want):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows(got).itertuples()} == want


def test_edges(spark):
    long = " ".join(f"w{i % 7919}x{i}" for i in range(30_000))
    texts = ["a b c", "A  b\tc", "a b c d e", "a b c d e f", None, "", " \n ", long, long + " tail", "one", "ONE", "é É", "É É", "a b c d e f g h", "a b c d e f g h i", "x " * 40, "x " * 41]
    check(ngramjoin.similar_documents(table(spark, texts)), brute(list(enumerate(texts))))


def test_empty_table(spark):
    assert ngramjoin.similar_documents(table(spark, ["x"]).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("num,most,block", [(80, 4, 384), (80, 1, 7), (60, 3, 5)])
def test_random_groups(spark, monkeypatch, num, most, block):
    """Edited copies at and about the threshold, passages that many share, short texts and chains."""
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rng = random.Random(num + most)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = []
    for size in (4, 5, 6, 9, 14, 30, 80, 200):
        base = text(size)
        texts += [edited(rng, base, s) for s in (0, 0, 0.004, 0.01, 0.02, 0.02, 0.03, 0.05) for _ in range(4)]
    passage = text(60)
    texts += [f"{text(rng.randrange(1, 40))} {passage} {text(rng.randrange(1, 40))}" for _ in range(60)]
    chain = text(400).split()
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 300, 7)]
    texts += [f"{passage} {i % 7}" for i in range(30)] + ["a b c d e " * 3 + str(i) for i in range(30)]
    rng.shuffle(texts)
    check(ngramjoin.similar_documents(table(spark, texts), num, 100, most), brute(list(enumerate(texts)), num))


def test_large_group(spark):
    """Near copies of one text beside texts of their own."""
    rng = random.Random(5)
    base = " ".join(f"b{i}" for i in range(150))
    texts = [edited(rng, base, 0.004) for _ in range(800)] + [" ".join(f"o{k}x{i}" for i in range(40)) for k in range(100)]
    docs = table(spark, texts)
    out = ngramjoin.similar_documents(docs)
    check(out, brute(list(enumerate(texts))))


def test_prefixes_are_long_enough(spark):
    """Linked sets share at least the smaller of both ``l`` of their prefix members."""
    rng = random.Random(11)
    universe = list(range(60))
    sets = []
    for _ in range(40):
        base = rng.sample(universe, rng.randrange(1, 25))
        sets += [set(base)] + [set(base) ^ set(rng.sample(universe, rng.randrange(0, 4))) for _ in range(3)]
    sets = [s for s in sets if s]
    df = {m: sum(m in s for s in sets) for m in universe}
    live = spark.createDataFrame([(m, i, len(s), df[m]) for i, s in enumerate(sets) for m in s if df[m] > 1], "member long, rep long, n long, df long")
    got = {}
    for r in ngramjoin.prefixes(live, 80, 100).collect():
        got.setdefault(r.rep, (r.l, set()))[1].add(r.member)
        assert r.place == 1 + sorted(sets[r.rep], key=lambda m: (df[m], m)).index(r.member)
    picked = {l for l, _ in got.values()}
    assert len(picked) > 1
    for a in range(len(sets)):
        for b in range(a):
            A, B = sets[a], sets[b]
            if A != B and 100 * len(A & B) >= 80 * len(A | B):
                assert len(got[a][1] & got[b][1]) >= min(got[a][0], got[b][0])


def test_query_is_brute_force(spark, sf_dir):
    docs = documents(sf_dir)
    out = op13_ngram_join(spark, sf_dir)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    check(out, brute(list(zip(docs.doc_id, docs.text, strict=True))))
    assert out.where(F.col("doc_id") != F.col("component_id")).count() > 0
