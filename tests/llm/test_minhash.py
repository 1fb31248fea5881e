import random
import re

import numpy as np
import pytest

from tamarack.llm import minhash
from tamarack.llm.shingles import shingle_sets

from .helpers import documents, rows, table

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            A, B = sets[a], sets[b]
            if A and B and 100 * len(A & B) >= 75 * len(A | B):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(got, want):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.itertuples())


def edited(rng, text, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_edges(spark):
    long = " ".join(f"w{i % 7919}x{i}" for i in range(30_000))
    texts = ["a b c", "A  b\tc", "a b c d e", "a b c d e f", None, "", " \n ", long, long + " tail", "one", "ONE", "é É", "É É", "a b c d e f g h", "a b c d e f g h i"]
    check(rows(minhash.near_duplicates(table(spark, texts))), brute(list(enumerate(texts))))


def test_near_copies(spark):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = " ".join(f"t{rng.randrange(3000)}" for _ in range(rng.choice([6, 12, 40, 150, 600])))
        texts += [base, base.upper()] + [edited(rng, base, share) for share in (0.01, 0.02, 0.03, 0.04, 0.05, 0.08)]
    rng.shuffle(texts)
    check(rows(minhash.near_duplicates(table(spark, texts))), brute(list(enumerate(texts))))


def test_chains_and_blocks(spark, monkeypatch):
    """A large group whose members reach each other over chains, in several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(9)
    base = " ".join(f"t{i}" for i in range(60))
    texts = [base]
    for _ in range(90):
        texts.append(edited(rng, rng.choice(texts), 0.03))
    check(rows(minhash.near_duplicates(table(spark, texts))), brute(list(enumerate(texts))))


def test_whole_table(spark, sf_dir):
    d = documents(sf_dir)
    check(rows(minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))), brute(list(zip(d.doc_id, d.text))))


def test_empty(spark):
    assert minhash.near_duplicates(table(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_set_sizes():
    texts = ["A b  c d e f", "a b c", "", None, "x" * 5000, "é " * 30]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("j", [0.2, 0.5, 0.75, 0.9])
def test_estimate_is_unbiased(j):
    rng = np.random.default_rng(int(j * 100))
    err = []
    for _ in range(60):
        n = 2000
        both = rng.integers(0, 2**63, int(n * j)).astype(np.uint64)
        own = [rng.integers(0, 2**63, (n - len(both)) // 2).astype(np.uint64) for _ in range(2)]
        r = minhash.registers([np.unique(np.r_[both, o]) for o in own])
        err.append(minhash.estimate(r[:1], r[1:])[0] - j)
    assert abs(np.mean(err)) < 0.02


def short_texts(pairs):
    """Texts of 8 and 7 words with 4 and 3 shingles, J = 0.75, and of other short lengths."""
    texts = []
    for i in range(pairs):
        w = [f"s{i}x{j}" for j in range(8)]
        texts += [" ".join(w), " ".join(w[:7])]
    return texts


def test_links_of_short_texts_are_exact(spark):
    texts = short_texts(2000)
    got = rows(minhash.near_duplicates(table(spark, texts)))
    assert list(got.component_id) == [i - i % 2 for i in range(len(texts))]


def test_short_texts_with_common_members(spark):
    rng = random.Random(11)
    line = [f"c{i}" for i in range(6)]
    texts = []
    for n in (*range(1, 12), 20, 31, 34, 35, 36, 37, 40, 44, 45, 46, 50):
        base = line + [f"t{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base, "tail"]), " ".join([*base, *(f"e{n}y{i}" for i in range(n // 4))])]
    check(rows(minhash.near_duplicates(table(spark, texts))), brute(list(enumerate(texts))))


def test_every_link_of_small_sets(spark):
    """All sizes of 2 to 12 members against each other, at, over and just under the threshold."""
    texts = []
    for n in range(2, 13):
        for m in range(n, 13):
            for both in {n, n - 1, -(-3 * (n + m) // 7), (3 * (n + m) - 1) // 7} - {0}:
                if both <= n:
                    stem = [f"p{n}x{m}y{both}z{i}" for i in range(both + 4)]
                    texts += [" ".join([*stem, *(f"{side}{len(texts)}v{i}" for i in range(size - both))]) for side, size in (("l", n), ("r", m))]
    check(rows(minhash.near_duplicates(table(spark, texts))), brute(list(enumerate(texts))))


def test_patterned_long_words_differ():
    """Words that collide under any polynomial hash modulo a power of two."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate({97: 98, 98: 97})
    one, two = shingle_sets([f"w x {a} y z", f"w x {b} y z"])
    assert one != two


def test_one_link_for_a_pair_of_components():
    import pyarrow as pa

    stem = [f"w{i}" for i in range(60)]
    sets = shingle_sets([" ".join([*stem, f"e{i}"]) for i in range(40)])
    n = len(sets)
    got = minhash._block_links(pa.table({"leader": [0] * n, "lo": [0] * n, "hi": [0] * n, "block": [0] * n, "rep": list(range(n)), "c": [i % 2 for i in range(n)], "members": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}))
    assert got.num_rows == 1
