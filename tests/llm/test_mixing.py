import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

from tokenizers import Tokenizer

from tamarack.llm import mixing
from tamarack.llm.queries import MIX_WEIGHTS, op7_mixing, tokenizer_file

from .helpers import documents, rows, table


def domain(source):
    m = re.search(r"([0-9]{1,9})$", source or "")
    return ("crawl", "books", "forum")[int(m[1]) % 3 if m else 0]


def share(total, children):
    """Water-filling by rounds over ``{name: (cap, weight)}``; fractions are cut at running whole numbers."""
    open_ = {k: (c, Fraction(w)) for k, (c, w) in children.items() if c and w}
    total = min(total, sum(c for c, _ in open_.values()))
    got = {}
    while open_:
        level = Fraction(total) / sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c <= level * w]
        if not full:
            break
        for k in full:
            got[k] = open_.pop(k)[0]
            total -= got[k]
    passed = Fraction(0)
    for k in sorted(open_, key=lambda k: (open_[k][0] / open_[k][1], k)):
        w = open_[k][1]
        got[k] = math.floor((passed + w) * level) - math.floor(passed * level)
        passed += w
    return got


def spread(tokens, weights, total, max_epochs):
    """Budget of every leaf, from the definition: depth first over the tree as nested calls."""
    live = {p: n for p, n in tokens.items() if n and all(weights.get(p[: d + 1], 1.0) > 0 for d in range(len(p)))}

    def deal(prefix, budget):
        own = {p: n for p, n in live.items() if p[: len(prefix)] == prefix}
        if prefix in own:
            return {prefix: budget}
        names = {p[len(prefix)] for p in own}
        under = {k: sum(n for p, n in own.items() if p[len(prefix)] == k) * max_epochs for k in names}
        parts = share(budget, {k: (under[k], weights.get((*prefix, k), 1.0)) for k in names})
        return {leaf: n for k, b in parts.items() for leaf, n in deal((*prefix, k), b).items()}

    return {k: v for k, v in (deal((), total) if live else {}).items() if v}


def brute(docs, weights, fraction, max_epochs, count, seed=17):
    leaf, n = {}, {}
    for i, text, lang, source in docs:
        leaf[i] = (domain(source), lang or "unknown", source or "unknown")
        n[i] = count(text or "")
    tokens = defaultdict(int)
    for i in leaf:
        tokens[leaf[i]] += n[i]
    given = spread(tokens, weights, int(fraction * sum(tokens.values())), max_epochs)
    out = set()
    for lf, budget in given.items():
        for epoch in range(max_epochs):
            left = min(budget - epoch * tokens[lf], tokens[lf])
            if left <= 0:
                break
            own = sorted((hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest(), i) for i in leaf if leaf[i] == lf)
            seen = 0
            for _, i in own:
                if seen < left or left == tokens[lf]:
                    out.add((i, epoch))
                seen += n[i]
    return out


def budgets(spark, tokens, weights, total, max_epochs=1):
    leaves = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "domain string, lang string, source string, tokens long")
    return {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, weights, total, max_epochs).collect()}


def test_whole_table(spark, sf_dir):
    d = documents(sf_dir)
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = brute(list(zip(d.doc_id, d.text, d.lang, d.source)), MIX_WEIGHTS, 0.5, 2, lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids))
    assert {(r.doc_id, r.epoch) for r in rows(op7_mixing(spark, sf_dir)).itertuples()} == want


def test_shortage_goes_to_siblings_first(spark):
    tokens = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "3"): 1000, ("b", "z", "4"): 1000}
    got = budgets(spark, tokens, {}, 800)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "3"): 200, ("b", "z", "4"): 400}
    got = budgets(spark, tokens, {}, 3000)  # branch b is short, branch a takes over
    assert got[("b", "z", "4")] == 1000 and sum(got.values()) == 3000


def test_weight_zero_gives_its_share_away(spark):
    tokens = {("crawl", "en", "a"): 100, ("books", "en", "b"): 100}
    assert budgets(spark, tokens, {("crawl", "en"): 0.0}, 100) == {("books", "en", "b"): 100}
    assert budgets(spark, tokens, {("crawl",): 0.0, ("books", "en", "b"): 0.0}, 100) == {}


def test_random_trees(spark):
    rng = random.Random(5)
    for _ in range(6):
        tokens = {(rng.choice("abc"), rng.choice("xyz"), f"s{i}"): rng.choice((0, 1, 7, rng.randrange(10**6))) for i in range(rng.randrange(1, 60))}
        paths = [p[:d] for p in tokens for d in (1, 2, 3)]
        weights = {p: rng.choice((0.0, 0.5, 1.0, 3.0, 7.25)) for p in rng.sample(paths, len(paths) // 3)}
        total, epochs = rng.randrange(2 * sum(tokens.values()) + 2), rng.randrange(1, 4)
        got = budgets(spark, tokens, weights, total, epochs)
        assert got == spread(tokens, weights, total, epochs)
        room = sum(epochs * n for p, n in tokens.items() if all(weights.get(p[:d], 1) for d in (1, 2, 3)))
        assert sum(got.values()) == min(total, room)


def test_many_leaves(spark):
    leaves = spark.range(120_000).selectExpr("'d' domain", "concat('l', id % 3) lang", "concat('s', id) source", "id % 50 tokens")
    got = mixing.budgets(leaves, {}, 1_000_000, 1).agg({"budget": "sum", "*": "count"}).first()
    assert got["sum(budget)"] == 1_000_000 and got["count(1)"] > 100_000


def test_edges(spark):
    texts = [None, "", "a b c", "a b c", "word " * 5000]
    df = table(spark, texts)
    got = rows(mixing.mix(df, fraction=1.0, max_epochs=1))
    assert set(got[got.n_tokens > 0].doc_id) == {2, 3, 4}
    assert mixing.mix(df.where("doc_id < 0")).count() == 0
    nulls = df.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source")
    got = rows(mixing.mix(nulls, fraction=1.0, max_epochs=1))
    assert set(got.source) == {"unknown"} and len(got) == 5
