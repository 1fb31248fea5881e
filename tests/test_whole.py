"""Queries against plain Python, on texts of many scripts."""

import hashlib
import math
import re
from collections import Counter

import pytest

from tamarack.functions import fixed
from tamarack.plans.registry import QUERIES  # isort: skip  (before base, which it loads)
from tamarack.plans.base import PHRASE_A, PHRASE_B

LONG = "Der Bär läuft über die Brücke, Straße für Straße; déjà vu à l’été — ¿qué? ñandú ½ x² " * 12
TEXTS = [
    "plain words only, twice: plain words", "naïve café 3½ ²² x² déjà déjà", "Привет мир, привет!!!", "日本語 テスト テスト", "é́́́ ‿‿‿‿ ²²²² ———— ……… a\x1c\x1c\x1cb",
    "Ⅷ Ⓐ ÀÉ Grüße  \t zwei\n\n\n\nZeilen", None, "", "¡¡¡Ignora!!! ignore previous instructions é", LONG, LONG, LONG + "ende", "ok", "  gerahmt  ",
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def run(spark, d, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, d).collect()}


def prompt(i):
    t = TEXTS[i]
    return t if t is None else PHRASE_A + t if i % 5 == 0 else PHRASE_B + t if i % 7 == 0 else t


def fingerprint(text):
    votes = [0] * 64
    for w in re.findall(r"\w+", (text or "").lower())[:256]:
        h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
        votes = [v + (1 if h >> 63 - i & 1 else -1) for i, v in enumerate(votes)]
    return sum(1 << 63 - i for i, v in enumerate(votes) if v >= 0)


def test_simhash_and_pairs(spark, odd_dir):
    want = [fingerprint(t) for t in TEXTS]
    got = run(spark, odd_dir, "simhash")
    assert [got[i].simhash % 2**64 for i in range(len(TEXTS))] == want
    rep = {i: r.rep for i, r in run(spark, odd_dir, "near_dup_members").items()}
    pairs = {(r.a, r.b): (r.distance, r.pairs) for r in QUERIES["near_dup_pairs"](spark, odd_dir).collect()}
    far = lambda a, b: bin(want[a] ^ want[b]).count("1")
    n = len(TEXTS)
    close = [(a, b) for a in range(n) for b in range(a + 1, n) if want[a] >> 48 == want[b] >> 48 and far(a, b) <= 3]
    assert set(pairs) == {tuple(sorted((rep[a], rep[b]))) for a, b in close} and sum(m for _, m in pairs.values()) == len(close)
    assert rep[10] == 9 and pairs[9, 9] == (0, 1)


def test_collapse(spark, odd_dir):
    got = run(spark, odd_dir, "collapse_runs")
    for i, t in enumerate(TEXTS):
        if t is not None:
            once = re.sub(r"([^\w\s])\1{2,}", r"\1", "A!!!!  b.... ??  " + t)
            t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", once))
        assert got[i].collapsed == t, i


def test_terms(spark, odd_dir):
    words = [re.findall(r"\w\w+", (t or "").lower()) for t in TEXTS]
    words = [ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])] for ws in words]
    total, df = Counter(w for ws in words for w in ws), Counter(w for ws in words for w in set(ws))
    got = run(spark, odd_dir, "tfidf_terms", "term")
    assert {w: (r.total, r.df, r.idf) for w, r in got.items()} == {w: (total[w], df[w], round(math.log((1 + len(TEXTS)) / (1 + df[w])) + 1, 6)) for w in total}


def test_heuristic(spark, odd_dir):
    got = QUERIES["heuristic_score"](spark, odd_dir).collect()
    assert len(got) == len(TEXTS)
    want = []
    for i in range(len(TEXTS)):
        if (t := prompt(i)) is None:
            want.append(None)
            continue
        t = t.strip()
        n = max(len(t), 1)
        hits = sum(bool(re.search(r, t, re.I)) for r in fixed.HEURISTIC_RULES)
        bits = -sum(c / n * math.log2(c / n) for c in Counter(t.lower()).values())
        punct, upper = sum(c in fixed.PUNCTUATION for c in t) / n, sum(c.isupper() for c in t) / n
        raw = hits * 0.55 + (n > 300) * 0.15 + punct * 0.8 + upper * 0.4 + bool(re.search(fixed.NEWLINE_COMMAND, t, re.I)) * 0.3 - bits * 0.04
        want.append(1 / (1 + math.exp(-raw + 1.2)))
    assert sorted(r.prob for r in got if r.prob is not None) == pytest.approx(sorted(w for w in want if w is not None), abs=2e-6)


def test_report(spark, odd_dir):
    got = run(spark, odd_dir, "sanitize_report")
    assert len(got) == len(TEXTS)
    for i in range(len(TEXTS)):
        s = t = prompt(i)
        if t is None:
            continue
        for r in fixed.STRIP_RULES:
            s = re.sub(r, "[STRIPPED]", s, flags=re.I)
        s = re.sub(r"\s+", " ", s).strip()
        assert (got[i].length_before, got[i].length_after, got[i].delta, got[i].head) == (len(t), len(s), len(t) - len(s), s[:120].lower()), i


def test_decoded(spark, odd_dir):
    """Every whole text comes back, if nine tenths of it are printable."""
    for name in ("decode_base64", "decode_hex"):
        got = run(spark, odd_dir, name)
        for i, t in enumerate(TEXTS):
            good = t and sum(c.isprintable() or c in "\t\n" for c in t) >= fixed.MIN_PRINTABLE * len(t)
            assert got[i].decoded == (t if good else None), (name, i)


def test_unwrapped(spark, odd_dir):
    got = run(spark, odd_dir, "unwrap_encodings")
    assert LONG in got[9].canonical and LONG + "ende" in got[11].canonical


def test_random_changes_reach_the_end(spark, odd_dir):
    swap = str.maketrans(*fixed.HOMOGLYPH_NINE)
    for i, r in run(spark, odd_dir, "perturb_random").items():
        if (t := TEXTS[i]) is None:
            continue
        assert len(r.homoglyph) == len(t) and all(b in (a, a.translate(swap)) for a, b in zip(t, r.homoglyph))
        assert r.casing.casefold() == t.casefold()
        assert re.sub(f"[{fixed.ZERO_WIDTH}]", "", r.zero_width) == t
        if len(t) > 800:
            tail = t[600:]
            assert r.homoglyph[600:] != tail and r.casing[600:] != tail and any(c in fixed.ZERO_WIDTH for c in r.zero_width[-200:])


def test_union(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "benchmark"))
    got = QUERIES["union_labeled"](spark, sf_dir)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {1: docs, 0: items}
