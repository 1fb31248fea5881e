"""Rule scores and engineered features."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import fixed
from .pieces import columns, in_pieces
from .sanitize import FLAGS, _trim, compiled, folded, may_match


def rule_hits(s: Column, rules: tuple[str, ...], flags: str = FLAGS) -> Column:
    """How many of the rules match; a rule is tried on texts that hold one of its literals."""
    low = folded(s)
    return reduce(lambda a, r: a + (may_match(low, [r]) & s.rlike(compiled(r, flags))).cast("int"), rules, F.lit(0))


def regex_heuristic_score(s: Column) -> Column:
    raw = rule_hits(s, fixed.BASELINE_RULES) + F.when(F.length(s) > 800, 0.5).otherwise(0.0)
    return 1 / (1 + F.exp(-(raw - 1.5)))


def rule_score(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    return rule_hits(s, fixed.SCORER_RULES) + F.when(F.length(s) > 800, 0.5).otherwise(0.0)


def rule_fraction(s: Column) -> Column:
    return rule_hits(s, fixed.FRACTION_RULES) / len(fixed.FRACTION_RULES)


def any_rule(s: Column) -> Column:
    return F.when(s.rlike(FLAGS + "|".join(fixed.ANY_RULES)), 1.0).otherwise(0.0)


_TABLE = 0x3000  # code points that are counted by table; higher ones singly
_CLASSES: dict[str, Callable[[str], bool]] = {
    "space": lambda c: c == " ",
    "punct": lambda c: c in fixed.PUNCTUATION,
    "digit": lambda c: unicodedata.category(c) == "Nd",
    "upper": lambda c: unicodedata.category(c) == "Lu",
    "uppercase": str.isupper,
    "non_ascii": lambda c: c > "\x7f",
}


@cache
def _class_table(names: tuple[str, ...]) -> np.ndarray:
    return np.array([[_CLASSES[n](chr(c)) for n in names] for c in range(_TABLE)], np.int64)


def character_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct code points of a text and how often each occurs."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) and codes.max() < _TABLE:
        counts = np.bincount(codes)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(codes, return_counts=True)


def _bits(counts: np.ndarray, n: int, epsilon: float) -> float:
    share = counts / n
    return float(-(share * np.log2(share + epsilon)).sum()) if len(counts) else 0.0


def _statistics(classes: tuple[str, ...], epsilon: float, lower: bool) -> Callable[[Column], Column]:
    """Struct of a trimmed text's ``length``, shares of ``classes`` and entropy in ``bits`` per character."""

    names = ["length", *classes, "bits"]

    def run(texts: list[str | None]) -> pa.Array:
        table, rows = _class_table(classes), []
        for text in texts:
            if text is None:
                rows.append((None,) * (len(classes) + 2))
                continue
            text = text.strip()
            n = max(1, len(text))
            codes, counts = character_counts(text)
            low = codes < _TABLE
            hits = counts[low] @ table[codes[low]]
            for code, many in zip(codes[~low].tolist(), counts[~low].tolist(), strict=True):
                hits = hits + [many * _CLASSES[c](chr(code)) for c in classes]
            if lower:
                counts = character_counts(text.lower())[1]
            rows.append((len(text), *(hits / n), _bits(counts, n, epsilon)))
        return columns(names, [pa.int32(), *[pa.float64()] * (len(names) - 1)], rows)

    return in_pieces(run, StructType([StructField(c, DoubleType() if c != "length" else IntegerType()) for c in names]))


_ENGINEERED = ("space", "punct", "digit", "upper", "non_ascii")
_engineered = _statistics(_ENGINEERED, 1e-12, False)
_heuristic = _statistics(("punct", "uppercase"), 0.0, True)


def engineered_features(text: Column) -> dict[str, Column]:
    """Length, five character shares and entropy of a trimmed text; null counts as empty.

    One Arrow pass counts each text's characters; all features are read off these counts.
    """
    s = _engineered(F.coalesce(text, F.lit("")))
    return {"n_chars": s["length"]} | {f"{c}_ratio": s[c] for c in _ENGINEERED} | {"entropy": s["bits"]}


def heuristic_score(text: Column) -> dict[str, Column]:
    """The weighted heuristic: probability, matched rules and what it was made of; null for a null text.

    Rules run on texts that hold one of their literals.
    """
    t = _trim(text)
    s = _heuristic(text)
    low = folded(t)
    n = F.greatest(s["length"], F.lit(1))
    hits = [may_match(low, [r]) & t.rlike(compiled(r)) for r in fixed.HEURISTIC_RULES]
    rules = reduce(lambda a, h: a + h.cast("int"), hits, F.lit(0))
    matched = F.array_compact(F.array(*(F.when(h, F.lit(i)) for i, h in enumerate(hits))))
    punct, upper, bits = s["punct"], s["uppercase"], s["bits"]
    newline = (may_match(low, [fixed.NEWLINE_COMMAND]) & t.rlike("(?iu)" + fixed.NEWLINE_COMMAND)).cast("int")
    raw = rules * 0.55 + F.when(n > 300, 0.15).otherwise(0.0) + punct * 0.8 + upper * 0.4 + newline * 0.3 - bits * 0.04
    return {
        "prob": 1 / (1 + F.exp(-raw + 1.2)), "rule_score": rules, "matched": matched, "length": n, "word_count": token_count(t),
        "entropy": bits, "punct_density": punct, "upper_ratio": upper, "has_newline_cmd": newline == 1,
    }


_ASCII_WORD = re.compile("[A-Za-z0-9]+")
_MARKERS = {"enc", "base64", "hex", "url"}


def token_set(text: str) -> set[str]:
    """Distinct lower-case ASCII words, without the names of decoding markers."""
    return set(_ASCII_WORD.findall(text.lower())) - _MARKERS


@F.pandas_udf(DoubleType())
def recovery_rate(original: pd.Series, canonical: pd.Series) -> pd.Series:
    """Share of the original's words that the canonical text has; 0 without words, null if either is null."""

    def rate(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        own = token_set(a)
        return len(own & token_set(b)) / len(own) if own else 0.0

    return pd.Series([rate(a, b) for a, b in zip(original, canonical, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def bag_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of two texts' counts of lower-case ASCII words, a stand-in for a sentence encoder; 0 if either has none, null if either is null."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        p, q = (Counter(_ASCII_WORD.findall(t.lower())) for t in (x, y))
        size = math.sqrt(sum(n * n for n in p.values())) * math.sqrt(sum(n * n for n in q.values()))
        return sum(n * q[w] for w, n in p.items()) / size if size else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_count(s: Column) -> Column:
    return F.regexp_count(F.coalesce(s, F.lit("")), F.lit(r"(?U)\S+"))


def first_bytes(s: Column, size: int = 256) -> Column:
    """The first ``size`` UTF-8 bytes, zero-padded, as binary."""
    return F.unhex(F.rpad(F.substring(F.hex(s.cast("binary")), 1, 2 * size), 2 * size, "0"))


def length_bin(s: Column) -> Column:
    n = F.length(s)
    return F.when(n < 50, "<50").when(n < 150, "50-149").when(n < 400, "150-399").when(n < 800, "400-799").otherwise("800+")
