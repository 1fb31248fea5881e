"""Fill-in-middle transformation over run-length encoded character classes.

A text is cut into units: a maximal run of ASCII letters is one unit, any other code point is
one unit of its own. The text is stored as its maximal runs of one class (letters, or
everything else) with the number of units before each run. The place of a cut after ``k``
units is the start of the last run with at most ``k`` units before it, plus, in a run of
others, the units still to go: one binary search, no list of units.

Runs of a batch of texts lie in one array (a text always starts a new run), so all cuts of a
batch are searched at once. Arrow carries texts one way only; three numbers a text come back
and Spark cuts and joins the strings.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values of the format
PLAIN_FROM, SPM_BELOW = 90, 20  # per cent
CHUNK = 1 << 22


class Runs(NamedTuple):
    """Class runs of several texts, one after the other.

    ``start`` holds the code points and ``before`` the units before each run, both with a
    closing total; ``text_start`` the code points before each text, with a closing total.
    """

    start: np.ndarray
    before: np.ndarray
    text_start: np.ndarray

    def units_before(self) -> np.ndarray:
        """Units before each text, with a closing total."""
        return self.before[np.searchsorted(self.start, self.text_start)]

    def offsets(self, units: np.ndarray) -> np.ndarray:
        """Code points before the given numbers of units, counted over all texts."""
        run = np.searchsorted(self.before, units, side="right") - 1
        return self.start[run] + units - self.before[run]  # a cut never lies inside a run of letters, whose one unit it would split


def encode(texts: list[str]) -> Runs:
    """Run-length class encoding of whole texts; empty texts have no run."""
    text_start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=text_start[1:])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (codes | 32) - np.uint32(97) < 26
    first = np.ones(len(codes), bool)
    first[1:] = letter[1:] != letter[:-1]
    first[text_start[text_start < len(codes)]] = True
    start = np.r_[np.flatnonzero(first), len(codes)]
    before = np.zeros(len(start), np.int64)
    np.cumsum(np.where(letter[start[:-1]], 1, np.diff(start)), out=before[1:])
    return Runs(start, before, text_start)


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "low", "high")]))
def places(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Units of a text, and the code points before its two cuts, drawn from ``h1`` and ``h2``."""
    texts = [t or "" for t in text.to_pylist()]
    draws = [h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2)]
    out = np.zeros((3, len(texts)), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):  # about CHUNK code points, or one longer text
            size += len(texts[end])
            end += 1
        runs = encode(texts[at:end])
        before = runs.units_before()
        n = np.diff(before)
        a, b = (d[at:end] % (n + 1) for d in draws)
        out[:, at:end] = n, *(runs.offsets(before[:-1] + f(a, b)) - runs.text_start[:-1] for f in (np.minimum, np.maximum))
        at = end
    return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "low", "high"])


def draws(key: Column, seed: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first digit groups of a SHA-256 over the seed and its id."""
    digits = F.sha2(F.concat(F.lit(seed), key.cast("string")).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, seed: str = "1:") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    ``form`` is ``plain`` for empty texts, for texts that hold one of the three marks and for
    the drawn share from ``plain_from`` per cent up; else ``spm`` for the share below
    ``spm_below`` per cent, else ``psm``. A null text is an empty one. Repeated texts are cut
    by their own ids; repeated ids give equal draws; a null id draws as an empty string.
    Whole texts of any length are read. Extra columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    h = draws(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (h[2] % 100).alias("c"), (h[3] % 100).alias("s"), h[0].alias("h1"), h[1].alias("h2"))
    placed = text.withColumn("at", places("text", "h1", "h2")).select("doc_id", "text", "c", "s", "at.n", F.col("at.low").cast("int").alias("low"), F.col("at.high").cast("int").alias("high"))
    marked = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when(marked | (F.col("c") >= plain_from), "plain").when(F.col("s") < spm_below, "spm").otherwise("psm")
    low, high = F.col("low"), F.col("high")
    pieces = placed.select(
        "doc_id", "n", form.alias("form"), "low", "high", "text",
        F.substring("text", F.lit(1), low).alias("p"), F.substring("text", low + 1, high - low).alias("m"), F.substring("text", high + 1, F.char_length("text")).alias("s"),
    )
    psm = F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m")
    spm = F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")
    cut = F.col("form") != "plain"
    return pieces.select(
        "doc_id", "n", "form", F.when(cut, low.cast("long")).alias("prefix_chars"), F.when(cut, (high - low).cast("long")).alias("middle_chars"),
        F.when(~cut, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restore(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that a transformed one was made from; the pieces hold no mark, so the first of each kind counts."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    whole = F.char_length(out)
    between = lambda a, b: F.substring(out, a, b - a)
    s, p, m = (F.instr(out, k) for k in (SUFFIX, PREFIX, MIDDLE))
    size = F.lit(3)
    psm = F.concat(between(p + size, s), F.substring(out, m + size, whole), between(s + size, m))
    spm = F.concat(between(p + size, m), F.substring(out, m + size, whole), between(s + size, p))
    return F.when(form == "plain", out).when(form == "psm", psm).otherwise(spm)
