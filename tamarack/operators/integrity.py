"""Dedup, fingerprints, splits and leakage of labelled text tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.coerce import text_norm
from ..functions.pieces import in_pieces
from .scratch import kept


def text_hash(text: Column) -> Column:
    """A stable 128-bit hex digest of the stripped text."""
    return F.md5(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "").cast("binary"))


@F.pandas_udf(StringType())
def xxh3_128(s: pd.Series) -> pd.Series:
    """The xxh3 digest of the stripped text, where byte parity with it is wanted."""
    import xxhash

    return s.map(lambda t: None if t is None else xxhash.xxh3_128_hexdigest(t.strip().encode()))


def exact_dedup(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Keep the first row of each normalised text, by ``order``.

    The first is found by a partial aggregate, so copies that make up a large part of the
    table meet as one row per task.
    """
    marked = df.withColumn("text_hash", text_hash(text_norm(F.col(text))))
    first = marked.groupBy("text_hash").agg(F.min(order).alias(order)).select(order)
    return marked.join(first, order, "left_semi")


def dedup_report(df: DataFrame, text: str = "text") -> DataFrame:
    h = text_hash(text_norm(F.col(text)))
    n, kept = F.count(F.lit(1)), F.countDistinct(h)
    return df.agg(n.alias("n_before"), kept.alias("n_after"), (n - kept).alias("n_removed"))


SIMHASH_TOKENS = 256
_VOTERS = 1 << 16  # words whose bits are unpacked at a time


def simhash64(df: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = SIMHASH_TOKENS) -> DataFrame:
    """``key, simhash``: signs of token-hash bit sums over the first ``most`` words (None: all), repeats counted.

    Bit i is set where at least half of the tokens' digests have it; a text without words
    has all bits set. Token bits are the first 64 of md5, so SQL engines agree.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"[^{fixed.WORD[1:-1]}]+"), F.lit(" ")))
    if most is not None:
        words = F.substring_index(words, " ", most)
    return df.select(key, _votes(F.nullif(words, F.lit(""))).alias("simhash"))


def _majority(texts: list[list[str]] | pa.Array) -> pa.Array:
    """The majority of the token digests at each of 64 bits, a tie counting as set; all bits without a token.

    Each distinct token is digested once for all texts.
    """
    texts = pa.array(texts, pa.list_(pa.string())) if isinstance(texts, list) else texts
    tokens = texts.flatten().dictionary_encode()
    raw = b"".join(md5(t).digest()[:8] for t in tokens.dictionary.cast(pa.binary()).to_pylist())
    digests, codes = np.frombuffer(raw, np.uint8).reshape(-1, 8), tokens.indices.to_numpy()
    ends = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().cumsum()
    out = np.full(len(texts), -1, np.int64)
    for k, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
        if start < end:
            votes = sum(np.unpackbits(digests[codes[at : min(at + _VOTERS, end)]], axis=1).sum(0, dtype=np.int64) for at in range(start, end, _VOTERS))
            out[k] = np.packbits(2 * votes >= end - start).view(">i8")[0]
    return pa.array(out)


def _split_majority(texts: pa.Array) -> pa.Array:
    """``_majority`` of texts whose tokens have one blank between them."""
    return _majority(pc.split_pattern(texts, " "))


_votes = in_pieces(_split_majority, LongType(), arrow=True)


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def near_dup_pairs(hashes: DataFrame, key: str = "doc_id", bits: int = fixed.NEAR_PREFIX_BITS, most: int = fixed.NEAR_DISTANCE) -> DataFrame:
    """Classes of equal fingerprints that share a prefix block and differ in at most ``most`` bits.

    One row ``a, b, distance, n_a, n_b, pairs`` for each pair of classes, named by their
    smallest keys (``a < b``) with their sizes and the number of row pairs they stand for;
    a class of several rows also has a row with itself, at distance 0. So copies are counted
    and not multiplied; ``near_dup_members`` tells who is in a class. Fingerprints that differ
    in ``most`` bits agree in one of ``most + 1`` parts of the bits behind the prefix, so the
    join is on prefix and part. The classes are written once, as all sides of the join read
    them: the texts are gone through once.
    """
    classes = kept(hashes.groupBy("simhash").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    cuts = [64 - bits - (64 - bits) * i // (most + 1) for i in range(most + 2)]  # bits behind the prefix, in most + 1 parts
    parts = [F.shiftrightunsigned(F.shiftleft("simhash", 64 - high), 64 - high + low) if high > low else F.lit(0).cast("long") for high, low in zip(cuts, cuts[1:], strict=False)]
    keyed = classes.withColumn("block", F.shiftrightunsigned("simhash", 64 - bits)).select("*", F.posexplode(F.array(*parts)).alias("i", "part"))
    x, y = keyed.alias("x"), keyed.alias("y")
    far = hamming64(F.col("x.simhash"), F.col("y.simhash"))
    same = (F.col("x.block") == F.col("y.block")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.rep") < F.col("y.rep")) & (far <= most)
    for i, (high, low) in enumerate(zip(cuts, cuts[1:-1], strict=False)):  # a pair may share several parts: the first counts
        same &= (F.col("x.i") <= i) | (F.col("x.simhash").bitwiseXOR(F.col("y.simhash")).bitwiseAND(F.lit((1 << high) - (1 << low))) != 0)
    near = x.join(y, same).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), far.alias("distance"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), (F.col("x.n") * F.col("y.n")).alias("pairs")
    )
    own = classes.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("distance"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return near.unionByName(own)


def near_dup_members(hashes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, rep``: each row's class, the smallest key with the same fingerprint."""
    return hashes.join(hashes.groupBy("simhash").agg(F.min(key).alias("rep")), "simhash").select(key, "rep")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.15, val: float = 0.15, seed: int = 1337) -> DataFrame:
    """Add ``split``: exact quotas per label (rounded up for test, then val), the rest train.

    Rows are dealt by a seeded digest of the key. Ranks are counted in two levels, by
    digest prefix and inside it, so a label may hold most rows.
    """
    d = df.withColumn("_d", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))).withColumn("_b", F.substring("_d", 1, 2))
    counts = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label)
    first = counts.select(label, "_b", (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_first"), F.sum("_n").over(w).alias("_total"))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_d", key))
    ranked = d.withColumn("_r", inside).join(first.withColumnRenamed(label, "_l").withColumnRenamed("_b", "_fb"), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_fb")))
    rank = F.col("_first") + F.col("_r")
    n_test, n_val = F.ceil(F.col("_total") * test), F.ceil(F.col("_total") * val)
    split = F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).select(*df.columns, "split")


def leakage(df: DataFrame, split: str = "split", digest: str = "text_hash") -> DataFrame:
    """Number of digests that each pair of splits shares."""
    per = df.select(split, digest).distinct().groupBy(digest).agg(F.sort_array(F.collect_set(split)).alias("s"))
    two = lambda a, b: F.sum((F.array_contains("s", a) & F.array_contains("s", b)).cast("long"))
    return per.agg(*(F.coalesce(two(a, b), F.lit(0)).alias(f"{a}_{b}") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))))


def tail_split(df: DataFrame, order: str, tail: int = 1625, head: int = 8000) -> DataFrame:
    """First ``head`` rows train, last ``tail`` rows test (test wins), by distributed ranks of ``order``."""
    first = df.select(order).orderBy(order).limit(head)
    last = df.select(order).orderBy(F.desc(order)).limit(tail)
    mark = first.withColumn("s", F.lit("train")).join(last.withColumn("t", F.lit("test")), order, "full_outer")
    return df.join(mark, order, "left").withColumn("split", F.coalesce("t", "s", F.lit("unused"))).drop("s", "t")


def hashed(digest: Callable[[bytes], str] = lambda b: hashlib.sha256(b).hexdigest()) -> Callable:
    """An Arrow column function for any other digest of the stripped text."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else digest(t.strip().encode()))

    return run
