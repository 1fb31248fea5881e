"""MinHash near-duplicate classes with HyperMinHash registers.

Each text's shingle set is folded into ``BANDS * ROWS`` buckets. A bucket keeps of its
smallest hash only the number of leading zeros and a few mantissa bits, one byte in all
(HyperMinHash); empty buckets borrow from full ones along fixed probe sequences, so two
sets agree in a register about as often as their Jaccard similarity J. Registers are
banded into keys; sets that share a key are candidates. A candidate pair's J is estimated
from its agreeing registers, less the agreement that truncation alone would give, and a
pair whose estimate lies six standard errors under the threshold is dropped. All others
are confirmed on the full sets, so no false link can arise. Where buckets are full, a true
link at J = 0.75 is missed with probability (1 - 0.75**5)**56, about 3e-7.

Sets of under ``SMALL`` members fill few buckets, and bands repeat what they borrow. Links
of such sets are found exactly instead, by a prefix filter: members are ordered from rare to
common, and linked sets share one among the first n - ceil(0.75 n) + 1. Sets that a small
one can be linked to give these keys as well. No estimate is asked of a small set.

Scale: equal sets collapse to one representative before banding. Within a band key all
members are compared to one leader (the one that shares most keys), which joins a large
group of near copies in one pass. Members that met the same leader and are still in
different components are then compared to each other in blocks of about 384 documents:
a task reads two blocks and returns one link for each pair of components that it finds
linked, so neither pairs nor the links between two large components are rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release, settings
from .graph import connected_components
from .shingles import mix64, shingle_sets

BANDS, ROWS = 56, 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 3
EMPTY = 255
COLLISION = 1 / 3 / 2**MANTISSA_BITS  # two geometric counts agree with probability 1/3
NUMERATOR, DENOMINATOR = 75, 100
SMALL = 32
WIDE = (SMALL - 1) * DENOMINATOR // NUMERATOR  # the largest set that a small one can be linked to
BLOCK = 384
_PROBES = np.random.default_rng(20240601).integers(0, REGISTERS, (24, REGISTERS))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``REGISTERS`` bytes per set; all ``EMPTY`` for an empty set."""
    n = len(sets)
    low = np.full(n * REGISTERS, 2**64 - 1, np.uint64)
    if n and (sizes := np.array([len(s) for s in sets])).sum():
        values = np.concatenate(sets)
        doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
        bucket = (mix64(values, 2) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
        np.minimum.at(low, doc * REGISTERS + bucket.astype(np.int64), mix64(values, 3))
    full = low != 2**64 - 1
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.int64)
    zeros = np.clip(64 - exponent, 0, 30)
    shift = np.clip(exponent - 1 - MANTISSA_BITS, 0, 63).astype(np.uint64)
    reg = (zeros << MANTISSA_BITS | ((low >> shift) & np.uint64(2**MANTISSA_BITS - 1)).astype(np.int64)).astype(np.uint8)
    reg[~full] = EMPTY
    first = reg.reshape(n, REGISTERS)
    out = first.copy()
    for probe in _PROBES:
        empty = out == EMPTY
        if not empty.any():
            break
        out = np.where(empty, first[:, probe], out)
    for i in np.flatnonzero((out == EMPTY).any(1) & (first != EMPTY).any(1)):  # few members: take the next full bucket
        row = np.flatnonzero(out[i] != EMPTY)
        hole = np.flatnonzero(out[i] == EMPTY)
        out[i, hole] = out[i, row[np.searchsorted(row, hole) % len(row)]]
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    """Keys of each band: the band's number and its register bytes, exactly, in 63 bits."""
    keys = np.repeat(np.arange(BANDS, dtype=np.int64)[None, :], len(reg), 0)
    for r in range(ROWS):
        keys = keys << 8 | reg[:, r * BANDS : (r + 1) * BANDS].astype(np.int64)
    return keys


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of register rows, corrected for chance agreement of truncated values."""
    return np.clip(((a == b).mean(1) - COLLISION) / (1 - COLLISION), 0, 1)


def margin(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Six standard errors of ``estimate`` at the threshold, given how many buckets the sets fill; 1 for small sets."""
    least = np.minimum(n_a, n_b)
    effective = np.minimum(0.6 * REGISTERS, least)
    return np.where(least < SMALL, 1, 6 * np.sqrt(0.25 / np.maximum(effective, 1)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sets = shingle_sets(part["text"].to_pylist())
            reg = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in reg], pa.binary()),
                    pa.array([s.view(np.int64) if 0 < len(s) <= WIDE else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "registers", "few"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = band_keys(_matrix(part["registers"]))
            ids = np.repeat(part["doc_id"].to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "rep"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _matrix(batch["reg_a"]), _matrix(batch["reg_b"])
        n_a, n_b = (batch[c].to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        keep = estimate(a, b) + margin(n_a, n_b) >= NUMERATOR / DENOMINATOR if len(a) else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], ["a", "b"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = shingle_sets(part["text"].to_pylist())
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "members"])


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, registers`` of each text, and the members ``few`` of sets up to ``WIDE``; equal sets have equal keys."""
    return docs.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, registers binary, few array<long>")


def _prefixes(reps: DataFrame) -> DataFrame:
    """``key, rep`` of sets up to ``WIDE``: their rarest members, of which linked sets share one.

    Members of one set only come first in that order and are counted, not joined. Keys are
    negative, those of bands are not.
    """
    each = reps.where(F.col("n_shingles") <= WIDE).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("few").alias("member"))
    each = materialize(each, "few")
    common = materialize(each.groupBy("member").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "common")
    one = Window.partitionBy("rep")
    own = each.join(common, "member").withColumn("of", F.count(F.lit(1)).over(one)).withColumn("place", F.row_number().over(one.orderBy("sets", "member")))
    length = F.expr(f"n - (n * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR} + 1 - (n - of)")
    rarest = own.where(F.col("place") <= length).select(F.col("member").bitwiseOR(F.lit(-(2**63)).cast("long")).alias("key"), "rep")
    out = materialize(rarest, "prefixes")
    release(each)
    return out


def _fits(a: str, b: str) -> F.Column:
    """Sizes that a pair over the threshold can have."""
    return (F.col(a) * DENOMINATOR >= F.col(b) * NUMERATOR) & (F.col(b) * DENOMINATOR >= F.col(a) * NUMERATOR)


def _confirmed(pairs: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the candidate pairs ``a, b`` whose full sets reach the threshold, as ``src, dst``."""
    side = lambda x: signed.select(F.col("doc_id").alias(x), F.col("registers").alias(f"reg_{x}"), F.col("n_shingles").alias(f"n_{x}")).hint("merge")
    likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely, "a long, b long")
    of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("members").alias(f"m_{x}")).hint("merge")
    common = F.size(F.array_intersect("m_a", "m_b"))
    union = F.size("m_a") + F.size("m_b") - common
    links = likely.join(of("a"), "a").join(of("b"), "b").where(common * DENOMINATOR >= union * NUMERATOR)
    return materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the two blocks of one task: one for each pair of components that are linked there."""
    ids, comp, block = (table[c].to_numpy() for c in ("rep", "c", "block"))
    sets = [np.asarray(m.values if hasattr(m, "values") else m, np.int64).view(np.uint64) for m in table["members"].combine_chunks()]
    n = np.array([len(s) for s in sets])
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    src, dst = [], []
    if len(left) and len(right):
        reg = registers(sets)
        wanted = np.zeros((len(ids), len(ids)), bool)
        for i in left:
            j = right[(comp[right] != comp[i]) & (n[right] * DENOMINATOR >= n[i] * NUMERATOR) & (n[i] * DENOMINATOR >= n[right] * NUMERATOR)]
            if lo == hi:
                j = j[j > i]
            wanted[i, j[estimate(reg[j], reg[i]) + margin(n[j], n[i]) >= NUMERATOR / DENOMINATOR]] = True
        if wanted.any():
            used = np.flatnonzero(wanted.any(0) | wanted.any(1))
            values = np.concatenate([sets[i] for i in used])
            owner = np.repeat(used, n[used])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            cut = np.flatnonzero(values[1:] != values[:-1]) + 1
            begin, end = np.r_[0, cut], np.r_[cut, len(values)]
            common = np.zeros(wanted.shape, np.int32)
            for s, e in zip(begin[end - begin > 1], end[end - begin > 1], strict=True):
                common[owner[s:e, None], owner[s:e]] += 1
            i, j = np.nonzero(wanted & (common.astype(np.int64) * DENOMINATOR >= (n[:, None] + n - common) * NUMERATOR))
            _, one = np.unique(np.sort(np.stack([comp[i], comp[j]], 1), 1), axis=0, return_index=True)
            src, dst = ids[i[one]], ids[j[one]]
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def near_duplicates(docs: DataFrame, batch_rows: int = 2000) -> DataFrame:
    """Near-duplicate class of every document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when ``100 * |A & B| >= 75 * |A | B|`` on their full shingle
    sets; ``component_id`` is the smallest ``doc_id`` reachable over links and ``kept``
    marks the document that has it. Null, empty and blank texts have an empty set and are
    linked with nothing. Other columns of ``docs`` are ignored, whatever their names; an
    empty table gives an empty result. ``doc_id`` must be unique and not null. Whole texts
    are read, ``batch_rows`` at a time, which bounds what a worker holds.
    """
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    signed = materialize(sketches(docs), "sketches")
    classes = materialize(signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = signed.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bands = reps.where(F.col("n_shingles") >= SMALL).select("doc_id", "registers").mapInArrow(_bands, "key long, rep long")
    bands = materialize(bands, "bands").unionByName(_prefixes(reps))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    live = materialize(bands.join(materialize(shared, "shared"), "key"), "live")
    release(bands)

    sizes = signed.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    central = materialize(live.groupBy("rep").agg(F.sum("members").alias("central")).join(sizes, "rep"), "central")
    sets = docs.select("doc_id", "text").join(central.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = materialize(sets.mapInArrow(_members, "doc_id long, members array<long>"), "sets")
    top = F.max(F.struct("central", (-F.col("rep")).alias("minus"), "n")).alias("top")
    leader = materialize(live.select("key", "rep").join(central, "rep").groupBy("key").agg(top), "leaders")
    leader = leader.select("key", (-F.col("top.minus")).alias("leader"), F.col("top.n").alias("n_l"))
    met = materialize(live.select("key", "rep").join(leader, "key").select("leader", "n_l", "rep").distinct().join(sizes, "rep"), "met")
    release(live)
    stars = met.where((F.col("leader") != F.col("rep")) & _fits("n_l", "n"))
    links = _confirmed(stars.select(F.col("leader").alias("a"), F.col("rep").alias("b")), signed, sets)
    joined = connected_components(links)

    group = met.select("leader", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    group = materialize(group.select("leader", "rep", F.coalesce("component", "rep").alias("c")), "grouped")
    mixed = group.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi and size > 2")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    tasks = (
        group.join(materialize(mixed.select("leader", blocks.alias("blocks")), "mixed"), "leader")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leader", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "c")
    )
    loaded = tasks.join(sets.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
    more = materialize(loaded.groupBy("leader", "lo", "hi").applyInArrow(_block_links, "src long, dst long"), "more")
    final = connected_components(links.unionByName(more))

    named = materialize(
        classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id")), "named"
    )
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
