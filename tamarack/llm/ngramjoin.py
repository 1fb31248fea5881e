"""Similarity join of five-word shingle sets with adaptive multi-match prefixes.

Members are ordered from rare to common by the number of sets that hold them. Two sets of
Jaccard similarity t or more have at least ``need = ceil(t * n)`` members in common, seen from
either side, so the first ``n - need + l`` members of both share at least ``l`` (``l`` up to
``need``). Each set picks its own ``l``: a longer prefix has more postings, and asks for more
matches, of which fewer sets reach enough. The estimate of its cost is the number of postings
that its prefix meets, ``met``, plus a verification for each of the at most ``met / l`` sets
that can reach ``l`` matches. A pair is verified when its prefixes share as many members as
the smaller of both ``l``, and the bound by places in the order allows the similarity.

Pruning comes first: a set is *active* if at least ``need`` of its members lie in some other
active set; members of inactive sets are no postings. A set that has more than ``n - need``
members of its own among three eighths of all hashes is out already, which spares most texts
the shuffle of the rest. Common members of two linked sets are all in two active sets, so a
verification reads these members and the sizes of the full sets.

Scale: equal sets collapse to one representative. A third of the corpus may be near copies of
one text: each member's postings are first compared to one leader, the set with most company,
and what is linked falls into one component. Sets that met the same leader and are in other
components than most of its group are then compared to the group in blocks of about 384: a
task reads two blocks and returns one link for each pair of components it finds linked, so no
pairs are rows, and the part of the group that is one component already is not compared to
itself. Nothing is gathered but the members of one text and the sets of two blocks. Every step
is a shuffle by member or by document; what is read twice is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release, settings
from .graph import connected_components
from .shingles import shingle_sets

MOST = 4
BLOCK = 384
READ = 1 / 16  # cost of reading a member in a verification, in postings


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch["text"].to_pylist())
        keys = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "set_key"])


def _postings(eighths: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = shingle_sets(part["text"].to_pylist())
                if eighths < 8:
                    sets = [s[(s & np.uint64(7)) < eighths] for s in sets]
                reps = np.repeat(part["doc_id"].to_numpy(zero_copy_only=False), [len(s) for s in sets])
                values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                for low in range(0, len(reps), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(values[low : low + 100_000].view(np.int64)), pa.array(reps[low : low + 100_000])], ["member", "rep"])

    return run


def _possible_sets(texts: DataFrame, sizes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Sizes of the sets that don't have too many members of their own among some of all hashes."""
    some = texts.mapInArrow(_postings(3), "member long, rep long")
    alone = some.groupBy("member").agg(F.count(F.lit(1)).alias("df"), F.min("rep").alias("rep")).where("df = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    return sizes.join(alone, "rep", "left").where(F.coalesce("alone", F.lit(0)) <= F.col("n") - _need("n", numerator, denominator)).select("rep", "n")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of members that several sets hold, with the number ``df`` of these."""
    return postings.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("member"))).where("df > 1")


def _need(n: str | Column, numerator: int, denominator: int) -> Column:
    """``ceil(n * t)``, in integers."""
    n = F.col(n) if isinstance(n, str) else n
    return F.floor((n * numerator + (denominator - 1)) / denominator).cast("long")


def _active(shared: DataFrame, sizes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Postings ``member, rep, n`` of the sets of which enough members are shared."""
    fit = shared.groupBy("rep").agg(F.count(F.lit(1)).alias("of")).join(sizes, "rep").where(F.col("of") >= _need("n", numerator, denominator))
    return shared.select("member", "rep").join(fit.select("rep", "n"), "rep")


def prefixes(live: DataFrame, numerator: int, denominator: int, most: int = MOST) -> DataFrame:
    """``member, rep, n, place, l, company`` of the prefix that each set picks by estimated cost.

    ``live`` has ``member, rep, n, df``; members of one set only come first in the order and
    have no row. ``company`` is the number of postings that all of a set's rows meet.
    """
    one = Window.partitionBy("rep")
    rarest = one.orderBy("df", "member")
    base = F.col("n") - _need("n", numerator, denominator)
    rows = live.select(
        "member", "rep", "n",
        (F.col("n") - F.count(F.lit(1)).over(one) + F.row_number().over(rarest)).alias("place"),
        F.sum(F.col("df") - 1).over(rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("met"),
        F.sum(F.col("df") - 1).over(one).alias("company"),
    )
    rows = rows.where(F.col("place") <= base + most)
    options = []
    for k in range(1, most + 1):
        met = F.coalesce(F.max(F.when(F.col("place") <= base + k, F.col("met"))).over(one), F.lit(0))
        cost = met * (1 + F.col("n") * (READ / k))
        options.append(F.when(F.lit(k) <= _need("n", numerator, denominator), F.struct(cost.alias("cost"), F.lit(k).alias("l"))))
    return rows.withColumn("l", F.array_min(F.array_compact(F.array(*options)))["l"]).where(F.col("place") <= base + F.col("l")).drop("met")


def _possible(a: str, b: str, numerator: int, denominator: int) -> Column:
    """Whether a member at given places allows sets ``a, b`` to be similar: what lies before and behind it bounds the overlap."""
    place, n = (lambda x: F.col(f"place_{x}")), (lambda x: F.col(f"n_{x}"))
    most = F.least(place(a), place(b)) + F.least(n(a) - place(a), n(b) - place(b))
    return most * (numerator + denominator) >= (n(a) + n(b)) * numerator


def _verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int, name: str) -> DataFrame:
    """Those of the candidate pairs ``a, b`` that reach the similarity, as ``src, dst``."""
    of = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("members").alias(f"m_{x}")).hint("merge")
    common = F.size(F.array_intersect("m_a", "m_b"))
    links = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").where(common * denominator >= (F.col("n_a") + F.col("n_b") - common) * numerator)
    return materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), name)


def _matches(tokens: list[np.ndarray], size: int) -> np.ndarray:
    """Numbers of common elements of all pairs of the given arrays of distinct numbers."""
    owner = np.repeat(np.arange(size), [len(t) for t in tokens])
    values = np.concatenate(tokens)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    out = np.zeros((size, size), np.int32)
    for s, e in zip(np.r_[0, cut], np.r_[cut, len(values)], strict=True):
        if e - s > 1:
            out[owner[s:e, None], owner[s:e]] += 1
    return out


def _block_links(numerator: int, denominator: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Links between the two blocks of one task: one for each pair of components that are linked there."""
        ids, comp, block, n, least = (table[c].to_numpy() for c in ("rep", "c", "block", "n", "l"))
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        arrays = lambda c: [m.values.to_numpy(zero_copy_only=False) for m in table[c].combine_chunks()]
        row, other = np.arange(len(ids))[:, None], np.arange(len(ids))[None, :]
        ahead = (block[:, None] == lo) & (block[None, :] == hi) & (comp[:, None] != comp[None, :]) & ((lo != hi) | (row < other))
        ahead &= (n[:, None] * denominator >= n[None, :] * numerator) & (n[None, :] * denominator >= n[:, None] * numerator)
        src = dst = np.empty(0, np.int64)
        if ahead.any():
            ahead &= _matches(arrays("prefix"), len(ids)) >= np.minimum(least[:, None], least[None, :])
        if ahead.any():
            used = np.flatnonzero(ahead.any(0) | ahead.any(1))
            sets = arrays("members")
            common = _matches([sets[i] for i in used], len(used)).astype(np.int64)
            size = n[used]
            i, j = np.nonzero(ahead[np.ix_(used, used)] & (common * denominator >= (size[:, None] + size[None, :] - common) * numerator))
            i, j = used[i], used[j]
            _, one = np.unique(np.sort(np.stack([comp[i], comp[j]], 1), 1), axis=0, return_index=True)
            src, dst = ids[i[one]], ids[j[one]]
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _across(met: DataFrame, joined: DataFrame, loads: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links between sets that met one leader and are in different components."""
    group = met.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    group = materialize(group.select("leader", "rep", F.coalesce("component", "rep").alias("c")), "grouped")
    per = group.groupBy("leader", "c").agg(F.count(F.lit(1)).alias("size"))
    main = per.groupBy("leader").agg(F.sum("size").alias("all"), F.max(F.struct("size", "c")).alias("top")).where("all > 2 and all > top.size")
    blocks = lambda size: F.ceil(size / BLOCK).cast("int")
    shape = materialize(main.select("leader", F.col("top.c").alias("main"), blocks(F.col("top.size")).alias("mains"), blocks(F.col("all") - F.col("top.size")).alias("rests")), "shape")
    inner = F.col("c") == F.col("main")
    block = F.when(inner, F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("rep"), F.col("rests"))).cast("int")
    tasks = (
        group.join(shape, "leader")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.when(inner, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("rests") - 1)))
        .select("leader", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "c")
    )
    loaded = tasks.join(loads.hint("merge"), "rep")
    return materialize(loaded.groupBy("leader", "lo", "hi").applyInArrow(_block_links(numerator, denominator), "src long, dst long"), "more_links")


def similar_documents(docs: DataFrame, numerator: int = 80, denominator: int = 100, most: int = MOST, batch_rows: int = 2000) -> DataFrame:
    """Class of every document under links of shingle similarity: ``doc_id, n_shingles, component_id``.

    Two documents are linked when ``denominator * |A & B| >= numerator * |A | B|``;
    ``component_id`` is the smallest ``doc_id`` reachable over links, its own included. Null,
    empty and blank texts have an empty set and are linked with nothing. Repeated texts are
    one set. Ties in the order of members go by their hash, ties of leaders to the smaller
    ``doc_id``, ties of cost to the shorter prefix; none changes the result. Other columns of
    ``docs`` are ignored, whatever their names; an empty table gives an empty result.
    ``doc_id`` must be unique and not null. Whole texts of any length are read.
    """
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}):
        return _similar(docs, numerator, denominator, most)


def _similar(docs: DataFrame, numerator: int, denominator: int, most: int) -> DataFrame:
    t = (numerator, denominator)
    signed = materialize(docs.select("doc_id", "text").mapInArrow(_signed, "doc_id long, n_shingles long, set_key binary"), "signed")
    some = signed.where("n_shingles > 0")
    classes = materialize(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")
    sizes = classes.select("rep", "n")
    texts = lambda reps: docs.select("doc_id", "text").join(reps.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    possible = materialize(_possible_sets(texts(sizes), sizes, *t), "possible")
    shared = materialize(_shared(texts(possible).mapInArrow(_postings(8), "member long, rep long")).select("member", "rep"), "shared")
    live = materialize(_shared(_active(shared, possible, *t)), "live")
    release(shared)
    live2 = materialize(_shared(_active(live, possible, *t)), "live2")  # what was shared with sets that are out counts no more
    release(live)

    rows = materialize(prefixes(live2, *t, most), "prefixes")
    sets = live2.groupBy("rep").agg(F.first("n").alias("n"), F.collect_list("member").alias("members"))
    own = rows.groupBy("rep").agg(F.first("l").alias("l"), F.collect_list("member").alias("prefix"))
    loads = materialize(sets.join(own, "rep"), "loads")
    release(live2)
    top = F.max(F.struct("company", (-F.col("rep")).alias("minus"), "n", "place", "l")).over(Window.partitionBy("member"))
    led = rows.withColumn("top", top).select(
        (-F.col("top.minus")).alias("a"), F.col("top.n").alias("n_a"), F.col("top.place").alias("place_a"), F.col("top.l").alias("l_a"),
        F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("l").alias("l_b"),
    )
    enough = F.count(F.lit(1)) >= F.first(F.least("l_a", "l_b"))
    near = F.min(_possible("a", "b", *t))
    met = materialize(led.groupBy("a", "b").agg((enough & near).alias("likely")), "met")
    links = _verified(met.where("likely and a <> b"), loads, *t, "star_links")
    joined = connected_components(links)
    more = _across(met.select(F.col("a").alias("leader"), F.col("b").alias("rep")), joined, loads, *t)
    if not more.isEmpty():
        joined = connected_components(links.unionByName(more))

    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(materialize(named, "named"), "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
