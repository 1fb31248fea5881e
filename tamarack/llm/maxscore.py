"""Exact top-k inner products by MaxScore over sharded, blocked posting lists.

Vectors are dealt to shards and queries to blocks of bounded size; a task scores one block
of queries against one shard. Both are ordered along the shard's main direction; the shard
is cut into blocks of rows and the queries into groups of neighbours. In a block of rows
each dimension has a base (its commonest value) and a posting list of the rows that differ
from it, with the largest gain over the base that the list can give a query of either sign.

A group goes through the blocks with a bar for each query, its k-th best score so far, which
rises from block to block. Dimensions are ordered by gain; the trailing ones whose gains
together cannot lift a row over the bar of any query are non-essential. Only rows in an
essential list become candidates; then lists are read in strides for the rows and queries
that are still competitive, that is, where the sum so far plus the most that the unread
lists can add reaches the bar. That most is the smaller of the gains' sum and the product of
the unread parts' norms. When few pairs are left, they are probed one by one. Shard results
are merged by rank. Sums are exact: in doubles while products and sums stay below 2**53,
else in Python integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices

SHARD = 8192
BLOCK = 1024
ROWS = 1024
GROUP = 64
STRIDE = 16
FEW = 0.5  # share of pairs under which they are probed one by one
NEVER = float("-inf")


def quantised(embedding: Column, scale: int = 64) -> Column:
    """Components as floor(scale * x); null where a component is null or not finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    arrays = column.combine_chunks()
    arrays = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    values, offsets = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [np.empty(0, int)])] = values[offsets[0] : offsets[-1]]
    return out


@dataclass
class Postings:
    """The lists of one block of rows; a list of more than half of the rows is kept as a column."""

    ids: np.ndarray
    own: np.ndarray  # differences from the base, one row per vector
    base: np.ndarray
    low: np.ndarray
    high: np.ndarray
    lists: dict[int, np.ndarray]

    @classmethod
    def of(cls, vectors: np.ndarray, ids: np.ndarray, kind: type) -> Postings:
        base = np.zeros(vectors.shape[1], np.int64)
        lists = {}
        for d in range(len(base)):
            values, counts = np.unique(vectors[:, d], return_counts=True)
            if 2 * counts.max() >= len(ids):
                base[d] = values[counts.argmax()]
                lists[d] = np.flatnonzero(vectors[:, d] != base[d])
        own = (vectors.astype(object) - base).astype(kind) if kind is object else vectors.astype(float) - base
        low, high = (np.minimum(own.min(0), 0), np.maximum(own.max(0), 0))
        return cls(ids, own, base.astype(kind), low, high, lists)

    def best(self, queries: np.ndarray, bars: np.ndarray, tally: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, row) that can reach the query's bar, with their scores."""
        gain = np.maximum(queries * self.low, queries * self.high)
        order = np.argsort(-gain.sum(0).astype(float), kind="stable")
        floor = queries @ self.base
        q, gain, width = queries[:, order], gain[:, order], len(order)
        rest = np.concatenate([np.cumsum(gain[:, ::-1], 1)[:, ::-1], np.zeros_like(gain[:, :1])], 1)  # what the lists from each on can add
        tally["cells"] += len(q) * self.own.size
        which, rows = np.arange(len(q)), np.arange(len(self.ids))
        essential = int((floor[:, None] + rest[:, :-1] >= bars[:, None]).sum(1).max(initial=0))  # without these no row reaches a bar
        total = np.zeros((len(q), len(rows)), self.own.dtype)
        done = 0
        if all(int(d) in self.lists for d in order[:essential]):
            for d in range(essential):
                of = self.lists[int(order[d])]
                total[:, of] = total[:, of] + q[:, d, None] * self.own[of, order[d]]
                tally["read"] += len(q) * len(of)
            if (floor + rest[:, essential] < bars).all():  # else even a row in no list counts
                rows = np.unique(np.concatenate([np.empty(0, np.int64), *(self.lists[int(d)] for d in order[:essential])]))
            total, done = total[:, rows], essential
        exact = self.own.dtype == object
        x = self.own[np.ix_(rows, order)]
        if not exact:
            left = np.concatenate([np.cumsum(x[:, ::-1] ** 2, 1)[:, ::-1], np.zeros((len(rows), 1))], 1)
            weight = np.concatenate([np.cumsum(q[:, ::-1] ** 2, 1)[:, ::-1], np.zeros((len(q), 1))], 1)

        def competitive() -> np.ndarray:
            """Bounds at ``done``; a margin covers rounding of the norms."""
            need = (bars[which] - floor[which])[:, None]
            alive = total + rest[which, done, None] >= need
            if not exact and done < width:
                alive &= total + np.sqrt(weight[which, done])[:, None] * np.sqrt(left[rows_in, done]) * (1 + 1e-9) + 1 >= need
            return alive

        rows_in = np.arange(len(rows))
        alive = competitive()
        while done < width and alive.any():
            if not exact and alive.mean() <= FEW:
                break
            some_q, some_x = alive.any(1), alive.any(0)
            if some_q.mean() < 0.8 or some_x.mean() < 0.8:
                which, rows_in, total = which[some_q], rows_in[some_x], total[np.ix_(some_q, some_x)]
            stop = min(width, done + STRIDE)
            total = total + q[which, done:stop] @ x[rows_in, done:stop].T
            tally["read"] += len(which) * len(rows_in) * (stop - done)
            done = stop
            alive = competitive()
        i, j = np.nonzero(alive)
        scores = total[i, j]
        who, of = which[i], rows_in[j]
        while done < width and len(who):  # few pairs: probe their unread lists, dropping those that fall behind
            stop = min(width, done + STRIDE)
            scores = scores + np.concatenate([(q[who[s:e], done:stop] * x[of[s:e], done:stop]).sum(1) for s, e in slices(len(who), 20_000)])
            tally["read"] += len(who) * (stop - done)
            done = stop
            most = np.minimum(rest[who, done], np.sqrt(weight[who, done] * left[of, done]) * (1 + 1e-9) + 1)
            keep = scores + floor[who] + most >= bars[who]
            who, of, scores = who[keep], of[keep], scores[keep]
        return who, rows[of], scores + floor[who]


def _keep(k: int, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each ``who``, best first; ties to the smaller id."""
    if scores.dtype == object:
        place = np.array(sorted(range(len(who)), key=lambda i: (who[i], -scores[i], ids[i])), np.int64)
    else:
        place = np.lexsort((ids, -scores, who))
    who, ids, scores = who[place], ids[place], scores[place]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], ids[keep], scores[keep]


def top_k(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, tally: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query id, vector id, score) of each query but itself; ties to the smaller id.

    ``tally`` gets the number of ``cells`` (query, vector, dimension) and how many were ``read``.
    """
    tally = {} if tally is None else tally
    tally.update(cells=tally.get("cells", 0), read=tally.get("read", 0))
    top = max(abs(int(queries.min(initial=0))), abs(int(queries.max(initial=0)))) * max(abs(int(vectors.min(initial=0))), abs(int(vectors.max(initial=0)))) * max(vectors.shape[1], 1)
    kind = float if 8 * top < 2**53 else object
    if len(ids) > ROWS:  # neighbours along the main direction share blocks, so that gains differ between blocks
        centre = vectors.mean(0)
        spread = vectors - centre
        main = np.linalg.eigh(spread.T @ spread)[1][:, -1]
        order = np.argsort(spread @ main, kind="stable")
        vectors, ids = vectors[order], ids[order]
        order = np.argsort((queries - centre) @ main, kind="stable")
        queries, query_ids = queries[order], query_ids[order]
    blocks = [Postings.of(vectors[s:e], ids[s:e], kind) for s, e in slices(len(ids), ROWS)]
    found = []
    for a, z in slices(len(query_ids), GROUP):
        group, own_ids = queries[a:z].astype(kind), query_ids[a:z]
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)
        bars = np.full(len(group), NEVER, kind if kind is float else object)
        # the block that lies farthest the group's way first, so that the bars rise early
        middle = group.sum(0)
        promise = [float((np.maximum(middle * b.low, middle * b.high) + middle * b.base).sum()) for b in blocks]
        for at in np.argsort(-np.array(promise), kind="stable"):
            who, rows, scores = blocks[at].best(group, bars, tally)
            cand = blocks[at].ids[rows]
            other = cand != own_ids[who]
            if kind is float and len(who) > 4 * k * len(group):  # many rows and no bar yet: drop what k others pass
                other &= scores >= _kth(k, who, np.where(other, scores, NEVER), len(group))[who]
            best = _keep(k, *(np.concatenate([x, y[other]]) for x, y in zip(best, (who, cand, scores), strict=True)))
            last = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1
            bars[best[0][last]] = best[2][last]
        found.append((own_ids[best[0]], best[1], best[2].astype(np.int64)))
    return tuple(np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(3))


def _kth(k: int, who: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """The k-th best score of each of ``n`` queries; ``who`` is sorted."""
    out = np.full(n, NEVER)
    starts = np.searchsorted(who, np.arange(n + 1))
    for i, (s, e) in enumerate(zip(starts, starts[1:], strict=False)):
        if e - s > k:
            out[i] = np.partition(scores[s:e], e - s - k)[e - s - k]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Top ``k`` of ``vectors`` (``vec_id, embedding``) for each of ``queries``.

    Returns ``query_id, rank`` (from 1)``, vec_id, score``: the highest integer inner
    products of quantised vectors, ties to the smaller id; a query never finds its own id,
    and finds fewer than ``k`` where there are fewer others. Vectors that are null or hold
    a null or non-finite component take no part; a shorter vector counts as padded with
    zeros. Extra columns are ignored; empty tables give an empty result; equal vectors
    under different ids are ranked each for itself.
    """
    clean = lambda df: df.select("vec_id", quantised(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    pool, asked = materialize(clean(vectors), "pool"), materialize(clean(queries), "asked")
    size = pool.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shards, width = max(1, -(-size[0] // SHARD)), max(1, size[1] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    blocks = max(1, -(-asked.count() // BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "v", deal(blocks).alias("block"), every(shards).alias("shard"))
    right = pool.select("vec_id", "v", deal(shards).alias("shard"), every(blocks).alias("block"))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        found = ([], [], [])
        if a.num_rows and b.num_rows:
            found = top_k(_dense(a["v"], width), a["vec_id"].to_numpy(), _dense(b["v"], width), b["vec_id"].to_numpy(), k)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), found, strict=True)})

    cells = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
    found = cells.applyInArrow(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
