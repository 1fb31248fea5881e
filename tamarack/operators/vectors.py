"""Exact vector search against banks, and the features read off the neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed

SHARD, BLOCK, STRIPE = 8192, 8192, 256  # bank vectors and queries that meet in one task, and queries of one product


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def knn_topk(queries: DataFrame, bank: DataFrame, k: int = 5, query: str = "query_id", item: str = "vec_id") -> DataFrame:
    """The k bank vectors with the largest inner product: ``query, rank, item, score``.

    ``queries`` has ``query, qv`` and ``bank`` ``item, bv``. Both sides are dealt to blocks of
    bounded size; a task multiplies one block of queries with one shard of the bank in Arrow
    and keeps k of each query, and the shards' lists are merged. A matrix product finds what may
    be among the k within its rounding error; their scores are then added in index order, as
    ``dot`` does. Of equal vectors of a shard only the first k are looked at. Ties go to the
    smaller id. Nulls take no part; vectors of one table have one length.
    """
    queries, bank = queries.select(query, "qv").dropna(), bank.select(item, "bv").dropna()
    blocks, shards = max(1, -(-queries.count() // BLOCK)), max(1, -(-bank.count() // SHARD))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", deal(query, blocks).alias("block"), every(shards).alias("shard"))
    right = bank.select("*", deal(item, shards).alias("shard"), every(blocks).alias("block"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        names = (query, item, "score")
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (a[query].type, b[item].type, pa.float64()), strict=True)})
        order = b[item].combine_chunks().to_numpy(zero_copy_only=False).argsort(kind="stable")
        v = _matrix(b["bv"])[order]
        first = _firsts(v, k)
        rows, columns, scores = _nearest(_matrix(a["qv"]), v[first], k)
        return pa.table({query: a[query].take(pa.array(rows)), item: b[item].take(pa.array(order[first[columns]])), "score": pa.array(scores)})

    schema = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{item}` {bank.schema[item].dataType.simpleString()}, score double"
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(best, schema)
    order = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, "rank", item, "score")


def _firsts(v: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that fewer than k earlier rows equal, rising."""
    _, kind = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    by = kind.argsort(kind="stable")
    start = np.flatnonzero(np.r_[True, kind[by][1:] != kind[by][:-1]])
    nth = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
    return np.sort(by[nth < k])


def _nearest(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, row of ``v`` and score of the k best of each row; ties go to the smaller row of ``v``."""
    k, dims, parts = min(k, len(v)), q.shape[1], []
    far = np.sqrt((v * v).sum(1).max())
    for at in range(0, len(q), STRIPE):
        x = q[at : at + STRIPE]
        near = x @ v.T
        slack = 4 * (dims + 2) * np.finfo(float).eps * np.sqrt((x * x).sum(1)) * far  # more than two orders of adding can differ by
        bar = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] - slack
        rows, columns = np.nonzero(~(near < bar[:, None]))  # what is not a number stays in
        score = np.zeros(len(rows))
        for d in range(dims):
            score += x[rows, d] * v[columns, d]
        top = np.lexsort((columns, -score, ~np.isnan(score), rows))  # Spark takes NaN for the largest
        rows, columns, score = rows[top], columns[top], score[top]
        start = np.searchsorted(rows, np.arange(len(x)))
        some = np.arange(len(rows)) - start[rows] < k
        parts.append((at + rows[some], columns[some], score[some]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def retrieval_features(attack: DataFrame, benign: DataFrame, query: str = "query_id") -> DataFrame:
    """Largest, mean and population deviation of both neighbour lists, and their margin."""
    side = lambda df, n: df.groupBy(query).agg(F.max("score").alias(f"{n}_max"), F.avg("score").alias(f"{n}_mean"), F.stddev_pop("score").alias(f"{n}_std"))
    return side(attack, "attack").join(side(benign, "benign"), query).withColumn("margin", F.col("attack_max") - F.col("benign_max"))


def veto(p: Column, margin: Column) -> Column:
    return F.greatest(p, F.when(margin >= fixed.VETO_MARGIN, fixed.VETO_FLOOR).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
