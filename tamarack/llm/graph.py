"""Connected components over an edge table, with no edge or label on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the graph given by integer columns ``src, dst``.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edge set
    is stable; it then is a forest of stars around each component's smallest node. Each
    step is one partial aggregate plus one equi-join, so a node with very many neighbours
    costs a skewed join (which adaptive execution splits) and never a gathered group.

    Returns ``node, component`` for the nodes that have an edge (self-loops ignored).
    """
    stars = materialize(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        wide = materialize(large, "large")
        low2 = materialize(wide.groupBy("u").agg(F.min("v").alias("m")), "low2")
        small = (
            wide.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = materialize(small, "small")
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for t in (stars, low, wide, low2):
            release(t)
        stars = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
