"""Mixing sources to target weights down a domain - language - source tree.

A token budget is dealt top-down. At each node it is split over the children by weight,
no child getting more than its subtree can give (its tokens times ``max_epochs``); what a
child cannot use goes to its siblings by weight, and only what a whole subtree cannot use
reaches the siblings of its ancestors. A node of weight 0, and all below it, gives nothing
and counts for no capacity. A leaf's documents are ordered anew in each epoch by a seeded
digest; whole epochs are taken while they fit and of the last one the prefix that reaches
the budget (its last document may pass it).

The tree stays distributed: each level is one table of nodes, split by running sums over
siblings. The prefix needs no sort of a leaf: tokens are summed by leaf and leading digest
digits, and only the group in which the budget runs out is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .packing import token_lengths

LEVELS = ("domain", "lang", "source")
WEIGHT_UNIT = 1_000_000  # weights count in millionths, so that shares are exact


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def default_domain(source: Column) -> Column:
    """A stand-in for a catalogue of domains: sources by their number, three ways."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    kind = F.pmod(F.coalesce(F.when(number != "", number.cast("long")), F.lit(0)), F.lit(3))
    return F.when(kind == 0, "crawl").when(kind == 1, "books").otherwise("forum")


def weighted(leaves: DataFrame, weights: Mapping[tuple[str, ...], float]) -> DataFrame:
    """Leaves with the weight of each node on their path, ``weight_0`` and on; those under a weight of 0 go.

    ``weights`` is a setting, so its table is small; nodes not named weigh 1.
    """
    out = leaves
    for d in range(len(LEVELS)):
        named = [(*path, round(w * WEIGHT_UNIT)) for path, w in weights.items() if len(path) == d + 1]
        given = leaves.sparkSession.createDataFrame(named, ", ".join([*(f"{c} string" for c in LEVELS[: d + 1]), "given long"]))
        out = out.join(given, list(LEVELS[: d + 1]), "left").withColumn(f"weight_{d}", F.coalesce("given", F.lit(WEIGHT_UNIT))).drop("given").where(f"weight_{d} > 0")
    return out


def split_budget(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Each node's share of its parent's ``budget``: columns ``parent, name, budget`` of ``nodes``.

    ``nodes`` has also ``cap`` and ``weight``. In order of cap per weight, a node takes its cap
    as long as that is no more than its share of what is left; the others share the rest by
    weight, cut at running whole numbers, so that no unit is lost and no cap is passed. The
    running sums stream over siblings sorted by parent; no group is held in memory.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    before = Window.partitionBy(*parent).orderBy(big("cap") / big("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("cap", "weight")}
    whole = nodes.groupBy(*parent).agg(F.sum("weight").alias("_weights"), F.least(F.sum("cap"), F.max("budget")).alias("_budget"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in parent] or [F.lit(True)]
    both = lambda a, b: a.alias("l").join(b.alias("r"), on).select("l.*", *(F.col(f"r.{c}") for c in b.columns if c not in parent))
    rows = both(nodes.select("*", sums["cap"].alias("_caps"), sums["weight"].alias("_passed")), whole)
    rows = rows.withColumn("_full", big("cap") * (big("_weights") - big("_passed")) <= (big("_budget") - big("_caps")) * big("weight"))
    # the running sums only grow, so their least among open nodes are those at the first one
    first = rows.groupBy(*parent).agg(F.min(F.when(~F.col("_full"), F.col("_caps"))).alias("_taken"), F.min(F.when(~F.col("_full"), F.col("_passed"))).alias("_closed"))
    rows = both(rows, first)
    upto = lambda w: F.expr(f"cast(({w}) as decimal(19,0)) * cast((_budget - _taken) as decimal(19,0)) div cast((_weights - _closed) as decimal(19,0))")
    own = F.when(F.col("_full"), F.col("cap")).otherwise(upto("_passed - _closed + weight") - upto("_passed - _closed"))
    return rows.select(*parent, name, own.cast("long").alias("budget"))


def budgets(leaves: DataFrame, weights: Mapping[tuple[str, ...], float], total: int, max_epochs: int) -> DataFrame:
    """Token ``budget`` of every leaf that gets any; ``leaves`` has ``LEVELS`` (not null) and ``tokens``."""
    usable = materialize(weighted(leaves.where("tokens > 0"), weights).withColumn("cap", F.col("tokens") * max_epochs), "usable")
    given: DataFrame | None = None
    for d, name in enumerate(LEVELS):
        parent = list(LEVELS[:d])
        nodes = usable.groupBy(*parent, name).agg(F.sum("cap").alias("cap"), F.max(f"weight_{d}").alias("weight"))
        nodes = nodes.withColumn("budget", F.lit(total).cast("long")) if given is None else nodes.join(given, parent)
        given = materialize(split_budget(nodes, parent, name), f"level{d}")
    return given.where("budget > 0")


def mix(
    docs: DataFrame,
    weights: Mapping[tuple[str, ...], float] | None = None,
    fraction: float = 0.5,
    max_epochs: int = 2,
    seed: int = 17,
    domain: Callable[[Column], Column] = default_domain,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Select documents so that ``fraction`` of all tokens is spread to the target weights.

    ``weights`` maps a node's path, for example ``("crawl", "en")``, to its weight among
    its siblings; nodes not named weigh 1. Returns the columns ``doc_id, domain, lang,
    source, epoch, n_tokens``; a document appears once per epoch that takes it. Tokens are
    those of the tokenizer at ``tokenizer_path``, or blank-separated words without one.
    Null domain, language or source count as ``unknown``; null and empty texts have no
    tokens and are taken where the prefix passes them; a leaf without tokens gives nothing.
    Whole texts are counted, however long. Ties in the seeded order go to the smaller
    ``doc_id``; documents with equal texts are taken each for itself; a repeated ``doc_id``
    counts as often as it stands. Extra columns are ignored; an empty table gives an empty
    result.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    tree = (F.coalesce(domain(F.col("source")), F.lit("unknown")).alias("domain"), named("lang"), named("source"))
    if tokenizer_path:
        rows = token_lengths(docs.select("doc_id", "text", *tree), tokenizer_path, LEVELS)
    else:
        rows = docs.select("doc_id", *tree, word_count(F.col("text")).alias("n_tokens"))
    rows = materialize(rows, "rows")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = int(fraction * (leaves.agg(F.sum("tokens")).first()[0] or 0))
    given = leaves.join(budgets(leaves, weights or {}, total, max_epochs), list(LEVELS))
    each = given.select(*LEVELS, F.col("tokens").alias("leaf_tokens"), "budget", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    wanted = each.withColumn("budget", F.least("leaf_tokens", F.col("budget") - F.col("epoch") * F.col("leaf_tokens"))).where("budget > 0")
    copies = rows.join(materialize(wanted, "wanted"), list(LEVELS)).withColumn("digest", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "doc_id")))
    copies = copies.withColumn("bucket", F.substring("digest", 1, 3))
    whole = copies.where("budget >= leaf_tokens")
    part = copies.where("budget < leaf_tokens")
    group = [*LEVELS, "epoch"]
    sums = part.groupBy(*group, "budget", "bucket").agg(F.sum("n_tokens").alias("here"))
    before = F.sum("here").over(Window.partitionBy(*group).orderBy("bucket")) - F.col("here")
    sums = materialize(sums.select(*group, "bucket", "budget", before.alias("before"), "here").where("before < budget"), "prefix")
    named_sums = sums.select(*group, "bucket", "before", "here")
    near = part.join(named_sums, [*group, "bucket"])
    inside = near.where("before + here < budget")
    own = F.sum("n_tokens").over(Window.partitionBy(*group, "bucket").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    edge = near.where("before + here >= budget").withColumn("own", F.coalesce(own, F.lit(0))).where("before + own < budget")
    out = ["doc_id", *LEVELS, "epoch", "n_tokens"]
    return whole.select(*out).unionByName(inside.select(*out)).unionByName(edge.select(*out))
