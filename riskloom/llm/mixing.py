"""Mixing sources to target weights over a tree of domains, languages and sources.

Budgets go down the tree.  Among the children of a node its budget is shared by weight;
a child cannot take more than its part of the tree holds (its tokens times
``max_epochs``), and what it leaves is shared again among its siblings by weight, so a
shortage reaches other parts of the tree only when all siblings are full.  That is one
water level per node, found with window sums over children in the order of capacity
per weight.

A leaf's documents are put in a seeded order, a new one for every epoch.  Whole epochs
come first, then the longest prefix of the next epoch that fits.  The prefix is found
from token sums per range of the order key; only the range in which the budget ends is
sorted, so no leaf is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one range of a leaf's order holds on average.
ROWS_PER_RANGE = 2048


def share(children: DataFrame, parent: Sequence[str], own: str) -> DataFrame:
    """Adds ``budget`` to children (``weight``, ``capacity``, ``parent_budget``, columns of ``parent`` and ``own``)."""
    order = Window.partitionBy(*parent, F.lit(0)).orderBy("ratio", own)
    whole = Window.partitionBy(*parent, F.lit(0))
    ranked = (children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(-1.0))
              .withColumns({"before": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
                            "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
              .withColumn("level", F.when(F.col("rest") > 0, (F.col("parent_budget") - F.col("before")) / F.col("rest")))
              .withColumn("first_open", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", own, "level"))).over(whole)))
    budget = F.when(F.col("first_open").isNull() | (F.col("ratio") < F.col("first_open.ratio")), F.col("capacity")).otherwise(
        F.least("capacity", F.col("first_open.level") * F.col("weight")))
    return ranked.withColumn("budget", budget).drop("ratio", "before", "rest", "level", "first_open")


def tree_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[str], budget: float, max_epochs: int) -> DataFrame:
    """Leaves (``levels``, ``tokens``) with their ``budget`` in whole tokens.

    ``weights`` has a SQL expression for each level over the level columns down to it;
    nodes whose weight is missing or not above 0 get nothing.
    """
    paths = [list(levels[:i + 1]) for i in range(len(levels))]
    weighted = [f"_w{i}" for i in range(len(levels))]
    known = leaves.withColumns({w: F.greatest(F.coalesce(F.expr(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for w, c in zip(weighted, weights)})
    alive = F.lit(True)
    for w in weighted:
        alive = alive & (F.col(w) > 0)
    known = known.withColumn("capacity", F.when(alive, F.col("tokens") * F.lit(max_epochs)).otherwise(0).cast("double"))
    given = None
    for i, path in enumerate(paths):
        nodes = known.groupBy(*path).agg(F.first(weighted[i]).alias("weight"), F.sum("capacity").alias("capacity"))
        nodes = (nodes.withColumn("parent_budget", F.lit(float(budget))) if given is None
                 else nodes.join(given.select(*paths[i - 1], F.col("budget").alias("parent_budget")), paths[i - 1]))
        given = share(nodes, path[:-1], path[-1])
    return leaves.join(given.select(*levels, F.floor(F.col("budget") + 1e-6).cast("long").alias("budget")), list(levels))


def mix(docs: DataFrame, levels: dict[str, str], weights: Sequence[str], share_of_tokens: float = 0.5,
        max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """Rows of ``docs`` that the mixture takes, with ``epoch``, ``tokens`` and the level columns (prefix ``mix_``).

    ``levels`` maps a name to its SQL expression, from the root down; ``weights`` are over the
    names with the prefix.  The budget is ``share_of_tokens`` of all tokens (words).  A
    document comes once per epoch that takes it; documents are never cut, a prefix ends
    before the one that would pass the budget.  Missing level values are a group of their
    own (empty text).  Texts without words have no tokens and go with the prefix.
    Documents with the same doc_id and text stand together in the order.
    """
    names = [f"mix_{x}" for x in levels]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    base = docs.withColumns({f"mix_{x}": F.coalesce(F.expr(c).cast("string"), F.lit("")) for x, c in levels.items()} | {
        "tokens": F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")})
    leaves = base.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = stage(leaves, "mix-leaves")
    total, widest = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    bits = max(0, ceil(log2(max(1, widest / ROWS_PER_RANGE))))
    plan = tree_budgets(leaves, names, weights, total * share_of_tokens, max_epochs)
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = stage(plan.select(*names, F.col("full").alias("__full"), (F.col("budget") - F.col("full") * F.col("tokens")).alias("__left")), "mix-plan")

    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__full").cast("string"), key)), 1, 15), 16, 10).cast("long")
    bucket = F.shiftright(place, 60 - bits).cast("int") if bits else F.lit(0)
    placed = base.join(plan, names).withColumns({"__place": place, "__bucket": bucket})
    by_leaf = Window.partitionBy(*names).orderBy("__bucket")
    sums = placed.where("__left > 0").groupBy(*names, "__bucket", "__left").agg(F.sum("tokens").alias("t"))
    ends = sums.withColumn("end", F.sum("t").over(by_leaf)).where(F.col("end") > F.col("__left"))
    ends = ends.groupBy(*names).agg(F.min(F.struct("__bucket", (F.col("end") - F.col("t")).alias("__before"))).alias("at"))
    ends = stage(plan.join(ends.select(*names, F.col("at.__bucket").alias("__cut"), F.col("at.__before").alias("__before")), names, "left"), "mix-cuts")

    placed = base.join(ends, names).withColumns({"__place": place, "__bucket": bucket})
    prefix = (F.col("__left") > 0) & (F.col("__cut").isNull() | (F.col("__bucket") < F.col("__cut")))
    rows = [c for c in docs.columns if c not in ("epoch", "tokens", *names)]
    epochs = F.sequence(F.lit(0), F.col("__full") - F.when(prefix, 0).otherwise(1))
    sure = placed.where((F.col("__full") > 0) | prefix).select(*rows, *names, "tokens", F.explode(epochs).alias("epoch"))
    edge = Window.partitionBy(*names).orderBy("__place", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    last = (placed.where((F.col("__left") > 0) & (F.col("__bucket") == F.col("__cut")))
            .withColumn("__end", F.sum("tokens").over(edge)).where(F.col("__end") <= F.col("__left") - F.col("__before"))
            .select(*rows, *names, "tokens", F.col("__full").alias("epoch")))
    return sure.unionByName(last)
