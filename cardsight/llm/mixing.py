"""Operator 6: mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The corpus is a tree (domain, language, source by default). A token budget
flows down it: each node's share is split among its children by their weights,
no child getting more than its subtree can give (its tokens times the allowed
epochs). What a child cannot give goes to its siblings first, and to the
siblings of its ancestors only when the whole subtree is short, as a node's
capacity is the sum of its children's. Each split is exact water-filling: with
capacities c and weights w, child i gets min(c_i, L * w_i) with one level L for
the family, found by running sums over the children in order of c/w.

A leaf's documents are put in a seeded order, another one in every epoch. Whole
epochs are taken while the budget lasts, then the order's prefix: every document
whose running token total begins below the budget (so a leaf is overrun by less
than one document, or by equal rows, which are taken together). Prefixes are
found from token sums of hash ranges; only the range in which the budget ends is
looked at row by row, after equal rows were added up, so a leaf that holds a
third of all rows is neither sorted nor gathered. The selection is one threshold
per leaf: texts are never shuffled.

Defined results: null levels form a leaf of their own (``none``); null and
empty texts have no tokens and are taken only when the order reaches them; equal rows
are taken together; null ids are kept; an empty table gives an empty result;
documents keep all their columns, whatever their names. Weights not given are 1.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardsight.llm.common import cut, join_small

SEED = 7_919
RANGE_ROWS = 20_000   # rows of a hash range at most, on average


def n_words(text: Column) -> Column:
    """Tokens as words: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _fill(nodes: DataFrame, parents: list[str], budget: Column) -> DataFrame:
    """Split ``budget`` among the nodes of each family: adds ``share``."""
    # Children in order of the level at which they run out.
    order = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), "node")
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.max("level").over(Window.partitionBy(*parents))
    return (nodes.withColumn("level", (budget - before) / weight_left)
            .withColumn("share", F.greatest(F.lit(0.0), F.least("capacity", level * F.col("weight")))).drop("level"))


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: float, weights: Mapping[tuple, float],
                 max_epochs: int) -> DataFrame:
    """Adds ``budget`` (tokens) to the leaves (levels, supply). Reads one row per leaf."""
    given = F.create_map(*(x for path, w in {("",): 1.0, **weights}.items()
                           for x in (F.lit("\x1f".join(path)), F.lit(float(w)))))
    parent = None
    for depth in range(1, len(levels) + 1):
        here, above = levels[:depth], levels[:depth - 1]
        nodes = (leaves.groupBy(*here).agg((F.sum("supply") * float(max_epochs)).alias("capacity"))
                 .withColumn("weight", F.coalesce(given[F.concat_ws("\x1f", *here)], F.lit(1.0)))
                 .withColumn("node", F.col(here[-1])).where("weight > 0"))
        if parent is None:
            nodes = _fill(nodes, [], F.lit(float(budget)))
        else:
            nodes = _fill(nodes.join(parent.select(*above, F.col("share").alias("from_parent")), above), above,
                          F.col("from_parent"))
        parent = nodes.select(*here, "share")
    return leaves.join(parent, levels, "left").withColumn(
        "budget", F.floor(F.coalesce("share", F.lit(0.0)) + 1e-6).cast("long")).drop("share")


def _keyed(key: Column, epoch: Column) -> Column:
    """A document's place in an epoch's order: 63 hashed bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), epoch, key), 1)


def mix(docs: DataFrame, levels: Mapping[str, Column], fraction: float, weights: Mapping[tuple, float] | None = None,
        max_epochs: int = 1) -> DataFrame:
    """The mixed documents: struct ``row`` (a document's columns), the levels, ``epoch`` and ``n_tokens``.

    ``levels``: the tree's levels, root first, as expressions on ``docs``.
    ``fraction``: the token budget as a share of the corpus's tokens.
    ``weights``: weight by path from the root, such as ``("web",)`` or ``("web", "en")``.
    """
    names = [f"level_{i}" for i in range(len(levels))]
    rows = docs.select(F.struct("*").alias("row"), *(
        F.coalesce(c.cast("string"), F.lit("none")).alias(n) for n, c in zip(names, levels.values())))
    rows = rows.select("row", *names, n_words(F.col("row.text")).alias("n_tokens"),
                       F.xxhash64(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")),
                                  F.coalesce(F.col("row.text"), F.lit(""))).alias("key"))
    # Equal rows of a leaf are one row here.
    narrow = cut(rows.groupBy(*names, "key").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")))
    leaves = cut(narrow.groupBy(*names).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_keys")))
    total, most = leaves.agg(F.sum("supply"), F.max("n_keys")).first()
    plan = leaf_budgets(leaves, names, (total or 0) * fraction, weights or {}, max_epochs)
    whole = F.when(F.col("supply") > 0, F.least(F.expr("budget div supply"), F.lit(max_epochs))).otherwise(max_epochs)
    plan = cut(plan.withColumn("whole", whole.cast("long"))
               .withColumn("rest", F.when(F.col("whole") >= max_epochs, 0)
                           .otherwise(F.col("budget") - F.col("whole") * F.col("supply")).cast("long")))

    bits = max(1, math.ceil(math.log2(max(1, (most or 1) / RANGE_ROWS)))) if (most or 0) > RANGE_ROWS else 1
    placed = (join_small(narrow, plan.where("rest > 0").select(*names, "whole", "rest"), names)
              .withColumn("place", _keyed(F.col("key"), F.col("whole")))
              .withColumn("range", F.shiftright("place", 63 - bits)))
    sums = placed.groupBy(*names, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    so_far = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = (sums.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
            .where("before < rest and before + n >= rest").select(*names, "range", "before"))
    within = Window.partitionBy(*names).orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    ends = (placed.join(cut(last), [*names, "range"])
            .withColumn("total", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
            .where("total < rest").groupBy(*names).agg(F.max("place").alias("end")))
    chosen = cut(plan.select(*names, "whole").join(ends, names, "left"))

    copies = F.col("whole") + (_keyed(F.col("key"), F.col("whole")) <= F.coalesce("end", F.lit(-1))).cast("long")
    mixed = (join_small(rows, chosen, names).withColumn("copies", copies).where("copies > 0")
             .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))))
    return mixed.select("row", *(F.col(n).alias(level) for n, level in zip(names, levels)), "epoch", "n_tokens")
