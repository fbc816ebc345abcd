"""Operator 8: placement by a hierarchical weighted hash tree (law ``key``).

Shards are the leaves of a planned tree of regions and racks. A document descends it: at
each level it goes to the child with the least draw. A child's draw is hashed from the
document's id and the child's own place in the tree, and is exponential with the child's
weight (the sum of its leaves') as its rate, so each child is chosen in proportion to its weight. Where
a weight changes, only draws on the way to that leaf change: documents move into or out of
its region, and none moves between other regions.

The plan has room for more shards than are open. A document that arrives at a leaf that
is not open descends again with the next attempt's draws, until it arrives at an open
one. Its leaves, attempt by attempt, do not depend on which are open: a shard that opens
takes only the documents whose way passes it before the leaf that they have now, so
one more shard takes documents into itself alone, whatever region it lies in. What finds no
open leaf in ``ATTEMPTS`` attempts goes to the open leaf with the least draw of its own, under which the
same holds.

Slots number the rows of a shard from 0. They are counted within (input
partition, shard) groups, which no hot key can swell, and shifted by prefix
sums of the group sizes.

Defined results: rows with equal ids go to one shard, null ids to one as well;
a null text has size 1; repeated rows get slots of their own; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardsight.llm.common import cut

SEED = 20_261
ATTEMPTS = 16
REGIONS, RACKS, SHARDS = 4, 2, 2   # the plan's regions, racks in each, shards in each rack


@dataclass(frozen=True)
class Leaf:
    """A planned shard with its place in the tree and its weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def plan(regions: int = REGIONS, racks: int = RACKS, shards: int = SHARDS,
         weights: Sequence[float] | None = None) -> list[Leaf]:
    """The leaves of a plan, filled up rack by rack and region by region; all weights are positive."""
    n = regions * racks * shards
    if weights and (len(weights) != n or min(weights) <= 0):
        raise ValueError(f"{n} positive weights are needed")
    return [Leaf(s, s // (racks * shards), s // shards % racks, weights[s] if weights else 1.0) for s in range(n)]


def _draw(key: Column, attempt: Column, node: str, weight: float) -> Column:
    # The upper 53 bits of the hash as a uniform number in (0, 1].
    u = (F.shiftrightunsigned(F.xxhash64(key, attempt, F.lit(f"{SEED}/{node}")), 11) + 1) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _least(children: list[tuple[Column, Column]]) -> Column:
    """What the child with the least draw leads to; ties go to the first."""
    best, to = children[0]
    for draw, other in children[1:]:
        to = F.when(draw < best, other).otherwise(to)
        best = F.least(best, draw)
    return to


def _nodes(leaves: list[Leaf], of: Callable[[Leaf], int]) -> dict[int, list[Leaf]]:
    out: dict[int, list[Leaf]] = {}
    for x in leaves:
        out.setdefault(of(x), []).append(x)
    return dict(sorted(out.items()))


def descend(leaves: list[Leaf], key: Column, attempt: Column) -> Column:
    """The leaf at the end of one way down: region, rack, shard."""
    def weight(some: list[Leaf]) -> float:
        return sum(x.weight for x in some)

    regions = []
    for r, in_region in _nodes(leaves, lambda x: x.region).items():
        racks = []
        for k, in_rack in _nodes(in_region, lambda x: x.rack).items():
            shards = [(_draw(key, attempt, f"region {r}/rack {k}/shard {x.shard}", x.weight), F.lit(x.shard)) for x in in_rack]
            racks.append((_draw(key, attempt, f"region {r}/rack {k}", weight(in_rack)), _least(shards)))
        regions.append((_draw(key, attempt, f"region {r}", weight(in_region)), _least(racks)))
    return _least(regions)


def ways(leaves: list[Leaf], key: Column) -> Column:
    """The leaves that a document arrives at, attempt by attempt."""
    return F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), lambda t: descend(leaves, key, t))


def first_open(way: Column, leaves: list[Leaf], key: Column, open_shards: int) -> Column:
    """The shard of a document when the first ``open_shards`` leaves of the plan are open."""
    if not 0 < open_shards <= len(leaves):
        raise ValueError(f"the plan has room for {len(leaves)} shards")
    last = _least([(_draw(key, F.lit(-1), f"shard {x.shard}", x.weight), F.lit(x.shard)) for x in leaves
                   if x.shard < open_shards])
    return F.coalesce(F.get(F.filter(way, lambda s: s < open_shards), F.lit(0)), last).cast("int")


def place(docs: DataFrame, n_shards: int, grown: int | None = None, leaves: list[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard of ``n_shards``, slot and, when ``grown`` is given, the shard with that many open."""
    leaves = leaves or plan()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        key.alias("key"), ways(leaves, key).alias("way"), F.monotonically_increasing_id().alias("row"))
    way, key = F.col("way"), F.col("key")
    rows = rows.select("doc_id", "size", "text_crc32", first_open(way, leaves, key, n_shards).alias("shard"),
                       (first_open(way, leaves, key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), "row",
                       F.shiftright("row", 33).alias("part"))
    rows = cut(rows)
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part", "shard").orderBy("row")) - 1
    return (rows.withColumn("within", within).join(offsets, ["part", "shard"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within")).alias("slot"),
                    "grown_shard"))
