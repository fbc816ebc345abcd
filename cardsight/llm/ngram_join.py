"""Operator 3: exact n-gram Jaccard join by prefix trees.

Documents whose sets of word n-grams overlap enough (100 * intersection >=
90 * union by default) are linked; the result is one row per document with its
class. Every link counts, and none is guessed: each step below only drops pairs
that cannot link.

1. Sets. A document's n-grams become 64-bit hashes, ordered by value (the global
   order). Equal sets are one class, known by a 128-bit digest.
2. Own n-grams. If x links with anything, at most (1-t)|x| of its n-grams are in no
   other set. N-grams below a hash threshold are counted by the sets that hold them (a
   grouped minimum and maximum); a set with more than that many of its own has no
   partner. This drops nearly all documents that merely share a passage.
3. Segments. The global order is cut into k ranges, one more than the number of
   n-grams in which two linked sets of that size can differ, so some range is equal
   in both, and the next one differs by at most one n-gram (a sum of k terms below
   k has a term 0 that is followed by a term of 1 or less). A range's content, with
   the next one's when it is sparse, is a signature. Sets that share one meet in the
   group of the least set that has it.
4. Trees. Within a group the ordered sets form a prefix tree. It is walked once
   for all probe sets together: a node holds its overlaps with the probes, shared
   by the sets below it, and probes whose overlap can no longer suffice, given what
   is left of the probe and of the longest set below the node, leave the walk; a
   subtree without probes is skipped. Links found join classes, and a class is passed on as
   one edge from its least set to each other one.

A set is in several groups, and groups larger than ``BLOCK_SETS`` sets are cut into blocks, a
task per pair of blocks. First each set takes part in one group, whose blocks meet its first
block, and the links found are followed to classes. Of all groups only those with several classes are
left then, and in them only the sets outside the main class meet the others: sets that already
share a class need not be compared. They meet by their outlines first, 16 bits of each n-gram, whose overlap is
never less than the sets'; whole sets follow only where outlines of two classes overlap enough. A group of near copies that holds a third of all rows thus takes work in
proportion to its size, and is never in one task. Copies are collapsed before anything is compared, counts are
pre-aggregated, and no pairs are listed.

Defined results: documents without words have an empty set and stay alone; null
ids take no part (their component is null); repeated rows are copies of one class;
rows that share an id but not a text are told apart by their texts; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardsight.llm.common import cut, in_arrow, join_small, shared_table, text_slices
from cardsight.llm.graph import components
from cardsight.llm.words import spread, word_hashes

BLOCK_SETS = 512          # sets of a group in one block
BLOCK_GRAMS = 400_000     # n-grams in one block, on average
MATRIX_BYTES = 32 << 20   # probe matrix of one walk
SMALL_SET = 64            # sets up to this size have all their n-grams counted
SAMPLE = 1.6              # share of the n-grams counted, in multiples of 1 - t
SPARSE = 2                # ranges with as many n-grams or fewer are told by the next range as well
SLICE_BYTES = 1 << 19     # text whose sets are built at once
HOT_SAMPLE = 64           # one set in so many is looked at for frequent signatures
HOT_SAMPLED = 32          # sets of the sample that a frequent signature is in, at least
CLASS_RATIO = 1.5         # sizes of one class of signatures


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The hashed distinct n-grams of each text's words, ascending. Fewer words than n are one n-gram."""
    words, first = word_hashes(texts)
    grams = _grams(words, n) if len(words) >= n else np.empty(0, dtype=np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(grams[a:b - n + 1] if b - a >= n else _grams(words[a:b], b - a))


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    grams = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        grams = spread(grams * np.uint64(0x9E3779B97F4A7C15) + words[i:i + len(grams)])
    return grams


def digest(grams: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def _class_start(c: int) -> int:
    return int(np.ceil(CLASS_RATIO ** c - 1e-9))


@lru_cache(maxsize=100_000)
def schemes(size: int, t: Fraction) -> list[tuple[int, int]]:
    """(class, ranges) under which a set of this size gives signatures.

    A pair is found under the class of its smaller set.
    """
    out, c = [], 0
    while _class_start(c) <= size:
        most = _class_start(c + 1) - 1
        if size * t <= most:  # the smaller set of a pair can be in this class
            both = most + int(most / t)
            k = int(both * (1 - t) / (1 + t)) + 1
            if k > 1:         # else only equal sets link
                out.append((c, k))
        c += 1
    return out


def signatures(grams: np.ndarray, t: Fraction) -> np.ndarray:
    """Signatures of a set's ranges under all its schemes."""
    out = []
    mixed = spread(grams ^ np.uint64(0xD6E8FEB86659FD93))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    high = grams >> np.uint64(32)
    for c, k in schemes(len(grams), t):
        part = ((high * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        n = np.bincount(part, minlength=k)
        end = np.cumsum(n)
        content = sums[end] - sums[end - n]
        name = spread(np.arange(k, dtype=np.uint64) + np.uint64(c << 40))
        sig = spread(content ^ spread(n.astype(np.uint64) + name))
        out.append(sig[n > SPARSE])
        for j in np.flatnonzero(n <= SPARSE):
            after = (j + 1) % k
            near = mixed[end[after] - n[after]:end[after]]
            # The next range as it is, and without each of its n-grams.
            out.append(spread(sig[j] ^ spread(np.append(content[after] - near, content[after]))))
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(flat)))


def _profiles(docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """doc_id, body (its text's hash), n_shingles, digest (d1, d2), set (id, odd for small sets), counted (n-grams to count)."""
    limit = np.uint64(_sample_limit(t))
    all_up_to = int(SMALL_SET / t) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, most=SLICE_BYTES):
                names, sizes, counted = [], [], []
                for g in gram_sets(some.column("text"), n):
                    names.append(digest(g))
                    sizes.append(len(g))
                    counted.append(g if len(g) <= all_up_to else g[:np.searchsorted(g, limit)].copy())
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), some.column("body"), pa.array(sizes, pa.int64()),
                    pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
                    pa.array([a & ~1 | (size <= SMALL_SET) for (a, _), size in zip(names, sizes)], pa.int64()),
                    _lists(counted)], names=["doc_id", "body", "n_shingles", "d1", "d2", "set", "counted"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body().alias("body"), "text"), run,
                    "doc_id long, body long, n_shingles long, d1 long, d2 long, set long, counted array<long>")


def _body() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _sample_limit(t: Fraction) -> int:
    return min(int(SAMPLE * (1 - t) * 2 ** 64), 2 ** 64 - 1)


def _with_partners(profiles: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The sets that do not have more than (1-t) of their n-grams for themselves."""
    limit = _sample_limit(t) - (1 << 63)  # n-grams as signed longs, order moved by the sign bit
    below = F.col("gram").bitwiseXOR(F.lit(-(1 << 63))) < limit
    own = (profiles.where("doc_id is not null").select("set", F.explode("counted").alias("gram"))
           .groupBy("gram").agg(F.min("set").alias("set"), F.max("set").alias("last")).where("set = last")
           .where(below | (F.col("set").bitwiseAND(1) == 1))
           .groupBy("set").agg(F.count("*").alias("n_own")))
    return (sets.join(own, "set", "left")
            .where(F.coalesce("n_own", F.lit(0)) * t.denominator <= F.col("n_shingles") * (t.denominator - t.numerator))
            .drop("n_own"))


def _rebuilt(docs: DataFrame, wanted: DataFrame, n: int, t: Fraction) -> DataFrame:
    """The wanted sets from their documents' texts: set, size, grams (bytes), signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, most=SLICE_BYTES):
                want = zip(some.column("d1").to_pylist(), some.column("d2").to_pylist())
                got = [(s, g) for s, g, w in zip(some.column("set").to_pylist(), gram_sets(some.column("text"), n), want)
                       if digest(g) == w]
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _ in got], pa.int64()), pa.array([len(g) for _, g in got], pa.int64()),
                    pa.array([g.tobytes() for _, g in got], pa.binary()), _lists([signatures(g, t) for _, g in got])],
                    names=["set", "size", "grams", "signatures"])

    rows = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                      wanted.select("doc_id", "set", "d1", "d2"), ["doc_id"])
    return in_arrow(rows.select("text", "set", "d1", "d2"), run,
                    "set long, size long, grams binary, signatures array<long>")


class Unions:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class PrefixTree:
    """The ordered sets of a block as a prefix tree, walked for many probes at once."""

    def __init__(self, sets: list[np.ndarray], t: Fraction):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets])
        self.t = t
        self.shared = [0]  # leading n-grams shared with the set before
        for a, b in zip(self.sets, self.sets[1:]):
            m = min(len(a), len(b))
            apart = np.flatnonzero(a[:m] != b[:m])
            self.shared.append(int(apart[0]) if len(apart) else m)

    def walk(self, probes: list[np.ndarray], n_grams: int) -> Iterator[tuple[int, np.ndarray]]:
        """(set, linked probes) for each set with links."""
        width = len(probes)
        has = np.zeros((n_grams, width), dtype=np.uint8)
        for p, grams in enumerate(probes):
            has[grams, p] = 1
        size = np.array([len(p) for p in probes])
        # Probe n-grams before each 64th place of the order: what a probe has left behind it.
        step = 64
        passed = np.add.reduceat(has, np.arange(0, n_grams, step), axis=0, dtype=np.int32).cumsum(axis=0)
        num, den = self.t.numerator, self.t.denominator
        todo = [(0, len(self.sets), 0, np.arange(width), np.zeros(width, dtype=np.int64))]
        while todo:
            lo, hi, depth, active, overlap = todo.pop()
            node = self.sets[lo]
            end = len(node) if hi - lo == 1 else min(min(self.shared[lo + 1:hi]), len(node))
            if end > depth:
                overlap = overlap + has[np.ix_(node[depth:end], active)].sum(axis=0, dtype=np.int64)
            shortest, longest = int(self.size[lo:hi].min()), int(self.size[lo:hi].max())
            # The most that can be shared: the overlap so far and the lesser of what is left on either side.
            left = size[active]
            at = int(node[end - 1]) // step if end else 0
            if at:
                left = left - passed[at - 1][active]
            most = overlap + np.minimum(left, longest - end)
            keep = most * (den + num) >= num * (size[active] + shortest)
            if not keep.any():
                continue
            active, overlap = active[keep], overlap[keep]
            if hi - lo == 1:
                union = size[active] + len(node) - overlap
                linked = active[overlap * den >= num * union]
                if len(linked):
                    yield self.order[lo], linked
                continue
            # Children: runs of sets that go on alike behind the shared stretch.
            cuts = [lo, *(i for i in range(lo + 1, hi) if self.shared[i] <= end), hi]
            todo += [(a, b, end, active, overlap) for a, b in zip(cuts, cuts[1:])]


def block_links(names: list[int], sets: list[np.ndarray], sides: list[int], t: Fraction) -> list[tuple[int, int]]:
    """The classes within a block (one side) or between two blocks (sides 0 and 1), as edges (least name, name)."""
    if len(sets) < 2 or 0 not in sides:  # a block of no sets may meet another one
        return []
    order, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.astype(np.int64)
    sets = np.split(flat, np.cumsum([len(s) for s in sets])[:-1])
    stored = [i for i, side in enumerate(sides) if side == 0]
    probing = [i for i, side in enumerate(sides) if side == 1] or stored
    tree, unions = PrefixTree([sets[i] for i in stored], t), Unions(len(sets))
    width = max(1, MATRIX_BYTES // max(1, len(order)))
    for at in range(0, len(probing), width):
        some = probing[at:at + width]
        for i, linked in tree.walk([sets[p] for p in some], len(order)):
            for p in linked.tolist():
                unions.join(stored[i], some[p])
    least: dict[int, int] = {}
    roots = [unions.find(i) for i in range(len(sets))]
    for root, name in zip(roots, names):
        least[root] = min(least.get(root, name), name)
    return [(least[root], name) for root, name in zip(roots, names) if name != least[root]]


def outline(grams: np.ndarray) -> np.ndarray:
    """The leading 16 bits of each n-gram, in order. Two outlines share, value by value, at least as many n-grams as their sets."""
    return (grams >> np.uint64(48)).astype(np.uint16)


def _distinct(values: np.ndarray) -> np.ndarray:
    """An outline as a set: each value with its number among the equal ones."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, dtype=np.int64)
    number = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    return values.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)


def may_link(names: list[int], roots: list[int], sets: list[np.ndarray], sides: list[int], t: Fraction) -> list[int]:
    """The sets (by name) that, by their outlines, may be linked into a class of another root within their blocks."""
    least = {name: name for name in names} | {b: a for a, b in block_links(names, sets, sides, t)}
    found: dict[int, set[int]] = {}
    for name, root in zip(names, roots):
        found.setdefault(least[name], set()).add(root)
    return sorted(name for name in least if len(found[least[name]]) > 1)


def _by_block(grouped: DataFrame, columns: list[str], result: Callable[[list, list[list]], pa.RecordBatch], schema: str) -> DataFrame:
    """``result`` of the key and the columns of each (grp, lo, hi), whose rows are next to each other in their partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in columns]
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("grp", "lo", "hi")))
            values = [[v.as_buffer() for v in batch.column(c)] if c in ("grams", "outline") else batch.column(c).to_pylist()
                      for c in columns]
            for here, row in zip(keys, zip(*values)):
                if here != key:
                    if key is not None:
                        yield result(key, held)
                    key, held = here, [[] for _ in columns]
                for column, value in zip(held, row):
                    column.append(value)
        if key is not None:
            yield result(key, held)

    dealt = grouped.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "side", "set")
    return in_arrow(dealt, run, schema)


def _tree_links(grouped: DataFrame, t: Fraction) -> DataFrame:
    """Links of blocks."""
    def result(key: tuple, held: list[list]) -> pa.RecordBatch:
        names, sides, grams = held
        found = block_links(names, [np.frombuffer(g, dtype=np.uint64) for g in grams], sides, t)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()),
                                           pa.array([b for _, b in found], pa.int64())], names=["u", "v"])

    return _by_block(grouped, ["set", "side", "grams"], result, "u long, v long")


def _outlined(sets: DataFrame) -> DataFrame:
    """set, outline (bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [outline(np.frombuffer(g.as_buffer(), dtype=np.uint64)).tobytes() for g in batch.column("grams")]
            yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(short, pa.binary())], names=["set", "outline"])

    return in_arrow(sets.select("set", "grams"), run, "set long, outline binary")


def _in_doubt(sets: DataFrame, placed: DataFrame, t: Fraction) -> DataFrame:
    """Of the places (grp, lo, hi, set, side, root) those of sets that may link another class there: the rest's outlines
    share too few n-grams. Outlines take a quarter of the sets' bytes, so whole sets go only where a link is likely."""
    def result(key: tuple, held: list[list]) -> pa.RecordBatch:
        names, sides, roots, short = held
        found = may_link(names, roots, [_distinct(np.frombuffer(o, dtype=np.uint16)) for o in short], sides, t)
        return pa.RecordBatch.from_arrays([*(pa.array([k] * len(found), kind) for k, kind in zip(key, (pa.int64(), pa.int32(), pa.int32()))),
                                           pa.array(found, pa.int64())], names=["grp", "lo", "hi", "set"])

    grouped = _outlined(sets).join(placed, "set").select("grp", "lo", "hi", "set", "side", "root", "outline")
    kept = cut(_by_block(grouped, ["set", "side", "root", "outline"], result, "grp long, lo int, hi int, set long"))
    return placed.drop("root").join(kept, ["grp", "lo", "hi", "set"], "left_semi")


def _groups(sets: DataFrame) -> DataFrame:
    """(set, grp): the groups that each set is in, by the least set that shares a signature with it.

    Signatures are shuffled once and put in order by a window. Those that a sample of the sets shows to be
    in more than a thousandth of them are dealt with by themselves: their least sets are counted in each
    task first and joined back, so no task holds all sets of a frequent signature."""
    signed = sets.select("set", F.explode("signatures").alias("sig"))
    least = max(HOT_SAMPLED, sets.count() // (HOT_SAMPLE * 1000))
    hot = cut(signed.where(F.pmod(F.xxhash64("set"), F.lit(HOT_SAMPLE)) == 0).groupBy("sig").agg(F.count("*").alias("n"))
              .where(F.col("n") > least).select("sig"))
    some_hot = hot.limit(1).count() > 0
    cold = join_small(signed, hot, ["sig"], "left_anti") if some_hot else signed
    alike = Window.partitionBy("sig")
    met = cold.select("set", F.min("set").over(alike).alias("grp"), F.max("set").over(alike).alias("last")).where(
        "grp < last").select("set", "grp")
    if some_hot:
        warm = join_small(signed, hot, ["sig"], "left_semi")
        firsts = cut(warm.groupBy("sig").agg(F.min("set").alias("grp"), F.max("set").alias("last")).where("grp < last"))
        met = met.unionByName(join_small(warm, firsts.select("sig", "grp"), ["sig"]).select("set", "grp"))
    return met.distinct()


def _n_blocks(n: Column, grams: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(grams / BLOCK_GRAMS)).cast("int")


def _block_of(blocks: str, seed: int = 42) -> Column:
    return F.expr(f"cast(pmod(xxhash64(set, {seed}), {blocks}) as int)")


def links(docs: DataFrame, wanted: DataFrame, n: int, t: Fraction) -> DataFrame:
    """Edges (u, v) between sets that generate the classes of linked sets.

    First every set takes part in one of its groups, that of the least set of all, where each block meets the
    group's first block. The links found are followed to classes. Then all groups are looked at: only those with
    members of several classes are left, and in them the members outside the main class meet all others."""
    sets = shared_table(_rebuilt(docs, wanted, n, t))
    groups = shared_table(_groups(sets).join(sets.select("set", "size"), "set"))
    one = cut(groups.groupBy("set").agg(F.min("grp").alias("grp"), F.first("size").alias("size")))
    sizes = cut(one.groupBy("grp").agg(F.count("*").alias("n"), _n_blocks(F.count("*"), F.sum("size")).alias("blocks"))
                .where("n > 1").select("grp", "blocks"))
    placed = one.join(sizes, "grp").withColumn("block", _block_of("blocks"))
    first = _blocks(sets, placed.withColumn("other", F.explode(F.expr(
        "case when block = 0 then sequence(0, blocks - 1) else array(0) end"))).select(
        "grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "set",
        (F.col("block") > F.col("other")).cast("int").alias("side")))
    found = shared_table(_tree_links(first, t))
    # A group of one block has its classes at once; blocks' classes are put together where there are several.
    several = sizes.where("blocks > 1").limit(1).count() > 0
    roots = components(found) if several else found.select(F.col("v").alias("node"), F.col("u").alias("root"))
    # Members that have all met in the step above need not meet again.
    met = placed.where("blocks = 1").select("set", "grp", F.lit(True).alias("met"))
    classed = cut(groups.join(roots.withColumnRenamed("node", "set"), "set", "left").join(met, ["set", "grp"], "left").select(
        "grp", "set", "size", F.coalesce("root", "set").alias("root"), F.coalesce("met", F.lit(False)).alias("met")))
    per_class = cut(classed.groupBy("grp", "root").agg(F.count("*").alias("n"), F.sum("size").alias("grams"),
                                                       F.min("met").alias("met")))
    size = F.struct("n", "root")
    opened = cut(per_class.groupBy("grp").agg(
        F.max_by("root", size).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.sum("grams").alias("grams"),
        F.max_by("grams", size).alias("main_grams"), F.min("met").alias("met")).where("n > n_main and not met").select(
        "grp", "main", _n_blocks(F.col("n"), F.col("grams")).alias("blocks"),
        _n_blocks(F.col("n") - F.col("n_main"), F.col("grams") - F.col("main_grams")).alias("rests")))
    if not opened.limit(1).count():
        return found
    members = classed.join(opened, "grp")
    asked = members.where("root <> main").select("grp", "set", "root", _block_of("rests", 1).alias("lo"), F.explode(
        F.expr("sequence(0, blocks - 1)")).alias("hi"), F.lit(1).alias("side"))
    others = members.select("grp", "set", "root", F.explode(F.expr("sequence(0, rests - 1)")).alias("lo"),
                            _block_of("blocks").alias("hi"), F.lit(0).alias("side"))
    doubtful = _in_doubt(sets, cut(asked.unionByName(others)), t)
    return found.unionByName(_tree_links(_blocks(sets, doubtful), t))


def _blocks(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """The sets at their places: grp, lo, hi, set, side, grams."""
    return sets.select("set", "grams").join(placed, "set").select("grp", "lo", "hi", "set", "side", "grams")


def _members(docs: DataFrame, n: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(rows with words: doc_id, body, n_shingles, class, component_id; the other rows)."""
    profiles = shared_table(_profiles(docs, n, t))
    known = profiles.where("doc_id is not null and n_shingles > 0")
    sets = cut(known.groupBy("d1", "d2", "set", "n_shingles").agg(F.min("doc_id").alias("doc_id")))
    wanted = cut(_with_partners(known, sets, t))
    roots = components(links(docs, wanted, n, t)).withColumnRenamed("node", "set")
    member = cut(sets.join(roots, "set"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = cut(sets.select("d1", "d2", "set", F.col("doc_id").alias("alone")).join(
        member.join(cut(least), "root").select("d1", "d2", "root", "component_id"), ["d1", "d2"], "left")
        .select("d1", "d2", F.coalesce("root", "set").alias("class"), F.coalesce("component_id", "alone").alias("component_id")))
    some = known.select("doc_id", "body", "n_shingles", "d1", "d2").join(named, ["d1", "d2"]).drop("d1", "d2")
    return some, profiles.where("doc_id is null or n_shingles = 0")


def classes(docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(90, 100)) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links), one row per row of ``docs``."""
    some, others = _members(docs, n, Fraction(threshold))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(
        others.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(80, 100)) -> DataFrame:
    """One document of each class, with all its columns: the one with the least id.

    A document is an id with a text: rows that share an id but not a text are told apart
    by their texts (and of those in one class one stays), and rows that repeat both are one
    document. Rows with a null id or without words stay.
    """
    some, _ = _members(docs, n, Fraction(threshold))
    found = cut(some.select("doc_id", "body", "class"))
    kept = cut(found.groupBy("class").agg(F.min(F.struct("doc_id", "body")).alias("k")).select("class", "k.doc_id", "k.body"))
    dropped = cut(found.join(kept, ["class", "doc_id", "body"], "left_anti").select("doc_id", "body").distinct())
    again = cut(found.groupBy("doc_id", "body").count().where("count > 1").join(dropped, ["doc_id", "body"], "left_anti")
                .select("doc_id", "body"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _body().alias("body"))
    left = join_small(rows, dropped, ["doc_id", "body"], "left_anti")
    if again.limit(1).count():
        once = (join_small(left, again, ["doc_id", "body"], "left_semi").groupBy("doc_id", "body")
                .agg(F.first("row").alias("row")).select("row", "doc_id", "body"))
        left = join_small(left, again, ["doc_id", "body"], "left_anti").unionByName(once)
    return left.select("row.*")
