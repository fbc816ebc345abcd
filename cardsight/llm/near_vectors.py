"""Operator 7: embedding near-duplicates by small-world graphs per shard.

Vectors of one label are dealt to shards of at most about ``SHARD`` distinct vectors.
A shard's vectors are built into a hierarchical navigable small-world graph, in
batches: a batch is searched in the graph so far, its neighbours are picked for
diversity, and links back are pruned the same way. Every vector is then looked up
in every shard of its label: greedily through the upper levels, by a beam on the
lowest. What the beam finds is checked by cosine in double precision.

Beams widen until they are wide enough: a shard's beam doubles until an audit of
stored vectors against exact search passes, and a query of whose beam half or
more are links is asked again with a beam as wide as the shard, which scores
every vector in it. Where no graph of the shard passes the audit, every query is
asked that way.

Equal vectors are one vertex with a count, so a vector repeated in a third of all
rows costs one row per task. Queries are cut into chunks, graphs are built once and
sent to each chunk, and of the links only those that join two classes leave a task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or id, link with nothing (0 links, their own
component); vectors of different lengths are never compared; repeated rows of one id
count once as a partner; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsight.llm.common import cut, in_arrow, shared_table, arrow_ready
from cardsight.llm.graph import components

SHARD = 16_384       # distinct vectors of one graph
CHUNK = 4_096        # query vectors of one task
DEGREE = 16          # links of a vertex on the upper levels; twice as many on the lowest
BUILD_BEAM = 64
BEAM = 32            # where the audits begin
AUDITED = 256        # stored vectors of a shard that are audited
RECALL = 0.99        # of the links, and of the nearest neighbours
BATCH = 512


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class SmallWorld:
    """A navigable small-world graph of unit vectors; neighbours are found by dot product."""

    def __init__(self, x: np.ndarray, names: np.ndarray, degree: int = DEGREE):
        self.x = x.astype(np.float32)
        self.degree = degree
        n = len(x)
        u = (np.array([xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) for i in names],
                      dtype=np.float64) + 1) / 2.0 ** 64
        self.level = np.minimum((-np.log(np.minimum(u, 1.0)) / np.log(degree)).astype(np.int64), 8)
        # links[l][i]: neighbours of i on level l, -1 where there are fewer.
        self.links = [np.full((n, degree * (1 + (lv == 0))), -1, dtype=np.int32) for lv in range(int(self.level.max()) + 1)]
        self.entry = int(np.argmax(self.level))
        self._build()

    def _build(self) -> None:
        n = len(self.x)
        order = np.concatenate([[self.entry], np.setdiff1d(np.arange(n), [self.entry])])  # the top one first
        at = 1
        while at < n:
            size = min(BATCH, max(64, at))
            new = order[at:at + size]
            self._insert(new)
            at += len(new)

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        own = q @ q.T
        np.fill_diagonal(own, -2.0)
        start = np.full((len(new), 1), self.entry)
        for lv in range(len(self.links) - 1, -1, -1):
            here = self.level[new] >= lv
            found, sims = self._search(q, start, lv, BUILD_BEAM if here.any() else 1)
            start = found[:, :1]
            if not here.any():
                continue
            # Candidates: what the beam found, and the nearest of the batch that are on this level too.
            mates = np.where(here[None, :], own, -2.0)[here]
            k = min(self.links[lv].shape[1], len(new))
            near = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            near_sims = np.take_along_axis(mates, near, axis=1)
            cand = np.concatenate([found[here], np.where(near_sims > -2.0, new[near], -1)], axis=1)
            sims = np.concatenate([sims[here], near_sims], axis=1)
            picked = self._pick(new[here], cand, sims, self.links[lv].shape[1])
            self.links[lv][new[here]] = picked
            self._link_back(new[here], picked, lv)

    def _pick(self, of: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours: a candidate nearer to a picked one than to the vertex comes only after the others."""
        out = np.full((len(of), most), -1, dtype=np.int32)
        for a in range(0, len(of), 128):
            c, s = cand[a:a + 128], np.where(cand[a:a + 128] >= 0, sims[a:a + 128], -3.0)
            by = np.argsort(-s, axis=1, kind="stable")[:, :3 * most]
            c, s = np.take_along_axis(c, by, axis=1), np.take_along_axis(s, by, axis=1)
            v = self.x[np.maximum(c, 0)]
            between = np.einsum("aid,ajd->aij", v, v)
            picked = np.zeros(c.shape, dtype=bool)
            for j in range(c.shape[1]):
                crowded = (picked & (between[:, j] > s[:, j:j + 1])).any(axis=1)
                picked[:, j] = ~crowded & (s[:, j] > -2.0) & (picked.sum(axis=1) < most // 2)
            rank = np.where(picked, 0, np.where(s > -2.0, 1, 2))
            by = np.argsort(rank, axis=1, kind="stable")[:, :most]
            chosen = np.where(np.take_along_axis(rank, by, axis=1) < 2, np.take_along_axis(c, by, axis=1), -1)
            out[a:a + 128, :chosen.shape[1]] = chosen
        return out

    def _link_back(self, new: np.ndarray, picked: np.ndarray, lv: int) -> None:
        width = self.links[lv].shape[1]
        src, dst = np.repeat(new, picked.shape[1]), picked.reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        sims = np.einsum("ij,ij->i", self.x[src], self.x[dst])
        order = np.lexsort((-sims, dst))
        src, dst, sims = src[order], dst[order], sims[order]
        head = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else dst
        nth = np.arange(len(dst)) - np.repeat(head, np.diff(np.append(head, len(dst))))
        near = nth < width
        to = dst[head] if len(dst) else dst
        extra = np.full((len(to), width), -1, dtype=np.int64)
        extra[np.searchsorted(to, dst[near]), nth[near]] = src[near]
        old = self.links[lv][to].astype(np.int64)
        extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        cand = np.concatenate([old, extra], axis=1)
        full = (cand >= 0).sum(axis=1) > width
        room = np.argsort(cand < 0, axis=1, kind="stable")[:, :width]
        kept = np.take_along_axis(cand, room, axis=1)
        if full.any():
            c = cand[full]
            s = np.einsum("ad,acd->ac", self.x[to[full]], self.x[np.maximum(c, 0)])
            kept[full] = self._pick(to[full], c, s, width)
        self.links[lv][to] = kept

    def _search(self, q: np.ndarray, start: np.ndarray, lv: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(vertices, similarities), best first, of a beam search on one level; -1 where fewer were found."""
        links, x = self.links[lv], self.x
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(x)), dtype=bool)
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        sims = np.full((len(q), beam), -2.0, dtype=np.float32)
        ids[:, 0] = start[:, 0]
        sims[:, 0] = np.einsum("ad,ad->a", q, x[start[:, 0]])
        seen[rows, start[:, 0]] = True
        done = np.zeros((len(q), beam), dtype=bool)
        wave = max(1, min(4, beam // 8))  # vertices looked at together
        active = rows
        while len(active):
            waiting = np.where((ids[active] >= 0) & ~done[active], sims[active], -3.0)
            best = np.argpartition(-waiting, wave - 1, axis=1)[:, :wave] if wave < beam else \
                np.zeros((len(active), 1), dtype=np.int64)
            open_ = np.take_along_axis(waiting, best, axis=1) > -3.0
            going = open_.any(axis=1)
            active, best, open_ = active[going], best[going], open_[going]
            if not len(active):
                break
            done[active[:, None], best] |= open_
            at = np.take_along_axis(ids[active], best, axis=1)
            next_ = np.where(open_[:, :, None], links[np.maximum(at, 0)], -1).reshape(len(active), -1).astype(np.int64)
            fresh = (next_ >= 0) & ~seen[active[:, None], np.maximum(next_, 0)]
            seen[np.repeat(active, next_.shape[1])[fresh.reshape(-1)], next_.reshape(-1)[fresh.reshape(-1)]] = True
            # A vertex reached from two sides in one wave is kept once.
            if wave > 1:
                by = np.argsort(np.where(fresh, next_, -1), axis=1, kind="stable")
                sorted_ = np.take_along_axis(np.where(fresh, next_, -1), by, axis=1)
                again = np.zeros_like(fresh)
                again[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
                next_, fresh = sorted_, (sorted_ >= 0) & ~again
            s = np.where(fresh, np.einsum("ad,akd->ak", q[active], x[np.maximum(next_, 0)]), -2.0).astype(np.float32)
            all_ids = np.concatenate([ids[active], np.where(fresh, next_, -1)], axis=1)
            all_sims = np.concatenate([sims[active], s], axis=1)
            all_done = np.concatenate([done[active], np.zeros(s.shape, dtype=bool)], axis=1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, top, axis=1)
            sims[active] = np.take_along_axis(all_sims, top, axis=1)
            done[active] = np.take_along_axis(all_done, top, axis=1)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(np.float32)
        start = np.full((len(q), 1), self.entry)
        for lv in range(len(self.links) - 1, 0, -1):
            start = self._search(q, start, lv, 4)[0][:, :1]
        return self._search(q, start, 0, beam)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, level=self.level, entry=self.entry, degree=self.degree,
                 **{f"links{i}": a for i, a in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "SmallWorld":
        it, z = cls.__new__(cls), np.load(io.BytesIO(data))
        it.x, it.level, it.entry, it.degree = z["x"], z["level"], int(z["entry"]), int(z["degree"])
        it.links = [z[f"links{i}"] for i in range(int(it.level.max()) + 1)]
        return it


def _many(ids: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Queries that may have more links than their beam holds: half of what it found or more."""
    return 2 * links.sum(axis=1) >= (ids >= 0).sum(axis=1)


def audited_beam(world: SmallWorld, unit: np.ndarray, names: np.ndarray, threshold: float) -> tuple[int, float]:
    """(beam, recall): the first beam, doubled from ``BEAM``, that passes the audit; else the widest one tried.

    The recall is the least of three: the nearest neighbours', and the links' of vectors with fewer links than
    the beam and of the others, counted apart so that a large group does not hide the small ones. A beam as wide
    as the shard is exact."""
    by_hash = np.argsort([xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True), seed=1) for i in names])
    some = by_hash[:AUDITED]
    exact = unit[some] @ unit.T
    exact[np.arange(len(some)), some] = -2.0
    wanted = exact >= threshold
    n_wanted = wanted.sum(axis=1)
    nearest = np.argsort(-exact, axis=1, kind="stable")[:, :min(3, len(unit) - 1)]
    beam = min(BEAM, len(unit))
    while beam < len(unit):
        ids, _ = world.search(unit[some], beam)
        found = np.zeros(exact.shape, dtype=bool)
        found[np.nonzero(ids >= 0)[0], ids[ids >= 0]] = True
        near = np.take_along_axis(found, nearest, axis=1).mean()
        own = np.arange(len(some))
        linked = wanted.copy()
        linked[own, some] = True  # a stored vector finds itself too when it asks
        again = _many(ids, (ids >= 0) & np.take_along_axis(linked, np.maximum(ids, 0), axis=1))
        hits = np.where(again, n_wanted, (wanted & found).sum(axis=1))
        large = n_wanted >= beam
        recall = min([near, *(hits[x].sum() / n_wanted[x].sum() for x in (large, ~large) if n_wanted[x].any())])
        if recall >= RECALL or beam >= 1024:
            return beam, float(recall)
        beam = min(2 * beam, len(unit))
    return beam, 1.0


def audited_world(unit: np.ndarray, names: np.ndarray, threshold: float) -> tuple[SmallWorld | None, int, float]:
    """(graph, beam, recall) of a shard; no graph and a beam as wide as the shard where none passes the audit."""
    for degree in (DEGREE, 2 * DEGREE, 4 * DEGREE) if len(names) > BEAM else ():
        world = SmallWorld(unit, names, degree)
        beam, recall = audited_beam(world, unit, names, threshold)
        if recall >= RECALL:
            return (world if beam < len(names) else None), beam, recall
    return None, len(names), 1.0


def links_in(world: SmallWorld | None, beam: int, unit: np.ndarray, part: np.ndarray, threshold: float) -> list[np.ndarray]:
    """For each query of ``part``, the stored vectors ``unit`` that it links with."""
    linked, wide = [np.empty(0, dtype=np.int64)] * len(part), np.arange(len(part))
    if world:
        ids, _ = world.search(part, beam)
        exact = np.einsum("ad,akd->ak", part, unit[np.maximum(ids, 0)])
        links = (ids >= 0) & (exact >= threshold)
        linked = [i[x] for i, x in zip(ids, links)]
        wide = np.flatnonzero(_many(ids, links))
    for w in range(0, len(wide), 128):  # beams as wide as the shard
        some = wide[w:w + 128]
        for i, row in zip(some.tolist(), part[some] @ unit.T >= threshold):
            linked[i] = np.flatnonzero(row)
    return linked


def _prepared(vectors: DataFrame) -> DataFrame:
    """Vectors that can link: vec_id, label, size, digest, values (32-bit floats when they hold the values, else 64-bit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, label, vector in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))):
                if not vector or any(v is None for v in vector):
                    continue
                x = np.array(vector, dtype=np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                raw = (x + 0.0).tobytes()  # -0.0 and 0.0 are one value
                whole = xxhash.xxh3_128_intdigest(raw)
                rows.append((vec_id, label, len(x), (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63), raw))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)],
                                             names=["vec_id", "label", "size", "d1", "d2", "raw"])

    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    return in_arrow(rows, run, "vec_id long, label long, size int, d1 long, d2 long, raw binary")


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("raw").to_pylist()), dtype=np.float64).reshape(table.num_rows, -1)


def _built(vertices: DataFrame, threshold: float) -> DataFrame:
    def run(members: pa.Table) -> pa.Table:
        members = members.sort_by("vertex")
        names = members.column("vertex").to_numpy()
        unit = _unit(_matrix(members))
        world, beam, recall = audited_world(unit, names, threshold)
        return pa.table({"label": members.column("label")[:1], "size": members.column("size")[:1],
                         "shard": members.column("shard")[:1], "chunks": members.column("chunks")[:1],
                         "names": pa.array([names.tobytes()], pa.binary()),
                         "copies": pa.array([members.column("copies").to_numpy().tobytes()], pa.binary()),
                         "raw": pa.array([_matrix(members).tobytes()], pa.binary()),
                         "world": pa.array([world.dump() if world else b""], pa.binary()),
                         "beam": pa.array([beam], pa.int64()), "recall": pa.array([recall], pa.float64())})

    return vertices.groupBy("label", "size", "shard").applyInArrow(
        run, "label long, size int, shard int, chunks int, names binary, copies binary, raw binary, world binary, "
             "beam long, recall double")


def _pair_hash(vertex: int, others: np.ndarray) -> np.ndarray:
    """A hash of each unordered pair of names."""
    least, most = np.minimum(others, vertex).astype(np.uint64), np.maximum(others, vertex).astype(np.uint64)
    x = least * np.uint64(0x9E3779B97F4A7C15) ^ (most * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


_ANSWER = "kind int, a long, b long, h long"


def _answers(kind: list, a: list, b: list, h: list) -> pa.Table:
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                     "h": pa.array(h, pa.int64())})


def _signed(x: np.uint64) -> int:
    return int(np.array([x], dtype=np.uint64).view(np.int64)[0])


def _asked(graphs: DataFrame, queries: DataFrame, threshold: float, again: bool = False) -> DataFrame:
    """kind 0: (vertex, links found in the shard, the xor of their pairs' hashes); kind 1: an edge that joins two
    classes; kind 2: (stored vertex, the xor of the hashes of the pairs in which it was found).

    ``again``: the queries are compared with all vectors of the shard; kind 2 is left out, and kind 3 is (stored vertex,
    copies of the query) for each link that the query did not find before."""
    def run(key, graph: pa.Table, asked: pa.Table) -> pa.Table:
        kind, a, b, h = [], [], [], []
        if graph.num_rows and asked.num_rows:
            g = graph.to_pylist()[0]
            names, copies = np.frombuffer(g["names"], dtype=np.int64), np.frombuffer(g["copies"], dtype=np.int64)
            unit = _unit(np.frombuffer(g["raw"], dtype=np.float64).reshape(len(names), -1))
            world = SmallWorld.load(g["world"]) if g["world"] else None
            who, own, q = asked.column("vertex").to_numpy(), asked.column("copies").to_numpy(), _unit(_matrix(asked))
            label = np.arange(len(names))  # classes of stored vectors known so far
            found_by = np.zeros(len(names), dtype=np.uint64)
            for at in range(0, len(who), BATCH):
                part = q[at:at + BATCH]
                before = links_in(world, g["beam"], unit, part, threshold)
                linked = links_in(None, len(names), unit, part, threshold) if again else before
                for vertex, mine, found, seen in zip(who[at:at + BATCH].tolist(), own[at:at + BATCH].tolist(), linked, before):
                    found = found[names[found] != vertex]
                    if again:
                        new = np.setdiff1d(found, seen)
                        kind += [3] * len(new)
                        a += names[new].tolist()
                        b += [mine] * len(new)
                        h += [0] * len(new)
                    if not len(found):
                        continue
                    pairs = _pair_hash(vertex, names[found])
                    found_by[found] ^= pairs
                    classes, first = np.unique(label[found], return_index=True)
                    kind += [0, *[1] * len(first)]
                    a += [vertex] * (1 + len(first))
                    b += [int(copies[found].sum()), *names[found[first]].tolist()]
                    h += [_signed(np.bitwise_xor.reduce(pairs)), *[0] * len(first)]
                    if len(classes) > 1:
                        label[np.isin(label, classes)] = classes[0]
            if not again:
                hit = np.flatnonzero(found_by)
                kind += [2] * len(hit)
                a += names[hit].tolist()
                b += [0] * len(hit)
                h += found_by[hit].view(np.int64).tolist()
        return _answers(kind, a, b, h)

    key = ["label", "size", "shard", "chunk"]
    return graphs.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, _ANSWER)


def _settled(graphs: DataFrame, queries: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(vertex, links), counted alike from both ends of every link, and the edges that join classes.

    A vertex finds the same vertices that find it, or the xor of its pairs' hashes tells. Those for
    which it does are compared with all vectors; a link that this adds also counts for its other end."""
    asked = shared_table(_asked(graphs, queries, threshold))
    counted = asked.where("kind = 0").groupBy(F.col("a").alias("vertex")).agg(F.sum("b").alias("links"))
    edges = asked.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    uneven = cut(asked.where("kind in (0, 2)").groupBy(F.col("a").alias("vertex")).agg(F.bit_xor("h").alias("h"))
                 .where("h <> 0").select("vertex"))
    if not uneven.limit(1).count():
        return counted, edges
    exact = shared_table(_asked(graphs, queries.join(uneven, "vertex", "left_semi"), threshold, again=True))
    whole = exact.where("kind = 0").groupBy(F.col("a").alias("vertex")).agg(F.sum("b").alias("links"))
    more = (exact.where("kind = 3").select(F.col("a").alias("vertex"), F.col("b").alias("links"))
            .join(uneven, "vertex", "left_anti"))
    kept = counted.join(uneven, "vertex", "left_anti").unionByName(more).groupBy("vertex").agg(F.sum("links").alias("links"))
    return kept.unionByName(whole), edges.unionByName(
        exact.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, shard_size: int = SHARD, recall: bool = False) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``vectors``.

    ``recall`` adds the recall that the audit of the vector's shard measured (1 where the shard is searched
    whole, null for vectors that link with nothing by rule)."""
    arrow_ready(vectors.sparkSession)
    prepared = shared_table(_prepared(vectors))
    # A vertex is a distinct vector of a label; its name is its least id.
    same = ["label", "size", "d1", "d2"]
    alike = cut(prepared.select(*same, "vec_id").distinct().groupBy(*same)
                .agg(F.min("vec_id").alias("vertex"), F.count("*").alias("copies")))
    per_label = alike.groupBy("label", "size").agg(
        F.ceil(F.count("*") / shard_size).cast("int").alias("shards"),
        F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    vertices = (prepared.join(alike.withColumnRenamed("vertex", "vec_id"), [*same, "vec_id"]).dropDuplicates([*same, "vec_id"])
                .join(cut(per_label), ["label", "size"])
                .select("label", "size", F.col("vec_id").alias("vertex"), "copies", "raw", "shards", "chunks",
                        F.expr("cast(pmod(xxhash64(vec_id, 1), shards) as int)").alias("shard"),
                        F.expr("cast(pmod(xxhash64(vec_id, 2), chunks) as int)").alias("chunk")))
    vertices = shared_table(vertices)
    graphs = shared_table(_built(vertices.drop("shards", "chunk"), threshold))
    links, edges = _settled(
        graphs.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))),
        vertices.select("label", "size", "vertex", "copies", "raw", "chunk",
                        F.explode(F.expr("sequence(0, shards - 1)")).alias("shard")), threshold)
    links, roots = cut(links), components(edges)
    known = cut(alike.join(links, "vertex", "left").join(roots.withColumnRenamed("node", "vertex"), "vertex", "left")
                .select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("root", "vertex").alias("component_id")))
    able = prepared.select("vec_id", *same).join(known, same).select("vec_id", "label", "n_links", "component_id")
    out = _with_the_rest(vectors, able)
    if not recall:
        return out
    audited = vertices.join(graphs.select("label", "size", "shard", "recall"), ["label", "size", "shard"]).select("vertex", "recall")
    of = prepared.select("vec_id", *same).distinct().join(alike.select(*same, "vertex"), same).join(audited, "vertex")
    return out.join(of.groupBy("vec_id").agg(F.min("recall").alias("recall")), "vec_id", "left")


def _with_the_rest(vectors: DataFrame, able: DataFrame) -> DataFrame:
    """Adds the rows that link with nothing."""
    values = F.col("embedding").cast("array<double>")
    can = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size(values) > 0, F.lit(False))
           & F.coalesce(F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
           & F.coalesce(F.exists(values, lambda v: v != 0), F.lit(False)))
    rest = vectors.where(~can).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                                      F.col("vec_id").cast("long").alias("component_id"))
    return (able.select("vec_id", "n_links", "component_id").unionByName(rest)
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
