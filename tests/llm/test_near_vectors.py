import math
import random

import numpy as np

from cardsight.llm import near_vectors


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, n_links string, shard string")


def _vectors(seed=1, n=400, dim=24):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    while len(rows) < n:
        base = rng.normal(size=dim)
        for _ in range(random.Random(i).choice([1, 1, 3, 40])):
            noise = rng.normal(size=dim) * random.Random(i).choice([0, 0.02, 0.1])
            rows.append((i, int(rng.integers(0, 3)), [float(x) for x in (base + noise).astype(np.float32)], "x", "y"))
            i += 1
    return rows


def brute(rows, threshold=0.98):
    up = {v: v for v, *_ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(up, 0)
    x = [np.array(e, dtype=np.float64) for _, _, e, *_ in rows]
    for i, (v, lv, *_) in enumerate(rows):
        for j, (w, lw, *_) in enumerate(rows):
            if i != j and lv == lw and x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= threshold:
                links[v] += 1
                a, b = find(v), find(w)
                up[max(a, b)] = min(a, b)
    return {v: (links[v], find(v)) for v in up}


def test_links_equal_brute_force(spark, monkeypatch):
    rows = _vectors()
    want = brute(rows)
    for shard, chunk in ((16384, 4096), (60, 50)):
        monkeypatch.setattr(near_vectors, "CHUNK", chunk)
        got = near_vectors.near_duplicates(_table(spark, rows), shard_size=shard).collect()
        assert len(got) == len(rows)
        hit = sum(min(r["n_links"], want[r["vec_id"]][0]) for r in got)
        assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
        assert hit >= 0.99 * sum(n for n, _ in want.values())
        assert sum(r["component_id"] == want[r["vec_id"]][1] for r in got) >= 0.99 * len(got)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, 0, one, "x", "y"), (2, 0, [2.0, 4.0, 6.0], "x", "y"), (3, 1, one, "x", "y"), (4, None, one, "x", "y"),
            (5, 0, None, "x", "y"), (6, 0, [0.0, 0.0, 0.0], "x", "y"), (7, 0, [1.0, None, 3.0], "x", "y"),
            (8, 0, [1.0, float("nan"), 3.0], "x", "y"), (9, 0, [float("inf"), 2.0, 3.0], "x", "y"), (10, 0, [], "x", "y"),
            (11, 0, [1.0, 2.0], "x", "y"), (2, 0, [2.0, 4.0, 6.0], "x", "y"), (None, 0, one, "x", "y"), (12, 0, one, "x", "y")]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in
                  near_vectors.near_duplicates(_table(spark, rows)).collect()), key=str)
    want = [(1, 2, 1), (2, 2, 1), (2, 2, 1), (12, 2, 1), (None, 0, None), *((i, 0, i) for i in range(3, 12))]
    assert got == sorted(want, key=str)
    assert near_vectors.near_duplicates(_table(spark, [])).collect() == []


def test_graph_recall():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    names = np.arange(len(x))
    world = near_vectors.SmallWorld(x, names)
    found, _ = near_vectors.SmallWorld.load(world.dump()).search(x[:200], 64)
    nearest = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([np.isin(n, f).mean() for n, f in zip(nearest, found)]) > 0.9
    beam, recall = near_vectors.audited_beam(world, x, names, 0.98)
    assert recall >= near_vectors.RECALL or beam >= 1024


def _clusters(n_clusters, size, dim, noise, seed=3):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(n_clusters, dim)), size, axis=0)
    return near_vectors._unit(x + noise * rng.normal(size=x.shape))


def test_shard_whose_graphs_fail_the_audit_is_searched_whole(monkeypatch):
    unit = _clusters(60, 20, 16, 0.01)
    names = np.arange(len(unit))
    monkeypatch.setattr(near_vectors.SmallWorld, "_link_back", lambda *a: None)  # graphs that do not hang together
    world = near_vectors.SmallWorld(unit, names)
    assert near_vectors.audited_beam(world, unit, names, 0.98)[1] < near_vectors.RECALL
    world, beam, recall = near_vectors.audited_world(unit, names, 0.98)
    assert beam == len(unit) and recall == 1.0
    found = near_vectors.links_in(world, beam, unit, unit[:100], 0.98)
    assert all(f.tolist() == np.flatnonzero(row >= 0.98).tolist() for f, row in zip(found, unit[:100] @ unit.T))


class _Beam:
    """A graph whose beam holds ``ids`` for every query."""

    def __init__(self, ids):
        self.ids = np.array(ids)

    def search(self, q, beam):
        return np.repeat(self.ids[None, :beam], len(q), axis=0), None


def test_beam_of_links_but_one_is_asked_again():
    unit = _clusters(2, 100, 16, 0.01)
    world = _Beam([*range(31), 150])
    assert near_vectors.links_in(world, 32, unit, unit[:1], 0.98)[0].tolist() == list(range(100))
    few = near_vectors.links_in(_Beam([*range(3), *range(150, 179)]), 32, unit, unit[:1], 0.98)
    assert few[0].tolist() == [0, 1, 2]


def test_audit_counts_large_groups():
    # Every vector has 99 links; beams of any width hold its three nearest and no more than 10 links.
    unit = _clusters(20, 100, 16, 0.01)
    names = np.arange(len(unit))

    class Poor:
        def search(self, q, beam):
            ids = np.full((len(q), beam), -1)
            for i, row in enumerate(q @ unit.T):
                by = np.argsort(-row, kind="stable")
                ids[i] = np.concatenate([by[:10], by[200:]])[:beam]
            return ids, None

    assert near_vectors.audited_beam(Poor(), unit, names, 0.98)[1] < near_vectors.RECALL


def test_links_count_from_both_ends(spark):
    """A narrow beam finds some links from one end only; they count for both ends all the same."""
    near_vectors.arrow_ready(spark)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12))
    x = np.repeat(base, 2, axis=0) + rng.normal(scale=0.02, size=(800, 12))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    names = np.arange(800, dtype=np.int64)
    world = near_vectors.SmallWorld(unit, names, 4)
    beam = 5
    before = near_vectors.links_in(world, beam, unit, unit, 0.98)
    pairs = {(i, int(j)) for i, found in enumerate(before) for j in found if i != j}
    one_sided = {p for p in pairs if p[::-1] not in pairs}
    assert one_sided
    graph = [(1, 12, 0, 0, bytearray(names.tobytes()), bytearray(np.ones(800, np.int64).tobytes()), bytearray(x.tobytes()),
              bytearray(world.dump()), beam)]
    graphs = spark.createDataFrame(graph, "label long, size int, shard int, chunk int, names binary, copies binary, raw binary, "
                                          "world binary, beam long")
    rows = [(1, 12, int(i), 1, bytearray(x[i].tobytes()), 0, 0) for i in names]
    queries = spark.createDataFrame(rows, "label long, size int, vertex long, copies long, raw binary, chunk int, shard int")
    links, edges = near_vectors._settled(graphs, queries, 0.98)
    got = {r["vertex"]: r["links"] for r in links.collect()}
    exact = unit @ unit.T >= 0.98
    uneven = {i for p in one_sided for i in p}
    want = {}
    for i, j in pairs | {p[::-1] for p in pairs} | {(i, int(j)) for i in uneven for j in np.flatnonzero(exact[i]) if j != i} | {
            (int(j), i) for i in uneven for j in np.flatnonzero(exact[i]) if j != i}:
        want[i] = want.get(i, 0) + 1
    assert got == want
    joined = {(r["u"], r["v"]) for r in edges.collect()}
    assert all((i, j) in joined or (j, i) in joined for i, j in pairs if want[i] == 1)


def test_recall_is_reported(spark):
    rows = [(i, 1, [float(i % 5 + 1), 1.0]) for i in range(30)] + [(99, 1, None)]
    got = {r["vec_id"]: r["recall"] for r in near_vectors.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), recall=True).collect()}
    assert got.pop(99) is None and set(got.values()) == {1.0}
