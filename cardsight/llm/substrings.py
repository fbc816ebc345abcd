"""Operator 4: suffix-array removal of repeated 50-byte strings across documents.

A byte goes when it is covered by a 50-byte string that also starts in a
document with a smaller id. The steps, each a bounded amount of bytes per task:

1. Copies of a whole text (by its SHA-256) go at once: all but the smallest id.
2. The other texts are laid into chunks of ``CHUNK`` bytes and written once. Every
   50-byte window is named by its minimizer, the least hash of its 20-byte strings, so
   equal windows have equal names. Names are counted by chunks, pre-aggregated to one
   entry per chunk; those found in two documents go back to their chunks.
3. Stretches of windows with one such name are cut out, distinct ones per chunk, and
   dealt to shards by their name: whatever equals a window lies in the same shard.
4. A shard builds suffix arrays over its stretches, ``SHARD`` bytes at a time, by
   Larsson-Sadakane refinement: positions are ranked by 8 bytes, and the groups
   that are still unsorted are refined to 16, 32 and 50 bytes by the rank of a
   position further on. Neighbours with 50 bytes in common get the least id of their group.
   Arrays of one shard are merged by binary search of each one's strings in the others.
5. The least ids go back to the chunks, where the covered bytes are marked and removed.

The common prefixes of neighbours are compared for all of them at once, eight
bytes at a time up to 50, as Kasai's scan, one position after another, cannot be
put into array operations; longer prefixes are never needed.

Defined results: null and empty texts, and texts below 50 bytes, lose nothing;
rows with a null id lose nothing and take nothing from others; rows with equal ids
take nothing from each other; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsight.llm.common import cut, in_arrow, join_small, shared_table, arrow_ready

LENGTH = 50               # bytes of a string
GRAM = 20                 # bytes that name a window
CHUNK = 2 << 20           # bytes of text in a chunk; a longer text is a chunk of its own
BLOCK = 4 << 20           # bytes of a chunk whose windows are named at once
NAMES_OF = 32 << 20       # bytes of text whose windows' names are counted in one task
STRETCHES_OF = 4 << 20    # bytes of text whose stretches are dealt to one shard
SHARD = 4 << 20           # bytes of one suffix array

_REACH = LENGTH - GRAM + 1   # 20-byte strings in a window
_KEY = np.uint64((1 << 47) - 1)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _words(data: bytes, big: bool = False) -> np.ndarray:
    """The 8 bytes from each position on, as numbers; ``data`` must have 8 bytes behind the last position."""
    return np.ndarray(len(data) - 8, dtype=">u8" if big else "<u8", buffer=data, strides=(1,)).astype(np.uint64)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


def window_names(data: bytes) -> np.ndarray:
    """The name of each window that starts in ``data``."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, dtype=np.uint64)
    w = _words(data + b"\0" * 8)
    h = w[:n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += w[8:n - GRAM + 9]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += w[GRAM - 8:n - 7]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return _sliding(h, _REACH, np.minimum)


class Chunk:
    """Texts laid end to end, and the runs of windows with one name."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes):
        self.ids, self.sizes, self.data = ids, sizes, data
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, text, mixed name) of each run; windows lie within a text."""
        found = [self._runs_in(at, min(at + BLOCK, len(self.data))) for at in range(0, max(len(self.data), 1), BLOCK)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _runs_in(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs of the windows that start in a block. Its end cuts a run in two, which changes no window's name."""
        names = window_names(self.data[begin:end + LENGTH - 1])
        # Of each text, the windows that start in the block.
        low = np.clip(self.starts, begin, begin + len(names))
        n = np.maximum(np.minimum(self.ends - LENGTH + 1, begin + len(names)) - low, 0)
        text = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(text)) + np.repeat(low - np.cumsum(n) + n, n)
        name = names[at - begin]
        if not len(at):
            none = np.empty(0, dtype=np.int64)
            return none, none, none, np.empty(0, dtype=np.uint64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        return at[first], np.diff(np.append(first, len(at))), text[first], _spread(name[first])

    def stretches(self, shared: np.ndarray, n_names: int, n_shards: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches with shared names: (distinct (shard, bytes)), and of each stretch its entry, start and text."""
        first, n, text, name = self.runs()
        of = np.isin(_named(name, n_names), shared)
        first, n, text, name = first[of], n[of], text[of], name[of]
        shard = (_spread(name ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(n_shards)).astype(np.int64)
        seen: dict[bytes, int] = {}
        entries: list[tuple[int, bytes]] = []
        entry = np.empty(len(first), dtype=np.int64)
        for i, (a, b, s) in enumerate(zip(first.tolist(), (first + n + LENGTH - 1).tolist(), shard.tolist())):
            part = self.data[a:b]
            k = seen.setdefault(part, len(entries))
            if k == len(entries):
                entries.append((s, part))
            entry[i] = k
        return entries, entry, first, text


def _bucket(name: np.ndarray, n_names: int) -> np.ndarray:
    return name % np.uint64(n_names)


def _named(name: np.ndarray, n_names: int) -> np.ndarray:
    """A name's 47 bits and its bucket in one number."""
    return ((name >> np.uint64(16)) & _KEY) | (_bucket(name, n_names) << np.uint64(47))


def _pack6(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def chunk_names(chunk: Chunk, n_names: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, its names in the chunk, ascending; the lowest bit tells those found in two texts)."""
    _, _, text, name = chunk.runs()
    order = np.lexsort((text, name))
    name, text = name[order], text[order]
    new = np.ones(len(name), dtype=bool)
    new[1:] = name[1:] != name[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return
    several = text[first] != text[np.append(first[1:], len(text)) - 1]
    name = name[first]
    key = (((name >> np.uint64(16)) & _KEY) << np.uint64(1)) | several.astype(np.uint64)
    bucket = _bucket(name, n_names)
    order = np.lexsort((key, bucket))
    key, bucket = key[order], bucket[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    for a, b in zip(edges, edges[1:]):
        yield int(bucket[a]), _pack6(key[a:b])


def suffix_array(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order of their ``length`` bytes, first slot of each position's group).

    Every position of ``data`` is ranked, as if zeros followed the end.
    """
    return _refined(data, length)[:2]


def _refined(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array, and bytes that each slot is known to share with the one before it: those that the two were
    ranked by when they came apart."""
    n = len(data)
    words = _words(data + b"\0" * 8, big=True)
    order = np.argsort(words, kind="stable")
    known = 8
    sorted_words = words[order]
    head = np.ones(n, dtype=bool)
    head[1:] = sorted_words[1:] != sorted_words[:-1]
    shared = np.where(head, 0, length)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while known < length:
        step = min(known, length - known)
        # Slots of groups with more than one member; the others have their final place.
        single = head & np.append(head[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        here = order[slots]
        far = here + step
        ahead = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        key = rank[here] * np.int64(n + 1) + ahead
        again = np.argsort(key, kind="stable")
        order[slots] = here[again]
        key = key[again]
        split = np.ones(len(slots), dtype=bool)
        split[1:] = key[1:] != key[:-1]
        shared[slots[split & ~head[slots]]] = known
        head[slots] = split
        rank[order[slots]] = np.maximum.accumulate(np.where(split, slots, 0))
        known += step
    return order, rank, shared


def neighbours_in_common(data: bytes, order: np.ndarray, length: int = LENGTH, shared: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each position of a suffix array has in common with the one before it, up to ``length``.

    Those that are known to be ``shared`` are not compared again."""
    words = _words(data + b"\0" * (length + 8), big=True)
    common = np.zeros(len(order), dtype=np.int64) if shared is None else shared.copy()
    for at in range(0, length, 8):
        going = np.flatnonzero(common[1:] == at) + 1
        x = words[order[going] + at] ^ words[order[going - 1] + at]
        # Leading equal bytes of two words: 8, or 7 less the place of the highest byte that differs.
        common[going] += np.where(x == 0, 8, 7 - _high_byte(x))
    common[:1] = 0
    return np.minimum(common, length)


def _high_byte(x: np.ndarray) -> np.ndarray:
    """The place, from 0 at the low end, of the highest byte that is not 0."""
    place = np.zeros(len(x), dtype=np.int64)
    for step in (32, 16, 8):
        more = (x >> np.uint64(step)) > 0
        x = np.where(more, x >> np.uint64(step), x)
        place += more * np.int64(step // 8)
    return place


class Shard:
    """Stretches with the least id that holds each, and the least id of each of their windows."""

    def __init__(self, parts: list[bytes], least: np.ndarray):
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.data = b"".join(parts)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.part = part = np.repeat(np.arange(len(parts)), sizes)
        self.is_window = np.arange(len(self.data)) + LENGTH <= self.ends[part]
        order, _, shared = _refined(self.data)
        apart = neighbours_in_common(self.data, order, shared=shared) < LENGTH
        # Groups of equal strings; what runs over a stretch's end is no window and counts for nothing.
        group = np.cumsum(apart) - 1
        of = np.where(self.is_window, least[part], np.iinfo(np.int64).max)[order]
        heads = np.flatnonzero(apart)
        self.group_of = np.empty(len(order), dtype=np.int64)
        self.group_of[order] = group
        self.least = np.minimum.reduceat(of, heads)
        self.real = self.least < np.iinfo(np.int64).max

    def strings(self) -> np.ndarray:
        """The shard's distinct windows, in order."""
        windows = np.flatnonzero(self.is_window)
        holder = np.zeros(len(self.least), dtype=np.int64)
        holder[self.group_of[windows]] = windows
        at = holder[self.real]
        grid = np.ndarray((max(0, len(self.data) - LENGTH + 1),), dtype=f"V{LENGTH}", buffer=self.data, strides=(1,))
        return np.frombuffer(grid[at].tobytes(), dtype=f"S{LENGTH}") if len(at) else np.empty(0, dtype=f"S{LENGTH}")

    def take(self, other: "Shard") -> None:
        """Lower the least ids by another shard's, found by binary search."""
        mine, theirs = self.strings(), other.strings()
        if not len(mine) or not len(theirs):
            return
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        same = theirs[at] == mine
        real = np.flatnonzero(self.real)
        self.least[real[same]] = np.minimum(self.least[real[same]], other.least[other.real][at[same]])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, first window in it, windows, least id) of runs of windows with one least id."""
        at = np.flatnonzero(self.is_window)
        ids, part = self.least[self.group_of[at]], self.part[at]
        head = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (part[1:] != part[:-1])))
        return part[head], at[head] - self.starts[part[head]], np.diff(np.append(head, len(at))), ids[head]


def _runs(parts: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of all stretches, in their order; shards of ``SHARD`` bytes are merged with each other."""
    shards, at, size = [], 0, 0
    for i, part in enumerate([*parts, None]):
        if part is None or size and size + len(part) > SHARD:
            shards.append((at, Shard(parts[at:i], least[at:i])))
            at, size = i, 0
        size += len(part or b"")
    for _, a in shards:
        for _, b in shards:
            if a is not b:
                a.take(b)
    found = [(at, shard.runs()) for at, shard in shards]
    return tuple(np.concatenate([r[i] + (at if i == 0 else 0) for at, r in found]) for i in range(4))


_REPLY = "g long, kind int, bucket int, a binary, b binary, c binary, d binary"


def _reply(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)],
                    names=["g", "kind", "bucket", "a", "b", "c", "d"])


def _shared_names(rows: pa.Table) -> pa.Table:
    """One bucket: to each chunk, its names that are found in two texts."""
    blobs = [_unpack6(x) for x in rows.column("names").to_pylist()]
    keys = np.concatenate(blobs)
    owner = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
    order = np.argsort(keys >> np.uint64(1), kind="stable")
    name, several = keys[order] >> np.uint64(1), (keys[order] & np.uint64(1)).astype(bool)
    head = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    size = np.diff(np.append(head, len(name)))
    is_shared = np.repeat((size > 1) | np.logical_or.reduceat(several, head), size)
    name, owner = name[is_shared], owner[order][is_shared]
    back = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[back], np.arange(len(blobs) + 1))
    bucket = rows.column("bucket")[0].as_py()
    return _reply([(g, 0, bucket, _pack6(name[back[ends[i]:ends[i + 1]]]), None, None, None)
                   for i, g in enumerate(rows.column("g").to_pylist()) if ends[i + 1] > ends[i]])


def _least_ids(rows: pa.Table) -> pa.Table:
    """One shard: to each chunk, runs (stretch, first window, windows, least id) where an id below some owner's is known."""
    parts: list[bytes] = []
    least: list[int] = []
    seen: dict[bytes, int] = {}
    owners = []
    for g, data, sizes, low, high in zip(*(rows.column(c).to_pylist() for c in ("g", "data", "sizes", "low", "high"))):
        sizes = np.frombuffer(sizes, dtype=np.int64)
        low, high = np.frombuffer(low, dtype=np.int64), np.frombuffer(high, dtype=np.int64)
        ends = np.cumsum(sizes).tolist()
        mine = []
        for a, b, doc in zip([0, *ends], ends, low.tolist()):
            part = data[a:b]
            k = seen.setdefault(part, len(parts))
            if k == len(parts):
                parts.append(part)
                least.append(doc)
            else:
                least[k] = min(least[k], doc)
            mine.append(k)
        owners.append((g, mine, high))
    part, first, n, ids = _runs(parts, np.array(least, dtype=np.int64))
    head = np.searchsorted(part, np.arange(len(parts) + 1))
    lowest = np.minimum.reduceat(ids, head[:-1])
    shard_no = rows.column("shard")[0].as_py()
    out = []
    for g, mine, high in owners:
        mine = np.array(mine, dtype=np.int64)
        of = np.flatnonzero(lowest[mine] < high)
        if len(of):
            times = head[mine[of] + 1] - head[mine[of]]
            at = np.repeat(head[mine[of]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out.append((g, 1, shard_no, *(x.astype(np.int64).tobytes() for x in
                                          (np.repeat(of, times), first[at], n[at], ids[at]))))
    return _reply(out)


_CHUNK_SCHEMA = "g long, ids binary, sizes binary, data binary"


def _chunked(docs: DataFrame) -> DataFrame:
    """The texts in compressed chunks: g, ids, sizes, data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        g, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        press = zstandard.ZstdCompressor(level=3)

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([g], pa.int64()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                pa.array([np.array([len(t) for t in texts], dtype=np.int64).tobytes()], pa.binary()),
                pa.array([press.compress(b"".join(texts))], pa.binary())], names=["g", "ids", "sizes", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                if texts and size + len(raw) > CHUNK:
                    yield chunk()
                    g, ids, texts, size = g + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield chunk()

    return in_arrow(docs, run, _CHUNK_SCHEMA)


def _opened(row: dict) -> Chunk:
    import zstandard

    sizes = np.frombuffer(row["sizes"], dtype=np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(sizes.sum()))) \
        if sizes.sum() else b""
    return Chunk(np.frombuffer(row["ids"], dtype=np.int64), sizes, data)


def _names_of(chunks: DataFrame, n_names: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                named = list(chunk_names(_opened(row), n_names))
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in named], pa.int32()), pa.array([row["g"]] * len(named), pa.int64()),
                    pa.array([x for _, x in named], pa.binary())], names=["bucket", "g", "names"])

    return in_arrow(chunks, run, "bucket int, g long, names binary")


def _shared_of(replies: pa.Table) -> np.ndarray:
    rows = [r for r in replies.select(["kind", "bucket", "a"]).to_pylist() if r["kind"] == 0]
    return np.concatenate([_unpack6(r["a"]) | np.uint64((r["bucket"] & 0x1FFFF) << 47) for r in rows]) \
        if rows else np.empty(0, dtype=np.uint64)


def _stretches_of(chunks: DataFrame, replies: DataFrame, n_names: int, n_shards: int) -> DataFrame:
    def run(key, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        for row in chunk.to_pylist():
            it = _opened(row)
            entries, entry, _, text = it.stretches(_shared_of(replies), n_names, n_shards)
            ids = it.ids[text]
            low = np.full(len(entries), np.iinfo(np.int64).max)
            high = np.full(len(entries), np.iinfo(np.int64).min)
            np.minimum.at(low, entry, ids)
            np.maximum.at(high, entry, ids)
            shard = np.array([s for s, _ in entries], dtype=np.int64)
            for s in np.unique(shard).tolist():
                at = np.flatnonzero(shard == s)
                parts = [entries[i][1] for i in at.tolist()]
                rows.append((s, row["g"], b"".join(parts), np.array([len(p) for p in parts], dtype=np.int64).tobytes(),
                             low[at].tobytes(), high[at].tobytes()))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)],
                        names=["shard", "g", "data", "sizes", "low", "high"])

    return (chunks.groupBy("g").cogroup(replies.groupBy("g"))
            .applyInArrow(run, "shard int, g long, data binary, sizes binary, low binary, high binary"))


def _removed(chunks: DataFrame, replies: DataFrame, n_names: int, n_shards: int) -> DataFrame:
    def run(key, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():
            it = _opened(row)
            entries, entry, first, text = it.stretches(_shared_of(replies), n_names, n_shards)
            shard = np.array([s for s, _ in entries], dtype=np.int64)
            place = {s: np.flatnonzero(shard == s) for s in np.unique(shard).tolist()}
            edge = np.zeros(len(it.data) + 1, dtype=np.int32)
            by_entry = np.argsort(entry, kind="stable")
            ends = np.searchsorted(entry[by_entry], np.arange(len(entries) + 1))
            for r in replies.to_pylist():
                if r["kind"] != 1:
                    continue
                k, at, n, least = (np.frombuffer(r[c], dtype=np.int64) for c in "abcd")
                k = place[r["bucket"]][k]
                # Each run for every stretch that is this entry.
                times = ends[k + 1] - ends[k]
                which = np.repeat(np.arange(len(k)), times)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                stretch = by_entry[ends[k][which] + inner]
                gone = least[which] < it.ids[text[stretch]]
                begin = (first[stretch] + at[which])[gone]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + n[which][gone] + LENGTH - 1, -1)
            gone = np.cumsum(edge, dtype=np.int32)[:-1] > 0
            data = np.frombuffer(it.data, dtype=np.uint8)
            for doc_id, a, b in zip(it.ids.tolist(), it.starts.tolist(), it.ends.tolist()):
                off = gone[a:b]
                spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum()) if b > a else 0
                out.append((doc_id, b - a, int(off.sum()), spans,
                            hashlib.sha256(data[a:b][~off].tobytes() if spans else it.data[a:b]).hexdigest()))
        kinds = [*[pa.int64()] * 4, pa.string()]
        return pa.table([pa.array([r[i] for r in out], kinds[i]) for i in range(5)],
                        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (chunks.groupBy("g").cogroup(replies.groupBy("g"))
            .applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per row of ``docs``."""
    arrow_ready(docs.sparkSession)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text"))
    base = cut(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                           F.sha2("text", 256).alias("sha")))
    whole = base.where((F.col("n_bytes") >= LENGTH) & F.col("doc_id").isNotNull())
    first = cut(whole.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                .where("first < last").select("sha", "first"))
    copies = cut(whole.join(first, "sha").where("doc_id > first").select("doc_id", "sha", "n_bytes"))
    nothing = F.sha2(F.lit(""), 256)
    gone = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                         nothing.alias("kept_sha256"))
    unnamed = base.where("doc_id is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"),
                                                  F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    left = join_small(rows.where("doc_id is not null").withColumn("sha", F.sha2("text", 256)),
                      copies.select("doc_id", "sha").distinct(), ["doc_id", "sha"], "left_anti")
    chunks = shared_table(_chunked(left.select("doc_id", "text")))
    total = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_names, n_shards = total // NAMES_OF + 1, total // STRETCHES_OF + 1
    shared = shared_table(_names_of(chunks, n_names).groupBy("bucket").applyInArrow(_shared_names, _REPLY))
    stretches = _stretches_of(chunks, shared, n_names, n_shards)
    least = stretches.groupBy("shard").applyInArrow(_least_ids, _REPLY)
    return (_removed(chunks, shared.unionByName(least), n_names, n_shards)
            .unionByName(gone).unionByName(unnamed))
