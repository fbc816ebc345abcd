"""Operator 2: bounded-space online packing of token streams into fixed windows.

Each partition keeps ``OPEN_WINDOWS`` open windows. A document's ids (ending
with the end id) go whole into the open window that they fill best. When none
has room and no further window may be opened, the fullest is emitted: its
gap is filled with the document's first ids (a gap of ``MAX_PAD`` ids or fewer
is padded instead), and the rest is placed anew. Stretches of a full window are
emitted at once. What the open windows hold at the end of a partition is merged
across partitions: laid end to end by prefix sums of the partitions' leftovers
(one number per partition), cut at full windows, and the last, unfilled stretch
at powers of two, which need no padding.

Memory is bounded by the open windows of a task; the only step on one task sums
one row per partition. Packed pieces are written once to the shared folder, so
that a lost executor cannot lead to two different packings.

Defined results: null and empty texts hold the end id alone; repeated rows are
packed each; null ids stay null; an empty table gives no pieces; columns other
than ``doc_id`` and ``text`` are ignored. Special strings inside texts become
special ids, as the tokenizer does by default.
"""

from __future__ import annotations

import bisect
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardsight.llm.common import in_arrow, shared_table, texts_of

WINDOW = 4096
OPEN_WINDOWS = 64      # open windows of a partition
MAX_PAD = 8            # ids of padding that are accepted rather than cutting a document
END_ID = 2
CACHE_SIZE = 300_000   # words in each half of a worker's cache

PIECE_SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
                "part long, spot long")


class WordIds:
    """Token ids (little-endian unsigned 32-bit) of texts, by a cache of whole words.

    For tokenizers that lower-case, drop white space, and split letters from
    punctuation, never merging across either. Words are looked up with A-Z lowered;
    a miss that ends in a mark is made of its letters' ids and the mark's, and
    unknown words of letters are encoded many at a time, cut where a token ends a
    word. Texts that hold a special string are encoded whole.
    """

    MARKS = b".,;:!?"
    JOINED = 4096  # words of letters encoded at a time
    _open: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "WordIds":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of letters: each is one word to the tokenizer too."""
        out = {}
        for at in range(0, len(words), self.JOINED):
            part = words[at:at + self.JOINED]
            raw = self._whole([b" ".join(part).decode()])[0]
            ends = np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 1
            if len(ends) != len(part):  # not the words it was taken for
                out |= zip(part, self._whole([w.decode() for w in part]))
                continue
            begin = 0
            for word, end in zip(part, (4 * ends).tolist()):
                out[word] = raw[begin:end]
                begin = end
        return out

    @staticmethod
    def _plain(word: bytes) -> bool:
        text = word.decode()
        return text.isalpha() and text == text.lower()

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        stems, letters, rest = {}, set(), []
        for w in words:
            if w[-1] in self.MARKS and self._plain(w[:-1]):
                stems[w] = w[:-1]
                letters.add(w[:-1])
            elif self._plain(w):
                letters.add(w)
            else:
                rest.append(w)
        known = {w: self.young.get(w) or self.old.get(w) for w in letters}
        known |= self._letters([w for w, ids in known.items() if ids is None])
        marks = {bytes([m]): self._whole([chr(m)])[0] for m in self.MARKS} if stems else {}
        return (known | {w: known[stem] + marks[w[-1:]] for w, stem in stems.items()}
                | dict(zip(rest, self._whole([w.decode() for w in rest]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode().lower() for t in texts]
        whole = [any(s in r for s in self.specials) for r in raw]
        cut = [[] if w else r.split() for r, w in zip(raw, whole)]
        misses = set().union(*cut).difference(self.young)
        if len(self.young) + len(misses) > CACHE_SIZE:
            self.old, self.young = self.young, {}
            misses = set().union(*cut)
        known = {w: self.old[w] for w in misses if w in self.old}
        self.young.update(known)
        self.young.update(self._encode([w for w in misses if w not in known]))
        ids = self.young.__getitem__
        return [self._whole([t])[0] if w else b"".join(map(ids, words)) for t, w, words in zip(texts, whole, cut)]


class OpenWindows:
    """The open windows of one partition, found by their room."""

    def __init__(self, part: int, size: int = WINDOW, most: int = OPEN_WINDOWS, max_pad: int = MAX_PAD):
        self.part, self.size, self.most, self.max_pad = part, size, most, max_pad
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list[tuple]] = {}  # window -> pieces
        self.made = 0
        self.out: list[tuple] = []

    def _sequence(self, k: int) -> int:
        return self.part << 32 | k

    def _emit(self, k: int, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, ids, total, self._sequence(k), at, self.part, None))
            at += n

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.size:
            self._emit(self.made, [(doc_id, start, ids[4 * start:4 * (start + self.size)], total)])
            self.made += 1
            start += self.size
        while start < total:
            need = total - start
            i = bisect.bisect_left(self.rooms, (need, -1))
            if i < len(self.rooms):            # best fit: the least room that suffices
                take, (room, k) = need, self.rooms.pop(i)
            elif len(self.rooms) < self.most:  # a new window
                take, room, k = need, self.size, self.made
                self.made += 1
                self.held[k] = []
            else:                              # none fits: the fullest goes, its gap filled
                room, k = self.rooms.pop(0)
                take = room if room > self.max_pad else 0
                if not take:
                    self._emit(k, self.held.pop(k))
                    continue
            self.held[k].append((doc_id, start, ids[4 * start:4 * (start + take)], total))
            start += take
            if room > take:
                bisect.insort(self.rooms, (room - take, k))
            else:
                self._emit(k, self.held.pop(k))

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def leftovers(self) -> list[tuple]:
        """The pieces of the windows still open; spot: ids before them among the partition's leftovers."""
        out, spot = [], 0
        for k in sorted(self.held):
            for doc_id, start, ids, total in self.held[k]:
                out.append((doc_id, start, len(ids) // 4, ids, total, None, None, self.part, spot))
                spot += len(ids) // 4
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], names=names)


def _pack_partitions(docs: DataFrame, tokenizer_path: str, window: int, open_windows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.at(tokenizer_path)
        end = END_ID.to_bytes(4, "little")
        windows = OpenWindows(TaskContext.get().partitionId(), window, open_windows)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for i in range(0, len(texts), 1000):
                for doc_id, ids in zip(doc_ids[i:i + 1000], words.encode(texts[i:i + 1000])):
                    windows.add(doc_id, ids + end)
                yield _batch(windows.taken())
        yield _batch(windows.leftovers())

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECE_SCHEMA)


def powers_below(start: int, total: int) -> list[tuple[int, int]]:
    """``total`` ids from ``start`` on, cut into descending powers of two."""
    out = []
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            out.append((start, start + (1 << bit)))
            start += 1 << bit
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of packed sequences.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit
    integers. The pieces of a sequence lie gapless from offset 0.
    """
    packed = shared_table(_pack_partitions(docs, tokenizer_path, window, open_windows))
    whole = packed.where("sequence_id is not null").drop("part", "spot")
    left = packed.where("sequence_id is null")

    # One row per partition: where its leftovers begin when all are laid end to end.
    sums = left.groupBy("part").agg(F.sum("length").alias("n"))
    begin = sums.select("part", F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = packed.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1 << 32
    tail = total - total % window

    laid = left.join(begin, "part").withColumn("at", F.col("begin") + F.col("spot"))
    ends = F.col("at") + F.col("length")
    cells = F.transform(F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + length - 1) div {window}")),
                        lambda k: F.struct((k * window).alias("lo"), ((k + 1) * window).alias("hi")))
    cells = F.filter(cells, lambda c: c["hi"] <= tail)
    if total > tail:
        cells = F.concat(cells, F.array(*(
            F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
            for lo, hi in powers_below(tail, total - tail))))
    cells = F.filter(cells, lambda c: (c["lo"] < ends) & (c["hi"] > F.col("at")))
    merged = (laid.withColumn("cell", F.explode(cells))
              .withColumn("lo", F.greatest("at", "cell.lo"))
              .withColumn("length", F.least(ends, F.col("cell.hi")) - F.col("lo"))
              .select("doc_id", (F.col("start") + F.col("lo") - F.col("at")).alias("start"), "length",
                      F.expr("substring(ids, cast(4 * (lo - at) + 1 as int), cast(4 * length as int))").alias("ids"),
                      "doc_tokens", (F.lit(first) + F.col("cell.lo")).alias("sequence_id"),
                      (F.col("lo") - F.col("cell.lo")).alias("offset")))
    return whole.unionByName(merged)
