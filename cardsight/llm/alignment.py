"""Operator 12: alignment of two tokenizations of the same bytes by diagonal run skipping.

A text is tokenized by a byte-level BPE (A, with a space put before the text) and by a
sentencepiece model (B, which adds that space itself). Both spell the same bytes; the
byte offsets where a token of either ends are the two end arrays. Offsets in both arrays
cut the tokens into groups, and tokens whose bytes overlap are linked.

Run skipping. Where A and B agree token by token, the end arrays are equal at a fixed
shift between their indexes. From the current pair of indexes the stretches
``ea[i:i+w]`` and ``eb[j:j+w]`` are compared with doubled width as long as they are
equal (from ``FIRST_WIDTH`` on); a width that fails is halved until the run's end is known. The whole run becomes
one-to-one groups at once. The group behind it is irregular: both arrays are walked until
they meet again, each step of the walk is a link, and the shift becomes the difference of
the indexes behind the group.

Tokens. Texts are encoded whole. Where the byte-level model's merges are in the order of
their ids, which is checked, its vocabulary is handed to tiktoken, which gives the same ids
several times faster; texts with a stretch of ``LONG_RUN`` characters without or of white space
are left to the slower library, whose time does not grow with the square of the stretch.

Counts. How often an id pair is linked in the corpus is summed up within each task and
then by Spark. Counts go back to the documents in two tiers: the most frequent pairs, at
most ``TABLE_PAIRS``, are broadcast; links of rarer pairs are joined to their counts, and
as they are rare no pair is hot. The bound changes the speed only.

Defined results: texts that are null, empty, or whose joined bytes under A or B are not
those of the text behind a space have no tokens: zeros and an empty digest; repeated rows
are aligned each and count each; null ids stay null; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsight.llm.common import in_arrow, shared_table, text_slices, texts_of

TABLE_PAIRS = 1 << 18    # id pairs in the broadcast table
TASK_PAIRS = 400_000     # id pairs that a task sums up before it passes them on
TASK_LINKS = 1_000_000   # links that a task gathers before it sums them up
WRITTEN = 60_000         # one-to-one groups that a worker keeps in writing

FIRST_WIDTH = 8          # ends that are compared first
LONG_RUN = 4000          # characters

MARK = "▁"

_GAP_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


def byte_decoder() -> dict[str, int]:
    """Byte-level BPE's alphabet: visible bytes stand for themselves, the others for the code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def runs(ea: list[int], eb: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(i, j, length, k, m) along two end arrays that have the same last end: a run of ``length`` one-to-one
    groups from the indexes i and j, and the irregular group behind it, which ends before k and m (empty at the end)."""
    i = j = 0
    n = len(ea)
    out = []
    while i < n:
        at, to, w = i, j, FIRST_WIDTH
        while i + w <= n and ea[i:i + w] == eb[j:j + w]:
            i += w
            j += w
            w *= 2
        while w > 1:
            w //= 2
            if i + w <= n and ea[i:i + w] == eb[j:j + w]:
                i += w
                j += w
        length = i - at
        if i < n:
            x, y = ea[i], eb[j]
            while x != y:
                if x < y:
                    i += 1
                    x = ea[i]
                else:
                    j += 1
                    y = eb[j]
            i += 1
            j += 1
        out.append((at, to, length, i, j))
    return out


def _walked(ea: list[int], eb: list[int], i: int, k: int, j: int, m: int) -> Iterator[tuple[int, int]]:
    """The links of the group of A's tokens i to k and B's tokens j to m: the steps of its walk."""
    while True:
        yield i, j
        if ea[i] < eb[j]:
            i += 1
        elif ea[i] > eb[j]:
            j += 1
        else:
            return


def linked(found: list[tuple[int, int, int, int, int]], ea: list[int], eb: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(A's and B's indexes of all links, how many of them are the runs': these come first, in order)."""
    at, to, length, k, m = np.array(found, dtype=np.int64).T
    i, j = at + length, to + length
    # In a group with one token on one side every token of the other side is linked to it.
    na, nb = k - i, m - j
    simple = (np.minimum(na, nb) == 1)
    many = np.where(simple, np.maximum(na, nb), 0)
    first_a, first_b, counts = np.concatenate([at, i]), np.concatenate([to, j]), np.concatenate([length, many])
    moves_a, moves_b = np.concatenate([length > 0, na > 1]), np.concatenate([length > 0, nb > 1])
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    ia = np.repeat(first_a, counts) + step * np.repeat(moves_a, counts)
    ib = np.repeat(first_b, counts) + step * np.repeat(moves_b, counts)
    others = [x for g in np.flatnonzero((na > 1) & (nb > 1)).tolist()
              for x in _walked(ea, eb, int(i[g]), int(k[g]), int(j[g]), int(m[g]))]
    if others:
        more = np.array(others, dtype=np.int64)
        ia, ib = np.concatenate([ia, more[:, 0]]), np.concatenate([ib, more[:, 1]])
    return ia, ib, int(length.sum())


class Aligner:
    """The two tokenizers with their tokens' bytes; one instance per worker process."""

    _open: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of = byte_decoder()
        a_tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in a_tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.fast = self._fast(json.loads(self.a.to_str()), of)
        self.written = Written()

    def _fast(self, spec: dict, of: dict[str, int]):
        """The byte-level model as tiktoken's, if its merges give ids in ascending order; else nothing."""
        import public_tokenizers
        import tiktoken

        ids = spec["model"]["vocab"]
        merged = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in ids.items() if t not in special and all(c in of for c in t)}
        if not plain or merged != sorted(merged) or len(ranks) != len(merged) + 256:
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def at(cls, byte_path: str, piece_path: str) -> "Aligner":
        key = byte_path, piece_path
        if key not in cls._open:
            cls._open[key] = cls(byte_path, piece_path)
        return cls._open[key]

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        """A's ids of texts."""
        slow = [k for k, t in enumerate(texts) if self.fast is None or len(t) > LONG_RUN and (
            max(map(len, t.split()), default=0) > LONG_RUN or _GAP_RUN.search(t))]
        out = [None if self.fast is None else self.fast.encode_ordinary(t) for t in texts] if not slow else [None] * len(texts)
        if slow:
            left = set(slow)
            for k, e in zip(slow, self.a.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False)):
                out[k] = e.ids
            for k, t in enumerate(texts):
                if k not in left:
                    out[k] = self.fast.encode_ordinary(t)
        return out

    @staticmethod
    def spell(tokens: list[bytes], ids: list[int]) -> bytes:
        return b"".join(map(tokens.__getitem__, ids))

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """A's and B's ids of each text; none where they do not spell the text behind a space."""
        spelled = [" " + t if t else "" for t in texts]
        out = list(zip(self.a_ids(spelled), self.b.encode(texts, num_threads=1)))
        # tiktoken's ids spell their text: every byte is a token, and nothing is normalized.
        return [(a, b) if s and self.spell(self.b_bytes, b) == (whole := s.encode())
                and (self.fast is not None or self.spell(self.a_bytes, a) == whole)
                else ([], []) for s, (a, b) in zip(spelled, out)]

    def align(self, a: list[int], b: list[int]) -> tuple[int, str, np.ndarray]:
        """Number of groups, their digest, and the linked pairs (A's id << 32 | B's id), in no fixed order."""
        if not a:
            return 0, "", np.empty(0, dtype=np.int64)
        aa, bb = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ea, eb = np.cumsum(self.a_sizes[aa]).tolist(), np.cumsum(self.b_sizes[bb]).tolist()
        found = runs(ea, eb)
        ia, ib, n_runs = linked(found, ea, eb)
        pairs = aa[ia] << 32 | bb[ib]
        one_to_one = list(map(self.written.__getitem__, pairs[:n_runs].tolist()))
        groups: list[str] = []
        seen = 0
        for i, j, n, k, m in found:
            if n:
                groups += one_to_one[seen:seen + n]
                seen += n
                i += n
                j += n
            if k - i == 1 and m - j == 2:
                groups.append(f"{a[i]}|{b[j]},{b[j + 1]}")
            elif k - i == 2 and m - j == 1:
                groups.append(f"{a[i]},{a[i + 1]}|{b[j]}")
            elif i < k:
                groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
        return len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs


class Written(dict):
    """One-to-one groups in writing, the first ``WRITTEN`` of them kept."""

    def __missing__(self, pair: int) -> str:
        text = f"{pair >> 32}|{pair & 0xFFFFFFFF}"
        if len(self) < WRITTEN:
            self[pair] = text
        return text


class PairSums:
    """Sums of id pairs, gathered in blocks; what grows beyond the bound is passed on."""

    def __init__(self):
        self.links: list[np.ndarray] = []
        self.gathered = 0
        self.pairs, self.sums = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, pairs: np.ndarray) -> None:
        self.links.append(pairs)
        self.gathered += len(pairs)
        if self.gathered >= TASK_LINKS:
            self.fold()

    def fold(self) -> None:
        pairs, n = np.unique(np.concatenate(self.links), return_counts=True) if self.links else (self.pairs[:0], self.sums[:0])
        both, at = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([self.sums, n]), minlength=len(both))
        self.pairs, self.sums, self.links, self.gathered = both, sums.astype(np.int64), [], 0

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        out = self.pairs, self.sums
        self.__init__()
        return out


_LINKED = ("kind string, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, linked binary, "
           "pair long, n long")


def _linked(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of kind ``doc`` (a document with its linked pairs, as 64-bit numbers) and ``pair`` (a task's sums)."""
    def rows(kind: str, size: int, **columns) -> pa.RecordBatch:
        schema = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
                  "groups_sha256": pa.string(), "linked": pa.binary(), "pair": pa.int64(), "n": pa.int64()}
        arrays = [pa.array([kind] * size, pa.string())]
        for name, t in schema.items():
            got = columns.get(name)
            arrays.append(pa.nulls(size, t) if got is None else got if isinstance(got, pa.Array) else pa.array(got, t))
        return pa.RecordBatch.from_arrays(arrays, names=["kind", *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, sums = Aligner.at(byte_path, piece_path), PairSums()
        for batch in batches:
            for some in text_slices(batch):
                tokens = aligner.tokens(texts_of(some))
                found = [aligner.align(a, b) for a, b in tokens]
                for *_, pairs in found:
                    sums.add(pairs)
                yield rows("doc", some.num_rows, doc_id=some.column("doc_id"), n_a=[len(a) for a, _ in tokens],
                           n_b=[len(b) for _, b in tokens], n_groups=[g for g, *_ in found],
                           groups_sha256=[d for _, d, _ in found], linked=[_packed(p) for *_, p in found])
                if len(sums.pairs) > TASK_PAIRS:
                    pair, n = sums.taken()
                    yield rows("pair", len(pair), pair=pa.array(pair), n=pa.array(n))
        pair, n = sums.taken()
        if len(pair):
            yield rows("pair", len(pair), pair=pa.array(pair), n=pa.array(n))

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _LINKED)


def _packed(pairs: np.ndarray) -> bytes:
    """Pairs as bytes: A's ids, then B's, of 32 bits each. (Ids apart compress better.)"""
    return (pairs >> 32).astype("<u4").tobytes() + pairs.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    ids = np.frombuffer(data, dtype="<u4").astype(np.int64)
    half = len(ids) // 2
    return ids[:half] << 32 | ids[half:]


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n, best: links of each id pair in the corpus, and whether no pair of its B id has more."""
    counts = shared_table(linked.where("kind = 'pair'").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_frequent(counts: DataFrame, table_pairs: int) -> int:
    """The least power of two that at most ``table_pairs`` pairs reach."""
    level = F.floor(F.log2("n")).cast("int")
    by_level = {r["level"]: r["pairs"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()}
    at, seen = 63, 0
    while at >= 0 and seen + by_level.get(at, 0) <= table_pairs:
        seen += by_level.get(at, 0)
        at -= 1
    return 1 << (at + 1)


def _scored(docs: DataFrame, pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> DataFrame:
    """Documents with the sums over the links of frequent pairs, and their other links."""
    table = docs.sparkSession.sparkContext.broadcast((pair, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            keep = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
            sums, bests, links, missed = [], [], [], []
            for data in batch.column("linked"):
                pairs = _unpacked(data.as_buffer())
                at = np.searchsorted(pair, pairs)
                hit = pair[np.minimum(at, len(pair) - 1)] == pairs if len(pair) else np.zeros(len(pairs), dtype=bool)
                sums.append(int(n[at[hit]].sum()))
                bests.append(int(best[at[hit]].sum()))
                links.append(len(pairs))
                missed.append(pairs[~hit])
            ends = np.cumsum([0, *map(len, missed)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x, pa.int64()) for x in (links, bests, sums)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*missed, pair[:0]])))], names=[
                    "row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum", "missed"])

    return in_arrow(docs, run, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
                               "n_links long, n_best long, count_sum long, missed array<long>")


def aligned(docs: DataFrame, byte_path: str, piece_path: str, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    linked = shared_table(_linked(docs, byte_path, piece_path))
    counts = shared_table(pair_counts(linked))
    least = _least_frequent(counts, table_pairs)
    top = counts.where(F.col("n") >= least).toArrow()
    pair = top.column("pair").to_numpy()
    order = np.argsort(pair)
    rows = linked.where("kind = 'doc'").select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b",
                                               "n_groups", "groups_sha256", "linked")
    scored = shared_table(_scored(rows, pair[order], top.column("n").to_numpy()[order],
                                  top.column("best").to_numpy(zero_copy_only=False)[order]))
    rare = (scored.select("row", F.explode("missed").alias("pair")).join(counts.where(F.col("n") < least), "pair")
            .groupBy("row").agg(F.sum("n").alias("more_sum"), F.sum(F.col("best").cast("long")).alias("more_best")))
    return scored.drop("missed").join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
