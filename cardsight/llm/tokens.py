"""Operator 9: token counts by a two-tier lookup of pre-token lengths.

The tokenizer (a sentencepiece model without text normalisation whose pieces
hold the space mark only at their start) never merges across a space mark that
follows another character, nor across a line feed that no piece holds. A text is
therefore cut into pre-tokens, each counted by itself:

* first tier: a compact table of frequent pre-tokens and their lengths, at most
  ``TABLE_SIZE`` entries, broadcast to the workers;
* second tier: a bounded cache in each worker, filled by encoding misses.

All texts are read once, and no pre-token is shuffled. The table is filled from a
bounded sample: ``SAMPLE_ROWS`` rows of the table, the first ``SAMPLE_CHARS`` characters of each. The sample
decides which pre-tokens the table holds, and so the speed, never the counts.

Defined results: null and empty texts have 0 tokens; repeated rows are counted
each; null ids stay null; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsight.llm.common import in_arrow, texts_of

TABLE_SIZE = 65_536      # entries of the broadcast table (a few MB)
SAMPLE_ROWS = 2_000      # rows from which the table is filled
SAMPLE_CHARS = 4_000     # characters of each of them
CACHE_SIZE = 400_000     # entries of each half of a worker's cache

MARK = "\u2581"          # the model's space mark

# The general cut, behind the model's own first space: a line feed with what
# follows it, spaces with the word after them, or spaces alone.
_PIECES = re.compile("\n[^ \n]*| +[^ \n]+| +")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text. A word behind one space is written without it."""
    if not text:
        return []
    if ("  " not in text and " \n" not in text and "\n " not in text and MARK not in text
            and text[0] not in " \n" and text[-1] != " "):
        return text.replace("\n", " \n").split(" ")
    return [p[1:] if p[0] == " " and len(p) > 1 and p[1] != " " else p
            for p in _PIECES.findall(" " + text.replace(MARK, " "))]


class PieceCounter:
    """Token lengths of pre-tokens for one model; one instance per worker process."""

    _open: dict[str, "PieceCounter"] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) or len(self.model.encode("a  b")) != 3:
            raise ValueError(f"{path}: its pieces cross words, so texts cannot be cut into pre-tokens")
        self.table: dict[str, int] | None = None
        self.young: dict[str, int] = {}  # the table and the newer half of the cache
        self.old: dict[str, int] = {}

    @classmethod
    def at(cls, path: str) -> "PieceCounter":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def lengths(self, pieces: list[str]) -> list[int]:
        """Token counts of pre-tokens.

        The model puts one space mark before whatever it encodes. It stands
        for the (first) space of a pre-token; behind a line feed it is one
        token too many.
        """
        ids = self.model.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [1 if p == " " else len(x) - (p[0] == "\n") for p, x in zip(pieces, ids)]

    def count(self, texts: list[str], table: dict[str, int]) -> list[int]:
        """Token counts of texts: table first, then the cache, then the model for what neither holds."""
        if self.table is not table:
            self.table, self.young = table, dict(table)
        cut = [pre_tokens(t) for t in texts]
        misses = set().union(*cut).difference(self.young)
        if len(self.young) + len(misses) > CACHE_SIZE + len(table):
            self.old, self.young = self.young, dict(table)
            misses = set().union(*cut).difference(self.young)
        known = {p: self.old[p] for p in misses if p in self.old}
        new = [p for p in misses if p not in known]
        self.young.update(known)
        self.young.update(zip(new, self.lengths(new)) if new else ())
        length = self.young.__getitem__
        return [sum(map(length, pieces)) for pieces in cut]


def frequent_pieces(docs: DataFrame, model_path: str, size: int = TABLE_SIZE) -> dict[str, int]:
    """The sample's most frequent pre-tokens with their token lengths, at most ``size``. The sample (8 million characters
    at most) is taken from the first partitions that hold enough rows, and counted here."""
    seen: Counter[str] = Counter()
    for row in docs.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_ROWS).collect():
        seen.update(pre_tokens(row["text"] or ""))
    pieces = [p for p, n in seen.most_common(size) if n > 1]
    return dict(zip(pieces, PieceCounter.at(model_path).lengths(pieces))) if pieces else {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``, one row per row of ``docs``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, model_path, table_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.at(model_path)
        for batch in batches:
            n = counter.count(texts_of(batch), table.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = in_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
