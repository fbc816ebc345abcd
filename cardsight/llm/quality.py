"""Operator 10: quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements
and one failure bit per rule; policies (named, versioned sets of rules) and
ablations are then bit operations on the ledger, without the texts.

Defined results: a null text has no words; an empty text fails ``min_words``;
repeated rows each get their own (equal) ledger row; null ids stay null; an
empty table gives an empty ledger. Columns other than ``doc_id`` and ``text``
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardsight.llm.common import WORD_GAP, map_batches, texts_of

SYMBOLS = "#*$%&|<>"
STRETCH = 100  # words in which distinct words are counted

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
            "n_upper", "n_alpha", "n_marks")

# Rule -> condition (on the measurements) that a document fails. The position is the bit.
RULES: dict[str, str] = {
    "min_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_words": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "few_distinct_words": "n_words >= 50 and 100 * n_distinct_words < 15 * n_words",
    "shouting": "n_words >= 10 and 2 * n_upper > word_chars",
    "exclamations": "2 * n_marks > n_words and n_words >= 10",
    "few_letters": "100 * n_alpha < 30 * word_chars",
    "word_length": "word_chars > 20 * n_words or word_chars < 2 * n_words",
}

# Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("min_words", "repeated_windows"),
    "web-1": ("min_words", "repeated_windows", "symbol_words", "duplicate_lines"),
    "web-2": ("min_words", "repeated_windows", "symbol_words", "duplicate_lines", "few_distinct_words", "shouting",
              "exclamations", "few_letters"),
}

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F], dtype=np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (two xor-shift-multiply steps)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def repeated_words(words: list[bytes], width: int = 5) -> tuple[int, int]:
    """(words that lie in a ``width``-word window found at least twice, distinct words in stretches).

    Windows are compared by a 64-bit hash of their words' numbers in this text. Distinct words are counted in
    stretches of ``STRETCH`` words, one after another, and summed: their share does not fall with a text's length.
    """
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=len(words))
    stretch = np.arange(len(words), dtype=np.uint64) // np.uint64(STRETCH)
    distinct = len(np.unique(stretch * np.uint64(len(numbers) + 1) + ids)) if len(words) > STRETCH else len(numbers)
    n = len(words) - width + 1
    if n < 2:
        return 0, distinct
    spread = _spread(ids + np.uint64(1))
    key = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        key = _spread(key * _MIX[i % len(_MIX)] + spread[i:i + n])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0, distinct
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum()), distinct


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = text.encode().split()  # bytes split on ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(WORD_GAP)]
    repeat, distinct = repeated_words(words)
    n_upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return (len(words), len(text) - sum(map(text.count, WORD_GAP)), sum(map(text.count, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), repeat, distinct, n_upper, sum(map(str.isalpha, text)), text.count("!"))


def _measured(texts: list[str]) -> list[pa.Array]:
    rows = [measure(t) for t in texts]
    return [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]


def _measure_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *_measured(texts_of(batch))],
                                      names=["doc_id", *MEASURES])


def _measure_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t or "" for t in batch.column("row").field("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("row"), *_measured(texts)], names=["row", *MEASURES])


_MEASURE_SCHEMA = ", ".join(f"{m} long" for m in MEASURES)


def _fail_bits(rules: Mapping[str, str]) -> Column:
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    return sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                for i, cond in enumerate(rules.values())), F.lit(0).cast("long"))


def ledger(docs: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """doc_id, the measurements, and ``fail_bits``: bit i is set when rule i fails."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (map_batches(ids, _measure_batch, f"doc_id long, {_MEASURE_SCHEMA}")
            .withColumn("fail_bits", _fail_bits(rules)))


def mask_of(names, rules: Mapping[str, str] = RULES) -> int:
    """The bit mask of the named rules."""
    place = {name: i for i, name in enumerate(rules)}
    return sum(1 << place[name] for name in set(names))


def fails(policy: str, rules: Mapping[str, str] = RULES) -> Column:
    """True where a ledger row breaks a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy], rules))) != 0


def ablation(led: DataFrame, policy: str, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only this rule rejects.

    Rows are first folded to one per distinct bit pattern, so the shuffle
    carries patterns, not documents.
    """
    mask = mask_of(POLICIES[policy], rules)
    patterns = (led.select(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits"))
                .groupBy("bits").agg(F.count("*").alias("n")))
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(mask_of([name], rules)).cast("long").alias("bit"))
                     for name in POLICIES[policy]))
    return (patterns.select("bits", "n", F.explode(each).alias("r"))
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this")))


def keep_documents(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """The documents that pass the policy, with all their columns.

    Each row travels whole beside its measurements, so nothing is joined:
    repeated rows, null ids and columns named like measurements need no care.
    """
    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    measured = map_batches(docs.select(F.struct("*").alias("row")), _measure_rows,
                           f"row struct<{row}>, {_MEASURE_SCHEMA}")
    return measured.withColumn("fail_bits", _fail_bits(RULES)).where(~fails(policy)).select("row.*")
