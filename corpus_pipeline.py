"""Corpus pipeline: quality rules, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. Its result is written as Parquet to the shared folder and read again as the
next one's documents. All stages but the last return the columns of documents; the
last returns the pieces of the packed sequences, with their token ids.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsight.llm import mixing, ngram_join, packing, pii, quality
from cardsight.llm.common import read_table, shared_table
from cardsight.llm.queries import MIX_WEIGHTS, PSEUDONYM_KEY, document_levels

QUALITY_POLICY = "web-2"
NEAR_WORDS, NEAR_SHARE = 5, Fraction(80, 100)
MIX_FRACTION = 0.8   # of the tokens that are left


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy."""
    return quality.keep_documents(docs, QUALITY_POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of near-duplicates."""
    return ngram_join.keep_one(docs, NEAR_WORDS, NEAR_SHARE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; ``n_chars`` follows the new text."""
    done = pii.pseudonymize(docs, PSEUDONYM_KEY)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else done


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a mixture near the target weights; no document is repeated."""
    return mixing.mix(docs, document_levels(), MIX_FRACTION, MIX_WEIGHTS, max_epochs=1).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packed", packed),
]

# Not expressible in SQL: the near-duplicate classes are a closure, and the
# pseudonyms, the seeded order and the token ids come from code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
