"""The registered ``opN_*`` queries: each applies one operator to its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsight.llm import (alignment, mixing, near_vectors, ngram_join, oracle, packing, pii, quality, secrets,
                           sharding, spelling, substrings, tokens, warc)
from cardsight.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The key of the pseudonyms over the test tables; a deployment passes its own secret to the operator.
PSEUDONYM_KEY = b"cardsight-test-tables"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_secret_scan", oracle.OP1)
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; a source is an owner, its texts in one language a repository."""
    return secrets.scan(read_table(spark, sf_dir, "documents"), owner="source",
                        repo=F.concat_ws("/", "source", "lang"))


@register("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids, with a digest of each piece's ids."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@register("op3_ngram_jaccard_join", oracle.OP3)
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents under links of their 3-word shingle sets at 90 of 100."""
    return ngram_join.classes(read_table(spark, sf_dir, "documents"), n=3, threshold=Fraction(90, 100))


@register("op4_suffix_array_dedup", oracle.OP4)
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the 50-byte strings that smaller ids hold."""
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


@register("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal numbers, dates and addresses replaced, and how many of each kind."""
    return pii.pseudonymize(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY, counts=True)


def document_levels() -> dict[str, Column]:
    """The tree over documents: five sources make a domain; then language, then source."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return {"domain": F.concat(F.lit("domain"), F.floor(number / 5).cast("string")), "lang": F.col("lang"),
            "source": F.col("source")}


# Target weights by path; nodes not named here have weight 1.
MIX_WEIGHTS = {("domain0",): 2.0, ("domain1",): 1.0, ("domain0", "en"): 2.0, ("domain1", "en"): 2.0,
               ("domain2", "en"): 2.0, ("domain3", "en"): 2.0}


@register("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to the target weights: 80 % of the corpus's tokens, in at most two epochs."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), document_levels(), 0.8, MIX_WEIGHTS, max_epochs=2)
    return mixed.select("row.doc_id", "domain", "lang", "source", "epoch", "n_tokens")


@register("op7_embedding_near_dedup", oracle.OP7)
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of one label at cosine 0.98."""
    return near_vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


@register("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by the hash tree, and where each goes with a ninth."""
    placed = sharding.place(read_table(spark, sf_dir, "documents"), 8, grown=9)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@register("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the sentencepiece model."""
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op10_quality_rules", oracle.op10(quality.RULES, quality.mask_of(quality.POLICIES["base-1"]),
                                                quality.mask_of(quality.POLICIES["web-2"])))
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdicts of the base rules and of policy web-2."""
    led = quality.ledger(read_table(spark, sf_dir, "documents"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      quality.fails("base-1").alias("base_failed"), (~quality.fails("web-2")).alias("kept"),
                      "fail_bits")


@register("op11_spelling_variants", oracle.OP11)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their near words, forms and roots."""
    return spelling.variants(read_table(spark, sf_dir, "documents"))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the byte-level and the sentencepiece tokens of all documents."""
    return alignment.aligned(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))


@register("op13_warc_archive", oracle.OP13)
def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to a content-addressed archive and read back from it."""
    return warc.read_back(spark, warc.archive(read_table(spark, sf_dir, "pages")))
