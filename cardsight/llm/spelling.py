"""Operator 11: spelling variants grouped by asymmetric q-chunks (DataFrame functions only).

Words are the corpus's letter runs with their counts. Two words are near if one inserted,
deleted or replaced code point turns one into the other. A word's form is its most
frequent near word, if that is at least ``RATIO`` times as frequent; its root is the end
of the chain of forms.

Chunks and grams. The shorter word of a pair (of equal ones either) contributes two
disjoint chunks, its first half and the rest; the other word contributes its positional
grams of the chunks' lengths. One edit lies in one of the two chunks, so the other one
is a gram of the longer word: the first at the same place, the last shifted by the
difference in length, which is nought or one. Grams further off can meet no chunk and are
left out. Words that share a chunk meet in a join, and what is left of the two words is
verified: it has to be one edit apart.

Hot chunks. Words that share a chunk agree outside of what is left, and what is left is
again two short words that are one edit apart. A group of more than ``GROUP_PAIRS``
pairs is therefore not joined but chunked once more by the halves of what is left, with the
shared chunk as part of the key, until its groups are small or one code point is left. Words that
agree in all but one place are few, and near each other.

Only distinct words, their chunks and near pairs are shuffled. Occurrences are counted
within each task first. Roots are found by pointer doubling: a chain's counts at least
double at each step, so there are few rounds.

Defined results: null and empty texts have no words; a null id is written as the empty
text before the colon; repeated rows count each; of near words with equal counts the
smallest in code-point order is taken; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardsight.llm.common import cut, shared_table

# The letters of a run, the divisor that marks a run for a slip, the least length and count of a word.
LETTERS = "[a-zÀ-ÿ]"
SLIP = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2

GROUP_PAIRS = 4096     # pairs of a chunk's group that are compared without a further chunk
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: the runs of all texts, with their slips, of enough code points and occurrences.

    Runs with fewer code points than a word needs cannot become one and are not matched.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        text, F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select("run", h.alias("h")).select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return (words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def _part(text: str, start: Column | int, length: Column) -> Column:
    """``length`` code points from ``start`` (from 0)."""
    at = F.lit(start) if isinstance(start, int) else start
    return F.substring(F.col(text), at + 1, length)


def _chunked(rows: DataFrame) -> DataFrame:
    """Each word's two chunks (key) with what is left of the word without them.

    ``rest`` is what is left so far. ``m`` is the length that the shorter word's rest has in this
    group, and ``d`` how much longer this one is: 0 for the word that gives the chunks and for
    grams of a word as long, 1 for those of a longer word.
    """
    half = F.floor(F.col("m") / 2).cast("int")
    first = F.struct(F.concat("key", F.lit("<"), _part("rest", 0, half)).alias("key"), (F.col("m") - half).alias("m"),
                     _part("rest", half, F.col("m") + F.col("d") - half).alias("rest"))
    last = F.struct(F.concat("key", F.lit(">"), _part("rest", half + F.col("d"), F.col("m") - half)).alias("key"),
                    half.alias("m"), _part("rest", 0, half + F.col("d")).alias("rest"))
    return rows.select("word", "n", "side", "d", F.explode(F.array(first, last)).alias("c")).select(
        "word", "n", "side", "d", "c.key", "c.m", "c.rest")


def _within(rows: DataFrame) -> DataFrame:
    """Pairs (word, other) of each group whose rests are one edit apart."""
    a = rows.where("side = 'chunk'").select("key", F.col("word").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("rx"))
    b = rows.where("side = 'gram'").select("key", F.col("word").alias("y"), F.col("n").alias("ny"), F.col("rest").alias("ry"), "d")
    one = F.levenshtein("rx", "ry", 1) == 1
    return a.join(b, "key").where(((F.col("d") == 1) | (F.col("x") < F.col("y"))) & one).select("x", "nx", "y", "ny")


def near_pairs(words: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """x, nx, y, ny: every pair of near words once, in no fixed direction."""
    length = F.char_length("word").cast("int")
    chunks = words.select("word", "n", F.lit("chunk").alias("side"), F.lit(0).alias("d"), length.alias("m"))
    grams = words.select("word", "n", F.lit("gram").alias("side"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d"),
                         length.alias("length")).select("word", "n", "side", "d", (F.col("length") - F.col("d")).alias("m"))
    # The key of a group starts with the shorter word's length.
    rows = chunks.unionByName(grams).where("m > 0").select(
        "word", "n", "side", "d", F.concat(F.col("m").cast("string"), F.lit("|")).alias("key"), "m", F.col("word").alias("rest"))
    found = None
    while True:
        rows = shared_table(_chunked(rows))
        size = rows.groupBy("key").agg(F.count_if(F.col("side") == "chunk").alias("n_chunks"),
                                       F.count_if(F.col("side") == "gram").alias("n_grams"), F.max("m").alias("m"))
        pairs = F.col("n_chunks") * F.col("n_grams")
        # Where one code point is left, words agree in all others: the group holds near words only.
        hot = cut(size.where((pairs > group_pairs) & (F.col("m") > 1)).select("key"))
        some_hot = hot.limit(1).count() > 0
        small = rows.join(hot, "key", "left_anti") if some_hot else rows
        here = _within(small)
        found = here if found is None else found.unionByName(here)
        if not some_hot:
            # An edit beside an equal code point may lie in either chunk.
            return found.groupBy("x", "y").agg(F.min("nx").alias("nx"), F.min("ny").alias("ny"))
        rows = rows.join(hot, "key", "left_semi")


def with_forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n. ``words`` and ``pairs`` are written tables."""
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("ny").alias("other_n")).unionByName(
        pairs.select(F.col("y").alias("word"), F.col("x").alias("other"), F.col("nx").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(
        (-F.col("other_n")).alias("k"), F.col("other").alias("other"))).alias("best"))
    most = -F.col("best.k")
    taken = most >= F.lit(ratio) * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.other")).alias("form"), F.when(taken, most).cast("long").alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word that has a form: pointers are doubled until all end at a word without one."""
    up = cut(forms.where("form is not null").select("word", F.col("form").alias("to")))
    while True:
        ends = up.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        further = cut(up.join(ends, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"),
                                                         F.col("beyond").isNotNull().alias("moved")))
        if not further.where("moved").limit(1).count():
            return further.select("word", F.col("to").alias("root"))
        up = further.drop("moved")


def variants(docs: DataFrame, ratio: int = RATIO, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """word, n, form, root, n_near, form_n: one row per word of the corpus."""
    words = shared_table(word_counts(docs))
    forms = shared_table(with_forms(words, shared_table(near_pairs(words, group_pairs)), ratio))
    return forms.join(roots(forms), "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
