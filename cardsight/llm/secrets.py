"""Operator 1: secret scan with corpus-wide ownership frequency (DataFrame functions only).

Base spans come from three patterns (assignments, access keys, hex runs). A
wider pattern proposes further candidates: long mixed runs that no base span
covers. Every candidate's value is hashed, and the hashes are counted by
distinct repositories and owners over the whole corpus. A value that
``OWNERS_OF_EXAMPLE`` owners or more hold is an example that was copied around; one that
fewer hold looks live. Base spans are always reported, with their verdict; a wider
candidate is reported (kind ``owned``) only when it looks live.

Positions are code points, ends exclusive: a match starts where the text
before it ends, so starts are sums of the lengths of the split text and of the
matches. Only spans and hashes are shuffled, never texts; counting is
pre-aggregated per (hash, owner, repository), so a value found in a third of
all rows is one row per task, and the join back to the spans lets AQE split it.
Positions are running sums over a text's gaps and matches, taken by a window over the
text's matches: the work grows with their number (times its logarithm), not its square.

Defined results: null and empty texts have no spans (the digest of the empty
string); null owners and repositories count as one owner or repository of
their own; repeated rows are reported each and count once per owner; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardsight.llm.common import cut

# The base patterns, each with the group that holds the value and the least length of that group.
ASSIGN = ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12)
ACCESS = ("AKIA[A-Z0-9]+", 0, 18)
HEX = ("[0-9a-f]+", 0, 16)
KINDS = ("assign", "access", "hex", "owned")

# A run of lower and upper case letters and digits, as keys in base 62 or 64 are.
WIDE = ("[A-Za-z0-9+/_=-]{20,}", 0, 20)

OWNERS_OF_EXAMPLE = 3   # a value held by as many owners is an example

_PARTS = "array<struct<kind:int,i:int,gap:int,size:int,least:int,hash:string,mixed:boolean>>"


def _parts(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """The pattern's non-overlapping matches, in order: the gap before each, its size, its value's length and hash.

    From here on no secret is carried in the clear."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("size"), values.alias("value"))
    return F.transform(zipped, lambda p, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), p["gap"].alias("gap"), p["size"].alias("size"),
        F.length(p["value"]).alias("least"), F.sha2(p["value"], 256).alias("hash"), _mixed(p["value"]).alias("mixed"))).cast(_PARTS)


def _guarded(text: Column, guard: Column, parts: Column) -> Column:
    """Matches, worked out only where a cheap test lets them be."""
    return F.when(guard, parts).otherwise(F.array().cast(_PARTS))


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def matches(docs: DataFrame, owner: str | Column = "source", repo: str | Column = "source") -> DataFrame:
    """row, doc_id, owner, repo and parts (the matches of all patterns) of every row; written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (F.col(owner) if isinstance(owner, str) else owner).cast("string").alias("owner"),
                        (F.col(repo) if isinstance(repo, str) else repo).cast("string").alias("repo"), text.alias("text"))
    t = F.col("text")
    return cut(named.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", F.concat(
            _guarded(t, t.rlike(ASSIGN[0]), _parts(t, *ASSIGN, 0)),
            _guarded(t, t.contains("AKIA"), _parts(t, *ACCESS, 1)),
            # A shorter run is dropped anyway, so only runs that are long enough are matched.
            _guarded(t, t.rlike("[0-9a-f]{16}"), _parts(t, "[0-9a-f]{16,}", 0, HEX[2], 2)),
            _guarded(t, t.rlike(WIDE[0]), _parts(t, *WIDE, 3))).alias("parts")))


def spans(found: DataFrame) -> DataFrame:
    """row, owner, repo, kind, start, end, hash of the spans: values that are long enough, and of the
    wider pattern's those that are mixed and that no base span touches."""
    each = found.where(F.size("parts") > 0).select("row", "owner", "repo", F.explode("parts").alias("p")).select(
        "row", "owner", "repo", "p.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    least = F.element_at(F.array(*(F.lit(x[2]) for x in (ASSIGN, ACCESS, HEX, WIDE))), F.col("kind") + 1)
    placed = placed.where((F.col("least") >= least) & ((F.col("kind") < 3) | F.col("mixed"))).select(
        "row", "owner", "repo", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "hash")
    base = F.col("kind") < 3
    by_start = Window.partitionBy("row").orderBy("start")
    # A base span touches a wider one if it starts no later and ends behind its start, or starts inside it.
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    # Taken from the end, as frames that are open to the end cost the square of their rows.
    following = F.min(F.when(base, F.col("start"))).over(
        Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1))
    touched = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    return placed.withColumn("touched", touched).where(base | ~F.col("touched")).drop("touched")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_found, n_repos, n_owners over the spans of the whole corpus."""
    return (found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
            .groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
            .groupBy("hash").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"),
                                 F.count("*").alias("n_owners")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: str | Column = "source", repo: str | Column = "source") -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base spans, all spans, and the verdicts' counts."""
    rows = matches(docs, owner, repo)
    found = cut(spans(rows))
    counts = cut(ownership(found))
    place, base = F.struct("start", "kind", "end"), F.col("kind") < 3
    live = F.col("n_owners") < OWNERS_OF_EXAMPLE
    each = [F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(3)]
    judged = found.join(counts, "hash").groupBy("row").agg(
        *each, F.sort_array(F.collect_list(F.when(base, place))).alias("base"),
        F.sort_array(F.collect_list(F.when(base | live, place))).alias("all"),
        F.count_if(~live).alias("n_example"), F.count_if(live).alias("n_live"))
    numbers = [*(f"n_{k}" for k in KINDS[:3]), "n_example", "n_live"]
    judged = judged.select("row", *numbers, _written(F.col("base")).alias("base"), _written(F.col("all")).alias("spans"))
    out = rows.select("row", "doc_id").join(judged, "row", "left")
    return out.select("doc_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers[:3]),
                      F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"),
                      *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers[3:]))
