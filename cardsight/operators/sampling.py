"""Rebalancing and sampling.

Randomness is a seeded hash of the row key, so a sample does not depend on
partitioning or on task retries. Draws never pass through the driver: the
driver sees only class counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardsight.constants import OVERSAMPLE_RATIO, TUNING_SAMPLE_ROWS, TUNING_SEED, UNDERSAMPLE_RATIO
from cardsight.operators.rank import global_row_number

LABEL = "is_fraud"
DRAWS_IN_CHUNK = 100_000  # repeated draws that one row of the plan is expanded to at once
DRAWS_IN_TASK = 200_000   # repeated draws that a task puts in order of their rows, on average


def concat(frames: list[DataFrame]) -> DataFrame:
    """Concatenate chunks by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def class_counts(df: DataFrame, label: str = LABEL) -> dict[int, int]:
    """Rows per class (a handful of numbers)."""
    return {int(r[0]): int(r[1]) for r in df.groupBy(label).count().collect() if r[0] is not None}


def _draw_tasks(k: int) -> int:
    """Partitions for ``k`` draws. Their number is given, as draws are a few bytes each: dealt by bytes, one task
    would get tens of millions of them to sort."""
    return k // DRAWS_IN_TASK + 1


def _hash(key: str, seed: int, salt: int = 0):
    return F.xxhash64(F.col(key), F.lit(seed), F.lit(salt))


def oversample(df: DataFrame, ratio: float = OVERSAMPLE_RATIO, key: str = "trans_num", seed: int = TUNING_SEED,
               label: str = LABEL, counts: dict[int, int] | None = None) -> DataFrame:
    """Random over-sampling with replacement of the minority class until
    it has ``int(ratio * majority)`` rows; originals are kept.

    Minority rows are numbered 0..m-1 in seeded-hash order; ``k`` draws are
    generated with ``range(k)``, hashed to an index and counted by it; each row is
    joined to its count and repeated. Every step is distributed, in tasks of a bounded
    number of draws; ``k`` grows with the data, not the driver."""
    counts = counts or class_counts(df, label)
    (min_cls, m), (_, big) = sorted(counts.items(), key=lambda kv: kv[1])[0], \
        sorted(counts.items(), key=lambda kv: kv[1])[-1]
    k = int(ratio * big) - m
    if k <= 0 or m == 0:
        return df
    minority = df.filter(F.col(label) == min_cls).withColumn("_h", _hash(key, seed))
    numbered = global_row_number(minority, ["_h", key], name="_idx").withColumn("_idx", F.col("_idx") - 1)
    spark = df.sparkSession
    tasks = _draw_tasks(k)
    draws = spark.range(0, k, 1, tasks).select(F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(1)), F.lit(m)).alias("_idx"))
    times = draws.repartition(tasks, "_idx").groupBy("_idx").agg(F.count(F.lit(1)).alias("_n"))
    # A row that is drawn very often is repeated chunk by chunk.
    extra = (numbered.join(times, "_idx")
             .withColumn("_chunk", F.explode(F.expr(f"sequence(0, (_n - 1) div {DRAWS_IN_CHUNK})")))
             .withColumn("_draw", F.explode(F.expr(f"sequence(1, least({DRAWS_IN_CHUNK}, _n - _chunk * {DRAWS_IN_CHUNK}))"))))
    return df.unionByName(extra.select(*df.columns))


def undersample(df: DataFrame, ratio: float = UNDERSAMPLE_RATIO, key: str = "trans_num", seed: int = TUNING_SEED,
                label: str = LABEL, counts: dict[int, int] | None = None) -> DataFrame:
    """Random under-sampling without replacement of the majority class
    to ``int(minority / ratio)`` rows: the first rows in seeded-hash order.
    Rows whose class is null pass through."""
    counts = counts or class_counts(df, label)
    ordered = sorted(counts.items(), key=lambda kv: kv[1])
    (_, m), (maj_cls, big) = ordered[0], ordered[-1]
    keep = int(m / ratio)
    if keep >= big:
        return df
    # The first rows in hash order: a cutoff on the hash lets a little more than ``keep`` rows through, and
    # only those near the cutoff are ranked.
    u = _unit(key, seed, 2)
    share, slack = keep / big, 10.0 * (keep ** 0.5 + 10.0) / big
    majority = df.filter(F.col(label) == maj_cls).withColumn("_u", u)
    sure = majority.filter(F.col("_u") < max(0.0, share - slack))
    near = majority.filter((F.col("_u") >= max(0.0, share - slack)) & (F.col("_u") < share + slack))
    n_sure, n_near = sure.count(), near.count()
    if n_sure > keep or n_sure + n_near < keep:  # a vanishing chance: rank the whole class
        sure, near, n_sure = majority.limit(0), majority, 0
    last = global_row_number(near, ["_u", key], name="_rn").filter(F.col("_rn") <= keep - n_sure).drop("_rn")
    kept = sure.unionByName(last.select(*sure.columns)).drop("_u")
    return df.filter(~F.col(label).eqNullSafe(F.lit(maj_cls))).unionByName(kept.select(*df.columns))


def rebalance(df: DataFrame, over: float = OVERSAMPLE_RATIO, under: float = UNDERSAMPLE_RATIO,
              key: str = "trans_num", seed: int = TUNING_SEED, label: str = LABEL) -> DataFrame:
    """U2 then U3. With counts M (majority) and m: the minority grows to
    int(over * M), then the majority shrinks to int(that / under). The
    transaction's state travels with its row."""
    counts = class_counts(df, label)
    big_cls = max(counts, key=counts.get)
    small_cls = min(counts, key=counts.get)
    grown = oversample(df, over, key, seed, label, counts)
    after = {small_cls: max(int(over * counts[big_cls]), counts[small_cls]), big_cls: counts[big_cls]}
    return undersample(grown, under, key, seed, label, after)


def _plans(df: DataFrame, by: str, over: float, under: float, label: str) -> DataFrame:
    """Per group: its minority class (small_cls) with m rows, and how many rows of either class U2 and U3 leave."""
    y = F.col(label)
    counts = df.groupBy(F.col(by).alias("_g")).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("q"))
    m, big = F.least("p", "q"), F.greatest("p", "q")
    grown = F.when(m == 0, m).otherwise(F.greatest(F.floor(F.lit(float(over)) * big), m))
    left = F.when(m == 0, big).otherwise(F.least(big, F.floor(grown / F.lit(float(under)))))
    return counts.select("_g", F.when(F.col("p") <= F.col("q"), 1).otherwise(0).alias("small_cls"), m.alias("m"),
                         grown.cast("long").alias("grown"), left.cast("long").alias("kept"), big.alias("big"))


def rebalance_by(df: DataFrame, by: str = "state", over: float = OVERSAMPLE_RATIO, under: float = UNDERSAMPLE_RATIO,
                 key: str = "trans_num", seed: int = TUNING_SEED, label: str = LABEL) -> DataFrame:
    """U2 then U3 within every group, with ``draw`` (0 for a row itself, from 1 on for repeated draws of it).

    In a group with M and m rows of its classes the minority grows to int(over * M) by
    draws with replacement, then the majority shrinks to int(that / under); groups with one class
    stay as they are. A group may hold any share of the rows: draws are made and joined
    by (group, index), and of the majority only rows near the hash cutoff are ranked."""
    plans = _plans(df, by, over, under, label).checkpoint(eager=True)
    rows = df.join(plans, df[by].eqNullSafe(plans["_g"])).withColumn("draw", F.lit(0).cast("long"))
    small = rows.filter(F.col(label) == F.col("small_cls"))
    big = rows.filter(F.col(label) != F.col("small_cls"))
    order = [F.col(by).asc_nulls_first(), F.xxhash64(key, F.lit(seed)), F.col(key)]
    numbered = global_row_number(small.filter("grown > m"), order, name="_rn")
    first = numbered.groupBy(F.col(by).alias("_fg")).agg(F.min("_rn").alias("_first"))
    # Draws: chunks of numbers first, so that no task makes all draws of a large group.
    more = plans.filter("grown > m").select("_g", "m", (F.col("grown") - F.col("m")).alias("k"))
    tasks = _draw_tasks(int(more.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]))
    chunks = (more.join(first, more["_g"].eqNullSafe(first["_fg"]))
              .withColumn("chunk", F.explode(F.expr(f"sequence(0, (k - 1) div {DRAWS_IN_CHUNK})"))))
    # A draw names the row by its number among all rows: the group's first and the index within the group.
    draws = (chunks.repartition("_g", "chunk").withColumn("_draw", F.explode(F.expr(
        f"sequence(chunk * {DRAWS_IN_CHUNK} + 1, least((chunk + 1) * {DRAWS_IN_CHUNK}, k))")))
        .select((F.col("_first") + F.pmod(F.xxhash64("_g", "_draw", F.lit(seed)), F.col("m"))).alias("_rn"), "_draw"))
    extra = numbered.join(draws.repartition(tasks, "_rn"), "_rn").withColumn("draw", F.col("_draw"))
    columns = [*df.columns, "draw"]
    return concat([small.select(*columns), extra.select(*columns),
                   _first_by_hash(big, by, F.col("kept"), F.col("big"), key, seed).select(*columns)])


def _first_by_hash(rows: DataFrame, by: str, keep: Column, size: Column, key: str, seed: int) -> DataFrame:
    """The first ``keep`` of each group's ``size`` rows in seeded-hash order."""
    slack = 1.0
    while True:
        gap = F.lit(10.0 * slack) * (F.sqrt(keep.cast("double")) + 10.0) / size
        share = keep / size
        placed = rows.withColumn("_u", _unit(key, seed, 2)).withColumn("_part", F.when((keep >= size) | (
            F.col("_u") < share - gap), 0).when(F.col("_u") < share + gap, 1).otherwise(2)).filter("_part < 2")
        seen = placed.groupBy(F.col(by).alias("_sg")).agg(
            F.count_if(F.col("_part") == 0).alias("_sure"), F.count(F.lit(1)).alias("_seen"), F.max(keep).alias("_keep"),
            F.max(size).alias("_size")).checkpoint(eager=True)
        if not seen.filter("_keep < _size and (_sure > _keep or _seen < _keep)").limit(1).count():
            break
        slack *= 4.0  # a vanishing chance: look further around the cutoff
    near = placed.filter("_part = 1")
    near = near.join(seen.select("_sg", "_sure"), near[by].eqNullSafe(seen["_sg"])).drop("_sg")
    w = Window.partitionBy(by).orderBy("_u", key)
    last = near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep - F.col("_sure"))
    return placed.filter("_part = 0").unionByName(last.drop("_rn", "_sure"))


def _unit(key: str, seed: int, salt: int):
    """A seeded hash of the key mapped monotonically to [0, 1)."""
    return (_hash(key, seed, salt).cast("double") + F.lit(9.223372036854776e18)) / F.lit(1.8446744073709552e19)


def per_group_sample(df: DataFrame, group: str = "state", n: int = TUNING_SAMPLE_ROWS, key: str = "trans_num",
                     seed: int = TUNING_SEED) -> DataFrame:
    """U4: the first ``n`` rows of every group in seeded-hash order (all rows
    of smaller groups).

    A plain ``row_number()`` window per group would sort a hot group in one
    task. Instead: per-group counts (one row per group) give each group a
    cutoff on the uniform hash so that about ``n + 10 sqrt(n) + 100`` rows
    pass; only those candidates are ranked, so every window task holds about
    ``n`` rows whatever the group size. A group with too few candidates (a
    vanishing chance) is retried with a wider cutoff, so the result is
    exact."""
    u = _unit(key, seed, 3)
    counts = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_g_n"))
    want = float(n) + 10.0 * float(n) ** 0.5 + 100.0
    base = df.withColumn("_u", u)
    widen = 1.0
    while True:
        cut = counts.withColumn("_cut", F.least(F.lit(1.0), F.lit(want * widen) / F.col("_g_n")))
        # Rows without a group are a group of their own; a cutoff of 1 takes every row.
        cand = (base.join(cut, base[group].eqNullSafe(cut["_g"]))
                .filter((F.col("_cut") >= 1.0) | (F.col("_u") < F.col("_cut"))).drop("_g"))
        got = cand.groupBy(F.col(group).alias("_got")).agg(F.count(F.lit(1)).alias("_c"))
        short = (counts.join(got, counts["_g"].eqNullSafe(got["_got"]), "left")
                 .filter(F.coalesce("_c", F.lit(0)) < F.least(F.col("_g_n"), F.lit(n))).limit(1).take(1))
        if not short:
            break
        widen *= 4.0
    w = Window.partitionBy(group).orderBy("_u", key)
    return (cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
            .drop("_rn", "_u", "_cut", "_g_n"))


def with_folds(df: DataFrame, k: int, key: str = "trans_num", seed: int = TUNING_SEED,
               name: str = "fold") -> DataFrame:
    """Fold number in [0, k) from a seeded hash (MD5) of the key."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8)
    return df.withColumn(name, (F.conv(digits, 16, 10).cast("long") % F.lit(k)).cast("int"))
