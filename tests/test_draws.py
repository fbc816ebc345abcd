"""Repeated draws (U2): the same rows as a join of every draw, in tasks of a bounded number of draws."""

from collections import Counter

from pyspark.sql import functions as F

from cardsight.constants import TUNING_SEED
from cardsight.operators import sampling


def _rows(spark, n, minority, groups=1):
    return spark.range(n).select(F.concat(F.lit("t"), "id").alias("trans_num"), F.concat(F.lit("s"), F.col("id") % groups).alias("state"),
                                 (F.col("id") < minority).cast("int").alias("is_fraud"))


def _most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_draws_are_dealt_by_number_not_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(sampling, "DRAWS_IN_TASK", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = _rows(spark, 22_000, 2_000).localCheckpoint()
        grown = sampling.oversample(df, 1.0)
        extra = grown.exceptAll(df)
        assert extra.count() == 18_000
        assert _most_in_a_task(grown.filter("is_fraud = 1")) < 4_000
        by = sampling.rebalance_by(df, "state", 1.0, 1.0)
        assert by.filter("draw > 0").count() == 18_000
        assert _most_in_a_task(by.filter("draw > 0")) < 4_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counted_draws_are_the_draws(spark):
    df = _rows(spark, 500, 40).localCheckpoint()
    m, k = 40, 420
    order = [r[0] for r in df.filter("is_fraud = 1").orderBy(F.xxhash64("trans_num", F.lit(TUNING_SEED), F.lit(0)), "trans_num").select("trans_num").collect()]
    drawn = Counter(order[r[0]] for r in spark.range(k).select(F.pmod(F.xxhash64("id", F.lit(TUNING_SEED), F.lit(1)), F.lit(m))).collect())
    got = Counter(r["trans_num"] for r in sampling.oversample(df, 1.0).filter("is_fraud = 1").collect())
    assert got == drawn + Counter(order)


def test_draws_stay_within_their_group(spark):
    df = _rows(spark, 900, 60, 3).withColumn("state", F.when(F.col("state") != "s0", F.col("state"))).localCheckpoint()
    got = sampling.rebalance_by(df, "state", 1.0, 1.0)
    sizes = {(r["state"], r["is_fraud"]): r["count"] for r in got.groupBy("state", "is_fraud").count().collect()}
    assert sizes == {(s, label): 280 for s in (None, "s1", "s2") for label in (0, 1)}
    draws = got.filter("draw > 0")
    assert draws.select("state", "draw").distinct().count() == draws.count() == 3 * 260
    assert not draws.join(df.withColumnRenamed("state", "_s"), "trans_num").filter("not state <=> _s").count()


def test_one_row_drawn_more_often_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(sampling, "DRAWS_IN_CHUNK", 100)
    df = _rows(spark, 1001, 1).localCheckpoint()
    assert sampling.oversample(df, 1.0).filter("is_fraud = 1").count() == 1000
