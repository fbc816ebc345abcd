"""Invariants of the scalable operators against straightforward versions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cardsight.operators import cases as cmd
from cardsight.operators import evaluate as ev
from cardsight.operators import rank
from cardsight.operators import reports as rep
from cardsight.operators import sampling
from cardsight.plans.common import txn
from cardsight.sources import tables

from testdata_paths import SF_SMALL


def test_global_row_number_matches_window(spark):
    t = txn(spark, SF_SMALL).select("trans_num", "amt")
    mine = rank.global_row_number(t, ["amt", "trans_num"], name="rn", num_partitions=5)
    ref = t.withColumn("rn2", F.row_number().over(Window.orderBy("amt", "trans_num")))
    j = mine.join(ref, ["trans_num", "amt"])
    assert j.count() == t.count()
    assert j.filter(F.col("rn") != F.col("rn2")).count() == 0


def test_running_sums_match_window(spark):
    t = ev.score_counts(txn(spark, SF_SMALL))
    mine = rank.global_running_sums(t, [F.desc("score")], ["pos"], num_partitions=4)
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ref = t.withColumn("ref", F.sum("pos").over(w))
    assert mine.join(ref, "score").filter(F.col("pos_cum") != F.col("ref")).count() == 0


def test_running_sums_by_group_match_window(spark):
    t = ev.score_counts(txn(spark, SF_SMALL), by=["state"])
    mine = rank.running_sums_by(t, "state", [F.desc("score")], ["neg"], num_partitions=3)
    w = Window.partitionBy("state").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ref = t.withColumn("ref", F.sum("neg").over(w))
    assert mine.join(ref, ["state", "score"]).filter(F.col("neg_cum") != F.col("ref")).count() == 0


def test_decile_sizes_differ_by_at_most_one(spark):
    d = rep.deciles(txn(spark, SF_SMALL), "amt")
    sizes = [r.n_cases for r in d.collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


def test_auroc_and_ap_in_unit_interval(spark):
    t = txn(spark, SF_SMALL)
    a = ev.auroc(t).first().auroc
    p = ev.average_precision(t).first().average_precision
    assert 0.0 <= a <= 1.0 and 0.0 <= p <= 1.0


def test_rollback_keeps_buckets_consistent(spark):
    t = txn(spark, SF_SMALL)
    c = tables.cases_view(t)
    out = cmd.apply_decisions(tables.bucket_tables(t), c.drop("cc_num"), tables.decisions_view(c))
    assert cmd.consistency_violations(out).count() == 0
    assert out["unmatched"].count() == 0
    rolled = tables.decisions_view(c).filter("verdict = 'not_fraud'").count()
    assert out["fraud"].count() == tables.bucket(t, "fraud").count() - \
        tables.decisions_view(c).filter("verdict = 'not_fraud'").join(
            tables.bucket(t, "fraud").select(F.col("trans_num").alias("txn_id")), "txn_id", "left_semi").count()
    assert rolled >= 0


def test_rebalance_counts(spark):
    t = txn(spark, SF_SMALL)
    counts = sampling.class_counts(t)
    big = max(counts.values())
    bal = sampling.class_counts(sampling.rebalance(t, 0.5, 1.0))
    assert bal[0] == bal[1] == int(0.5 * big)


def test_case_ids_are_dense(spark):
    c = tables.cases_view(txn(spark, SF_SMALL))
    n = c.count()
    r = c.agg(F.min("case_id").alias("lo"), F.max("case_id").alias("hi"),
              F.count_distinct("case_id").alias("d")).first()
    assert (r.lo, r.hi, r.d) == (1, n, n)


def test_per_group_sample_equals_brute_force_window(spark):
    t = txn(spark, SF_SMALL).select("trans_num", "state")
    n = 7
    mine = sampling.per_group_sample(t, "state", n).select("trans_num")
    w = Window.partitionBy("state").orderBy(sampling._unit("trans_num", 42, 3), "trans_num")
    ref = t.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("trans_num")
    assert mine.count() == ref.count()
    assert mine.exceptAll(ref).count() == 0 and ref.exceptAll(mine).count() == 0


def test_latest_decision_aggregation_matches_window(spark):
    rows = [("a", "investigating", "status", 1), ("a", "closed", "confirm", 3), ("b", "closed", "not_fraud", 2),
            ("b", "open", "status", 2), ("c", "closed", "confirm", 5)]
    d = spark.createDataFrame(rows, "txn_id string, status string, verdict string, t int") \
             .withColumn("decided_at", F.timestamp_seconds(F.col("t")).cast("timestamp_ntz")).drop("t")
    got = {r.txn_id: (r.status, r.verdict) for r in cmd.latest_decisions(d).collect()}
    assert got == {"a": ("closed", "confirm"), "b": ("closed", "not_fraud"), "c": ("closed", "confirm")}
