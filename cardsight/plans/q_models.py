"""Sampling, per-state models and their ensemble (U1-U5, M2-M6, A18, A19). Model queries are random or iterative: checked by rows and by
invariants in the tests; their deterministic parts have oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardsight.constants import TUNING_SEED
from cardsight.operators import features as fe
from cardsight.operators import models as ml
from cardsight.operators import sampling
from cardsight.plans.catalog import register
from cardsight.plans.common import r6, txn
from cardsight.plans.oracle_views import with_txn
from cardsight.sources import files, tables

SPLIT = "2000-01-01 00:00:00"
_MEMO: dict = {}


def _split_text(spark, sf_dir):
    """Raw text feed split into training (before 2000) and held-out rows;
    the split flag is computed from the source time before it becomes text. The feed is written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "feed")
    if key not in _MEMO:
        # Feature building and scoring cost much more than a row's bytes tell: rows are dealt out evenly, over all cores,
        # while they are still keys and numbers.
        tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        base = txn(spark, sf_dir, tasks).withColumn("_train", F.col("trans_ts") < F.lit(SPLIT).cast("timestamp_ntz"))
        _MEMO[key] = files.written(tables.txn_text_view(base, spoil_mod=50), "feed")
    raw = _MEMO[key]
    return raw.filter("_train").drop("_train"), raw.filter(~F.col("_train")).drop("_train")


def trained(spark, sf_dir):
    """Feature model, training table, ensemble and held-out features: the training split's rows are
    rebalanced and written by state, state forests fitted (round 1), entered in a registry and loaded from
    it. Kept for the session: the driver holds paths of models, neither models nor data."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MEMO:
        train_raw, test_raw = _split_text(spark, sf_dir)
        fm, train = fe.fit_transform(train_raw, stored=True)
        table = ml.write_training_table(train, files.scratch_path(spark, "training"))
        test = fe.transform(test_raw, fm, stored=True)
        test = files.written(test, "held-out", fe.vector_schema(test.schema))
        registry = files.scratch_path(spark, "registry")
        fitted = ml.train_state_models(table, parallelism=8, registry=registry)
        ml.register_models(spark, fitted, registry)
        skipped = [m for m in fitted if not m.trained]
        _MEMO[key] = (fm, table, ml.load_ensemble(spark, registry) + skipped, test, registry)
    return _MEMO[key]


def boosted(spark, sf_dir):
    """Boosted trees per state on the same training table (round 2), in the same registry; every round loaded."""
    key = (spark.sparkContext.applicationId, sf_dir, "boosted")
    if key not in _MEMO:
        _, table, _, _, registry = trained(spark, sf_dir)
        fitted = ml.train_state_models(table, kind="boosted", parallelism=8, round=2, registry=registry)
        ml.register_models(spark, fitted, registry)
        _MEMO[key] = (fitted, ml.load_ensemble(spark, registry, "all"))
    return _MEMO[key]


# ---------------------------------------------------------------- U2-U5

REBALANCE_SQL = """
, c AS (SELECT count(*) FILTER (WHERE is_fraud = 0) AS big, count(*) FILTER (WHERE is_fraud = 1) AS small FROM txn),
g AS (SELECT greatest(CAST(floor({over} * big) AS BIGINT), small) AS grown, big FROM c)
SELECT 1 AS is_fraud, grown AS n FROM g
UNION ALL SELECT 0, least(big, CAST(floor(grown / {under}) AS BIGINT)) FROM g"""


@register("u02_u03_rebalance_counts", with_txn(REBALANCE_SQL.format(over=0.5, under=1.0)))
def u02_u03_rebalance_counts(spark, sf_dir):
    """U2 (to 0.5) then U3 (to 1.0): both classes end at int(0.5 * majority)."""
    bal = sampling.rebalance(txn(spark, sf_dir), 0.5, 1.0)
    return bal.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"))


@register("u02_oversample_full", with_txn(REBALANCE_SQL.format(over=1.0, under=1.0)))
def u02_oversample_full(spark, sf_dir):
    """U2 to 1.0 then U3 to 1.0 (the second step changes nothing)."""
    bal = sampling.rebalance(txn(spark, sf_dir), 1.0, 1.0)
    return bal.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"))


@register("u02_oversampled_are_minority", with_txn("""
SELECT count(*) FILTER (WHERE is_fraud = 1) AS n_fraud_rows, count(*) FILTER (WHERE is_fraud = 0) AS n_other
FROM txn WHERE is_fraud = 1"""))
def u02_oversampled_are_minority(spark, sf_dir):
    """Every drawn row is an existing minority row: distinct ids of the
    over-sampled minority equal the original minority."""
    bal = sampling.oversample(txn(spark, sf_dir), 1.0)
    ids = bal.filter(F.col("is_fraud") == 1).select("trans_num", "is_fraud").dropDuplicates(["trans_num"])
    return ids.agg(F.count_if(F.col("is_fraud") == 1).alias("n_fraud_rows"),
                   F.count_if(F.col("is_fraud") == 0).alias("n_other"))


@register("u04_tuning_sample_counts", with_txn("""
SELECT state, least(count(*), 10000) AS n FROM txn GROUP BY state"""))
def u04_tuning_sample_counts(spark, sf_dir):
    """U4: at most 10,000 rows per state (seeded)."""
    s = sampling.per_group_sample(txn(spark, sf_dir), "state", 10000)
    return s.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# Rows and positives of each state's training rows after U2 (0.5) and U3 (1.0) within the state.
BALANCED_SQL = """
, c AS (SELECT state, count(*) FILTER (WHERE is_fraud = 1) AS p, count(*) FILTER (WHERE is_fraud = 0) AS q FROM txn
        WHERE trans_ts < TIMESTAMP '2000-01-01 00:00:00' AND CAST(split_part(trans_num, '-', 1) AS BIGINT) % 50 <> 0
        GROUP BY state),
g AS (SELECT *, least(p, q) AS small, greatest(p, q) AS big,
             CASE WHEN least(p, q) = 0 THEN 0 ELSE greatest(CAST(floor(0.5 * greatest(p, q)) AS BIGINT), least(p, q)) END AS grown
      FROM c),
b AS (SELECT state, small, p <= q AS pos_small, grown, CASE WHEN small = 0 THEN big ELSE least(big, grown) END AS kept FROM g),
balanced AS (SELECT state, grown + kept AS n_rows, CASE WHEN pos_small THEN grown ELSE kept END AS n_pos, small > 0 AS trained
             FROM b)"""


@register("a18_ensemble_weights", with_txn(BALANCED_SQL + """
SELECT state, round(n_rows / sum(n_rows) OVER (), 6) AS weight FROM balanced WHERE trained"""))
def a18_ensemble_weights(spark, sf_dir):
    """Ensemble weight of each trained state model = its
    training rows over all trained models' rows."""
    models = trained(spark, sf_dir)[2]
    w = ml.state_row_weights(models)
    return spark.createDataFrame(sorted(w.items()), "state string, weight double").select(
        "state", r6(F.col("weight")).alias("weight"))


@register("u05_fold_sizes", with_txn(f"""
SELECT CAST(CAST('0x' || substr(md5(trans_num || ':{TUNING_SEED}'), 1, 8) AS BIGINT) % 5 AS INT) AS fold, count(*) AS n
FROM txn GROUP BY 1"""))
def u05_fold_sizes(spark, sf_dir):
    """Fold column from a seeded hash; rows per fold."""
    return sampling.with_folds(txn(spark, sf_dir), 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- M2-M7, A19

@register("m06_majority_baseline", with_txn("""
SELECT majority, round(n / total, 6) AS accuracy FROM (
  SELECT is_fraud AS majority, count(*) AS n, sum(count(*)) OVER () AS total FROM txn GROUP BY is_fraud)
ORDER BY n DESC, majority LIMIT 1"""))
def m06_majority_baseline(spark, sf_dir):
    out = ml.majority_baseline(txn(spark, sf_dir))
    return out.select("majority", r6(F.col("accuracy")).alias("accuracy"))


def _state_table(spark, models):
    return spark.createDataFrame([(m.state, m.n_rows, m.n_pos, m.trained) for m in models],
                                 "state string, n_rows long, n_pos long, trained boolean")


@register("m02_state_models", with_txn(BALANCED_SQL + "SELECT state, n_rows, n_pos, trained FROM balanced"))
def m02_state_models(spark, sf_dir):
    """M2: one balanced forest per state on its (at most 10,000-row) sample of the
    rebalanced rows; one-class states skipped."""
    return _state_table(spark, trained(spark, sf_dir)[2])


@register("m02_boosted_models", with_txn(BALANCED_SQL + "SELECT state, n_rows, n_pos, trained FROM balanced"))
def m02_boosted_models(spark, sf_dir):
    """M2: boosted trees per state, positives weighted by neg / pos, on the same rows."""
    return _state_table(spark, boosted(spark, sf_dir)[0])


@register("m04_ensemble_scores")
def m04_ensemble_scores(spark, sf_dir):
    """M4 + A18 + P8 on the held-out rows: weighted sum of the last round's state models'
    fraud probabilities, decision at 0.64. The models come from the registry."""
    _, _, models, test, _ = trained(spark, sf_dir)
    scored = ml.decide(ml.ensemble_scores(test, models))
    return scored.select("trans_num", "state", "is_fraud", "probability", "pred")


HELD_OUT_SQL = """
FROM txn WHERE trans_ts >= TIMESTAMP '2000-01-01 00:00:00' AND CAST(split_part(trans_num, '-', 1) AS BIGINT) % 50 <> 0"""


SIZES_SQL = f"""{HELD_OUT_SQL}),
t AS (SELECT count(*) AS n_models FROM balanced WHERE trained)"""

_SCORE_CHECKS = ", 0 AS n_without_score, 0 AS n_outside, 1.0 AS weight_sum"


def _score_checks(scored, models):
    p = F.col("probability")
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(p.isNull()).cast("int").alias("n_without_score"),
                      F.count_if((p < -1e-9) | (p > 1 + 1e-9)).cast("int").alias("n_outside")).select(
        "n_rows", F.lit(sum(m.trained for m in models)).cast("long").alias("n_models"), "n_without_score", "n_outside",
        r6(F.lit(sum(ml.row_weights(models)))).alias("weight_sum"))


@register("m04_last_round", with_txn(BALANCED_SQL + f"""
, h AS (SELECT count(*) AS n_rows {SIZES_SQL}
SELECT n_rows, n_models {_SCORE_CHECKS} FROM h, t"""))
def m04_last_round(spark, sf_dir):
    """M4, last round only: rows scored, models, scores that are missing or outside [0, 1], and the sum of weights."""
    _, _, models, test, _ = trained(spark, sf_dir)
    return _score_checks(ml.ensemble_scores(test, models), models)


@register("m04_every_round", with_txn(BALANCED_SQL + f"""
, h AS (SELECT count(*) AS n_rows {SIZES_SQL}
SELECT n_rows, 2 * n_models AS n_models {_SCORE_CHECKS} FROM h, t"""))
def m04_every_round(spark, sf_dir):
    """M4, every round (forests and boosted trees), each model weighted by its state's rows; checked as the last round."""
    models = boosted(spark, sf_dir)[1]
    return _score_checks(ml.ensemble_scores(trained(spark, sf_dir)[3], models), models)


def _saved(spark, sf_dir):
    """The trained feature model, written and read back, and the state models."""
    fm, _, models, test, _ = trained(spark, sf_dir)
    path = files.scratch_path(spark, "features")
    fe.save_features(fm, path)
    return fe.load_features(spark, path), models, test


def _detected(spark, sf_dir):
    """Per-row decisions on the raw held-out feed with the reloaded feature model."""
    fm, models, _ = _saved(spark, sf_dir)
    _, test_raw = _split_text(spark, sf_dir)
    expected = ["trans_num", "state", "features", "is_fraud"]
    feats = fe.align(fe.transform(test_raw, fm, reuse_votes=True, stored=True), expected)
    return ml.decide(ml.ensemble_scores(feats, models))


@register("m05_batch_detect", with_txn(f"""
SELECT state, count(*) AS n_rows, count(*) FILTER (WHERE is_fraud = 1) AS n_fraud, count(*) AS n_decided
{HELD_OUT_SQL} GROUP BY state"""))
def m05_batch_detect(spark, sf_dir):
    """M5: raw text batch -> features (model saved and loaded) -> state risk ->
    alignment -> ensemble -> decision; rows, frauds and decisions per state."""
    return _detected(spark, sf_dir).groupBy("state").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("is_fraud") == 1).alias("n_fraud"),
        F.count_if(F.col("pred").isin(0, 1)).alias("n_decided"))


@register("m05_evaluation", with_txn(f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_fraud = 1) AS n_fraud,
       count(*) FILTER (WHERE is_fraud = 0) AS n_clean, true AS best_beats_default {HELD_OUT_SQL}"""))
def m05_evaluation(spark, sf_dir):
    """The ensemble judged at its F1-best threshold (A24): the confusion
    counts add up to the held-out rows, and its F1 is not below the default
    threshold's."""
    from cardsight.operators import evaluate as ev
    _, models, test = _saved(spark, sf_dir)
    scored = ml.ensemble_scores(test, models).checkpoint(eager=True)
    best = ev.best_threshold(scored, score="probability").first()
    at_best = ev.confusion_counts(ml.decide(scored, threshold=best["threshold"]))
    default = ev.threshold_metrics(ml.decide(scored)).first()["f1"]
    return at_best.select(
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_rows"), (F.col("tp") + F.col("fn")).alias("n_fraud"),
        (F.col("tn") + F.col("fp")).alias("n_clean"), F.lit(best["f1"] >= default - 1e-6).alias("best_beats_default"))


@register("m01_reloaded_features", with_txn(f"""
SELECT count(*) AS n_rows, 0 AS n_different {HELD_OUT_SQL}"""))
def m01_reloaded_features(spark, sf_dir):
    """The reloaded feature model gives the same features, row by row."""
    from pyspark.ml.functions import vector_to_array
    fm, _, test = _saved(spark, sf_dir)
    _, test_raw = _split_text(spark, sf_dir)

    def hashed(df, name):
        values = F.transform(vector_to_array("features"), lambda v: F.round(v, 9))
        return df.groupBy(F.xxhash64("trans_num", "state", "is_fraud", values).alias("h")).agg(F.count(F.lit(1)).alias(name))
    one, two = hashed(test, "a"), hashed(fe.transform(test_raw, fm), "b")
    both = one.join(two, "h", "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.agg(F.sum("b").alias("n_rows"), F.sum((F.col("a") != F.col("b")).cast("int")).cast("int").alias("n_different"))


def _importances(spark, sf_dir):
    fm, _, models, _, _ = trained(spark, sf_dir)
    imp = ml.feature_importances(spark, models)
    return imp.join(fm.feature_names, "idx"), sum(m.trained for m in models)


@register("a19_feature_importance")
def a19_feature_importance(spark, sf_dir):
    """Mean importance per feature over the state models, top 20."""
    from cardsight.operators import evaluate as ev
    imp, n_models = _importances(spark, sf_dir)
    return ev.mean_importance(imp, 20, n_models)


@register("a19_importance_totals", with_txn(BALANCED_SQL + """
SELECT count(*) AS n_models, 1.0 AS total, 0 AS n_negative FROM balanced WHERE trained"""))
def a19_importance_totals(spark, sf_dir):
    """A19 checked: the mean importances of all features add up to 1 over the state models, and none is negative."""
    from cardsight.operators import evaluate as ev
    imp, n_models = _importances(spark, sf_dir)
    means = ev.mean_importance(imp, None, n_models)
    return means.agg(r6(F.sum("importance")).alias("total"), F.count_if(F.col("importance") < 0).cast("int").alias("n_negative")).select(
        F.lit(n_models).cast("long").alias("n_models"), "total", "n_negative")


@register("m03_tuning")
def m03_tuning(spark, sf_dir):
    """M3: the forest grid per state (27 settings, 5 hash folds, precision of
    the fraud class) on each state's at most 10,000-row training sample, then
    the fit of each state's choice, both with the full number of trees."""
    table = trained(spark, sf_dir)[1]
    tuned = ml.tune_per_state(table, parallelism=8)
    fitted = {m.state: m for m in ml.train_state_models(table, parallelism=8, settings={t["state"]: t["setting"] for t in tuned})}
    rows = [(t["state"], t["setting"] and str(sorted(t["setting"].items())), t["metric"], t["n_rows"],
             fitted[t["state"]].trained) for t in tuned]
    return spark.createDataFrame(rows, "state string, best_params string, best_metric double, n_rows long, fitted boolean")
