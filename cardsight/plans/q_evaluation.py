"""Evaluation of the stored score against the label."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardsight.operators import evaluate as ev
from cardsight.plans.catalog import register
from cardsight.plans.common import r6, txn
from cardsight.plans.oracle_views import with_txn

CURVE_SQL = """
, s AS (SELECT fraud_score AS score, count(*) FILTER (WHERE is_fraud = 1) AS pos,
               count(*) FILTER (WHERE is_fraud = 0) AS neg FROM txn GROUP BY fraud_score),
c AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, sum(pos) OVER () AS P, sum(neg) OVER () AS N
      FROM s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pr AS (SELECT *, tps / (tps + fps) AS precision, tps / P AS recall FROM c),
prf AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pr)
"""

# Decisions at the threshold with the greatest F1 (A24), as the evaluation takes them.
CM_SQL = CURVE_SQL + """
, best AS (SELECT score AS threshold FROM prf ORDER BY f1 DESC, score LIMIT 1),
p AS (SELECT *, CAST(fraud_score >= threshold AS INT) AS pred FROM txn, best),
cm AS (SELECT count(*) FILTER (WHERE is_fraud = 1 AND pred = 1) AS tp,
              count(*) FILTER (WHERE is_fraud = 0 AND pred = 1) AS fp,
              count(*) FILTER (WHERE is_fraud = 0 AND pred = 0) AS tn,
              count(*) FILTER (WHERE is_fraud = 1 AND pred = 0) AS fn FROM p)
"""


def _scored(spark, sf_dir):
    t = txn(spark, sf_dir)
    return ev.predict(t, threshold=ev.best_threshold(t).first()["threshold"])


def _round_all(df, cols):
    for c in cols:
        df = df.withColumn(c, r6(F.col(c)))
    return df


@register("a20_confusion_matrix", with_txn(CM_SQL + """
SELECT 0 AS label, 0 AS pred, tn AS n FROM cm UNION ALL SELECT 0, 1, fp FROM cm
UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm"""))
def a20_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(_scored(spark, sf_dir))


@register("a21_threshold_metrics", with_txn(CM_SQL + """
SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn))
             / ((tp / (tp + fp)) + (tp / (tp + fn))) END, 6) AS f1
FROM cm"""))
def a21_threshold_metrics(spark, sf_dir):
    return _round_all(ev.threshold_metrics(_scored(spark, sf_dir)), ["accuracy", "precision", "recall", "f1"])


@register("a22_class_report", with_txn(CM_SQL + """
, k AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0,
               tp + fn AS s1, tn + fp AS s0, tp + fp + tn + fn AS total FROM cm),
f AS (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1_1, 2 * p0 * r0 / (p0 + r0) AS f1_0 FROM k)
SELECT '0' AS cls, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f1_0, 6) AS f1, s0 AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1_1, 6), s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / total, 6), total FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f1_0 + f1_1) / 2, 6), total
  FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / total, 6), round((r0 * s0 + r1 * s1) / total, 6),
  round((f1_0 * s0 + f1_1 * s1) / total, 6), total FROM f"""))
def a22_class_report(spark, sf_dir):
    return _round_all(ev.class_report(_scored(spark, sf_dir)), ["precision", "recall", "f1"])


@register("a23_log_loss", with_txn("""
SELECT round(avg(-(is_fraud * ln(greatest(least(fraud_score, 1 - 1e-15), 1e-15))
                 + (1 - is_fraud) * ln(1 - greatest(least(fraud_score, 1 - 1e-15), 1e-15)))), 6) AS log_loss
FROM txn"""))
def a23_log_loss(spark, sf_dir):
    return _round_all(ev.log_loss(txn(spark, sf_dir)), ["log_loss"])


@register("a24_pr_curve", with_txn(CURVE_SQL + """
SELECT score, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf
UNION ALL SELECT NULL, 1.0, 0.0, 0.0"""))
def a24_pr_curve(spark, sf_dir):
    """Every threshold, and the end point (precision 1, recall 0) that has none."""
    pr = ev.pr_curve(txn(spark, sf_dir), ends=True)
    return _round_all(pr.select("score", "precision", "recall", "f1"), ["precision", "recall", "f1"])


@register("a24_best_threshold", with_txn(CURVE_SQL + """
SELECT score AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM prf ORDER BY f1 DESC, score LIMIT 1"""))
def a24_best_threshold(spark, sf_dir):
    return _round_all(ev.best_threshold(txn(spark, sf_dir)), ["f1", "precision", "recall"])


@register("a25_average_precision", with_txn(CURVE_SQL + """
SELECT round(sum(pos / P * precision), 6) AS average_precision FROM prf"""))
def a25_average_precision(spark, sf_dir):
    return _round_all(ev.average_precision(txn(spark, sf_dir)), ["average_precision"])


@register("a26_roc_curve", with_txn(CURVE_SQL + """
SELECT score, round(fps / N, 6) AS fpr, round(tps / P, 6) AS tpr FROM c
UNION ALL SELECT NULL, 0.0, 0.0"""))
def a26_roc_curve(spark, sf_dir):
    """Every threshold, and the origin that has none."""
    return _round_all(ev.roc_curve(txn(spark, sf_dir), ends=True), ["fpr", "tpr"])


@register("a26_auroc", with_txn(CURVE_SQL + """
SELECT round(sum(neg * (2 * tps - pos) / 2) / (max(P) * max(N)), 6) AS auroc FROM c"""))
def a26_auroc(spark, sf_dir):
    return _round_all(ev.auroc(txn(spark, sf_dir)), ["auroc"])


@register("a27_score_histogram", with_txn("""
, r AS (SELECT is_fraud, min(fraud_score) AS lo, max(fraud_score) AS hi FROM txn GROUP BY is_fraud),
h AS (SELECT t.is_fraud, lo, hi,
             CAST(least(CASE WHEN hi = lo THEN 0 ELSE floor((fraud_score - lo) * 50.0 / (hi - lo)) END, 49) AS INT)
               AS bin
      FROM txn t JOIN r ON t.is_fraud = r.is_fraud)
SELECT is_fraud, bin, count(*) AS n, min(lo) AS lo, min(hi) AS hi FROM h GROUP BY is_fraud, bin"""))
def a27_score_histogram(spark, sf_dir):
    return ev.score_histogram(txn(spark, sf_dir))


@register("a28_state_metrics", with_txn("""
, p AS (SELECT *, CAST(fraud_score >= 0.64 AS INT) AS pred,
               greatest(least(fraud_score, 1 - 1e-15), 1e-15) AS pc FROM txn),
cm AS (SELECT state, count(*) AS n_rows,
              count(*) FILTER (WHERE is_fraud = 1 AND pred = 1) AS tp,
              count(*) FILTER (WHERE is_fraud = 0 AND pred = 1) AS fp,
              count(*) FILTER (WHERE is_fraud = 0 AND pred = 0) AS tn,
              count(*) FILTER (WHERE is_fraud = 1 AND pred = 0) AS fn,
              avg(-(is_fraud * ln(pc) + (1 - is_fraud) * ln(1 - pc))) AS log_loss
       FROM p GROUP BY state),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
                CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM cm),
s AS (SELECT state, fraud_score AS score, count(*) FILTER (WHERE is_fraud = 1) AS pos,
             count(*) FILTER (WHERE is_fraud = 0) AS neg FROM txn GROUP BY state, fraud_score),
c AS (SELECT *, sum(pos) OVER (PARTITION BY state ORDER BY score DESC
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps FROM s),
a AS (SELECT state, CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL
                    ELSE sum(neg * (2 * tps - pos) / 2) / (sum(pos) * sum(neg)) END AS auc FROM c GROUP BY state)
SELECT m.state, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall,
       round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1,
       round(log_loss, 6) AS log_loss, round(auc, 6) AS auc, n_rows
FROM m JOIN a ON m.state = a.state"""))
def a28_state_metrics(spark, sf_dir):
    out = ev.state_metrics(txn(spark, sf_dir))
    return _round_all(out, ["accuracy", "precision", "recall", "f1", "log_loss", "auc"])


@register("p08_decisions", with_txn("""
SELECT CAST(fraud_score >= 0.64 AS INT) AS pred, count(*) AS n FROM txn GROUP BY 1"""))
def p08_decisions(spark, sf_dir):
    """Decision at the fixed 0.64 threshold, counted per outcome."""
    return ev.predict(txn(spark, sf_dir)).groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
