"""Fraud-analysis page: service filter + top-k (L3), the dashboard's second
pass (F2, F5), KPI block (A8), series (A9), top categories and shares
(A10, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardsight.operators import reports as rep
from cardsight.plans.catalog import register
from cardsight.plans.common import (END_DATE, MAX_AMOUNT, MERCHANT_PATTERN, MIN_AMOUNT, START_DATE, TXN_COLS,
                                    TXN_COLS_SQL, r2, r6, txn)
from cardsight.plans.oracle_views import with_txn
from cardsight.sources.tables import bucket

FILTER_SQL = f"""
SELECT * FROM txn
WHERE is_fraud = 1
  AND regexp_matches(merchant, '{MERCHANT_PATTERN}', 'i')
  AND amt >= {MIN_AMOUNT} AND amt <= {MAX_AMOUNT}
  AND trans_ts >= TIMESTAMP '{START_DATE} 00:00:00'
  AND trans_ts <= TIMESTAMP '{END_DATE} 23:59:59'
"""


def analysis_rows(spark, sf_dir, limit=None):
    fraud = bucket(txn(spark, sf_dir), "fraud")
    return rep.fraud_analysis(fraud, merchant=MERCHANT_PATTERN, min_amount=MIN_AMOUNT, max_amount=MAX_AMOUNT,
                              start_date=START_DATE, end_date=END_DATE, limit=limit)


@register("l03_fraud_analysis", with_txn(
    f"SELECT {TXN_COLS_SQL} FROM ({FILTER_SQL}) ORDER BY trans_ts DESC, trans_num LIMIT 1000"))
def l03_fraud_analysis(spark, sf_dir):
    return analysis_rows(spark, sf_dir, limit=1000).select(*TXN_COLS)


@register("a08_kpis", with_txn(f"""
SELECT count(*) AS total_cases, round(sum(amt), 2) AS total_amount, count(DISTINCT state) AS unique_states,
       min(trans_ts) AS first_ts, max(trans_ts) AS last_ts
FROM ({FILTER_SQL})"""))
def a08_kpis(spark, sf_dir):
    return rep.kpis(analysis_rows(spark, sf_dir)).withColumn("total_amount", r2(F.col("total_amount")))


@register("a08_kpis_capped", with_txn(f"""
SELECT count(*) AS total_cases, round(sum(amt), 2) AS total_amount, count(DISTINCT state) AS unique_states,
       min(trans_ts) AS first_ts, max(trans_ts) AS last_ts
FROM (SELECT * FROM ({FILTER_SQL}) ORDER BY trans_ts DESC, trans_num LIMIT 1000)"""))
def a08_kpis_capped(spark, sf_dir):
    """KPIs as the page shows them: over the (at most) 1,000 returned rows."""
    return rep.kpis(analysis_rows(spark, sf_dir, limit=1000)).withColumn("total_amount", r2(F.col("total_amount")))


def _period_sql(fmt):
    return with_txn(f"""
SELECT strftime(trans_ts, '{fmt}') AS period, count(*) AS fraud_count
FROM ({FILTER_SQL}) GROUP BY 1""")


@register("a09_fraud_by_day", _period_sql("%Y-%m-%d"))
def a09_fraud_by_day(spark, sf_dir):
    return rep.fraud_count_by_period(analysis_rows(spark, sf_dir), "day")


@register("a09_fraud_by_month", _period_sql("%Y-%m"))
def a09_fraud_by_month(spark, sf_dir):
    return rep.fraud_count_by_period(analysis_rows(spark, sf_dir), "month")


@register("a09_fraud_by_year", _period_sql("%Y"))
def a09_fraud_by_year(spark, sf_dir):
    return rep.fraud_count_by_period(analysis_rows(spark, sf_dir), "year")


TOP_SQL = f"""
SELECT category AS name, count(*) AS value FROM ({FILTER_SQL})
GROUP BY category ORDER BY value DESC, name LIMIT 5"""


@register("a10_top_categories", with_txn(TOP_SQL))
def a10_top_categories(spark, sf_dir):
    return rep.top_categories(analysis_rows(spark, sf_dir))


@register("a11_category_shares", with_txn(f"""
SELECT name, value, round(value / sum(value) OVER (), 6) AS share FROM ({TOP_SQL})"""))
def a11_category_shares(spark, sf_dir):
    out = rep.shares(rep.top_categories(analysis_rows(spark, sf_dir)))
    return out.withColumn("share", r6(F.col("share")))


DASH_SQL = f"""
SELECT * FROM (SELECT * FROM ({FILTER_SQL}) ORDER BY trans_ts DESC, trans_num LIMIT 1000)
WHERE contains(lower(merchant), lower('supplier#00000002'))
  AND contains(lower(state), lower('nation_1'))
  AND amt >= 5000.0
  AND trans_ts >= TIMESTAMP '1997-01-01 00:00:00' AND trans_ts <= TIMESTAMP '1999-03-31 00:00:00'
"""


def dashboard_rows(spark, sf_dir):
    return rep.dashboard_pass(analysis_rows(spark, sf_dir, limit=1000), merchant="supplier#00000002",
                              state="nation_1", min_amount=5000.0, start_date="1997-01-01", end_date="1999-03-31")


@register("f02_dashboard_pass", with_txn(f"SELECT {TXN_COLS_SQL} FROM ({DASH_SQL})"))
def f02_dashboard_pass(spark, sf_dir):
    """F2 + F3 + F5 on the service's 1,000 rows (midnight end cuts the last day)."""
    return dashboard_rows(spark, sf_dir).select(*TXN_COLS)


@register("a09_dashboard_by_month", with_txn(f"""
SELECT strftime(trans_ts, '%Y-%m') AS period, count(*) AS fraud_count FROM ({DASH_SQL}) GROUP BY 1"""))
def a09_dashboard_by_month(spark, sf_dir):
    return rep.fraud_count_by_period(dashboard_rows(spark, sf_dir), "month")


@register("f01_regex_category_state", with_txn(f"""
SELECT {TXN_COLS_SQL} FROM txn
WHERE regexp_matches(category, '^(small|economy)', 'i') AND regexp_matches(state, 'nation_2[0-4]$', 'i')
  AND amt <= 5000.0"""))
def f01_regex_category_state(spark, sf_dir):
    from cardsight.operators import filters as flt
    t = flt.regex_match(txn(spark, sf_dir), category="^(small|economy)", state="nation_2[0-4]$")
    return flt.amount_range(t, max_amount=5000.0).select(*TXN_COLS)


@register("f04_bad_date_ignored", with_txn(f"""
SELECT count(*) AS n FROM txn WHERE trans_ts <= TIMESTAMP '1995-06-30 23:59:59'"""))
def f04_bad_date_ignored(spark, sf_dir):
    """A malformed start date is ignored; the end date keeps its whole day."""
    from cardsight.operators import filters as flt
    t = flt.date_range(txn(spark, sf_dir), start_date="1995-13-45", end_date="1995-06-30")
    return t.agg(F.count(F.lit(1)).alias("n"))
