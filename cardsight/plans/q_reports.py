"""Rates, factor analysis, deciles, case series, success rate, paging and
state balance (A1-A7, A12-A14, A29, L1, L2, L5, L6, F6-F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardsight.operators import filters as flt
from cardsight.operators import reports as rep
from cardsight.plans.catalog import register
from cardsight.plans.common import (AS_OF, CASE_TXN_ID, TXN_COLS, TXN_COLS_SQL, cases, r6, txn,
                                    unnumbered_cases)
from cardsight.plans.oracle_views import with_cases, with_txn

# ---------------------------------------------------------------- A1, A2


@register("a01_merchant_rate", with_txn("""
SELECT merchant, round(avg(is_fraud), 6) AS fraud_rate, count(*) AS n_cases FROM txn GROUP BY merchant"""))
def a01_merchant_rate(spark, sf_dir):
    return rep.fraud_rate_by(txn(spark, sf_dir), "merchant").withColumn("fraud_rate", r6(F.col("fraud_rate")))


@register("a01_state_rate", with_txn("""
SELECT state, round(avg(is_fraud), 6) AS fraud_rate, count(*) AS n_cases FROM txn GROUP BY state"""))
def a01_state_rate(spark, sf_dir):
    return rep.fraud_rate_by(txn(spark, sf_dir), "state").withColumn("fraud_rate", r6(F.col("fraud_rate")))


@register("a02_global_rate", with_txn("SELECT round(avg(is_fraud), 6) AS global_rate FROM txn"))
def a02_global_rate(spark, sf_dir):
    return rep.global_rate(txn(spark, sf_dir)).select(r6(F.col("global_rate")).alias("global_rate"))


# ---------------------------------------------------------------- A3-A5

FACTOR_SQL = """
, f AS (
  SELECT *, CAST(hour(trans_ts) AS INT) AS hour,
         CAST(floor(date_diff('day', dob, DATE '2025-07-11') / 365) AS BIGINT) AS age,
         CAST(NULL AS VARCHAR) AS street
  FROM txn),
long AS (
  SELECT 'merchant' AS feature, merchant AS value, is_fraud FROM f
  UNION ALL SELECT 'category', category, is_fraud FROM f
  UNION ALL SELECT 'street', street, is_fraud FROM f
  UNION ALL SELECT 'city', city, is_fraud FROM f
  UNION ALL SELECT 'state', state, is_fraud FROM f
  UNION ALL SELECT 'hour', CAST(hour AS VARCHAR), is_fraud FROM f),
stats AS (
  SELECT feature, value, avg(is_fraud) AS fraud_rate, count(*) AS n_cases
  FROM long WHERE value IS NOT NULL GROUP BY feature, value HAVING count(*) >= 50)
SELECT feature, value, round(fraud_rate, 6) AS fraud_rate, n_cases, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY fraud_rate DESC, value) AS INT) AS rank
  FROM stats) WHERE rank <= 10"""


@register("a03_factor_ranking", with_txn(FACTOR_SQL))
def a03_factor_ranking(spark, sf_dir):
    out = rep.factor_ranking(rep.with_factor_columns(txn(spark, sf_dir)))
    return out.withColumn("fraud_rate", r6(F.col("fraud_rate")))


@register("a04_label_correlations", with_txn("""
, f AS (SELECT *, CAST(floor(date_diff('day', dob, DATE '2025-07-11') / 365) AS BIGINT) AS age FROM txn)
SELECT * FROM (
  SELECT 'amt' AS feature, round(corr(CAST(amt AS DOUBLE), CAST(is_fraud AS DOUBLE)), 6) AS corr FROM f
  UNION ALL SELECT 'city_pop', round(corr(CAST(city_pop AS DOUBLE), CAST(is_fraud AS DOUBLE)), 6) FROM f
  UNION ALL SELECT 'lat', round(corr(CAST(lat AS DOUBLE), CAST(is_fraud AS DOUBLE)), 6) FROM f
  UNION ALL SELECT 'long', round(corr(CAST(long AS DOUBLE), CAST(is_fraud AS DOUBLE)), 6) FROM f
  UNION ALL SELECT 'merch_lat', round(corr(CAST(merch_lat AS DOUBLE), CAST(is_fraud AS DOUBLE)), 6) FROM f
  UNION ALL SELECT 'merch_long', round(corr(CAST(merch_long AS DOUBLE), CAST(is_fraud AS DOUBLE)), 6) FROM f
  UNION ALL SELECT 'age', round(corr(CAST(age AS DOUBLE), CAST(is_fraud AS DOUBLE)), 6) FROM f)"""))
def a04_label_correlations(spark, sf_dir):
    out = rep.label_correlations(rep.with_factor_columns(txn(spark, sf_dir)))
    return out.withColumn("corr", r6(F.col("corr")))


def _decile_sql(column, expr=None):
    expr = expr or column
    return with_txn(f"""
, f AS (SELECT trans_num, is_fraud, {expr} AS v FROM txn WHERE {expr} IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY v, trans_num) AS rk, count(*) OVER () AS n FROM f),
b AS (SELECT *, CAST(CASE WHEN n <= 1 THEN 0 ELSE greatest(0, ceil(10 * (rk - 1) / (n - 1)) - 1) END AS INT) AS bin
      FROM r)
SELECT bin, round(avg(is_fraud), 6) AS fraud_rate, count(*) AS n_cases, '{column}' AS feature FROM b GROUP BY bin""")


def _deciles(spark, sf_dir, column):
    t = rep.with_factor_columns(txn(spark, sf_dir))
    return rep.deciles(t, column).withColumn("fraud_rate", r6(F.col("fraud_rate")))


@register("a05_deciles_amt", _decile_sql("amt"))
def a05_deciles_amt(spark, sf_dir):
    return _deciles(spark, sf_dir, "amt")


@register("a05_deciles_city_pop", _decile_sql("city_pop"))
def a05_deciles_city_pop(spark, sf_dir):
    return _deciles(spark, sf_dir, "city_pop")


@register("a05_deciles_age", _decile_sql(
    "age", "CAST(floor(date_diff('day', dob, DATE '2025-07-11') / 365) AS BIGINT)"))
def a05_deciles_age(spark, sf_dir):
    return _deciles(spark, sf_dir, "age")


def _register_coordinate(column: str):
    @register(f"a05_deciles_{column}", _decile_sql(column))
    def query(spark, sf_dir):
        return _deciles(spark, sf_dir, column)


for _column in ("lat", "long", "merch_lat", "merch_long"):
    _register_coordinate(_column)


# ---------------------------------------------------------------- A6, A7, A29 on cases

def _series_sql(fmt):
    return with_cases(f"""
SELECT strftime(trans_ts, '{fmt}') AS period,
       count(*) FILTER (WHERE is_fraud = 1) AS fraud_count,
       count(*) FILTER (WHERE is_fraud IS DISTINCT FROM 1) AS non_fraud_count
FROM cases WHERE trans_ts IS NOT NULL GROUP BY 1""")


@register("a06_case_timeseries_day", _series_sql("%Y-%m-%d"))
def a06_case_timeseries_day(spark, sf_dir):
    return rep.case_timeseries(unnumbered_cases(spark, sf_dir), "day")


@register("a06_case_timeseries_month", _series_sql("%Y-%m"))
def a06_case_timeseries_month(spark, sf_dir):
    return rep.case_timeseries(unnumbered_cases(spark, sf_dir), "month")


@register("a06_case_timeseries_year", _series_sql("%Y"))
def a06_case_timeseries_year(spark, sf_dir):
    return rep.case_timeseries(unnumbered_cases(spark, sf_dir), "year")


@register("a06_case_timeseries_text", with_cases("""
SELECT strftime(trans_ts, '%Y-%m') AS period,
       count(*) FILTER (WHERE is_fraud = 1) AS fraud_count,
       count(*) FILTER (WHERE is_fraud IS DISTINCT FROM 1) AS non_fraud_count
FROM cases WHERE CAST(split_part(trans_num, '-', 1) AS BIGINT) % 9 <> 0 GROUP BY 1"""))
def a06_case_timeseries_text(spark, sf_dir):
    """Case series over a text time column as stored by ingestion: ISO text,
    with unparsable values (order key multiple of 9) skipped."""
    c = cases(spark, sf_dir)
    ok = F.split(F.col("trans_num"), "-").getItem(0).cast("bigint")
    text = F.when(ok % 9 == 0, F.lit("not a time")).otherwise(F.date_format("trans_ts", "yyyy-MM-dd HH:mm:ss"))
    return rep.case_timeseries(c.withColumn("trans_date_trans_time", text), "month",
                               time_col="trans_date_trans_time")


SUCCESS_SQL = """
SELECT CASE WHEN f + nf = 0 THEN 0.0 ELSE round(f / (f + nf) * 100, 6) END AS fraud_percentage,
       CASE WHEN f + nf = 0 THEN 0.0 ELSE round(nf / (f + nf) * 100, 6) END AS non_fraud_percentage,
       f + nf AS total_cases, f AS fraud_count, nf AS non_fraud_count
FROM (SELECT count(*) FILTER (WHERE is_fraud = 1) AS f, count(*) FILTER (WHERE is_fraud = 0) AS nf FROM cases)"""


@register("a07_success_rate", with_cases(SUCCESS_SQL))
def a07_success_rate(spark, sf_dir):
    out = rep.success_rate(unnumbered_cases(spark, sf_dir))
    return out.withColumn("fraud_percentage", r6(F.col("fraud_percentage"))) \
              .withColumn("non_fraud_percentage", r6(F.col("non_fraud_percentage")))


@register("a29_displayed_counts", with_cases(f"""
SELECT CAST(round(fraud_percentage * total_cases / 100) AS BIGINT) AS fraud_shown,
       CAST(round(non_fraud_percentage * total_cases / 100) AS BIGINT) AS clean_shown
FROM ({SUCCESS_SQL.replace(', 6)', ', 12)')})"""))
def a29_displayed_counts(spark, sf_dir):
    return rep.displayed_counts(rep.success_rate(unnumbered_cases(spark, sf_dir)))


# ---------------------------------------------------------------- L1, F7, F8 on cases

CASE_COLS = ["case_id", "trans_num", "status", "created_at", "amt", "is_fraud"]
CASE_COLS_SQL = ", ".join(CASE_COLS)
AS_OF_MIDNIGHT = AS_OF[:10] + " 00:00:00"


@register("l01_case_page", with_cases(f"""
SELECT {CASE_COLS_SQL} FROM cases
WHERE status = 'investigating' OR (status = 'open' AND created_at < TIMESTAMP '{AS_OF_MIDNIGHT}')
ORDER BY created_at DESC, case_id LIMIT 20 OFFSET 20"""))
def l01_case_page(spark, sf_dir):
    page, _ = rep.case_page(cases(spark, sf_dir), status="investigating", as_of=AS_OF, limit=20, offset=20)
    return page.select(*CASE_COLS)


@register("a12_case_total", with_cases(f"""
SELECT count(*) AS total FROM cases
WHERE status = 'investigating' OR (status = 'open' AND created_at < TIMESTAMP '{AS_OF_MIDNIGHT}')"""))
def a12_case_total(spark, sf_dir):
    return rep.total_count(rep.case_filter(unnumbered_cases(spark, sf_dir), status="investigating", as_of=AS_OF))


@register("l05_case_page_count", with_cases(f"""
SELECT total, CAST(greatest(ceil(total / 20), 1) AS BIGINT) AS pages FROM (
  SELECT count(*) AS total FROM cases WHERE status = 'open' AND created_at >= TIMESTAMP '{AS_OF_MIDNIGHT}')"""))
def l05_case_page_count(spark, sf_dir):
    shown = rep.case_filter(unnumbered_cases(spark, sf_dir), status="open", as_of=AS_OF)
    return rep.page_count(rep.total_count(shown), 20)


@register("f08_status_counts", with_cases(f"""
SELECT 'open' AS bucket, count(*) AS n FROM cases
  WHERE status = 'open' AND created_at >= TIMESTAMP '{AS_OF_MIDNIGHT}'
UNION ALL SELECT 'investigating', count(*) FROM cases
  WHERE status = 'investigating' OR (status = 'open' AND created_at < TIMESTAMP '{AS_OF_MIDNIGHT}')
UNION ALL SELECT 'closed', count(*) FROM cases WHERE status = 'closed'"""))
def f08_status_counts(spark, sf_dir):
    """F8: cases listed under each status, from one grouped count; a status without cases counts 0."""
    shown = unnumbered_cases(spark, sf_dir).groupBy(flt.case_bucket(AS_OF).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([("open",), ("investigating",), ("closed",)], "bucket string")
    return names.join(shown, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@register("f07_case_by_txn", with_cases(f"""
SELECT {CASE_COLS_SQL} FROM cases WHERE list_contains(txn_ids, '{CASE_TXN_ID}')"""))
def f07_case_by_txn(spark, sf_dir):
    page, _ = rep.case_page(cases(spark, sf_dir), txn_id=CASE_TXN_ID)
    return page.select(*CASE_COLS)


# ---------------------------------------------------------------- L2, F6, F9, L6 on transactions

@register("l02_txn_page", with_txn(f"""
SELECT {TXN_COLS_SQL} FROM txn
WHERE contains(CAST(cc_num AS VARCHAR), '12') AND contains(lower(merchant), lower('supplier#00000002'))
ORDER BY trans_ts DESC, trans_num LIMIT 50 OFFSET 50"""))
def l02_txn_page(spark, sf_dir):
    page, _ = rep.txn_page(txn(spark, sf_dir), limit=50, offset=50, card="12", merchant="supplier#00000002")
    return page.select(*TXN_COLS)


@register("a12_txn_total", with_txn("""
SELECT count(*) AS total FROM txn
WHERE contains(CAST(cc_num AS VARCHAR), '12') AND contains(lower(merchant), lower('supplier#00000002'))"""))
def a12_txn_total(spark, sf_dir):
    _, total = rep.txn_page(txn(spark, sf_dir), card="12", merchant="supplier#00000002")
    return total


@register("f06_card_search", with_txn(f"""
SELECT {TXN_COLS_SQL} FROM txn WHERE contains(CAST(cc_num AS VARCHAR), '555')"""))
def f06_card_search(spark, sf_dir):
    return flt.card_contains(txn(spark, sf_dir), "555").select(*TXN_COLS)


@register("f09_id_in_list", with_txn(f"""
SELECT {TXN_COLS_SQL} FROM txn WHERE trans_num IN ('{CASE_TXN_ID}', '98-5-934-52', 'no-such-id')"""))
def f09_id_in_list(spark, sf_dir):
    return flt.id_in(txn(spark, sf_dir), [CASE_TXN_ID, "98-5-934-52", "no-such-id"]).select(*TXN_COLS)


@register("l06_export_head", with_txn(f"""
SELECT {TXN_COLS_SQL} FROM txn WHERE is_fraud = 1 ORDER BY trans_num LIMIT 1000"""))
def l06_export_head(spark, sf_dir):
    from cardsight.sources.tables import bucket
    return rep.head(bucket(txn(spark, sf_dir), "fraud"), 1000).select(*TXN_COLS)


# ---------------------------------------------------------------- A13, A14

@register("a13_class_balance", with_txn("""
SELECT state, count(*) FILTER (WHERE is_fraud = 1) AS n_pos, count(*) FILTER (WHERE is_fraud = 0) AS n_neg,
       count(DISTINCT is_fraud) AS n_classes,
       round(CASE WHEN count(*) FILTER (WHERE is_fraud = 1) = 0 THEN NULL
             ELSE count(*) FILTER (WHERE is_fraud = 0) / count(*) FILTER (WHERE is_fraud = 1) END, 6) AS pos_weight,
       count(DISTINCT is_fraud) < 2 AS one_class
FROM txn GROUP BY state"""))
def a13_class_balance(spark, sf_dir):
    return rep.class_balance(txn(spark, sf_dir)).withColumn("pos_weight", r6(F.col("pos_weight")))


@register("a14_state_weights", with_txn("""
SELECT state, n_rows, round(n_rows / sum(n_rows) OVER (), 6) AS weight
FROM (SELECT state, count(*) AS n_rows FROM txn GROUP BY state)"""))
def a14_state_weights(spark, sf_dir):
    return rep.state_weights(txn(spark, sf_dir)).withColumn("weight", r6(F.col("weight")))
