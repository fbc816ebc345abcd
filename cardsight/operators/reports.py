"""Reports: rates, factor rankings, deciles, time series, shares, KPIs and
paged listings. Aggregations are ``groupBy().agg`` (partial aggregation
before the shuffle, so a hot key costs one row per map task); every top-k
and page has an explicit tie-breaker so results are deterministic."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardsight.constants import (ANALYSIS_LIMIT, CASE_PAGE_SIZE, FACTOR_CAT_COLS, FACTOR_MIN_SUPPORT,
                                 FACTOR_NUM_COLS, FACTOR_TODAY, FACTOR_TOP_K, GRANULARITY_FORMATS,
                                 QUANTILE_BINS, TOP_CATEGORIES, TXN_PAGE_SIZE)
from cardsight.functions.dates import parse_service_time
from cardsight.operators import filters as flt
from cardsight.operators.rank import global_row_number, global_running_sums, quantile_bin

LABEL = "is_fraud"


# ---------------------------------------------------------------- rates (A1, A2)

def fraud_rate_by(df: DataFrame, key: str, label: str = LABEL) -> DataFrame:
    """A1: fraud rate and row count per value of ``key``."""
    return df.groupBy(key).agg(F.avg(label).alias("fraud_rate"), F.count(F.lit(1)).alias("n_cases"))


def global_rate(df: DataFrame, label: str = LABEL) -> DataFrame:
    """A2: one-row table with the overall fraud rate."""
    return df.agg(F.avg(label).alias("global_rate"))


# ---------------------------------------------------------------- factor analysis (A3-A5)

def with_factor_columns(txn: DataFrame, today: str = FACTOR_TODAY) -> DataFrame:
    """Adds ``hour`` (of the transaction) and ``age`` (whole days from birth
    to the fixed analysis day, floor-divided by 365). ``street`` is absent from
    the test view; it is added as null so the ranking shape is kept."""
    out = txn.withColumn("hour", F.hour("trans_ts"))
    out = out.withColumn("age", F.floor(F.datediff(F.lit(today).cast("date"), F.col("dob")) / F.lit(365)))
    if "street" not in out.columns:
        out = out.withColumn("street", F.lit(None).cast("string"))
    return out


def factor_ranking(df: DataFrame, features=FACTOR_CAT_COLS, min_support: int = FACTOR_MIN_SUPPORT,
                   top_k: int = FACTOR_TOP_K, label: str = LABEL) -> DataFrame:
    """For every feature at once, fraud rate and support per
    value, support >= ``min_support``, top ``top_k`` by rate (ties by value).

    One pass: the features are unpivoted to (feature, value) pairs, which
    are partially aggregated before the shuffle; the per-feature top-k is a
    ``row_number`` filter that Spark executes as a window group limit."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]))
    long = df.select(F.col(label), pairs.alias("p")).select("p.feature", "p.value", label)
    stats = (long.filter(F.col("value").isNotNull())
             .groupBy("feature", "value")
             .agg(F.avg(label).alias("fraud_rate"), F.count(F.lit(1)).alias("n_cases"))
             .filter(F.col("n_cases") >= min_support))
    w = Window.partitionBy("feature").orderBy(F.desc("fraud_rate"), F.asc("value"))
    return (stats.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= top_k)
            .withColumn("rank", F.col("rank").cast("int")))


def label_correlations(df: DataFrame, columns=FACTOR_NUM_COLS, label: str = LABEL) -> DataFrame:
    """A4: Pearson correlation of each numeric column with the label, one
    aggregation pass, returned long as (feature, corr)."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "corr")


def deciles(df: DataFrame, column: str, tie_col: str = "trans_num", bins: int = QUANTILE_BINS,
            label: str = LABEL) -> DataFrame:
    """Rank rows by (``column``, ``tie_col``), cut the ranks into
    ``bins`` equal-frequency bins, fraud rate and size per bin.

    Rows are counted per value, and running sums over the values give each
    value its range of ranks. A value whose ranks lie in one bin goes there
    with its counts; only rows of the values that a bin edge cuts (``bins - 1``
    at most) are ranked one by one."""
    base = df.select(column, tie_col, label).filter(F.col(column).isNotNull())
    values = base.groupBy(column).agg(F.count(F.lit(1)).alias("_c"), F.sum(label).alias("_s"),
                                      F.count(label).alias("_k"))
    ranked = global_running_sums(values, [column], ["_c"], totals=True)
    n = F.col("_c_total")
    ranked = (ranked.withColumn("_lo", quantile_bin(F.col("_c_cum") - F.col("_c") + 1, n, bins))
              .withColumn("_hi", quantile_bin(F.col("_c_cum"), n, bins)))
    whole = ranked.filter("_lo = _hi").select(F.col("_lo").alias("bin"), "_c", "_s", "_k")
    cut = ranked.filter("_lo < _hi").select(column, (F.col("_c_cum") - F.col("_c")).alias("_before"), n.alias("_n"))
    rows = global_row_number(base.join(cut, column), [column, tie_col], name="_r")
    first = rows.groupBy(column).agg(F.min("_r").alias("_first")).withColumnRenamed(column, "_v")
    rows = rows.join(first, rows[column] == first["_v"])
    part = (rows.withColumn("bin", quantile_bin(F.col("_before") + F.col("_r") - F.col("_first") + 1, F.col("_n"), bins))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("_c"), F.sum(label).alias("_s"), F.count(label).alias("_k")))
    return (whole.unionByName(part).groupBy("bin")
            .agg((F.sum("_s") / F.sum("_k")).alias("fraud_rate"), F.sum("_c").alias("n_cases"))
            .withColumn("feature", F.lit(column)))


# ---------------------------------------------------------------- time series

def period_key(ts, granularity: str):
    """Period text of a timestamp."""
    flt.check_granularity(granularity)
    return F.date_format(ts, GRANULARITY_FORMATS[granularity])


def case_timeseries(cases: DataFrame, granularity: str = "month", time_col: str = "trans_ts",
                    label: str = LABEL) -> DataFrame:
    """Per period, cases labelled 1 and all others (null too). A text
    time column is parsed with the service's rules; unparsable rows skip."""
    ts = F.col(time_col)
    if dict(cases.dtypes)[time_col] == "string":
        ts = parse_service_time(ts)
    keyed = cases.select(period_key(ts, granularity).alias("period"), F.col(label).alias("_y"))
    return (keyed.filter(F.col("period").isNotNull())
            .groupBy("period")
            .agg(F.count_if(F.col("_y") == 1).alias("fraud_count"),
                 F.count_if(F.coalesce(F.col("_y") != 1, F.lit(True))).alias("non_fraud_count"))
            .orderBy("period"))


def fraud_count_by_period(df: DataFrame, granularity: str = "month", time_col: str = "trans_ts") -> DataFrame:
    """Row count per period of (already fraud-filtered) rows; UTC."""
    return (df.select(period_key(F.col(time_col), granularity).alias("period"))
            .filter(F.col("period").isNotNull())
            .groupBy("period").agg(F.count(F.lit(1)).alias("fraud_count"))
            .orderBy("period"))


# ---------------------------------------------------------------- shares and KPIs

def success_rate(cases: DataFrame, label: str = LABEL) -> DataFrame:
    """Counts of label 1 and label 0 (null in neither) with percentages;
    no cases gives zeros."""
    y = F.col(label)
    counts = cases.agg(F.count_if(y == 1).alias("fraud_count"), F.count_if(y == 0).alias("non_fraud_count"))
    total = F.col("fraud_count") + F.col("non_fraud_count")
    pct = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), total) * F.lit(100.0), F.lit(0.0))
    return counts.select(pct("fraud_count").alias("fraud_percentage"),
                         pct("non_fraud_count").alias("non_fraud_percentage"),
                         total.alias("total_cases"), "fraud_count", "non_fraud_count")


def displayed_counts(rate: DataFrame) -> DataFrame:
    """Counts re-derived from the percentages, ``round(pct*total/100)``."""
    return rate.select(
        F.round(F.col("fraud_percentage") * F.col("total_cases") / F.lit(100.0)).cast("bigint").alias("fraud_shown"),
        F.round(F.col("non_fraud_percentage") * F.col("total_cases") / F.lit(100.0)).cast("bigint").alias("clean_shown"))


def kpis(df: DataFrame) -> DataFrame:
    """Count, amount total, distinct states, first and last time."""
    return df.agg(F.count(F.lit(1)).alias("total_cases"),
                  F.sum("amt").alias("total_amount"),
                  F.count_distinct("state").alias("unique_states"),
                  F.min("trans_ts").alias("first_ts"),
                  F.max("trans_ts").alias("last_ts"))


def top_categories(df: DataFrame, k: int = TOP_CATEGORIES, column: str = "category") -> DataFrame:
    """A10: the ``k`` most frequent values (ties by name)."""
    return (df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("value"))
            .orderBy(F.desc("value"), F.asc("name")).limit(k))


def shares(top: DataFrame) -> DataFrame:
    """Each value's share of the (k-row) top list. The window has no
    partition key but runs over k rows only."""
    return top.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy()))


def total_count(df: DataFrame) -> DataFrame:
    """Total rows beside a page."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def page_count(total: DataFrame, page_size: int) -> DataFrame:
    """``max(ceil(total/size), 1)`` pages."""
    return total.select("total", F.greatest(F.ceil(F.col("total") / F.lit(page_size)), F.lit(1))
                        .cast("bigint").alias("pages"))


# ---------------------------------------------------------------- state balance

def class_balance(df: DataFrame, key: str = "state", label: str = LABEL) -> DataFrame:
    """Per key, positives, negatives, the neg/pos weight and whether
    only one class is present."""
    y = F.col(label)
    return (df.groupBy(key).agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"),
                                F.count_distinct(y).alias("n_classes"))
            .withColumn("pos_weight", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")))
            .withColumn("one_class", F.col("n_classes") < 2))


def state_weights(df: DataFrame, key: str = "state") -> DataFrame:
    """Per-key row count normalised to sum to 1. The total is the sum of
    the counts (one row per key)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("weight", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()).cast("double"))


# ---------------------------------------------------------------- listings

def case_filter(cases: DataFrame, txn_id: str | None = None, status: str | None = None,
                as_of: _dt.datetime | str | None = None) -> DataFrame:
    """The cases that a page shows or its total counts; their ids are not read."""
    filtered = flt.txn_ids_contain(cases, txn_id)
    if not status:
        return filtered
    if as_of is None:
        raise ValueError("as_of is required for the status filter")
    return flt.case_status(filtered, status, as_of)


def case_page(cases: DataFrame, txn_id: str | None = None, status: str | None = None,
              as_of: _dt.datetime | str | None = None, limit: int = CASE_PAGE_SIZE,
              offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """L1: (page rows, total) of cases, newest first, ties by case id."""
    filtered = case_filter(cases, txn_id, status, as_of)
    page = filtered.orderBy(F.desc("created_at"), F.asc("case_id")).offset(offset).limit(limit)
    return page, total_count(filtered)


def txn_page(table: DataFrame, limit: int = TXN_PAGE_SIZE, offset: int = 0, card: str | None = None,
             merchant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """L2: (page rows, total) of a transaction bucket, newest first; optional
    card-number and merchant searches (F6, F2)."""
    filtered = flt.substring_match(flt.card_contains(table, card), merchant=merchant)
    page = filtered.orderBy(F.desc("trans_ts"), F.asc("trans_num")).offset(offset).limit(limit)
    return page, total_count(filtered)


def fraud_analysis(fraud: DataFrame, merchant: str | None = None, category: str | None = None,
                   state: str | None = None, min_amount: float | None = None,
                   max_amount: float | None = None, start_date: str | None = None,
                   end_date: str | None = None, limit: int | None = ANALYSIS_LIMIT) -> DataFrame:
    """L3: regex filters (F1), amount range (F3), day range (F4), newest
    first, at most ``limit`` rows. ``None``: all rows, unordered, for totals."""
    out = flt.regex_match(fraud, merchant=merchant, category=category, state=state)
    out = flt.amount_range(out, min_amount, max_amount)
    out = flt.date_range(out, start_date, end_date, end_mode="end_of_day")
    return out.orderBy(F.desc("trans_ts"), F.asc("trans_num")).limit(limit) if limit is not None else out


def dashboard_pass(rows: DataFrame, merchant: str | None = None, category: str | None = None,
                   state: str | None = None, min_amount: float | None = None,
                   max_amount: float | None = None, start_date: str | None = None,
                   end_date: str | None = None) -> DataFrame:
    """The dashboard's second pass: substring filters (F2), amount range,
    day range ending at midnight of the end day (F5)."""
    out = flt.substring_match(rows, merchant=merchant, category=category, state=state)
    out = flt.amount_range(out, min_amount, max_amount)
    return flt.date_range(out, start_date, end_date, end_mode="midnight")


def head(table: DataFrame, limit: int, order_col: str = "trans_num") -> DataFrame:
    """The first ``limit`` rows of a stable order."""
    return table.orderBy(order_col).limit(limit)
