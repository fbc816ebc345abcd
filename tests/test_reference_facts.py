"""Data facts taken from the reference's own page tests,
run through the Spark operators."""

import datetime as dt

from pyspark.sql import functions as F

from cardsight.functions import dates, display
from cardsight.operators import filters as flt
from cardsight.operators import reports as rep


def _ts(s):
    return dt.datetime.fromisoformat(s)


def test_fraud_two_kpis_and_merchant_filter(spark):
    rows = [("t1", "Test Merchant 1", "Gas", 100.0, _ts("2023-01-01 00:00:00"), "CA", 1),
            ("t2", "Test Merchant 2", "Groceries", 200.0, _ts("2023-01-02 00:00:00"), "NY", 1)]
    df = spark.createDataFrame(rows, "trans_num string, merchant string, category string, amt double, "
                                     "trans_ts timestamp_ntz, state string, is_fraud int")
    k = rep.kpis(df).first()
    assert (k.total_cases, k.total_amount, k.unique_states) == (2, 300.0, 2)
    assert rep.fraud_analysis(df, merchant="Test Merchant 1").count() == 1
    assert rep.dashboard_pass(df, merchant="test merchant 1").count() == 1
    months = {r.period: r.fraud_count for r in rep.fraud_count_by_period(df, "month").collect()}
    assert months == {"2023-01": 2}
    days = [r.period for r in rep.fraud_count_by_period(df, "day").collect()]
    assert days == ["2023-01-01", "2023-01-02"]


def test_txn_two_card_and_merchant_search(spark):
    rows = [("a", _ts("2023-10-27 10:00:00"), 123.45, 1, 1111222233334444, "Tech Store"),
            ("b", _ts("2023-10-26 15:30:00"), 50.0, 0, 5555666677778888, "Coffee Shop")]
    df = spark.createDataFrame(rows, "trans_num string, trans_ts timestamp_ntz, amt double, is_fraud int, "
                                     "cc_num long, merchant string")
    assert [r.trans_num for r in flt.card_contains(df, "5555").collect()] == ["b"]
    assert [r.trans_num for r in flt.substring_match(df, merchant="Coffee").collect()] == ["b"]
    page, total = rep.txn_page(df, limit=50)
    assert [r.trans_num for r in page.collect()] == ["a", "b"] and total.first().total == 2


def test_cases_four_status_with_ageing(spark):
    rows = [(1, "open", 123.45, _ts("2023-10-27 10:00:00")), (2, "investigating", 50.0, _ts("2023-10-26 15:30:00")),
            (3, "closed", 99.99, _ts("2023-10-25 08:00:00")), (4, "open", 250.0, _ts("2023-10-27 11:00:00"))]
    df = spark.createDataFrame(rows, "case_id long, status string, amt double, created_at timestamp_ntz") \
              .withColumn("txn_ids", F.array(F.col("case_id").cast("string")))

    def ids(status, as_of):
        return sorted(r.case_id for r in flt.case_status(df, status, as_of).collect())

    assert ids("open", "2023-10-27 12:00:00") == [1, 4]
    assert ids("investigating", "2023-10-27 12:00:00") == [2]
    assert ids("closed", "2023-10-27 12:00:00") == [3]
    assert ids("investigating", "2023-11-01 00:00:00") == [1, 2, 4]
    page, total = rep.case_page(df, limit=2, offset=0)
    assert [r.case_id for r in page.collect()] == [4, 1] and total.first().total == 4


def test_rate_fifty(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(0,)] * 40, "is_fraud int")
    r = rep.success_rate(df).first()
    assert (r.fraud_percentage, r.non_fraud_percentage, r.total_cases) == (20.0, 80.0, 50)
    shown = rep.displayed_counts(rep.success_rate(df)).first()
    assert (shown.fraud_shown, shown.clean_shown) == (10, 40)
    empty = rep.success_rate(df.filter("false")).first()
    assert (empty.fraud_percentage, empty.total_cases) == (0.0, 0)


def test_form_row_parsing_and_display(spark):
    df = spark.createDataFrame([("1/1/19 0:00", "1/1/90", 0.05)], "t string, dob string, score double")
    out = df.select(dates.parse_with(F.col("t"), "M/d/yy H:mm").alias("t"),
                    dates.parse_with(F.col("dob"), "M/d/yy").alias("dob"),
                    display.percent("score").alias("shown")).first()
    assert out.t == dt.datetime(2019, 1, 1, 0, 0) and out.dob == dt.datetime(1990, 1, 1)
    assert out.shown == "5.00%"


def test_pivot_years(spark):
    df = spark.createDataFrame([("1/1/55",), ("1/1/68",), ("1/1/69",), ("1/1/90",)], "d string")
    years = [r.y for r in df.select(F.year(dates.parse_with(F.col("d"), "M/d/yy")).alias("y")).collect()]
    assert years == [2055, 2068, 1969, 1990]


def test_incomplete_rows_rejected(spark):
    df = spark.createDataFrame([("m", 10.0), ("", 5.0), ("x", 0.0)], "merchant string, amt double")
    ok, bad = flt.split_complete(df, ["merchant", "amt"])
    assert ok.count() == 1 and bad.count() == 2


def test_format_vote_stop_rule(spark):
    good = [(f"1/{d}/2019 1:{d:02d}",) for d in range(1, 29)]
    df = spark.createDataFrame(good + [("junk",)], "trans_date_trans_time string")
    vote = dates.vote_format(df, "trans_date_trans_time")
    assert vote.chosen == "M/d/yyyy H:mm"
    assert vote.failures["M/d/yy H:mm"] == 29
    bad = spark.createDataFrame([("junk",), ("nope",)], "trans_date_trans_time string")
    assert dates.vote_format(bad, "trans_date_trans_time").fallback
