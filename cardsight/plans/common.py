"""Shared inputs and parameters for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsight.session import apply_sql_conf
from cardsight.sources import tables

# Query parameters used on the test data (chosen to select a real subset).
MERCHANT_PATTERN = "supplier#0+[1-5]"
MIN_AMOUNT = 1000.0
MAX_AMOUNT = 60000.0
START_DATE = "1996-01-01"
END_DATE = "1999-06-30"
AS_OF = "1998-06-15 09:30:00"
CASE_TXN_ID = "2391-6-1461-30"

TXN_COLS = ["trans_num", "trans_ts", "cc_num", "merchant", "category", "state", "amt", "is_fraud", "fraud_score"]
TXN_COLS_SQL = ", ".join(TXN_COLS)


def txn(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    apply_sql_conf(spark)
    return tables.txn_view(spark, sf_dir, tasks)


def cases_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cases_view(txn(spark, sf_dir))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_cc(spark, sf_dir).drop("cc_num")


def unnumbered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases without ids, for queries that do not read them."""
    return tables.cases_view(txn(spark, sf_dir), numbered=False).drop("cc_num")


def r6(col):
    return F.round(col, 6)


def r2(col):
    return F.round(col, 2)
