"""Base-table scans and the transaction / case views derived from them.

The test data is a TPC-H-like star schema. ``txn_view`` maps one
``lineitem`` row to one card transaction; labels and scores are derived for
testing (see FIXTURES.md). All derivations are column expressions, so
Catalyst prunes every scan to the columns a query actually uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsight.operators.rank import global_row_number

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def txn_view(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """One transaction per lineitem row (FIXTURES.md section 3).

    Join plan: orders is joined to customer and nation first (orders is a
    quarter of lineitem's rows and narrow), so the fact table is shuffled
    once, on the order key, right after its scan; supplier and part then
    join on lineitem's own keys and become broadcast joins whenever their
    measured size is under the broadcast threshold (AQE re-checks at
    runtime), as ``nation`` does. With ``tasks`` the fact rows are dealt over
    that many tasks by order key first, however few splits the scan has.
    """
    li = read_table(spark, sf_dir, "lineitem")
    if tasks:
        li = li.repartition(tasks, "l_orderkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")

    buyer = (orders.join(customer, orders.o_custkey == customer.c_custkey)
             .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .select("o_orderkey", "o_custkey", "c_mktsegment", "n_name"))

    # The order-key join comes first: the fact rows are shuffled carrying
    # only their integer keys, and the supplier / part lookups then run on
    # the shuffled (evenly partitioned) side instead of in the scan tasks.
    j = (li.join(buyer, li.l_orderkey == buyer.o_orderkey)
           .join(supplier, F.col("l_suppkey") == supplier.s_suppkey)
           .join(part, F.col("l_partkey") == part.p_partkey))

    ok, ln, sk, ck = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("o_custkey")
    lat = F.lit(25) + (ck * 7919 % 25000) / F.lit(1000.0)
    lon = F.lit(-125) + (ck * 104729 % 60000) / F.lit(1000.0)
    second_of_day = ((ok * 37 + ln * 911) % 86400).cast("int")
    return j.select(
        F.concat_ws("-", ok.cast("string"), ln.cast("string"),
                    F.col("l_partkey").cast("string"), sk.cast("string")).alias("trans_num"),
        F.timestamp_add("SECOND", second_of_day, F.col("l_shipdate")).alias("trans_ts"),
        ck.alias("cc_num"),
        F.col("s_name").alias("merchant"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("job"),
        F.col("l_extendedprice").alias("amt"),
        F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("city"),
        F.when(ck % 2 == 0, "F").otherwise("M").alias("gender"),
        F.date_add(F.lit("1955-01-01").cast("date"), (ck * 97 % 14600).cast("int")).alias("dob"),
        lat.alias("lat"),
        lon.alias("long"),
        (lat + ((sk * 31 + ln * 17) % 200 - 100) / F.lit(10000.0)).alias("merch_lat"),
        (lon + ((sk * 53 + ln * 29) % 200 - 100) / F.lit(10000.0)).alias("merch_long"),
        (F.lit(50000) + (ck * 6151 % 950000).cast("int")).alias("city_pop"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08), 1).otherwise(0).alias("is_fraud"),
        F.round(F.when(F.col("l_returnflag") == "R", F.lit(0.4)).otherwise(F.lit(0.0))
                + F.lit(4.0) * F.col("l_discount") + F.col("l_quantity") / F.lit(250.0), 6).alias("fraud_score"),
    )


def cases_view(txn: DataFrame, threshold: float = 0.64, numbered: bool = True) -> DataFrame:
    """Cases opened for transactions scored at or above ``threshold``.

    ``case_id`` is the 1-based position in (trans_ts, trans_num) order,
    computed with the range-partitioned row number (no single-task window);
    with ``numbered=False`` it is left out, and nothing is sorted.
    """
    cc = F.col("cc_num")
    flagged = txn.filter(F.col("fraud_score") >= F.lit(threshold)).select(
        "trans_num", "trans_ts", "cc_num", "amt", "merchant", "category", "state",
        "is_fraud", "fraud_score")
    ids = []
    if numbered:
        flagged = global_row_number(flagged, ["trans_ts", "trans_num"], name="case_id")
        ids = [F.col("case_id").cast("bigint").alias("case_id")]
    return flagged.select(
        *ids,
        F.array("trans_num").alias("txn_ids"),
        F.when(cc % 3 == 0, "open").when(cc % 3 == 1, "investigating").otherwise("closed").alias("status"),
        (F.col("trans_ts") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
        "trans_num", "trans_ts", "amt", "merchant", "category", "state", "is_fraud", "fraud_score",
        "cc_num",
    )


def case_table(txn: DataFrame, threshold: float = 0.64) -> DataFrame:
    """The ``cases`` view without the helper ``cc_num`` column."""
    return cases_view(txn, threshold).drop("cc_num")


def decisions_view(cases_with_cc: DataFrame) -> DataFrame:
    """Reviewer decisions: one per case whose card number is a multiple of 7."""
    return (cases_with_cc.filter(F.col("cc_num") % 7 == 0)
            .select(F.col("trans_num").alias("txn_id"),
                    F.lit("closed").alias("status"),
                    F.when(F.col("cc_num") % 2 == 0, "not_fraud").otherwise("confirm").alias("verdict")))


def txn_text_view(txn: DataFrame, spoil_mod: int | None = 50) -> DataFrame:
    """``txn`` with its time and birth date as text, as a raw feed carries
    them. Rows whose order key is a multiple of ``spoil_mod`` get 'bad' text
    times (FIXTURES.md section 5)."""
    ts_text = F.date_format("trans_ts", "M/d/yyyy H:mm")
    order_key = F.split(F.col("trans_num"), "-").getItem(0).cast("bigint")
    if spoil_mod:
        ts_text = F.when(order_key % spoil_mod == 0, F.lit("bad")).otherwise(ts_text)
    return (txn.withColumn("trans_date_trans_time", ts_text)
               .withColumn("dob", F.date_format("dob", "yyyy-MM-dd"))
               .drop("trans_ts"))


def bucket_tables(txn: DataFrame) -> dict[str, DataFrame]:
    """The three transaction buckets: all, new, fraud (fraud = label 1)."""
    return {"all": txn, "new": txn, "fraud": txn.filter(F.col("is_fraud") == 1)}


def bucket(txn: DataFrame, name: str) -> DataFrame:
    """Bucket scan by name; any other name is an error."""
    if name not in ("all", "new", "fraud"):
        raise ValueError(f"no such bucket: {name!r} (all, new or fraud)")
    return bucket_tables(txn)[name]
