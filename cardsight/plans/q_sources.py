"""Sources, sinks, streaming, projections and display (S1, S2, S4-S8, T1,
P1, P2, P4, P5, P7, P9, X17, X18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardsight.constants import DECISION_THRESHOLD, HIGH_CARD_COLS
from cardsight.functions import display
from cardsight.operators import cases as cmd
from cardsight.operators import features as fe
from cardsight.operators import filters as flt
from cardsight.plans.catalog import register
from cardsight.plans.common import cases, r2, r6, txn, unnumbered_cases
from cardsight.plans.oracle_views import with_cases, with_txn
from cardsight.sources import files, tables

# ---------------------------------------------------------------- S1, S2, S4-S8


@register("s01_csv_scan", with_txn("""
SELECT count(*) AS n, round(sum(amt), 2) AS total_amount, count(DISTINCT trans_num) AS n_keys,
       count(*) FILTER (WHERE CAST(split_part(trans_num, '-', 1) AS BIGINT) % 50 = 0) AS n_bad_times
FROM txn"""))
def s01_csv_scan(spark, sf_dir):
    """The raw feed written as CSV (by Spark, from the tables), read
    back with the fixed schema."""
    feed_rows = tables.txn_text_view(txn(spark, sf_dir), 50).select(*files.TXN_TEXT_SCHEMA.fieldNames())
    path = files.write_csv(feed_rows, files.scratch_path(spark, "feed-csv"))
    feed = files.read_csv(spark, path)
    return feed.agg(F.count(F.lit(1)).alias("n"), r2(F.sum("amt")).alias("total_amount"),
                    F.count_distinct("trans_num").alias("n_keys"),
                    F.count_if(F.col("trans_date_trans_time") == "bad").alias("n_bad_times"))


@register("s02_scan_pushdown", """
SELECT l_orderkey, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2001-06-01 00:00:00' AND l_discount >= 0.09""")
def s02_scan_pushdown(spark, sf_dir):
    """Parquet scan; the filter and the two-column projection reach the
    reader (PushedFilters / ReadSchema in the plan)."""
    li = tables.read_table(spark, sf_dir, "lineitem")
    return li.filter((F.col("l_shipdate") >= F.lit("2001-06-01 00:00:00").cast("timestamp_ntz"))
                     & (F.col("l_discount") >= 0.09)).select("l_orderkey", "l_extendedprice")


@register("s04_parquet_round_trip", with_txn("""
SELECT count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, round(sum(fraud_score), 6) AS score_sum FROM txn"""))
def s04_parquet_round_trip(spark, sf_dir):
    """Snappy Parquet sink, read back."""
    path = files.write_parquet(txn(spark, sf_dir), files.scratch_path(spark, "txn-parquet"))
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").cast("bigint").alias("n_fraud"),
                    r6(F.sum("fraud_score")).alias("score_sum"))


@register("s05_state_partitions", with_txn("""
SELECT state, count(*) AS n_rows FROM txn GROUP BY state"""))
def s05_state_partitions(spark, sf_dir):
    """One folder per state, with its row count."""
    path = files.write_by_state(txn(spark, sf_dir), files.scratch_path(spark, "by-state"))
    return files.partition_counts(spark, path)


@register("s07_partition_discovery", with_txn("SELECT DISTINCT state FROM txn"))
def s07_partition_discovery(spark, sf_dir):
    """Sorted states present in the partitioned table."""
    path = files.write_by_state(txn(spark, sf_dir).select("state", "trans_num"), files.scratch_path(spark, "states"))
    return files.partition_values(spark, path)


@register("s06_csv_export", with_txn("""
SELECT trans_num, merchant, round(amt, 2) AS amt, is_fraud FROM txn WHERE is_fraud = 1
ORDER BY trans_num LIMIT 1000"""))
def s06_csv_export(spark, sf_dir):
    """Export of the fraud bucket (first 1,000 in id order) to CSV."""
    fraud = tables.bucket(txn(spark, sf_dir), "fraud").select("trans_num", "merchant", "amt", "is_fraud")
    back = files.export_csv(fraud, files.scratch_path(spark, "export"), limit=1000)
    return back.select("trans_num", "merchant", r2(F.col("amt")).alias("amt"), "is_fraud")


@register("s08_lookup_round_trip", with_txn("""
, te AS (SELECT merchant, count(*) AS n, avg(is_fraud) AS mean FROM txn GROUP BY merchant),
p AS (SELECT avg(is_fraud) AS prior FROM txn)
SELECT 'merchant' AS lookup, merchant AS key,
       round(p.prior * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + mean * (1 / (1 + exp(-(n - 20) / 10.0))), 6) AS value
FROM te, p
UNION ALL SELECT 'state', state, round(avg(is_fraud), 6) FROM txn GROUP BY state"""))
def s08_lookup_round_trip(spark, sf_dir):
    """Fitted lookups (merchant encoding, state rates) saved as Parquet
    and both loaded back."""
    t = txn(spark, sf_dir)
    enc, _ = fe.fit_target_encoder(t)
    paths = files.save_lookups(files.scratch_path(spark, "artifact"), merchant_te=enc,
                               state_rate=fe.rate_table(t, "state", name="state_rate"))
    loaded = files.load_lookups(spark, paths)
    te = loaded["merchant_te"].select(F.lit("merchant").alias("lookup"), F.col("merchant").alias("key"),
                                      r6(F.col("encoding")).alias("value"))
    return te.unionByName(loaded["state_rate"].select(F.lit("state").alias("lookup"), F.col("state").alias("key"),
                                                      r6(F.col("state_rate")).alias("value")))


# ---------------------------------------------------------------- T1

STREAM_FIELDS = ["trans_num", "merchant", "category", "amt", "state", "trans_date_trans_time", "dob"]


@register("t01_stream_scoring", with_txn("""
, feed AS (SELECT *, CAST(split_part(trans_num, '-', 1) AS BIGINT) % 50 = 0 AS bad_time,
             coalesce(merchant, '') = '' OR coalesce(category, '') = '' OR coalesce(amt, 0) = 0 OR cc_num % 23 = 0 OR state IS NULL
               OR state = '' AS hollow
           FROM txn WHERE trans_ts >= TIMESTAMP '2000-01-01 00:00:00'),
held AS (SELECT * FROM feed WHERE NOT bad_time AND NOT hollow)
SELECT 'arrived' AS what, count(*) AS n FROM feed
UNION ALL SELECT 'all', count(*) FROM held
UNION ALL SELECT 'new', count(*) FROM held
UNION ALL SELECT 'rejected: incomplete', count(*) FROM feed WHERE hollow
UNION ALL SELECT 'rejected: time', count(*) FROM feed WHERE bad_time AND NOT hollow
UNION ALL SELECT 'fraud_without_case', 0
UNION ALL SELECT 'case_without_fraud', 0
UNION ALL SELECT 'gaps_in_case_ids', 0
UNION ALL SELECT 'gaps_in_all_ids', 0
UNION ALL SELECT 'gaps_in_new_ids', 0
UNION ALL SELECT 'gaps_in_fraud_ids', 0
UNION ALL SELECT 'routed_against_score', 0"""))
def t01_stream_scoring(spark, sf_dir):
    """The held-out text feed arrives as files (a part of its merchants blank); each micro-batch is checked (F12,
    F10), its accepted rows turned into features by the reloaded model, scored by the ensemble and
    routed to all / new / fraud with record ids, and opens cases; rejected rows go to a table of their own with
    the reason. Returns table sizes and the counts of rows that break the routing's rules."""
    from cardsight.operators import models as ml
    from cardsight.plans.q_models import _saved, _split_text
    from cardsight.streaming.scoring import reject_reasons, start_scoring_stream
    fm, models, _ = _saved(spark, sf_dir)
    _, feed = _split_text(spark, sf_dir)
    src, out = files.scratch_path(spark, "arrivals"), files.scratch_path(spark, "routed")
    feed = feed.withColumn("merchant", F.when(F.col("cc_num") % 23 == 0, F.lit("")).otherwise(F.col("merchant")))
    feed.drop("is_fraud", "fraud_score").repartition(4).write.parquet(src)
    carried = ("cc_num", "merchant", "category", "amt", "trans_date_trans_time")

    def scorer(batch):
        feats = fe.transform(batch, fm, with_label=False, reuse_votes=True, carry=carried, stored=True)
        scored = ml.ensemble_scores(feats, models, out="fraud_score")
        return scored.withColumnRenamed("trans_date_trans_time", "trans_ts").withColumn("arrived_at", F.col("trans_ts"))

    q = start_scoring_stream(spark, src, spark.read.parquet(src).schema, scorer, out,
                             files.scratch_path(spark, "stream-ckpt"), max_files_per_trigger=2,
                             checker=lambda batch: reject_reasons(batch, STREAM_FIELDS, fm.votes))
    q.awaitTermination()
    # A bucket without rows has no files to take a schema from.
    columns = {"cases": "trans_num string, case_id long", "rejected": "trans_num string, reason string"}
    stored = {name: spark.read.schema(columns.get(name, "trans_num string, fraud_score double, is_fraud int, record_id long"))
              .parquet(f"{out}/{name}") for name in ("all", "new", "fraud", "cases", "rejected")}
    n = F.count(F.lit(1))
    fraud, opened = (stored[t].groupBy("trans_num").agg(n.alias(f"n_{t}")) for t in ("fraud", "cases"))
    apart = fraud.join(opened, "trans_num", "full").na.fill(0)

    def gaps(table, column):  # ids are 1 to the number of rows, each once
        c = F.col(column)
        return table.agg((n - F.count_distinct(c) + F.coalesce(F.max(c) - n, F.lit(0)) + F.coalesce(F.min(c) - 1, F.lit(0))).alias("n"))

    parts = {"arrived": spark.read.parquet(src).agg(n.alias("n")), "all": stored["all"].agg(n.alias("n")),
             "new": stored["new"].agg(n.alias("n")),
             "rejected: incomplete": stored["rejected"].filter("reason = 'incomplete'").agg(n.alias("n")),
             "rejected: time": stored["rejected"].filter("reason = 'time'").agg(n.alias("n")),
             "fraud_without_case": apart.filter("n_fraud > n_cases").agg(n.alias("n")),
             "case_without_fraud": apart.filter("n_cases > n_fraud").agg(n.alias("n")),
             "gaps_in_case_ids": gaps(stored["cases"], "case_id"),
             **{f"gaps_in_{b}_ids": gaps(stored[b], "record_id") for b in ("all", "new", "fraud")},
             "routed_against_score": stored["all"].filter((F.col("fraud_score") >= DECISION_THRESHOLD) != (F.col("is_fraud") == 1))
             .agg(n.alias("n"))}
    res = None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("what"), "n")
        res = row if res is None else res.unionByName(row)
    return res


# ---------------------------------------------------------------- P1, P2, P4, P5, P7, P9

DROPPED = [c for c in HIGH_CARD_COLS]


@register("p01_drop_identifying", with_txn(
    "SELECT * EXCLUDE (cc_num, city, job, trans_num) FROM txn"))
def p01_drop_identifying(spark, sf_dir):
    """P1 (tolerant): identifying / high-cardinality columns dropped when
    present."""
    return fe.drop_columns(txn(spark, sf_dir), DROPPED)


@register("p01_drop_strict", with_txn("SELECT * EXCLUDE (cc_num, city, job, trans_num) FROM txn"))
def p01_drop_strict(spark, sf_dir):
    """P1 (strict): the same columns, each of which has to be there."""
    t = txn(spark, sf_dir)
    return fe.drop_columns(t, [c for c in DROPPED if c in t.columns], strict=True)


@register("p02_align_columns", with_txn("""
SELECT trans_num, amt, CAST(NULL AS DOUBLE) AS merchant_te, state FROM txn"""))
def p02_align_columns(spark, sf_dir):
    """Expected columns in order, missing ones null, extra ones gone."""
    t = txn(spark, sf_dir)
    return fe.align(t, ["trans_num", "amt", "merchant_te", "state"])


@register("p04_alias_names", with_txn("""
SELECT trans_num AS txn_id, cc_num AS card_id, amt AS amount, trans_ts AS trans_time FROM txn"""))
def p04_alias_names(spark, sf_dir):
    """Field names to their aliases."""
    return cmd.to_aliases(txn(spark, sf_dir)).select("txn_id", "card_id", "amount", "trans_time")


@register("p05_defaults", with_txn("""
SELECT CASE WHEN cc_num % 4 = 0 THEN 0 ELSE is_fraud END AS is_fraud, 'open' AS status,
       TIMESTAMP '2001-12-01 00:00:00' AS created_at, count(*) AS n
FROM txn GROUP BY 1, 2, 3"""))
def p05_defaults(spark, sf_dir):
    """P5: absent label -> 0, absent status -> open, absent time -> as_of."""
    t = txn(spark, sf_dir)
    incoming = t.withColumn("is_fraud", F.when(F.col("cc_num") % 4 == 0, F.lit(None)).otherwise(F.col("is_fraud")))
    filled = cmd.with_defaults(incoming.withColumn("status", F.lit(None).cast("string")), "2001-12-01 00:00:00")
    return filled.groupBy("is_fraud", "status", "created_at").agg(F.count(F.lit(1)).alias("n"))


@register("p07_float32", with_txn("""
SELECT trans_num, CAST(amt AS FLOAT) AS amt FROM txn"""))
def p07_float32(spark, sf_dir):
    """Numeric columns down-cast to 32-bit floats."""
    t = txn(spark, sf_dir).select("trans_num", "amt")
    return fe.downcast(t.withColumnRenamed("amt", "num__amt")).withColumnRenamed("num__amt", "amt")


@register("p09_id_normalise", with_txn("""
, u AS (SELECT trans_num, sha256(trans_num) AS h FROM txn)
SELECT trans_num, substr(h, 1, 32) AS id, substr(h, 1, 32) AS id_of_binary FROM u"""))
def p09_id_normalise(spark, sf_dir):
    """UUID-shaped ids (upper case, dashed) normalised to 32 lower hex
    digits, and so are binary ids; other ids kept."""
    t = txn(spark, sf_dir)
    h = F.sha2(F.col("trans_num"), 256)
    dashed = F.upper(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                                 F.substring(h, 17, 4), F.substring(h, 21, 12)))
    return t.select("trans_num", flt.normalise_id(dashed).alias("id"),
                    flt.normalise_id(F.unhex(F.substring(h, 1, 32))).alias("id_of_binary"))


# ---------------------------------------------------------------- X17, X18

@register("x17_case_text", with_cases("""
SELECT case_id, array_to_string(txn_ids, ', ') AS txn_text,
       upper(substr(status, 1, 1)) || substr(status, 2) AS status_text FROM cases"""))
def x17_case_text(spark, sf_dir):
    """Id arrays as text and prettified labels."""
    c = cases(spark, sf_dir)
    return c.select("case_id", display.join_ids("txn_ids").alias("txn_text"),
                    display.pretty_name("status").alias("status_text"))


@register("x18_money_text", with_txn("""
SELECT trans_num, format('{:,.2f}', amt) AS amount_text FROM txn"""))
def x18_money_text(spark, sf_dir):
    """Amounts with two decimals and thousands separators."""
    t = txn(spark, sf_dir)
    return t.select("trans_num", display.money("amt").alias("amount_text"))


@register("p03_two_fields", with_cases("SELECT trans_ts, is_fraud FROM cases"))
def p03_two_fields(spark, sf_dir):
    """Include projection (the case series reads two fields only)."""
    return unnumbered_cases(spark, sf_dir).select("trans_ts", "is_fraud")


@register("x19_stable_ids", with_txn("""
SELECT count(DISTINCT substr(sha256(concat_ws('|', trans_num, CAST(cc_num AS VARCHAR))), 1, 32)) AS n_ids,
       count(*) AS n FROM txn"""))
def x19_stable_ids(spark, sf_dir):
    """Repeatable 32-hex ids for new transactions (the random variant,
    ``display.random_id``, is not repeatable and so not checked)."""
    t = txn(spark, sf_dir).select(display.stable_id("trans_num", "cc_num").alias("id"))
    return t.agg(F.count_distinct("id").alias("n_ids"), F.count(F.lit(1)).alias("n"))


@register("f11_invalid_status", with_cases("""
SELECT case_id, status FROM (
  SELECT case_id, CASE WHEN case_id % 1000 = 0 THEN 'escalated' ELSE status END AS status FROM cases)
WHERE status NOT IN ('open', 'investigating', 'closed') OR status IS NULL"""))
def f11_invalid_status(spark, sf_dir):
    """F11 on data: cases whose status is outside the allowed set (a few
    statuses are rewritten to an unknown value to exercise the check)."""
    from cardsight.constants import CASE_STATUSES
    c = cases(spark, sf_dir).withColumn(
        "status", F.when(F.col("case_id") % 1000 == 0, F.lit("escalated")).otherwise(F.col("status")))
    return flt.invalid_rows(c, "status", CASE_STATUSES).select("case_id", "status")


@register("f14_nonzero_shares", with_cases("""
, r AS (SELECT merchant, count(*) FILTER (WHERE is_fraud = 1) AS f, count(*) FILTER (WHERE is_fraud = 0) AS nf
        FROM cases GROUP BY merchant)
SELECT merchant, name, value FROM (
  SELECT merchant, 'fraud' AS name, round(CASE WHEN f + nf = 0 THEN 0.0 ELSE f / (f + nf) * 100 END, 6) AS value FROM r
  UNION ALL
  SELECT merchant, 'non_fraud', round(CASE WHEN f + nf = 0 THEN 0.0 ELSE nf / (f + nf) * 100 END, 6) FROM r)
WHERE value > 0"""))
def f14_nonzero_shares(spark, sf_dir):
    """slices of every merchant's success rate with zero shares dropped."""
    y = F.col("is_fraud")
    counts = unnumbered_cases(spark, sf_dir).groupBy("merchant").agg(F.count_if(y == 1).alias("f"), F.count_if(y == 0).alias("nf"))
    def share(c):
        return F.coalesce(r6(F.try_divide(F.col(c).cast("double"), F.col("f") + F.col("nf")) * F.lit(100.0)), F.lit(0.0))
    slices = counts.select("merchant", F.explode(F.array(
        F.struct(F.lit("fraud").alias("name"), share("f").alias("value")),
        F.struct(F.lit("non_fraud").alias("name"), share("nf").alias("value")))).alias("s"))
    return flt.drop_zero(slices.select("merchant", "s.*"), "value")


@register("f12_completeness", with_txn("""
, incoming AS (SELECT trans_num, CASE WHEN cc_num % 13 = 0 THEN '' ELSE merchant END AS merchant,
                      CASE WHEN cc_num % 17 = 0 THEN 0.0 ELSE amt END AS amt, category FROM txn)
SELECT CASE WHEN merchant IS NULL OR merchant = '' OR amt IS NULL OR amt = 0 OR category IS NULL OR category = ''
            THEN 'rejected' ELSE 'accepted' END AS outcome, count(*) AS n
FROM incoming GROUP BY 1"""))
def f12_completeness(spark, sf_dir):
    """an incoming row with an empty text or a zero amount is
    rejected (blank merchants and zero amounts injected into the feed)."""
    t = txn(spark, sf_dir).select(
        "trans_num", F.when(F.col("cc_num") % 13 == 0, F.lit("")).otherwise(F.col("merchant")).alias("merchant"),
        F.when(F.col("cc_num") % 17 == 0, F.lit(0.0)).otherwise(F.col("amt")).alias("amt"), "category")
    ok, bad = flt.split_complete(t, ["merchant", "amt", "category"])
    return ok.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("outcome"), "n").unionByName(
        bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("outcome"), "n"))
