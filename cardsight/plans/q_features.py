"""Feature building and its pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardsight.constants import DOB_FORMATS, FORMAT_STOP_SHARE, TS_FORMATS
from cardsight.functions import dates
from cardsight.operators import features as fe
from cardsight.plans.catalog import register
from cardsight.plans.common import r6, txn
from cardsight.plans.oracle_views import with_txn
from cardsight.sources import files, tables


def _text(spark, sf_dir, spoil=50):
    """The raw text feed, written as the table that a feed is: the fits read it several times."""
    path = files.scratch_path(spark, "feed")
    return spark.read.parquet(files.write_parquet(tables.txn_text_view(txn(spark, sf_dir), spoil_mod=spoil), path))


# ---------------------------------------------------------------- A17, X1-X8

# DuckDB equivalents of the candidate formats, in the same order.
DUCK_TS = ["%m/%d/%y %H:%M", "%m/%d/%y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S",
           "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M %p"]


def vote_table(df, column, formats):
    """A17 as a table: failures per candidate and the chosen one, from one
    aggregation (the choice rule runs over the handful of candidate rows)."""
    raw = dates.collapse_ws(column)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(dates.parse_with(raw, f).isNull()).alias(f"f{i}") for i, f in enumerate(formats)]
    counts = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(f).alias("fmt"), F.col(f"f{i}").alias("failures"))
                      for i, f in enumerate(formats)])
    long = counts.select("rows", F.explode(cells).alias("c")).select("rows", "c.*")
    from pyspark.sql import Window
    w = Window.partitionBy()  # over the few candidate rows only
    stop = F.min(F.when(F.col("failures") <= F.lit(FORMAT_STOP_SHARE) * F.col("rows"), F.col("idx"))).over(w)
    best = F.min(F.struct(F.col("failures"), F.col("idx"))).over(w)
    chosen_idx = F.coalesce(stop, best["idx"])
    fallback = best["failures"] == F.col("rows")
    return long.select("idx", "fmt", "failures",
                       ((F.col("idx") == chosen_idx) & ~fallback).alias("chosen"))


def _vote_sql():
    rows = [f"SELECT {i} AS idx, '{TS_FORMATS[i]}' AS fmt, count(*) FILTER (WHERE try_strptime("
            f"trim(regexp_replace(trans_date_trans_time, '\\s+', ' ', 'g')), '{DUCK_TS[i]}') IS NULL) AS failures, "
            f"count(*) AS rows FROM txn_text" for i in range(len(TS_FORMATS))]
    union = "\n  UNION ALL ".join(rows)
    return f"""
, v AS ({union}),
s AS (SELECT min(idx) FILTER (WHERE failures <= {FORMAT_STOP_SHARE} * rows) AS stop,
             arg_min(idx, failures * 100 + idx) AS best_idx, min(failures) AS best_f, max(rows) AS n FROM v)
SELECT idx, fmt, failures, (idx = coalesce(stop, best_idx) AND best_f <> n) AS chosen FROM v, s"""


def _txn_text_cte(mod):
    return f""", txn_text AS (
SELECT * EXCLUDE (trans_ts, dob),
       CASE WHEN CAST(split_part(trans_num, '-', 1) AS BIGINT) % {mod} = 0 THEN 'bad'
            ELSE strftime(trans_ts, '%-m/%-d/%Y %-H:%M') END AS trans_date_trans_time,
       strftime(dob, '%Y-%m-%d') AS dob
FROM txn)"""


@register("a17_format_vote", with_txn(_txn_text_cte(50) + _vote_sql()))
def a17_format_vote(spark, sf_dir):
    """A17 with 2 % bad rows: the stop rule accepts the first good format."""
    return vote_table(_text(spark, sf_dir, 50), "trans_date_trans_time", TS_FORMATS)


@register("a17_format_vote_noisy", with_txn(_txn_text_cte(10) + _vote_sql()))
def a17_format_vote_noisy(spark, sf_dir):
    """A17 with 10 % bad rows: no format passes the stop rule; the best wins."""
    return vote_table(_text(spark, sf_dir, 10), "trans_date_trans_time", TS_FORMATS)


@register("x02_parsed_times", with_txn("""
SELECT count(*) AS n, min(date_trunc('minute', trans_ts)) AS first_ts, max(date_trunc('minute', trans_ts)) AS last_ts,
       min(CAST(dob AS TIMESTAMP)) AS first_dob, max(CAST(dob AS TIMESTAMP)) AS last_dob
FROM txn WHERE CAST(split_part(trans_num, '-', 1) AS BIGINT) % 50 <> 0"""))
def x02_parsed_times(spark, sf_dir):
    """X2 + X3 + F10: text times parsed with the voted format, unparsed rows
    dropped."""
    parsed = dates.parse_times(_text(spark, sf_dir, 50))
    kept = parsed.dropna(subset=["trans_date_trans_time", "dob"])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min("trans_date_trans_time").alias("first_ts"),
                    F.max("trans_date_trans_time").alias("last_ts"), F.min("dob").alias("first_dob"),
                    F.max("dob").alias("last_dob"))


@register("x03_two_digit_years", with_txn("""
SELECT CAST(CASE WHEN year(dob) <= 2068 - 100 THEN year(dob) + 100 ELSE year(dob) END AS INT) AS birth_year,
       count(*) AS n
FROM txn GROUP BY 1"""))
def x03_two_digit_years(spark, sf_dir):
    """Birth dates written ``M/d/yy``: years 69-99 are 19xx, 00-68 20xx."""
    t = txn(spark, sf_dir).withColumn("dob_text", F.date_format("dob", "M/d/yy"))
    vote = dates.vote_format(t, "dob_text", DOB_FORMATS)
    parsed = dates.parse_column(t, "dob_text", DOB_FORMATS, vote=vote)
    return parsed.groupBy(F.year("dob_text").alias("birth_year")).agg(F.count(F.lit(1)).alias("n"))


@register("x05_ages", with_txn("""
SELECT CAST(floor(floor(date_diff('second', CAST(dob AS TIMESTAMP), trans_ts) / 86400) / 365) AS BIGINT) AS age,
       count(*) AS n
FROM txn GROUP BY 1"""))
def x05_ages(spark, sf_dir):
    """Whole days from birth to the transaction, floor-divided by 365."""
    t = txn(spark, sf_dir)
    return t.groupBy(dates.age_years("trans_ts", "dob").alias("age")).agg(F.count(F.lit(1)).alias("n"))


@register("x06_time_parts", with_txn("""
SELECT CAST(hour(trans_ts) AS INT) AS txn_hour, CAST(isodow(trans_ts) - 1 AS INT) AS txn_dow,
       CAST(month(trans_ts) AS INT) AS txn_month, count(*) AS n
FROM txn GROUP BY 1, 2, 3"""))
def x06_time_parts(spark, sf_dir):
    """Hour, weekday (Monday = 0), month."""
    t = txn(spark, sf_dir)
    return t.groupBy(dates.hour_of("trans_ts").alias("txn_hour"), dates.day_of_week("trans_ts").alias("txn_dow"),
                     dates.month_of("trans_ts").alias("txn_month")).agg(F.count(F.lit(1)).alias("n"))


@register("x08_seconds_of_day", with_txn("""
SELECT count(*) AS n, CAST(sum(hour(trans_ts) * 3600 + minute(trans_ts) * 60 + second(trans_ts)) AS BIGINT) AS secs
FROM txn"""))
def x08_seconds_of_day(spark, sf_dir):
    """``HH:MM:SS`` text to seconds since midnight."""
    t = txn(spark, sf_dir).withColumn("tod", F.date_format("trans_ts", "HH:mm:ss"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum(dates.seconds_of_day("tod")).cast("bigint").alias("secs"))


@register("x01_whitespace", with_txn("""
SELECT trim(regexp_replace('  ' || category || ' \t  ' || city || '  ', '\\s+', ' ', 'g')) AS label, count(*) AS n
FROM txn GROUP BY 1"""))
def x01_whitespace(spark, sf_dir):
    """Whitespace runs collapsed and ends trimmed."""
    t = txn(spark, sf_dir)
    messy = F.concat(F.lit("  "), F.col("category"), F.lit(" \t  "), F.col("city"), F.lit("  "))
    return t.groupBy(dates.collapse_ws(messy).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("x09_x10_amount_distance", with_txn("""
SELECT round(sum(ln(1 + amt)), 4) AS sum_amt_log,
       round(sum(sqrt(pow(merch_lat - lat, 2) + pow(merch_long - long, 2))), 4) AS sum_distance
FROM txn"""))
def x09_x10_amount_distance(spark, sf_dir):
    """X9 log(1 + amount), X10 distance in degrees."""
    t = txn(spark, sf_dir)
    dist = F.sqrt(F.pow(F.col("merch_lat") - F.col("lat"), 2) + F.pow(F.col("merch_long") - F.col("long"), 2))
    return t.agg(F.round(F.sum(F.log1p("amt")), 4).alias("sum_amt_log"), F.round(F.sum(dist), 4).alias("sum_distance"))


# ---------------------------------------------------------------- A15, J1-J3, X15, X16

TE_SQL = """
, te AS (SELECT merchant, count(*) AS n, avg(is_fraud) AS mean FROM txn GROUP BY merchant),
prior AS (SELECT avg(is_fraud) AS prior FROM txn),
tee AS (SELECT merchant, n, mean,
               (SELECT prior FROM prior) * (1 - 1 / (1 + exp(-(n - 20) / 10.0)))
               + mean * (1 / (1 + exp(-(n - 20) / 10.0))) AS encoding FROM te)
"""


@register("a15_target_encoding", with_txn(TE_SQL + """
SELECT merchant, n, round(mean, 6) AS mean, round(encoding, 6) AS encoding FROM tee"""))
def a15_target_encoding(spark, sf_dir):
    enc, _ = fe.fit_target_encoder(txn(spark, sf_dir))
    return enc.select("merchant", "n", r6(F.col("mean")).alias("mean"), r6(F.col("encoding")).alias("encoding"))


@register("j02_merchant_encoding_applied", with_txn("""
, base AS (SELECT * FROM txn WHERE trans_ts < TIMESTAMP '2000-01-01 00:00:00'),
te AS (SELECT merchant, count(*) AS n, avg(is_fraud) AS mean FROM base GROUP BY merchant),
tee AS (SELECT merchant, (SELECT avg(is_fraud) FROM base) * (1 - 1 / (1 + exp(-(n - 20) / 10.0)))
               + mean * (1 / (1 + exp(-(n - 20) / 10.0))) AS encoding FROM te)
SELECT t.merchant, round(coalesce(tee.encoding, (SELECT avg(is_fraud) FROM base)), 6) AS merchant_te, count(*) AS n
FROM txn t LEFT JOIN tee ON t.merchant = tee.merchant
WHERE t.trans_ts >= TIMESTAMP '2000-01-01 00:00:00' GROUP BY 1, 2"""))
def j02_merchant_encoding_applied(spark, sf_dir):
    """Encoder fitted on earlier rows, applied to later ones (unknown
    merchants get the prior)."""
    t = txn(spark, sf_dir)
    cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    enc, prior = fe.fit_target_encoder(t.filter(F.col("trans_ts") < cut))
    applied = fe.apply_target_encoder(t.filter(F.col("trans_ts") >= cut), enc, prior)
    return applied.groupBy("merchant", r6(F.col("merchant_te")).alias("merchant_te")).agg(
        F.count(F.lit(1)).alias("n"))


@register("j01_state_risk", with_txn("""
, base AS (SELECT * FROM txn WHERE trans_ts < TIMESTAMP '2000-01-01 00:00:00'),
r AS (SELECT state, avg(is_fraud) AS state_rate FROM base GROUP BY state)
SELECT t.state, round(coalesce(r.state_rate, (SELECT avg(is_fraud) FROM base)), 6) AS state_risk, count(*) AS n
FROM txn t LEFT JOIN r ON t.state = r.state
WHERE t.trans_ts >= TIMESTAMP '2000-01-01 00:00:00' GROUP BY 1, 2"""))
def j01_state_risk(spark, sf_dir):
    """State -> fraud rate of earlier rows, global rate when unseen."""
    t = txn(spark, sf_dir)
    cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    base = t.filter(F.col("trans_ts") < cut)
    rates = fe.rate_table(base, "state", name="state_rate")
    global_rate = float(base.agg(F.avg("is_fraud")).first()[0])
    out = fe.with_rate(t.filter(F.col("trans_ts") >= cut), rates, "state", "state_rate", global_rate,
                       out="state_risk")
    return out.groupBy("state", r6(F.col("state_risk")).alias("state_risk")).agg(F.count(F.lit(1)).alias("n"))


@register("j03_inverse_lookup", with_txn("""
, r AS (SELECT state, round(avg(is_fraud), 2) AS rate FROM txn GROUP BY state),
inv AS (SELECT rate, max(state) AS state FROM r GROUP BY rate),
t AS (SELECT txn.state AS orig, round(r.rate, 2) AS rate FROM txn JOIN r ON txn.state = r.state)
SELECT inv.state AS recovered_state, count(*) AS n FROM t JOIN inv ON t.rate = inv.rate GROUP BY 1"""))
def j03_inverse_lookup(spark, sf_dir):
    """Risk value back to a state; states sharing a (rounded) rate
    collapse to the last state."""
    t = txn(spark, sf_dir)
    rates = t.groupBy("state").agg(F.round(F.avg("is_fraud"), 2).alias("rate"))
    inv = fe.inverse_lookup(rates, "state", "rate").withColumnRenamed("state", "recovered_state")
    with_rate = fe.join_lookup(t.select("state"), rates, "state", how="inner")
    return fe.join_lookup(with_rate, inv, "rate", how="inner").groupBy("recovered_state").agg(
        F.count(F.lit(1)).alias("n"))


@register("x15_state_codes", with_txn("""
SELECT state, CAST(row_number() OVER (ORDER BY state) - 1 AS INT) AS state_code FROM (SELECT DISTINCT state FROM txn)"""))
def x15_state_codes(spark, sf_dir):
    """Label codes in sorted order from 0."""
    return fe.label_codes(txn(spark, sf_dir), "state")


# The coded columns; the view's street is null, and a null has no code.
CODED = ["merchant", "category", "gender", "job", "city", "state", "street"]
CODES_SQL = """
, v AS (SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c if c != 'street' else 'CAST(NULL AS VARCHAR)'} AS value FROM txn" for c in CODED) + """)
        WHERE value IS NOT NULL),
codes AS (SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INT) AS code
          FROM (SELECT DISTINCT "column", value FROM v))"""


def _with_street(spark, sf_dir):
    t = txn(spark, sf_dir)
    return t if "street" in t.columns else t.withColumn("street", F.lit(None).cast("string"))


@register("x15_codes", with_txn(CODES_SQL + 'SELECT "column", value, code FROM codes'))
def x15_codes(spark, sf_dir):
    """Label codes of all seven columns from one grouped pass and one segmented numbering."""
    return fe.codes_of(_with_street(spark, sf_dir), CODED)


@register("x15_encoded_csv", with_txn(CODES_SQL + """
SELECT v."column", count(*) AS n, CAST(sum(code) AS BIGINT) AS code_sum FROM v JOIN codes ON codes."column" = v."column"
  AND codes.value = v.value GROUP BY 1"""))
def x15_encoded_csv(spark, sf_dir):
    """The table with its seven columns coded, written as CSV and read back; per column, codes and their sum."""
    t = _with_street(spark, sf_dir).select("trans_num", *CODED)
    coded = fe.encode_columns(t, fe.codes_of(t, CODED), CODED)
    path = files.write_csv(coded, files.scratch_path(spark, "coded"))
    back = files.read_csv(spark, path, coded.schema)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("code")) for c in CODED])
    return (back.select(F.explode(pairs).alias("p")).select("p.*").filter("code is not null").groupBy("column")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("code").cast("bigint").alias("code_sum")))


@register("x16_code_round_trip", with_txn("""
SELECT state, count(*) AS n FROM txn GROUP BY state"""))
def x16_code_round_trip(spark, sf_dir):
    """X15 then X16: encode states to codes, decode back, count."""
    t = txn(spark, sf_dir)
    codes = fe.label_codes(t, "state")
    coded = fe.encode(t.select("state"), codes, "state").select("state_code")
    return fe.decode(coded, codes, "state").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- A16, M1

ENG_SQL = TE_SQL + """,
parsed AS (SELECT *, date_trunc('minute', trans_ts) AS ts_p, CAST(dob AS TIMESTAMP) AS dob_p FROM txn
           WHERE CAST(split_part(trans_num, '-', 1) AS BIGINT) % 50 <> 0),
eng AS (
  SELECT p.trans_num, p.state, p.category, p.is_fraud,
         CAST(p.city_pop AS DOUBLE) AS city_pop,
         floor(floor(date_diff('second', dob_p, ts_p) / 86400) / 365) AS age,
         CAST(hour(ts_p) AS DOUBLE) AS txn_hour, CAST(isodow(ts_p) - 1 AS DOUBLE) AS txn_dow,
         CAST(month(ts_p) AS DOUBLE) AS txn_month,
         coalesce(tee.encoding, (SELECT prior FROM prior)) AS merchant_te,
         ln(1 + amt) AS amt_log,
         sqrt(pow(merch_lat - lat, 2) + pow(merch_long - long, 2)) AS distance
  FROM parsed p LEFT JOIN tee ON p.merchant = tee.merchant),
cats AS (SELECT DISTINCT category AS v FROM parsed),
long AS (
  SELECT trans_num, 'city_pop' AS feature, city_pop AS value FROM eng
  UNION ALL SELECT trans_num, 'age', age FROM eng
  UNION ALL SELECT trans_num, 'txn_hour', txn_hour FROM eng
  UNION ALL SELECT trans_num, 'txn_dow', txn_dow FROM eng
  UNION ALL SELECT trans_num, 'txn_month', txn_month FROM eng
  UNION ALL SELECT trans_num, 'merchant_te', merchant_te FROM eng
  UNION ALL SELECT trans_num, 'amt_log', amt_log FROM eng
  UNION ALL SELECT trans_num, 'distance', distance FROM eng
  UNION ALL SELECT trans_num, 'amt_x_category_' || cats.v, CASE WHEN category = cats.v THEN amt_log ELSE 0 END
    FROM eng CROSS JOIN cats),
stats AS (SELECT feature, median(value) AS med, avg(value) AS mean, stddev_pop(value) AS std
          FROM long GROUP BY feature)
"""


@register("a16_feature_stats", with_txn(ENG_SQL + """
SELECT feature, round(med, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std FROM stats"""))
def a16_feature_stats(spark, sf_dir):
    """Exact median, mean and population deviation of every numeric
    feature (imputer and scaler fit)."""
    model = fe.fit_features(_text(spark, sf_dir, 50))
    rows = [(c, model.medians[c], model.means[c], model.stds[c]) for c in model.num_cols]
    # The plain features' statistics are a few values per feature; those of the interactions lie in the level table.
    df = spark.createDataFrame(rows, "feature string, median double, mean double, std double").unionByName(
        model.levels.filter(F.col("column") == model.crossed).select(
            F.concat(F.lit(f"amt_x_{model.crossed}_"), "value").alias("feature"), "median", "mean", "std"))
    return df.select("feature", r6(F.col("median")).alias("median"), r6(F.col("mean")).alias("mean"),
                     r6(F.col("std")).alias("std"))


@register("m01_feature_summary", with_txn(ENG_SQL + """,
scaled AS (SELECT l.feature, (l.value - s.mean) / CASE WHEN s.std = 0 THEN 1 ELSE s.std END AS z
           FROM long l JOIN stats s ON l.feature = s.feature),
states AS (SELECT DISTINCT state AS v FROM eng),
onehot AS (
  SELECT 'cat__category_' || cats.v AS feature, CASE WHEN category = cats.v THEN 1.0 ELSE 0.0 END AS z
    FROM eng CROSS JOIN cats
  UNION ALL SELECT 'cat__state_' || states.v, CASE WHEN state = states.v THEN 1.0 ELSE 0.0 END
    FROM eng CROSS JOIN states),
risk AS (SELECT state, avg(is_fraud) AS state_rate FROM txn GROUP BY state),
allf AS (SELECT 'num__' || feature AS feature, z FROM scaled UNION ALL SELECT * FROM onehot
         UNION ALL SELECT 'state_risk', risk.state_rate FROM eng JOIN risk ON eng.state = risk.state)
SELECT feature, round(min(z), 6) AS min_value, round(max(z), 6) AS max_value, round(avg(z * z), 6) AS mean_square,
       count(*) AS n
FROM allf GROUP BY feature"""))
def m01_feature_summary(spark, sf_dir):
    """M1 end to end on a raw feed with text times: fit, transform, then per
    output column min, max, mean square and row count."""
    model, out = fe.fit_transform(_text(spark, sf_dir, 50), parts=True)
    long = fe.feature_summary(out.drop("features"), model)
    return long.select("feature", r6(F.col("lo")).alias("min_value"), r6(F.col("hi")).alias("max_value"),
                       r6(F.col("sq")).alias("mean_square"), "n")


@register("x14_hour_category_interaction", with_txn("""
, s AS (SELECT avg(hour(trans_ts)) AS m, stddev_samp(hour(trans_ts)) AS sd FROM txn),
z AS (SELECT category, (hour(trans_ts) - s.m) / CASE WHEN s.sd = 0 THEN 1 ELSE s.sd END AS zh FROM txn, s)
SELECT 'hour_x_category_' || c.v AS feature, round(sum(CASE WHEN z.category = c.v THEN zh ELSE 0 END), 4) AS total,
       round(max(CASE WHEN z.category = c.v THEN zh ELSE 0 END), 6) AS max_value
FROM z CROSS JOIN (SELECT DISTINCT category AS v FROM txn) c GROUP BY 1"""))
def x14_hour_category_interaction(spark, sf_dir):
    """X14 as intended: hour standardised with the sample deviation, times
    each category indicator."""
    t = txn(spark, sf_dir).withColumn("txn_hour", F.hour("trans_ts"))
    crossed = fe.scaled_hour_interaction(t).groupBy("category").agg(
        F.sum("hour_x_category").alias("s"), F.max("hour_x_category").alias("m"), F.count(F.lit(1)).alias("n"))
    others = F.lit(t.count()) > F.col("n")  # rows of other levels have 0 here
    return crossed.filter("category is not null").select(
        F.concat(F.lit("hour_x_category_"), "category").alias("feature"), F.round("s", 4).alias("total"),
        r6(F.when(others, F.greatest("m", F.lit(0.0))).otherwise(F.col("m"))).alias("max_value"))
