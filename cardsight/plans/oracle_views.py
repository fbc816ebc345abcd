"""DuckDB text of the derived views, for the oracle SQL of each query.

The driver registers only the base tables, so every oracle query carries
``txn`` (and ``cases`` where needed) as common table expressions.
"""

TXN_SELECT = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                 CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS trans_num,
       l_shipdate + to_seconds((l_orderkey*37 + l_linenumber*911) % 86400) AS trans_ts,
       o_custkey AS cc_num, s_name AS merchant, p_type AS category, p_brand AS job,
       l_extendedprice AS amt, n_name AS state, c_mktsegment AS city,
       CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       DATE '1955-01-01' + CAST(o_custkey*97 % 14600 AS INT) AS dob,
       25 + (o_custkey*7919 % 25000)/CAST(1000 AS DOUBLE) AS lat,
       -125 + (o_custkey*104729 % 60000)/CAST(1000 AS DOUBLE) AS long,
       25 + (o_custkey*7919 % 25000)/CAST(1000 AS DOUBLE)
          + ((l_suppkey*31 + l_linenumber*17) % 200 - 100)/CAST(10000 AS DOUBLE) AS merch_lat,
       -125 + (o_custkey*104729 % 60000)/CAST(1000 AS DOUBLE)
          + ((l_suppkey*53 + l_linenumber*29) % 200 - 100)/CAST(10000 AS DOUBLE) AS merch_long,
       50000 + CAST(o_custkey*6151 % 950000 AS INT) AS city_pop,
       CASE WHEN l_returnflag='R' AND l_discount >= 0.08 THEN 1 ELSE 0 END AS is_fraud,
       round(CAST(CASE WHEN l_returnflag='R' THEN 0.4 ELSE 0.0 END AS DOUBLE)
             + 4*l_discount + l_quantity/250, 6) AS fraud_score
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
JOIN nation ON c_nationkey=n_nationkey JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey
"""

CASES_SELECT = """
SELECT CAST(row_number() OVER (ORDER BY trans_ts, trans_num) AS BIGINT) AS case_id, [trans_num] AS txn_ids,
       CASE WHEN cc_num % 3 = 0 THEN 'open' WHEN cc_num % 3 = 1 THEN 'investigating' ELSE 'closed' END AS status,
       trans_ts + INTERVAL 1 DAY AS created_at,
       trans_num, trans_ts, amt, merchant, category, state, is_fraud, fraud_score, cc_num
FROM txn WHERE fraud_score >= 0.64
"""

TXN_CTE = f"WITH txn AS ({TXN_SELECT})"
CASES_CTE = f"WITH txn AS ({TXN_SELECT}), cases_cc AS ({CASES_SELECT}), " \
            "cases AS (SELECT * EXCLUDE (cc_num) FROM cases_cc)"

DECISIONS_SELECT = """
SELECT trans_num AS txn_id, 'closed' AS status,
       CASE WHEN cc_num % 2 = 0 THEN 'not_fraud' ELSE 'confirm' END AS verdict
FROM cases_cc WHERE cc_num % 7 = 0
"""

TXN_TEXT_SELECT = """
SELECT * EXCLUDE (trans_ts, dob),
       CASE WHEN CAST(split_part(trans_num, '-', 1) AS BIGINT) % {mod} = 0 THEN 'bad'
            ELSE strftime(trans_ts, '%-m/%-d/%Y %-H:%M') END AS trans_date_trans_time,
       strftime(dob, '%Y-%m-%d') AS dob
FROM txn
"""


def with_txn(body: str) -> str:
    return f"{TXN_CTE}\n{body}"


def with_cases(body: str) -> str:
    return f"{CASES_CTE}\n{body}"


def with_decisions(body: str) -> str:
    return f"{CASES_CTE}, decisions AS ({DECISIONS_SELECT})\n{body}"


def with_txn_text(body: str, mod: int = 50) -> str:
    return f"{TXN_CTE}, txn_text AS ({TXN_TEXT_SELECT.format(mod=mod)})\n{body}"
