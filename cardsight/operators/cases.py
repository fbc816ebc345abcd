"""Commands on the transaction buckets and the case table (S9, S10, C1-C6,
J4-J6, W4).

Tables are immutable: every command returns new ``DataFrame``s, which
``sources.versions`` writes and makes current together (``run_decisions``). Commands work in bulk -- one decisions
table drives all four outputs -- and join on keys; nothing is collected.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsight.operators.filters import check_bucket, check_status, normalise_id
from cardsight.operators.rank import global_row_number
from cardsight.sources import versions

CASE_FIELDS = ["trans_num", "trans_ts", "amt", "merchant", "category", "state", "is_fraud", "fraud_score"]


# Alias -> field name of incoming rows.
ALIASES = {"txn_id": "trans_num", "card_id": "cc_num", "amount": "amt", "trans_time": "trans_ts"}


def to_fields(rows: DataFrame) -> DataFrame:
    """Alias names to field names; a field that is there under both names keeps its own, filled from the alias."""
    out = rows
    for alias, name in ALIASES.items():
        if alias in out.columns and name in out.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), F.col(alias))).drop(alias)
        elif alias in out.columns:
            out = out.withColumnRenamed(alias, name)
    return out


def to_aliases(rows: DataFrame) -> DataFrame:
    """Field names to their aliases."""
    return rows.withColumnsRenamed({name: alias for alias, name in ALIASES.items()})


def with_defaults(rows: DataFrame, as_of=None) -> DataFrame:
    """P5: an absent label is 0; of case rows (``as_of`` given) an absent status is open and an absent time ``as_of``."""
    kinds = {"is_fraud": "int", **({"status": "string", "created_at": "timestamp_ntz"} if as_of is not None else {})}
    values = {"is_fraud": F.lit(0), "status": F.lit("open"), "created_at": _ts(as_of) if as_of is not None else None}
    return rows.withColumns({c: F.coalesce(F.col(c) if c in rows.columns else F.lit(None).cast(kind), values[c]).cast(kind)
                             for c, kind in kinds.items()})


def _ts(value: _dt.datetime | str):
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(value).cast("timestamp_ntz")


def next_ids(rows: DataFrame, order_cols, start_after, name: str) -> DataFrame:
    """Sequence values ``start_after + 1, +2, ...`` in ``order_cols``
    order (range-partitioned numbering; ``start_after`` is a literal or a
    one-row-per-partition-safe scalar such as a previous maximum)."""
    numbered = global_row_number(rows, order_cols, name="_seq")
    return numbered.withColumn(name, (F.lit(start_after) + F.col("_seq")).cast("bigint")).drop("_seq")


def current_max(table: DataFrame, column: str) -> int:
    """The largest id in use (0 for an empty table): one scalar aggregate."""
    value = table.agg(F.max(column)).first()[0]
    return int(value or 0)


def open_cases(fraud_rows: DataFrame, as_of, start_after: int = 0) -> DataFrame:
    """One open case per fraud transaction: its fields, ``txn_ids`` =
    [its id], the next case id, status open, created at ``as_of``."""
    keep = [c for c in CASE_FIELDS if c in fraud_rows.columns]
    with_ids = next_ids(fraud_rows.select(*keep), ["trans_ts", "trans_num"], start_after, "case_id")
    return with_ids.select("case_id", F.array("trans_num").alias("txn_ids"), F.lit("open").alias("status"),
                           _ts(as_of).alias("created_at"), *keep)


def ingest(batch: DataFrame, tables: dict[str, DataFrame], cases: DataFrame, as_of,
           bucket: str = "all") -> tuple[dict[str, DataFrame], DataFrame]:
    """Every row goes to ``all`` and ``new`` whatever ``bucket`` says,
    fraud-labelled rows also to ``fraud``, and each of those opens a case. Rows may come under
    alias names (P4) and without a label (P5). Tables with a ``record_id`` number their
    new rows on from their own greatest one."""
    check_bucket(bucket)
    batch = with_defaults(to_fields(batch))
    fraud = batch.filter(F.col("is_fraud") == 1)
    rows = {"all": batch, "new": batch, "fraud": fraud}
    out = {name: table.unionByName(with_record_ids(rows[name], table).select(*table.columns))
           for name, table in tables.items()}
    new_cases = open_cases(fraud, as_of, start_after=current_max(cases, "case_id"))
    return out, cases.unionByName(new_cases.select(*cases.columns))


def with_record_ids(rows: DataFrame, table: DataFrame) -> DataFrame:
    """C5 for a bucket: the next record ids for rows that go to ``table``, where it has them."""
    if "record_id" not in table.columns:
        return rows
    return next_ids(rows, ["trans_ts", "trans_num"], current_max(table, "record_id"), "record_id")


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str | list[str]) -> DataFrame:
    """Append the rows whose key is not yet present (anti join); of rows that
    share a key, the least by its other columns."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*") if others else rows.distinct()
    fresh = once.join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def latest_decisions(decisions: DataFrame, order_col: str | None = "decided_at") -> DataFrame:
    """One decision per transaction id, the latest one wins (ties by
    status, verdict). An aggregation (``min_by`` on a sort key), so a
    transaction with very many decisions is combined map-side, not held in
    one window task."""
    if order_col is None or order_col not in decisions.columns:
        return decisions.groupBy("txn_id").agg(F.min(F.struct("status", "verdict")).alias("_d")) \
                        .select("txn_id", "_d.status", "_d.verdict")
    order_key = F.struct((-F.unix_micros(F.col(order_col).cast("timestamp"))).alias("t"),
                         F.col("status").alias("s"), F.col("verdict").alias("v"))
    best = decisions.groupBy("txn_id").agg(
        F.min_by(F.struct(*[F.col(c) for c in decisions.columns if c != "txn_id"]), order_key).alias("_d"))
    return best.select("txn_id", "_d.*")


def case_decisions(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """(case_id, status, verdict) for cases holding a decided
    transaction id. The id array is exploded and equi-joined; a case with
    several decided ids takes the decision of its smallest id."""
    ids = cases.select("case_id", F.explode("txn_ids").alias("txn_id")) \
               .withColumn("txn_id", normalise_id(F.col("txn_id")))
    hit = ids.join(decisions.select("txn_id", "status", "verdict"), "txn_id")
    return hit.groupBy("case_id").agg(F.min_by(F.struct("status", "verdict"), F.col("txn_id")).alias("_d")) \
              .select("case_id", F.col("_d.status").alias("_new_status"), F.col("_d.verdict").alias("_verdict"))


def apply_decisions(tables: dict[str, DataFrame], cases: DataFrame, decisions: DataFrame,
                    key: str = "trans_num") -> dict[str, DataFrame]:
    """C2 / C3 / C4 in bulk from ``decisions(txn_id, status, verdict)``.

    verdict ``not_fraud`` (rollback): label 0 in all and new, row removed
    from fraud, case gets the status and label 0.
    verdict ``confirm``: case gets the status (closed), label kept.
    verdict ``status``: case gets the status only.
    Returns the four new tables plus ``unmatched``: decisions with no case.
    """
    decisions = latest_decisions(decisions.withColumn("txn_id", normalise_id(F.col("txn_id"))))
    rollback_ids = decisions.filter(F.col("verdict") == "not_fraud").select(F.col("txn_id").alias("_id")) \
                            .withColumn("_rb", F.lit(True))

    def keyed(t: DataFrame) -> DataFrame:
        return t.withColumn("_id", normalise_id(F.col(key)))

    def relabel(t: DataFrame) -> DataFrame:
        j = keyed(t).join(rollback_ids, "_id", "left")
        return j.withColumn("is_fraud", F.when(F.col("_rb"), F.lit(0)).otherwise(F.col("is_fraud"))) \
                .drop("_rb").select(*t.columns)

    per_case = case_decisions(cases, decisions)
    joined = cases.join(per_case, "case_id", "left")
    new_cases = (joined
                 .withColumn("status", F.coalesce(F.col("_new_status"), F.col("status")))
                 .withColumn("is_fraud", F.when(F.col("_verdict") == "not_fraud", F.lit(0))
                             .otherwise(F.col("is_fraud")))
                 .select(*cases.columns))
    case_ids = cases.select(F.explode("txn_ids").alias("txn_id")).select(normalise_id(F.col("txn_id")).alias("txn_id"))
    unmatched = decisions.join(case_ids, "txn_id", "left_anti")
    return {
        "all": relabel(tables["all"]),
        "new": relabel(tables["new"]),
        "fraud": keyed(tables["fraud"]).join(rollback_ids.select("_id"), "_id", "left_anti").drop("_id"),
        "cases": new_cases,
        "unmatched": unmatched,
    }


def run_decisions(spark: SparkSession, root: str, decisions: DataFrame) -> DataFrame:
    """C2 on stored tables: ``apply_decisions`` to the current version of all, new, fraud and cases under ``root``;
    the four outputs are published as one new version. Returns the decisions with no case."""
    now = versions.current(spark, root)
    out = apply_decisions({k: now[k] for k in ("all", "new", "fraud")}, now["cases"], decisions)
    unmatched = out.pop("unmatched").checkpoint(eager=True)
    versions.publish(spark, root, out)
    return unmatched


def set_case_status(cases: DataFrame, txn_ids: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """Set ``status`` on every case holding one of the ids in
    ``txn_ids(txn_id)``; returns (new cases, ids with no case)."""
    check_status(status)
    d = txn_ids.select(normalise_id(F.col("txn_id")).alias("txn_id")).dropDuplicates().withColumn("status", F.lit(status)) \
               .withColumn("verdict", F.lit("status"))
    per_case = case_decisions(cases, d)
    out = cases.join(per_case, "case_id", "left") \
               .withColumn("status", F.coalesce(F.col("_new_status"), F.col("status"))).select(*cases.columns)
    known = cases.select(F.explode("txn_ids").alias("txn_id")).select(normalise_id(F.col("txn_id")).alias("txn_id"))
    unmatched = d.join(known, "txn_id", "left_anti")
    return out, unmatched.select("txn_id")


def consistency_violations(tables: dict[str, DataFrame], key: str = "trans_num") -> DataFrame:
    """Fraud rows missing from ``all`` or labelled 0 there."""
    fraud = tables["fraud"].select(key)
    missing = fraud.join(tables["all"].select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    relabelled = fraud.join(tables["all"].filter(F.col("is_fraud") != 1).select(key), key, "left_semi") \
                      .withColumn("problem", F.lit("label_0_in_all"))
    return missing.unionByName(relabelled)


def case_transactions(cases: DataFrame, txn: DataFrame, key: str = "trans_num") -> DataFrame:
    """Cases joined to their transactions through the id array."""
    ids = cases.select("case_id", F.explode("txn_ids").alias(key))
    return ids.join(txn, key)


def cases_with_transaction(cases: DataFrame, txn: DataFrame, key: str = "trans_num") -> DataFrame:
    """J4 existence: cases with at least one stored transaction."""
    ids = cases.select("case_id", F.explode("txn_ids").alias(key))
    present = ids.join(txn.select(key), key, "left_semi").select("case_id").dropDuplicates()
    return cases.join(present, "case_id", "left_semi")
