"""Row filters. Each returns a filtered ``DataFrame``; an empty or ``None``
argument means "no filter", and filters combine by AND. All predicates are
built-in expressions, so comparisons on plain columns reach the Parquet scan
as pushed filters."""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardsight.constants import BUCKETS, CASE_STATUSES, GRANULARITY_FORMATS


def _lit_ts(value: _dt.datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def parse_day(text: str | None) -> _dt.datetime | None:
    """A ``YYYY-MM-DD`` argument, or ``None`` when absent or malformed
    (a malformed date is ignored, not an error)."""
    if not text:
        return None
    try:
        return _dt.datetime.strptime(text, "%Y-%m-%d")
    except ValueError:
        return None


def regex_match(df: DataFrame, **patterns: str | None) -> DataFrame:
    """case-insensitive, unanchored regular-expression match per column."""
    for column, pattern in patterns.items():
        if pattern:
            df = df.filter(F.col(column).rlike("(?i)" + pattern))
    return df


def substring_match(df: DataFrame, **needles: str | None) -> DataFrame:
    """case-insensitive substring match per column."""
    for column, needle in needles.items():
        if needle:
            df = df.filter(F.lower(F.col(column)).contains(needle.lower()))
    return df


def amount_range(df: DataFrame, min_amount: float | None = None, max_amount: float | None = None,
                 column: str = "amt") -> DataFrame:
    """inclusive amount range; either end optional."""
    if min_amount is not None:
        df = df.filter(F.col(column) >= F.lit(float(min_amount)))
    if max_amount is not None:
        df = df.filter(F.col(column) <= F.lit(float(max_amount)))
    return df


def date_range(df: DataFrame, start_date: str | None = None, end_date: str | None = None,
               column: str = "trans_ts", end_mode: str = "end_of_day") -> DataFrame:
    """Day-granular time range.

    ``end_mode="end_of_day"`` keeps the whole end day (up to 23:59:59, the
    service's rule); ``"midnight"`` ends at 00:00:00 of the end day (the
    dashboard's second pass, which cuts the last day).
    """
    start = parse_day(start_date)
    end = parse_day(end_date)
    if start is not None:
        df = df.filter(F.col(column) >= _lit_ts(start))
    if end is not None:
        if end_mode == "end_of_day":
            end = end.replace(hour=23, minute=59, second=59)
        elif end_mode != "midnight":
            raise ValueError(f"unknown end_mode {end_mode!r}")
        df = df.filter(F.col(column) <= _lit_ts(end))
    return df


def card_contains(df: DataFrame, needle: str | None, column: str = "cc_num") -> DataFrame:
    """partial card-number search on the decimal text of the number."""
    if needle:
        df = df.filter(F.col(column).cast("string").contains(needle))
    return df


def txn_ids_contain(cases: DataFrame, txn_id: str | None) -> DataFrame:
    """cases whose transaction-id array holds ``txn_id``."""
    if txn_id:
        cases = cases.filter(F.array_contains("txn_ids", txn_id))
    return cases


def case_status(cases: DataFrame, status: str | None, as_of: _dt.datetime | str) -> DataFrame:
    """F8: status filter with ageing relative to ``as_of`` (UTC).

    open          -> status open and created on or after as_of's midnight
    investigating -> status investigating, or open but created before it
    anything else -> plain equality
    """
    if not status:
        return cases
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    today = _lit_ts(as_of.replace(hour=0, minute=0, second=0, microsecond=0))
    st, created = F.col("status"), F.col("created_at")
    if status == "open":
        return cases.filter((st == "open") & (created >= today))
    if status == "investigating":
        return cases.filter((st == "investigating") | ((st == "open") & (created < today)))
    return cases.filter(st == status)


def case_bucket(as_of: _dt.datetime | str) -> Column:
    """F8 as a column: the status under which a case is listed on ``as_of``'s day (null: under none)."""
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    today = _lit_ts(as_of.replace(hour=0, minute=0, second=0, microsecond=0))
    st, created = F.col("status"), F.col("created_at")
    return F.when(st != "open", st).when(created >= today, st).when(created < today, F.lit("investigating"))


def normalise_id(column: Column) -> Column:
    """Canonical text id. UUID text loses its dashes and is lower-cased
    (32 hex digits); binary ids become lower hex; other text is kept."""
    text = column.cast("string")
    uuid_like = text.rlike("^[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}$")
    return (F.when(F.typeof(column) == "binary", F.lower(F.hex(column)))
            .when(uuid_like, F.lower(F.regexp_replace(text, "-", ""))).otherwise(text))


def id_in(df: DataFrame, ids: Iterable[str], column: str = "trans_num") -> DataFrame:
    """membership in a (small, argument-sized) id list.

    The arguments are written in every form in which an id may be stored, so
    the column itself stays bare and the list reaches the file scan. For a large
    id set, or ids of mixed letter case, use a semi join on ``normalise_id``."""
    if dict(df.dtypes)[column] == "binary":
        hexed = [h for i in ids if re.fullmatch("(?:[0-9a-f]{2})+", h := _norm_text_id(i).lower())]
        return df.filter(F.col(column).isin([F.unhex(F.lit(h)) for h in hexed])) if hexed else df.filter(F.lit(False))
    return df.filter(F.col(column).isin(sorted({form for i in ids for form in _stored_forms(i)})))


_UUID = re.compile("[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}")


def _norm_text_id(value: str) -> str:
    return value.replace("-", "").lower() if _UUID.fullmatch(value) else value


def _stored_forms(value: str) -> set[str]:
    if not _UUID.fullmatch(value):
        return {value}
    bare = _norm_text_id(value)
    dashed = "-".join([bare[:8], bare[8:12], bare[12:16], bare[16:20], bare[20:]])
    return {value, bare, bare.upper(), dashed, dashed.upper()}


def require_parsed(df: DataFrame, columns: Iterable[str], check_empty: bool = True) -> DataFrame:
    """drop rows lacking any of ``columns``; error when none are left.

    The emptiness check is a one-row probe (``limit(1)``), not a count."""
    columns = list(columns)
    out = df.dropna(subset=columns)
    if check_empty and not out.limit(1).take(1):
        raise ValueError(f"no row has a value in all of {sorted(columns)}")
    return out


def check_allowed(value: str, allowed: Iterable[str], what: str) -> str:
    """argument check against an allowed-value set."""
    allowed = list(allowed)
    if value not in allowed:
        raise ValueError(f"Invalid {what}: {value!r}; expected one of {allowed}")
    return value


def invalid_rows(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """F11 on data: rows whose ``column`` holds a value outside ``allowed``."""
    return df.filter(~F.col(column).isin(list(allowed)) | F.col(column).isNull())


def check_status(status: str) -> str:
    return check_allowed(status, CASE_STATUSES, "status")


def check_bucket(name: str) -> str:
    return check_allowed(name, BUCKETS, "bucket")


def check_granularity(name: str) -> str:
    return check_allowed(name, GRANULARITY_FORMATS, "granularity")


def incomplete(columns: Iterable[str], df: DataFrame) -> Column:
    """a row is incomplete when any field is null, empty text or zero."""
    conds = []
    types = dict(df.dtypes)
    for c in columns:
        col = F.col(c)
        cond = col.isNull()
        if types.get(c) == "string":
            cond = cond | (col == "")
        elif types.get(c) in ("int", "bigint", "double", "float", "smallint", "tinyint") \
                or str(types.get(c, "")).startswith("decimal"):
            cond = cond | (col == 0)
        conds.append(cond)
    out = F.lit(False)
    for cond in conds:
        out = out | cond
    return out


def split_complete(df: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the completeness rule."""
    flag = incomplete(list(columns), df)
    return df.filter(~flag), df.filter(flag)


def drop_zero(df: DataFrame, column: str = "value") -> DataFrame:
    """keep positive shares only."""
    return df.filter(F.col(column) > 0)
