"""Display helpers (X17, X18, X19) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def join_ids(col, sep: str = ", ") -> Column:
    """An array of ids as one text."""
    return F.array_join(_c(col), sep)


def pretty_name(col) -> Column:
    """``field_name`` -> ``Field Name``."""
    return F.initcap(F.regexp_replace(_c(col), "_", " "))


def pretty_name_text(name: str) -> str:
    """X17 for a column name known on the driver (schema metadata)."""
    return " ".join(w[:1].upper() + w[1:].lower() for w in name.replace("_", " ").split(" "))


def money(col) -> Column:
    """Two decimals with thousands separators."""
    return F.format_number(_c(col), 2)


def percent(col) -> Column:
    """A probability as a percentage with two decimals, e.g. 5.00%."""
    return F.concat(F.format_number(_c(col) * F.lit(100.0), 2), F.lit("%"))


def random_id() -> Column:
    """Random UUID text for a new transaction (not repeatable)."""
    return F.expr("uuid()")


def stable_id(*cols) -> Column:
    """X19, repeatable variant: 32 hex digits from a hash of the given
    columns, formatted like a dashless UUID."""
    return F.substring(F.sha2(F.concat_ws("|", *[_c(c).cast("string") for c in cols]), 256), 1, 32)
