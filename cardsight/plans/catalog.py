"""Registry of named queries: Spark plan + equivalent DuckDB SQL.

Each query takes ``(spark, sf_dir)`` and returns a ``DataFrame`` over the
whole test tables. ``oracle`` holds the DuckDB text for the same result
(column names aligned, computed doubles rounded to 6 places, money to 2);
queries without an oracle entry are random or iterative and are checked by
row counts and invariants in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from cardsight.plans import (q_analysis, q_cases, q_evaluation, q_features,  # noqa: F401
                                 q_models, q_reports, q_sources)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
