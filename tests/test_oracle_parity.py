"""Registered queries against their DuckDB SQL on sf0.001 (a fast subset of
the driver's gate, which runs every query at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from cardsight.plans import catalog
from cardsight.sources.tables import TABLES

from testdata_paths import SF_SMALL

# Left to the driver's gate: queries that fit models or features, or write and read tables several times.
SLOW = ("m0", "a18", "a19", "t01", "a16", "x15_encoded", "c02_published")
FAST = [n for n in catalog.oracle_sql() if not n.startswith(SLOW)]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, srows) == _rows(dcols, cur.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["period", "fraud_count"]


def test_every_query_has_oracle_or_is_declared_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    rows_only = {n for n in set(q) - set(o) if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())}
    assert rows_only <= {"u05_fold_sizes", "m04_ensemble_scores", "a19_feature_importance", "t01_stream_scoring",
                         "m03_tuning"}
