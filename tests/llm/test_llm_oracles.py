"""Operator queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from cardsight.llm import queries
from cardsight.sources.tables import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(cur.fetchall(), key=str)
