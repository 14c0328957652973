"""The registered SQL of the training-data queries on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from driftwell.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, found = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in found.fetchall())
