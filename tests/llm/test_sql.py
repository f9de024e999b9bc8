"""The contract's queries against their SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from ridgeplan.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in got.collect()) == sorted(tuple(str(r[k]) for k in order) for r in want.fetchall())
