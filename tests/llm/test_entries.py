"""The registered queries that have SQL against it in DuckDB, on the smallest tables."""

import duckdb
import pytest

from causeway.llm import entries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entries.queries()[name](spark, SF)
    want = c.sql(entries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)
