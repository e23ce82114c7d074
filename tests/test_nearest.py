"""Nearest scopes: uses meet a row for each scope and name, not one for each definition."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from causeway.operators import names
from causeway.plans import registry


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    where = tmp_path_factory.mktemp("nearest")
    segments = ["BUILDING", "FURNITURE", "MACHINERY"]
    put = lambda name, **columns: pq.write_table(pa.table(columns), where / f"{name}.parquet")
    put("customer", c_custkey=list(range(3000)), c_nationkey=[k % 2 for k in range(3000)], c_mktsegment=[segments[k % 3] for k in range(3000)], c_acctbal=[[6000.0, -600.0, -950.0][k // 3 % 3] for k in range(3000)])
    put("nation", n_nationkey=[0, 1], n_regionkey=[0, 0])
    put("orders", o_orderkey=list(range(300)), o_custkey=[k * 7 % 3000 for k in range(300)])
    return str(where)


def joined_rows(plan) -> int:
    """The most rows that a join of an executed plan made."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    below = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return max([own, *map(joined_rows, below)])


@pytest.mark.parametrize("name", ["n08_nearest_scope", "f18_nearest_definitions"])
def test_scopes_of_many_definitions(spark, tables, name):
    got = registry.queries()[name](spark, tables)
    rows = got.collect()
    c = duckdb.connect()
    for t in ("customer", "nation", "orders"):
        c.execute(f"CREATE VIEW {t} AS FROM '{tables}/{t}.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    assert len(rows) > 100 and sorted(tuple(r[x] for x in want.columns) for r in rows) == sorted(want.fetchall())
    assert 0 < joined_rows(got._jdf.queryExecution().executedPlan()) <= 3000


def test_all_definitions_of_the_nearest_scope(spark):
    uses = spark.createDataFrame([(1, "f", "a"), (2, "f", "b"), (3, "g", "a")], "use int, scope string, name string")
    chain = spark.createDataFrame([("f", "f", 0), ("f", "m", 1), ("g", "g", 0), ("g", "m", 1)], "scope string, ancestor string, depth int")
    defined = spark.createDataFrame([("f", "a", 10), ("f", "a", 11), ("m", "a", 12), ("m", "b", 13), ("m", "b", 14)], "scope string, name string, definition long")
    every = names.nearest_scope(uses, chain, defined, ["use"], every=True)
    assert sorted(map(tuple, every.collect())) == [(1, 0, "f", 10), (1, 0, "f", 11), (2, 1, "m", 13), (2, 1, "m", 14), (3, 1, "m", 12)]
    assert sorted(map(tuple, names.nearest_scope(uses, chain, defined, ["use"]).collect())) == [(1, 0, "f", 11), (2, 1, "m", 14), (3, 1, "m", 12)]
    assert sorted(map(tuple, names.nearest_span(uses, chain, defined, ["use"]).collect())) == [(1, 0, 2, 10, 11), (2, 1, 2, 13, 14), (3, 1, 1, 12, 12)]
