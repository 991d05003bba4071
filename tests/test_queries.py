import os

import duckdb
import pytest

from marlstone.plans import queries as plans
from marlstone.plans import statements

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", [*plans.SQL, *statements.SQL])
def test_query_matches_sql(spark, oracle, name):
    df = (plans.queries() | statements.queries())[name](spark, SF)
    expected = oracle.execute((plans.SQL | statements.SQL)[name])
    columns = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(expected.fetchall(), key=key)


def test_filters_reach_the_scan(spark):
    plan = plans.queries()["filter_gt"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,9000.0)]" in plan and "c_mktsegment" not in plan


def test_top_k_is_planned(spark):
    plan = plans.queries()["order_by_limit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
