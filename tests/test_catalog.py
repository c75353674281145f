"""Every catalog query against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from ledgerline.bindings import TABLES
from ledgerline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Queries whose plans differ; the quality rules are all of one kind, so every fourth stands for them here.
NAMES = sorted(n for n in catalog.ORACLE if not n.startswith("qc_")) + sorted(n for n in catalog.ORACLE if n.startswith("qc_"))[::4]


def norm(x):
    if x is None or isinstance(x, bool):
        return str(x)
    if isinstance(x, float | decimal.Decimal):
        return f"{float(x):.6g}"
    if isinstance(x, datetime.datetime) and x.time() == datetime.time(0):
        return str(x.date())
    return str(x)


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE) - {"quality_report"}))
def test_runs_without_oracle(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_the_first_instrument_goes_by_an_order_of_its_own(spark, tmp_path):
    """Rows of one company from many tasks, with ties and nulls; no row number is in the plan, since that of a lateral LIMIT has no order."""
    row = "%d as o_orderkey, %d as o_custkey, 'O' as o_orderstatus, cast(%f as double) as o_totalprice, timestamp'1997-01-01' as o_orderdate, '1-URGENT' as o_orderpriority"
    orders = [(34, 1, 9.0), (5, 1, 7.0), (3, 1, 7.0), (4, 1, 1.0), (9, 2, 2.0), (51, 3, 2.0)]  # 34 and 51 have no amount
    spark.sql(" union all ".join("select " + row % o for o in orders)).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select explode(array(1L, 1L, 2L, 3L, 4L)) as c_custkey, 'x' as c_name, 0 as c_nationkey, 'y' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select 0 as n_nationkey, 'z' as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    found = catalog.QUERIES["lateral_top1"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, 700), (1, 3, 700), (2, 9, 200)]
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
