"""Every job with an oracle against DuckDB on the same files."""

import duckdb
import pytest

import __spark_entry__ as contract
from stallwise.jobs import JOBS
from tests.conftest import SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
# the training-data queries have tests of their own beside their code
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in JOBS}
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def _rows(records, columns, order):
    index = [columns.index(c) for c in order]
    return sorted((tuple(r[i] for i in index) for r in records), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    assert _rows(df.collect(), df.columns, order) == _rows(result.fetchall(), columns, order)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["purchase_month", "gmv", "orders", "active_customers", "aov"]
    assert df.count() > 50
