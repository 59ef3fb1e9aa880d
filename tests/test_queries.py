"""Every engine query against DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from colweave.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def shown(v):
    return None if v is None else str(int(v)) if isinstance(v, Decimal) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(shown, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    want = duck.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, v or "") for v in r)
    assert sorted(got, key=key) == sorted((tuple(map(shown, r)) for r in want), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
