"""Every query with SQL gives the rows that DuckDB gives; the others run and keep their schema."""

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from pagemill import queries as own

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (int, str, bool)) or v is None:
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def counted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = own.queries()[name](spark, DATA)
    found = duck.execute(own.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert counted(df.collect(), df.columns) == counted(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracle_sql())))
def test_runs_over_whole_tables(spark, name):
    assert own.queries()[name](spark, DATA).collect()
