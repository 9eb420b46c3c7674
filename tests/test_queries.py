"""Every query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
ORACLE = __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(value):
    if isinstance(value, bool | type(None)):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return str(value) if not isinstance(value, int) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, str(DATA))
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = [tuple(same(r[c]) for c in names) for r in got.collect()]
    place = {c: i for i, c in enumerate(want.columns)}
    other = [tuple(same(r[place[c]]) for c in names) for r in want.fetchall()]
    assert sorted(rows, key=repr) == sorted(other, key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
