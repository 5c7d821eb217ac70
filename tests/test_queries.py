from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    if not DATA.exists():
        pytest.skip("no tables here")
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    assert len(got)
    if name in entry.oracle_sql():
        want = db.execute(entry.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
