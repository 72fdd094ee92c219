"""Every query that has an SQL twin gives its rows, at the smallest scale; the others give rows."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tarn.plans import catalog
from tarn.tables import NAMES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in NAMES:
        made.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return made


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
