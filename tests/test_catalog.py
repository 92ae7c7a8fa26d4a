"""Every table query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from latchgraph import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, con, name):
    frame = catalog.queries()[name](spark, DATA)
    got = frame.collect()
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(names)
    rows = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in got)
    assert rows == sorted(repr([plain(v) for _, v in sorted(zip(names, r), key=lambda x: x[0])]) for r in want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
