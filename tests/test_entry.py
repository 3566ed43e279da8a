import duckdb
import pytest

import __spark_entry__ as entry
from wendgraph.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def rows(names, found):
    return sorted(repr([x for _, x in sorted(zip(names, r))]) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    got = rows(df.columns, map(tuple, df.collect()))
    if name in SQL:
        want = con.sql(SQL[name])
        assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 7
