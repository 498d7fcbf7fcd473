"""Every query of the catalogue gives the rows of its SQL, on the smallest tables."""

import duckdb
import pytest

from spanloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([str(r[c]) for c in columns] for r in got.collect()) == sorted([str(r[i]) for i in at] for r in want.fetchall())
