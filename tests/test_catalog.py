"""Every registered query against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from talkweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(rows):
    def one(x):
        if isinstance(x, decimal.Decimal):
            x = float(x)
        return round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*names).collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    expected = [tuple(r[columns.index(n)] for n in names) for r in found.fetchall()]
    assert comparable(rows) == comparable(expected)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == entry.queries()[catalog.FLAGSHIP](spark, SF).columns
