"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import datetime

import duckdb
import pytest

from lexweave.plans import catalog, corpus, scalars, streams, tables  # noqa: F401  (they register their queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    catalog.QUERIES[name](spark, sf).limit(3).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
