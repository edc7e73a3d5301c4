"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from silvergrain.plans import catalog


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    ours = sorted((plain(tuple(r[c] for c in names)) for r in rows), key=repr)
    theirs = sorted((plain(tuple(r[columns.index(c)] for c in names)) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["namespace", "path", "chunk", "score", "source_namespace"]
    assert df.count() == 10
