"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quern.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def shown(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(tuple(shown(r[k]) for k in order) for r in df.collect())
    theirs = sorted(tuple(shown(v) for _, v in sorted(zip(names, r))) for r in cursor.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_group_folds_keep_groups_and_balance(spark):
    rows = registry.QUERIES["group_kfold"](spark, FOLDER).collect()
    assert len({r.o_custkey for r in rows}) == len(rows)
    assert {r.fold for r in rows} == set(range(5))
