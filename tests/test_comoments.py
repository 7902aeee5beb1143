"""Correlations by merged co-moments: against numpy and SQL, with nulls by pair, large values, many columns and many tasks."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import clean, comoments


def table(spark, x, parts):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(x.shape[1]))).repartition(parts)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_pairs_with_nulls(spark, parts):
    """Some tasks of 40 have no rows, a column is constant, one is null throughout."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 7)) + 1e9
    x[:, 1] += x[:, 0] - 1e9
    x[:, 2], x[:, 3] = 0.1, np.nan
    x[draw.random(x.shape) < 0.3] = np.nan
    got = {(r.left, r.right): r for r in comoments.pair_statistics(table(spark, x, parts), [f"c{i}" for i in range(7)]).collect()}
    assert len(got) == 21
    for (left, right), r in got.items():
        a, b = x[:, int(left[1])], x[:, int(right[1])]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert r.n == both.sum()
        if {left, right} & {"c2", "c3"}:
            assert r.r is None
        else:
            assert abs(r.r - np.corrcoef(a[both], b[both])[0, 1]) < 1e-6
            assert abs(r.covariance - np.cov(a[both], b[both])[0, 1]) < 1e-6


def test_same_as_sql(spark):
    file = "/root/testdata/sf0.001/lineitem.parquet"
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
    for r in clean.correlations(spark.read.parquet(file), names).collect():
        assert abs(r.r - duckdb.sql(f"SELECT corr({r.left}, {r.right}) FROM '{file}'").fetchall()[0][0]) < 1e-9


def test_six_hundred_columns(spark):
    """The filter at the real width: the later copy of a column goes, and of these enrich_ columns come last."""
    wide = spark.range(500).select(*(F.hash(F.col("id"), F.lit(i % 590)).cast("double").alias(f"{'enrich_' if i < 5 else 'x'}{i}") for i in range(600)))
    begun = time.time()
    dropped = clean.correlated_columns(wide, wide.columns)
    assert time.time() - begun < 30
    assert dropped == [f"x{i}" for i in range(595, 600)] + [f"enrich_{i}" for i in range(5)]


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert [(r.n, r.r) for r in comoments.pair_statistics(none, ["a", "b"]).collect()] == [(0, None)]
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [(r.n, r.r) for r in comoments.pair_statistics(one, ["a", "b"]).collect()] == [(1, None)]
