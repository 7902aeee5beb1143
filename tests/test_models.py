"""The model queries use the whole vector and score each row by models that have not seen it."""

import math
import random
import statistics
import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from quern.operators import models
from quern.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors of which only the last value, beyond the first eight, says the class."""
    path, r = tmp_path_factory.mktemp("vectors"), random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(9)] + [2.0 * (i % 2) - 1 + r.gauss(0, 0.3)], i % 2) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def auc(rows, score):
    pos, neg = ([r[score] for r in rows if r.y == y] for y in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def test_out_of_fold_scores_use_the_whole_vector(spark, folder):
    rows = registry.QUERIES["gbt_oof"](spark, folder).collect()
    assert {r.fold for r in rows} == set(range(5)) and len({r.vec_id for r in rows}) == len(rows) == 100
    assert auc(rows, "p_ensemble") > 0.9


def test_calibration_uses_the_whole_vector(spark, folder):
    rows = registry.QUERIES["isotonic_calibration"](spark, folder).collect()
    assert len(rows) == 70 and auc(rows, "p") > 0.9 and auc(rows, "calibrated") > 0.9


def test_stacking_uses_the_whole_vector(spark, folder):
    (row,) = registry.QUERIES["stacking"](spark, folder).collect()
    assert row.n == 100 and row.auc > 0.9


def test_stack_is_scored_out_of_fold(spark):
    """With a score that says nothing of one fold's class, that fold gets the others' base rate, not its own."""
    rows = spark.createDataFrame([(i, i % 2, 0.5, i % 2) for i in range(40)], "id long, y int, p double, fold int")
    got = models.stacked_out_of_fold(rows.unionByName(rows.where("y = 1").withColumn("y", F.lit(0)).limit(1)), "y", ["p"], k=2).collect()
    assert all(r.p_stack > 0.5 for r in got if r.fold == 0) and all(r.p_stack < 0.5 for r in got if r.fold == 1)


def test_stacking_plans_do_not_grow_with_the_folds(spark, folder):
    """What the fits and the evaluation read is stored: no plan carries the folds' windows along for each fold and use."""
    plan = registry.QUERIES["stacking"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 12 and "InMemoryRelation" not in plan


def test_fits_run_side_by_side_in_order(spark):
    """All fits are under way at once, and each result is in its fit's place."""
    met = threading.Barrier(5, timeout=60)

    def fit(i):
        met.wait()
        return i, spark.range(i).count()

    assert models.side_by_side(spark.range(1), fit, 5) == [(i, i) for i in range(5)]


def test_fold_fills_are_the_other_folds_medians(spark):
    """Exact medians of what the other folds have, NaN being absent; columns without gaps need none, empty ones have 0."""
    r = random.Random(7)
    number = lambda i: None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(r.choice([-1e9, -2.5, 0.0, 1e-12, 3.25, 1e300])) + r.random()
    rows = [(i % 3, number(i), float(i), i if i % 5 else None, None, math.inf if i % 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, `c.d` int, e double, f double").withColumnRenamed("c.d", "c")
    got = models.fold_fills(df, ["a", "b", "c", "e", "f"], "fold", 3)
    for i in range(3):
        own = [[float(x[j]) for x in rows if x[0] != i and x[j] is not None and not math.isnan(x[j])] for j in (1, 3)]
        assert got[i] == {"a": statistics.median(own[0]), "c": statistics.median(own[1]), "e": 0.0, "f": math.inf}
        plain = models.fill_values(df.where(F.col("fold") != i).withColumn("a", F.nanvl("a", F.lit(None))), ["a", "c", "e", "f"], [])
        assert got[i] == plain


def test_out_of_fold_scores_of_rows_with_gaps(spark):
    """Each fold's level learner equals one fitted by itself on rows filled with the other folds' medians."""
    r = random.Random(5)
    rows = [(i, i % 3, int(i % 2), None if i % 9 == 0 else i % 2 + r.gauss(0, 1), r.gauss(0, 1)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, fold int, y int, a double, b double").coalesce(1).persist()
    got = {x.id: x.p_level for x in models.out_of_fold(df, "y", ["a", "b"], [], k=3).collect()}
    train = df.where("fold != 1")
    fills = models.fill_values(train, ["a", "b"], [])
    alone = models.fit_level(train.na.fill(fills).withColumn("label", F.col("y").cast("double")), ["a", "b"], [])
    held = alone.transform(df.where("fold = 1").na.fill(fills)).select("id", models.probability().alias("p")).collect()
    assert len(got) == 90 and all(got[x.id] == pytest.approx(x.p, abs=1e-9) for x in held)


def test_stack_evaluation(spark):
    rows = registry.QUERIES["stack_evaluation"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(0 <= r.auc_base <= 1 and r.lo <= r.hi for r in rows)
