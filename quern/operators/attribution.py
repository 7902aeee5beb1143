"""What each feature adds to a row's margin: Shapley values of boosted trees, exact and in polynomial time."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.boosting import EMPTY, Model, Tree, _rows


def paths(tree: Tree) -> list[tuple[float, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
    """For each leaf its value and for each feature on its way: the share of rows that go this way, and the turns (node, left)."""
    out, todo = [], [(0, {})]
    while todo:
        node, way = todo.pop()
        f = tree.feature[node]
        if f == EMPTY:
            out.append((tree.value[node], way))
            continue
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            share, turns = way.get(f, (1.0, []))
            todo.append((child, {**way, f: (share * tree.cover[child] / tree.cover[node], [*turns, (node, left)])}))
    return out


def expected(model: Model) -> float:
    """The margin that is shared out from: the mean over the rows that the trees have seen, feature by feature."""
    return model.base + sum(value * math.prod(share for share, _ in way.values()) for tree in model.trees for value, way in paths(tree))


def shapley(model: Model, x: np.ndarray) -> np.ndarray:
    """The Shapley values of each row of x (rows by features); with expected(model) they add up to the margin.

    A coalition's value takes the turns of its features as the row has them, the others' as the shares
    of rows on either side. A leaf with d features on its way adds, to feature f, its value times (o_f - z_f) times
    the sum over coalitions S of the others of |S|! (d - |S| - 1)! / d! times the product of o over S
    and z over the rest, where o is 1 if the row takes all the feature's turns and z their share. The
    products by size of S are the coefficients of the polynomial of all (z + o t), found by d steps for
    all rows at once; a leaf costs d cubed.
    """
    out = np.zeros(x.shape)
    for tree in model.trees:
        at = np.array(tree.at)
        for value, way in paths(tree):
            if not way:
                continue
            names, d = list(way), len(way)
            share = [way[f][0] for f in names]
            taken = []
            for f in names:
                goes = np.ones(len(x), bool)
                for node, left in way[f][1]:
                    goes &= (np.isnan(x[:, f]) | (x[:, f] <= at[node])) == left
                taken.append(goes.astype(float))
            weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
            for i, f in enumerate(names):
                coefficient = np.zeros((d, len(x)))
                coefficient[0] = 1
                for j in range(d):
                    if j != i:
                        coefficient[1:] = coefficient[1:] * share[j] + coefficient[:-1] * taken[j]
                        coefficient[0] *= share[j]
                out[:, f] += value * (taken[i] - share[i]) * (np.array(weight) @ coefficient)
    return out


def attributions(rows: DataFrame, models: list[Model], names: list[str], key: str, which: str) -> DataFrame:
    """key, base and phi (array, a value a feature) of each row of rows (key, x, which: the number of its model).

    base and phi add up to the row's margin. The models go to the tasks, rows are scored in Arrow batches.
    """
    base, width = [expected(m) for m in models], len(names)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, number = _rows(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
            phi, start = np.zeros(x.shape), np.zeros(len(x))
            for m in np.unique(number).tolist():
                own = number == m
                phi[own], start[own] = shapley(models[m], x[own]), base[m]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), values], names=["key", "base", "phi"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "x", F.col(which).cast("int")).mapInArrow(run, f"key {kind}, base double, phi array<double>").withColumnRenamed("key", key)


def _long(attributed: DataFrame, names: list[str], key: str) -> DataFrame:
    named = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("phi").alias("phi"))
    return attributed.select(key, F.explode(named).alias("r")).select(key, F.col("r.feature").alias("feature"), F.col("r.phi").alias("phi"))


def strongest(attributed: DataFrame, names: list[str], key: str, k: int = 10) -> DataFrame:
    """key, place (from 1), feature, phi: the k features with the largest absolute values of each row; equal ones by name."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("phi")), "feature"))
    return _long(attributed, names, key).withColumn("place", place).where(F.col("place") <= k).select(key, "place", "feature", "phi")


def mean_attributions(attributed: DataFrame, names: list[str], key: str, groups: dict[str, str]) -> DataFrame:
    """feature, feature_group, mean absolute value, and the group's sum of these; features are few, rows are counted in the tasks."""
    means = _long(attributed, names, key).groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    group = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for pair in groups.items() for v in pair)), F.col("feature")), F.lit("other")) if groups else F.lit("other")
    whole = Window.partitionBy("feature_group")
    return means.withColumn("feature_group", group).select("feature", "feature_group", "mean_abs", F.sum("mean_abs").over(whole).alias("group_abs"))
