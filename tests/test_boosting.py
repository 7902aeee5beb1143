"""Leaf-wise boosting against a plain version that looks at every leaf in turn."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boosting


def table(spark, x, y, fold, parts=3):
    rows = [([None if np.isnan(v) else float(v) for v in r], int(a), int(b), i) for i, (r, a, b) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "x array<double>, y int, fold int, row long").repartition(parts)


def data(n, p, seed, missing=0.1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, p)).round(2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + draw.normal(size=n) * 0.3 > 0).astype(int)
    x[draw.random(x.shape) < missing] = np.nan
    return x, y, draw.integers(0, 3, n)


def plain(x, y, cuts, setting):
    """Margins of all rows of x: the best cut of all leaves first, one leaf at a time, every leaf's cut looked for from its rows."""
    bins, share = boosting._binned(x, cuts), y.mean()
    margin = np.full(len(y), math.log(share / (1 - share)))
    for _ in range(setting.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def best(rows):
            out = (0.0, None)
            for f in range(x.shape[1]):
                for cut in range(int(bins[:, f].max())):
                    go = bins[rows, f] <= cut
                    a, b = rows[go], rows[~go]
                    if min(len(a), len(b)) < setting.least_rows:
                        continue
                    score = lambda r: g[r].sum() ** 2 / (h[r].sum() + setting.l2)
                    gain = round((score(a) + score(b) - score(rows)) / 2, 9)
                    if gain > max(out[0], setting.least_gain):
                        out = (gain, (a, b))
            return out

        leaves = [("", np.arange(len(y)), best(np.arange(len(y))))]
        while len(leaves) < setting.leaves:
            leaves.sort(key=lambda leaf: (-leaf[2][0], leaf[0]))
            if leaves[0][2][1] is None:
                break
            way, _, (_, (a, b)) = leaves.pop(0)
            leaves += [(way + "l", a, best(a)), (way + "r", b, best(b))]
        for _, rows, _ in leaves:
            margin[rows] -= setting.step * g[rows].sum() / (h[rows].sum() + setting.l2)
    return margin


@pytest.mark.parametrize("leaves", [2, 5, 12])
def test_same_trees_as_one_leaf_at_a_time(spark, leaves):
    x, y, fold = data(150, 4, leaves)
    setting = boosting.Setting(trees=3, leaves=leaves, least_rows=4)
    (model,) = boosting.fit(table(spark, x, y, fold), 4, [(setting, -1)], 3, bins=16)
    cuts = [boosting.cut_points(*boosting.summary(c[~np.isnan(c)], np.ones((~np.isnan(c)).sum())), 16) for c in x.T]
    assert np.allclose(boosting.margins(model, x), plain(x, y, cuts, setting))
    assert all(sum(f < 0 for f in t.feature) <= leaves and sum(c for c, f in zip(t.cover, t.feature) if f < 0) == 150 for t in model.trees)


def test_many_models_are_those_fitted_alone(spark):
    """Folds and settings in one run; each model doesn't see its fold. More trees than margins are kept for."""
    x, y, fold = data(120, 3, 7)
    setting, other = boosting.Setting(trees=10, leaves=3), boosting.Setting(trees=4, leaves=6, step=0.5, rows=0.7, columns=0.7)
    jobs = [(setting, 0), (setting, 1), (other, 2)]
    together = boosting.fit(table(spark, x, y, fold), 3, jobs, 3, bins=8)
    for (s, skip), model in zip(jobs[:2], together):
        seen = fold != skip
        cuts = [boosting.cut_points(*boosting.summary(c[~np.isnan(c)], np.ones((~np.isnan(c)).sum())), 8) for c in x[seen].T]
        assert len(model.trees) == s.trees and np.allclose(boosting.margins(model, x[seen]), plain(x[seen], y[seen], cuts, s))
    assert len(together[2].trees) == 4
    rows = table(spark, x, y, fold).withColumn("p", boosting.probability(together, F.col("x"), F.col("fold"), 3)).collect()
    for r in rows:
        margin = boosting.margins(together[r.fold], np.array([[np.nan if v is None else v for v in r.x]]))[0]
        assert abs(r.p - 1 / (1 + math.exp(-margin))) < 1e-12
    assert boosting.Model.from_json(together[0].to_json()).trees == together[0].trees


def test_one_class_and_no_rows(spark):
    x, y, fold = data(30, 3, 1)
    (model,) = boosting.fit(table(spark, x, np.ones(30), fold), 3, [(boosting.Setting(trees=2), -1)], 3)
    assert not model.trees and model.base > 5
    (model,) = boosting.fit(table(spark, x[:0], y[:0], fold[:0]), 3, [(boosting.Setting(trees=2), -1)], 3)
    assert not model.trees and model.base == 0


def test_summaries_stand_for_their_values():
    draw = np.random.default_rng(1)
    values = draw.normal(size=50_000)
    parts = [boosting.summary(v, np.ones(len(v))) for v in np.split(values, 10)]
    v, w = boosting.summary(*(np.concatenate(c) for c in zip(*parts)))
    assert len(v) <= boosting.POINTS and abs(w.sum() - 50_000) < 1e-6
    cuts = boosting.cut_points(v, w, 20)
    share = np.diff([0, *np.searchsorted(np.sort(values), cuts, "right"), 50_000]) / 50_000
    assert len(cuts) == 19 and share.max() < 2 * np.median(share)
