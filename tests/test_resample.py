"""Metrics of weighted resamples: against pairs counted one by one, however ranges are cut."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import resample, stats


def weight(seed, r, key):
    digest = hashlib.md5(f"{seed}|{r // 4}|{key}".encode()).hexdigest()
    u = (int(digest[8 * (r % 4) : 8 * (r % 4) + 8], 16) + 0.5) / 2**32
    return sum(u > sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12))


def plain(rows, rounds, threshold=0.5):
    out = []
    for r in range(rounds):
        w = [weight(42, r, k) for k, _, _ in rows]
        pos, neg = ([(s, x) for (_, y, s), x in zip(rows, w) if y == c] for c in (1, 0))
        p, n = sum(x for _, x in pos), sum(x for _, x in neg)
        if not p or not n:
            out.append((r, None, None, None, None))
            continue
        won = sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg)
        tp, fp = (sum(x for s, x in side if s >= threshold) for side in (pos, neg))
        out.append((r, won / p / n, 2 * tp / (tp + fp + p), tp / p, 1 - fp / n))
    return out


def close(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b))


@pytest.mark.parametrize("levels", [3, 40, 1])
def test_metrics_of_resamples(spark, levels, monkeypatch):
    """Few levels: every border between tasks and blocks is a tie; one level: the auc is one half."""
    draw = np.random.default_rng(levels)
    rows = [(i, int(draw.random() < 0.3), float(draw.integers(0, levels)) / max(levels - 1, 1)) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, 1, None), (77, None, 0.5)], "id long, y int, s double")
    got = {r.round: tuple(r) for r in resample.poisson_metrics(df, "y", "s", F.col("id"), 10).collect()}
    assert len(got) == 10 and all(close(got[r[0]], r) for r in plain(rows, 10))


@pytest.mark.parametrize("levels", [1, 2, 5, 30])
def test_spans_join_however_they_are_cut(levels):
    draw = np.random.default_rng(levels)
    s = np.sort(draw.integers(0, levels, 50) / 7.0)
    y, w = draw.random(50) < 0.4, draw.integers(0, 4, (50, 6)).astype(float)
    whole = resample.Span.of(s, y, w, 0.5)
    for cuts in ([25], [1, 2, 3], [10, 11, 30, 49]):
        parts = [resample.Span.of(a, b, c, 0.5) for a, b, c in zip(np.split(s, cuts), np.split(y, cuts), np.split(w, cuts))]
        left = parts[0]
        for part in parts[1:]:
            left = resample.Span.unpack(left.pack()).then(part)
        right = parts[-1]
        for part in reversed(parts[:-1]):
            right = part.then(right)
        for joined in (left, right):
            assert all(np.allclose(getattr(joined, k), getattr(whole, k)) for k in whole.__dataclass_fields__)


def test_no_rows_and_one_class(spark):
    none = spark.createDataFrame([], "id long, y int, s double")
    assert resample.poisson_metrics(none, "y", "s", F.col("id"), 5).count() == 0
    one = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "id long, y int, s double")
    assert stats.poisson_auc(one, "y", "s", F.col("id"), 5).count() == 0
