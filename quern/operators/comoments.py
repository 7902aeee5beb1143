"""Means, variances and correlations of many columns at once, each pair over the rows that have both.

A task adds up five matrices of its rows by matrix products; the matrices of tasks are merged as
counts, means and centred co-moments, so sums of squares of large values never cancel. A state holds
some of the matrix's rows, so that its size is bounded whatever the number of columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.blocks import gathered, merged, numbers

#: Rows of the matrix in a state: 16 by 600 columns are half a MB.
STRIP = 16
#: For each pair: rows with both, the means of the first and the second there, their squares and products about these.
COUNT, LEFT, RIGHT, LEFT_SQUARE, RIGHT_SQUARE, PRODUCT = range(6)


def _central(x: np.ndarray) -> np.ndarray:
    """A value of each column near its middle: about it sums don't cancel, and a column of one value has sums of 0."""
    out = np.zeros(x.shape[1])
    for i in range(x.shape[1]):
        known = x[:, i][np.isfinite(x[:, i])]
        if len(known):
            out[i] = np.partition(known, len(known) // 2)[len(known) // 2]
    return out


def moments(x: np.ndarray, strips: list[slice], about: np.ndarray) -> list[np.ndarray]:
    """For each strip the six matrices of its rows by all columns, as sums about given values: not centred yet."""
    known = ~np.isnan(x)
    v, d = known.astype(float), np.where(known, x - about, 0.0)
    dd = d * d
    return [np.stack([v[:, s].T @ v, d[:, s].T @ v, v[:, s].T @ d, dd[:, s].T @ v, v[:, s].T @ dd, d[:, s].T @ d]) for s in strips]


def centred(sums: np.ndarray, rows: slice, about: np.ndarray) -> np.ndarray:
    """Sums about given values as means and centred co-moments."""
    n = np.maximum(sums[COUNT], 1)
    left, right = sums[LEFT] / n, sums[RIGHT] / n
    return np.stack([
        sums[COUNT], left + about[rows][:, None], right + about, sums[LEFT_SQUARE] - sums[LEFT] * left,
        sums[RIGHT_SQUARE] - sums[RIGHT] * right, sums[PRODUCT] - sums[LEFT] * right,
    ])


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The centred co-moments of two tables together."""
    n = a[COUNT] + b[COUNT]
    share = b[COUNT] / np.maximum(n, 1)
    dl, dr = (np.where(b[COUNT] == 0, 0.0, np.where(a[COUNT] == 0, b[k], b[k] - a[k])) for k in (LEFT, RIGHT))
    weight = a[COUNT] * share
    left, right = (np.where(a[COUNT] == 0, b[k], a[k] + d * share) for k, d in ((LEFT, dl), (RIGHT, dr)))
    return np.stack([n, left, right, a[LEFT_SQUARE] + b[LEFT_SQUARE] + dl * dl * weight, a[RIGHT_SQUARE] + b[RIGHT_SQUARE] + dr * dr * weight, a[PRODUCT] + b[PRODUCT] + dl * dr * weight])


def co_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """key, state: strips of the co-moment matrix of columns; strip key holds rows key * STRIP on."""
    p = len(columns)
    strips = [slice(a, min(a + STRIP, p)) for a in range(0, p, STRIP)]

    def gather(batches):
        sums, about = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = numbers(batch, range(p))
            about = _central(x) if about is None else about
            more = moments(x, strips, about)
            sums = more if sums is None else [a + b for a, b in zip(sums, more)]
        about = np.zeros(p) if about is None else about
        for i, some in enumerate(sums or moments(np.empty((0, p)), strips, about)):
            yield i, centred(some, strips[i], about).tobytes()

    def merge(a, b):
        shape = (6, -1, p)
        return joined(np.frombuffer(a).reshape(shape), np.frombuffer(b).reshape(shape)).tobytes()

    values = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    return merged(gathered(values, gather), merge)


def pair_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """left, right, n, covariance (of a sample), r of each pair of columns, left before right as given.

    A pair's numbers are those of the rows that have both; NaN counts as null. r is null without two
    such rows or where either column has no spread in them. One pass over the table.
    """
    p, names = len(columns), list(columns)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = np.frombuffer(state).reshape(6, -1, p)
                for i in range(m.shape[1]):
                    left = key * STRIP + i
                    after = slice(left + 1, p)
                    n, product, spread = m[COUNT, i, after], m[PRODUCT, i, after], np.sqrt(m[LEFT_SQUARE, i, after] * m[RIGHT_SQUARE, i, after])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        r, covariance = product / spread, product / (n - 1)
                    r = np.clip(r, -1, 1)
                    arrays = [pa.array([names[left]] * len(n), pa.string()), pa.array(names[left + 1 :], pa.string()), pa.array(n.astype(np.int64))]
                    arrays += [pa.array(x, pa.float64(), mask=~(np.isfinite(x) & (n > 1) & ok)) for x, ok in ((covariance, True), (r, spread > 0))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["left", "right", "n", "covariance", "r"])

    return co_moments(df, columns).mapInArrow(run, "left string, right string, n long, covariance double, r double")
