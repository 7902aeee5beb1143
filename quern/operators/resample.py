"""Metrics of many weighted resamples at once: a row draws a vector of weights, tasks add vectors up, one pass.

Rows are dealt by ranges of their score. What a task knows of its range is a state of a few vectors, as
long as there are rounds; two neighbouring ranges' states make the state of both, ties across their
border included, so that a score that most rows have may be spread over tasks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.blocks import gathered, merged

#: Rows whose weights are held at once, and rounds that one digest draws for.
BLOCK, DRAWS = 512, 4
#: The chance that a Poisson(1) number is at most 0, 1, ... 11.
CUMULATED = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson_weights(keys: list[bytes], rounds: int, seed: int) -> np.ndarray:
    """Rows by rounds: the Poisson(1) number, 12 at most, of each round's uniform draw: eight digits of md5(seed|round / 4|key)."""
    parts = [f"{seed}|{b}|".encode() for b in range(-(-rounds // DRAWS))]
    digests = b"".join(hashlib.md5(p + k).digest() for k in keys for p in parts)
    u = (np.frombuffer(digests, ">u4").reshape(len(keys), -1)[:, :rounds] + 0.5) / 2.0**32
    return np.searchsorted(CUMULATED, u).astype(float)


@dataclass
class Span:
    """What is known of the rows of a range of scores: pairs won, weights of both classes, those called at the
    threshold, and the first and last score with their weights. Each a vector over the rounds but the scores."""

    won: np.ndarray
    p: np.ndarray
    n: np.ndarray
    called_p: np.ndarray
    called_n: np.ndarray
    first: float
    first_p: np.ndarray
    first_n: np.ndarray
    last: float
    last_p: np.ndarray
    last_n: np.ndarray

    @classmethod
    def of(cls, score: np.ndarray, positive: np.ndarray, weight: np.ndarray, threshold: float) -> Span:
        """Rows in order of their score."""
        begins = np.flatnonzero(np.diff(score, prepend=np.nan) != 0)
        p, n = (np.add.reduceat(weight * side[:, None], begins) for side in (positive, ~positive))
        below = np.cumsum(n, 0) - n
        called = score[begins] >= threshold
        return cls((p * (below + n / 2)).sum(0), p.sum(0), n.sum(0), p[called].sum(0), n[called].sum(0), score[0], p[0], n[0], score[-1], p[-1], n[-1])

    def then(self, b: Span) -> Span:
        """This range and the next one: b's positives win over this range's negatives, halves at a common score."""
        won = self.won + b.won + b.p * self.n
        same = self.last == b.first
        if same:
            won = won + (self.last_p * b.first_n - b.first_p * self.last_n) / 2
        first_p, first_n, last_p, last_n = self.first_p, self.first_n, b.last_p, b.last_n
        if same and self.first == self.last:
            first_p, first_n = first_p + b.first_p, first_n + b.first_n
        if same and b.first == b.last:
            last_p, last_n = last_p + self.last_p, last_n + self.last_n
        return Span(won, self.p + b.p, self.n + b.n, self.called_p + b.called_p, self.called_n + b.called_n, self.first, first_p, first_n, b.last, last_p, last_n)

    def pack(self) -> bytes:
        vectors = (self.won, self.p, self.n, self.called_p, self.called_n, self.first_p, self.first_n, self.last_p, self.last_n)
        return np.concatenate([[self.first, self.last], *vectors]).tobytes()

    @classmethod
    def unpack(cls, state: bytes) -> Span:
        x = np.frombuffer(state)
        won, p, n, cp, cn, fp, fn, lp, ln = x[2:].reshape(9, -1)
        return cls(won, p, n, cp, cn, x[0], fp, fn, x[1], lp, ln)


def poisson_metrics(df: DataFrame, label: str, score: str, key: Column, rounds: int = 2000, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """round, auc, f1, sensitivity, specificity of resamples by Poisson(1) weights; null where a class is absent.

    A row's weights follow from seed and its key alone. Rows without label or score don't count. Rows
    cross one exchange, as they are, whatever the rounds.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    rows = rows.select(F.col(score).cast("double").alias("s"), (F.col(label) == 1).alias("y"), key.cast("string").cast("binary").alias("key"))

    def gather(batches):
        span = None
        for batch in batches:
            s, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys = [k or b"" for k in batch.column(2).to_pylist()]
            for a in range(0, len(s), BLOCK):
                cut = slice(a, a + BLOCK)
                new = Span.of(s[cut] + 0.0, y[cut].astype(bool), poisson_weights(keys[cut], rounds, seed), threshold)
                span = new if span is None else span.then(new)
        if span is not None:
            yield 0, span.pack()

    def finished(batches):
        import pyarrow as pa

        for batch in batches:
            for state in batch.column(1).to_pylist():
                x = Span.unpack(state)
                with np.errstate(divide="ignore", invalid="ignore"):
                    values = (x.won / x.p / x.n, 2 * x.called_p / (x.called_p + x.called_n + x.p), x.called_p / x.p, 1 - x.called_n / x.n)
                one = (x.p == 0) | (x.n == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), *(pa.array(v, mask=one | ~np.isfinite(v)) for v in values)], names=["round", "auc", "f1", "sensitivity", "specificity"])

    dealt = rows.repartitionByRange("s", F.xxhash64("key")).sortWithinPartitions("s")
    states = merged(gathered(dealt, gather), lambda a, b: Span.unpack(a).then(Span.unpack(b)).pack())
    return states.mapInArrow(finished, "round long, auc double, f1 double, sensitivity double, specificity double")
