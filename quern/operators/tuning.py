"""Search of settings by tree-structured Parzen estimators, trials side by side, and what the history says of each setting."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import stats
from quern.operators.boosting import Setting, fit, probability


@dataclass(frozen=True)
class Range:
    """Values of a setting from low to high, in whole numbers or not, evenly by the logarithm or not."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def inner(self, value: float) -> float:
        """The value's place from 0 to 1."""
        a, b, v = (math.log(x) if self.log else x for x in (self.low, self.high, value))
        return (v - a) / (b - a) if b > a else 0.5

    def outer(self, place: float) -> float:
        a, b = (math.log(x) if self.log else x for x in (self.low, self.high))
        value = a + min(max(place, 0.0), 1.0) * (b - a)
        value = min(max(math.exp(value) if self.log else value, self.low), self.high)
        return int(round(value)) if self.whole else value


#: Settings of the leaf-wise learner that a search may vary.
SPACE = {
    "trees": Range(5, 40, whole=True), "leaves": Range(4, 31, whole=True), "step": Range(0.02, 0.4, log=True), "l2": Range(0.1, 10.0, log=True),
    "least_rows": Range(2, 30, whole=True), "rows": Range(0.6, 1.0), "columns": Range(0.5, 1.0),
}


class Parzen:
    """A density on 0 to 1: equal parts of a normal around each place, cut off at the ends, and an even one."""

    def __init__(self, places: list[float]):
        self.places = sorted(places)
        ends = [0.0, *self.places, 1.0]
        least = 1.0 / min(100.0, 1.0 + len(places))
        self.widths = [min(max(ends[i + 1] - ends[i], ends[i + 2] - ends[i + 1], least), 1.0) for i in range(len(self.places))]

    def draw(self, source: random.Random) -> float:
        i = source.randrange(len(self.places) + 1)
        if i == len(self.places):
            return source.random()
        while True:
            x = source.gauss(self.places[i], self.widths[i])
            if 0 <= x <= 1:
                return x

    def log_density(self, x: float) -> float:
        total = 1.0
        for m, s in zip(self.places, self.widths):
            inside = (math.erf((1 - m) / s / math.sqrt(2)) + math.erf(m / s / math.sqrt(2))) / 2
            total += math.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi) * inside)
        return math.log(total / (len(self.places) + 1))


def propose(history: list[tuple[dict, float]], space: dict[str, Range], count: int, source: random.Random, start: int = 8, candidates: int = 24, share: float = 0.25) -> list[dict]:
    """count settings to try next: drawn evenly for the first start trials, then where good trials are dense and others aren't.

    The best share of the trials (at least two) are the good ones. A value is the one of several draws from the good
    ones' density at which it exceeds the others' most. Trials proposed together count as bad ones for
    one another, so that they stay apart.
    """
    done = sorted(history, key=lambda t: -t[1])
    out: list[dict] = []
    for _ in range(count):
        if len(history) + len(out) < start:
            out.append({name: r.outer(source.random()) for name, r in space.items()})
            continue
        n = max(2, math.ceil(share * len(done)))
        good, bad = [t for t, _ in done[:n]], [t for t, _ in done[n:]] + out
        setting = {}
        for name, r in space.items():
            near, far = (Parzen([r.inner(t[name]) for t in trials]) for trials in (good, bad))
            drawn = [near.draw(source) for _ in range(candidates)]
            setting[name] = r.outer(max(drawn, key=lambda x: near.log_density(x) - far.log_density(x)))
        out.append(setting)
    return out


def optimise(evaluate: Callable[[list[dict]], list[float]], space: dict[str, Range], trials: int, together: int = 4, seed: int = 42, **options) -> list[tuple[dict, float]]:
    """The history (setting, value) in order of the trials; evaluate gets the settings to be tried side by side."""
    source, history = random.Random(seed), []
    while len(history) < trials:
        tried = propose(history, space, min(together, trials - len(history)), source, **options)
        history += zip(tried, evaluate(tried))
    return history


def search(rows: DataFrame, width: int, trials: int = 16, folds: int = 3, together: int = 8, space: dict[str, Range] | None = None, seed: int = 42) -> list[tuple[dict, float]]:
    """The history of settings of the leaf-wise learner and their mean AUC over the folds, in order.

    rows: x (array), y, fold, row, as boosting.fit takes them. All folds of all trials that are tried
    together are fitted by the same passes. A fold whose AUC isn't defined doesn't count.
    """
    space = space or SPACE

    def evaluate(tried: list[dict]) -> list[float]:
        settings = [Setting(**t) for t in tried]
        models = fit(rows, width, [(s, k) for s in settings for k in range(folds)], folds, seed=seed)
        numbers: list[Column] = [F.col("fold") + F.lit(i * folds) for i in range(len(settings))]
        scored = rows.select("y", "fold", F.array(*(probability(models, F.col("x"), n, width) for n in numbers)).alias("p"))
        long = scored.select("y", "fold", F.posexplode("p").alias("trial", "p"))
        found: dict[int, list[float]] = {}
        for r in stats.roc_auc(long, "y", "p", ["trial", "fold"]).collect():  # a row a trial and fold
            if r.auc is not None:
                found.setdefault(r.trial, []).append(r.auc)
        return [float(np.mean(found[i])) if i in found else 0.0 for i in range(len(settings))]

    return optimise(evaluate, space, trials, together, seed)


def history_table(spark: SparkSession, history: list[tuple[dict, float]]) -> DataFrame:
    """trial, value, best (so far), settings (map): a row a trial."""
    rows, best = [], -math.inf
    for i, (setting, value) in enumerate(history):
        best = max(best, value)
        rows.append((i, value, best, {k: float(v) for k, v in setting.items()}))
    return spark.createDataFrame(rows, "trial int, value double, best double, settings map<string, double>")


# ---------------------------------------------------------------- importance of settings


def _grown(x: np.ndarray, y: np.ndarray, draw: np.random.Generator, least: int = 2) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """A regression tree on a resample of the rows of x (places from 0 to 1), as boxes (low, high, value)."""
    chosen = draw.integers(0, len(y), len(y))
    out, todo = [], [(chosen, np.zeros(x.shape[1]), np.ones(x.shape[1]))]
    while todo:
        rows, low, high = todo.pop()
        best = (1e-12, None)
        if len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                total = np.cumsum(y[order])
                n = np.arange(1, len(rows))
                gain = total[:-1] ** 2 / n + (total[-1] - total[:-1]) ** 2 / (len(rows) - n) - total[-1] ** 2 / len(rows)
                fine = (np.diff(x[order, f]) > 0) & (n >= least) & (len(rows) - n >= least)
                if fine.any():
                    k = int(np.argmax(np.where(fine, gain, -np.inf)))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, (x[order[k], f] + x[order[k + 1], f]) / 2))
        if best[1] is None:
            out.append((low, high, float(y[rows].mean())))
            continue
        f, cut = best[1]
        inner, outer = high.copy(), low.copy()
        inner[f] = outer[f] = cut
        todo += [(rows[x[rows, f] <= cut], low, inner), (rows[x[rows, f] > cut], outer, high)]
    return out


def variance_shares(boxes: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """For each setting the share of a tree's variance over the whole space that its own marginal has."""
    low, high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
    value, sides = np.array([b[2] for b in boxes]), high - low
    volume = sides.prod(1)
    mean = (volume * value).sum()
    whole = (volume * (value - mean) ** 2).sum()
    out = np.zeros(low.shape[1])
    for f in range(low.shape[1]) if whole > 0 else ():
        edges = np.unique(np.concatenate([low[:, f], high[:, f]]))
        others = np.where(sides[:, f] > 0, volume / np.where(sides[:, f] > 0, sides[:, f], 1), 0)
        for a, b in zip(edges[:-1], edges[1:]):
            inside = (low[:, f] <= a) & (high[:, f] >= b)
            out[f] += (b - a) * ((others[inside] * value[inside]).sum() - mean) ** 2
    return out / whole if whole > 0 else out


def importances(history: DataFrame, space: dict[str, Range], trees: int = 64, seed: int = 42) -> DataFrame:
    """setting, importance (shares of one) of a history (value, settings): a forest is fitted on it, tree by tree in tasks.

    A tree's variance over the whole space is decomposed: a setting's part is the variance of the mean
    over all other settings. Equal histories give equal importances. A history holds trials, not rows.
    """
    told = [(r.value, r.settings) for r in history.orderBy("trial").select("value", "settings").collect()]
    names = list(space)
    x = np.array([[space[n].inner(s[n]) for n in names] for _, s in told]).reshape(-1, len(names))
    y = np.array([v for v, _ in told], float)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_pylist():
                shares = variance_shares(_grown(x, y, np.random.default_rng([seed, i]))) if len(y) else np.zeros(len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(shares)], names=["setting", "share"])

    spark = history.sparkSession
    mean = spark.range(trees).mapInArrow(run, "setting string, share double").groupBy("setting").agg(F.avg("share").alias("share"))
    whole = mean.agg(F.sum("share").alias("all"))
    return mean.join(F.broadcast(whole)).select("setting", F.coalesce(F.try_divide("share", "all"), F.lit(0.0)).alias("importance"))
