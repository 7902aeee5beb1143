"""Boosted trees that grow leaf by leaf over binned features, many models at once.

Rows stay where they are: a pass over the stored table adds up, for every open leaf of every model, the
gradients by feature and bin; tasks' histograms are added up by a tree (see blocks) and only the best
cut of each leaf comes to the driver. Models differ in settings and in the fold they don't see, so
folds and trials of a search cost the passes of one model.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.blocks import FAN, added, gathered, merged
from quern.sources.work import release_exchanges, stored

#: Values that stand for a column's distribution, and values held before they are reduced to so many.
POINTS, HELD = 1024, 1 << 16
#: A table of at most so many rows is one part, whose histograms needn't be added up.
SMALL = 1 << 16
#: Trees after which the stored margins are brought up to date.
REFRESH = 8
EMPTY = -1


@dataclass(frozen=True)
class Setting:
    """trees of at most so many leaves; step shrinks them; rows and columns are the shares that a tree sees."""

    trees: int = 20
    leaves: int = 15
    step: float = 0.2
    l2: float = 1.0
    least_rows: int = 5
    least_gain: float = 1e-6
    rows: float = 1.0
    columns: float = 1.0


@dataclass
class Tree:
    """Nodes as lists: feature (-1 for a leaf), the last bin and value that go left, children, value, rows seen, and the cut's gain."""

    feature: list[int]
    cut: list[int]
    at: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    cover: list[float]
    gain: list[float]


@dataclass
class Model:
    """base is the margin without trees; a row's margin adds a leaf's value from each tree."""

    setting: Setting
    base: float
    trees: list[Tree] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Model:
        told = json.loads(text)
        return cls(Setting(**told["setting"]), told["base"], [Tree(**t) for t in told["trees"]])


# ---------------------------------------------------------------- bins


def summary(values: np.ndarray, weights: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """At most so many values with weights that stand for all; exact if there are no more distinct ones."""
    known, place = np.unique(values, return_inverse=True)
    weight = np.bincount(place, weights, len(known))
    if len(known) <= points:
        return known, weight
    total = np.cumsum(weight)
    at = np.searchsorted(total, (np.arange(points) + 0.5) / points * total[-1])
    chosen, count = np.unique(at, return_counts=True)
    return known[chosen], count * total[-1] / points


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 values that part the weight evenly; x goes to the first bin whose value isn't below it."""
    if len(values) <= bins:
        return values[:-1]
    total = np.cumsum(weights)
    at = np.unique(np.searchsorted(total, np.arange(1, bins) / bins * total[-1]))
    return values[at[at < len(values) - 1]]


def _rows(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column of doubles as a matrix, null as NaN."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def column_summaries(rows: DataFrame, width: int, folds: int) -> tuple[list, np.ndarray]:
    """For each fold the summaries of its columns, and its rows and positives (folds by 2). rows: x (array), y, fold."""

    def gather(batches):
        held, kept, counts, size = [[] for _ in range(folds)], [None] * folds, np.zeros((folds, 2)), 0

        def reduce():
            for f in range(folds):
                if not held[f]:
                    continue
                x = np.concatenate(held[f])
                held[f].clear()
                old = kept[f] or [(np.zeros(0), np.zeros(0))] * width
                new = []
                for j in range(width):
                    v = x[:, j][~np.isnan(x[:, j])]
                    new.append(summary(np.concatenate([old[j][0], v]), np.concatenate([old[j][1], np.ones(len(v))])))
                kept[f] = new

        for batch in batches:
            x, y, fold = _rows(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for f in np.unique(fold).tolist():
                held[f].append(x[fold == f])
                counts[f] += (fold == f).sum(), y[fold == f].sum()
            size += len(y)
            if size > HELD:
                reduce()
                size = 0
        reduce()
        for f in range(folds):
            for j in range(width) if kept[f] else ():
                yield f * width + j, np.concatenate(kept[f][j]).tobytes()
            yield folds * width + f, counts[f].tobytes()

    last = folds * width

    def merge(a, b):
        a, b = np.frombuffer(a), np.frombuffer(b)
        (v, w), (s, t) = a.reshape(2, -1), b.reshape(2, -1)
        return np.concatenate(summary(np.concatenate([v, s]), np.concatenate([w, t]))).tobytes()

    states = gathered(rows.select("x", "y", "fold"), gather)
    both = merged(states.where(F.col("key") < last), merge).unionByName(merged(states.where(F.col("key") >= last), added))
    found = {r["key"]: np.frombuffer(r["state"]) for r in both.collect()}
    nothing = np.zeros(0)
    sums = [[tuple(found[f * width + j].reshape(2, -1)) if f * width + j in found else (nothing, nothing) for j in range(width)] for f in range(folds)]
    return sums, np.stack([found.get(last + f, np.zeros(2)) for f in range(folds)])


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: 0 for none, else one more than the cut points below it."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(c, x[:, j], "left") + 1)
    return out


# ---------------------------------------------------------------- growth


def _walk(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    node, feature = np.zeros(len(bins), np.int32), np.array(tree.feature)
    cut, left, right = np.array(tree.cut), np.array(tree.left), np.array(tree.right)
    rows = np.flatnonzero(feature[node] >= 0)
    while len(rows):
        at = node[rows]
        node[rows] = np.where(bins[rows, feature[at]] <= cut[at], left[at], right[at])
        rows = rows[feature[node[rows]] >= 0]
    return node


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _chosen(row: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Which rows a tree sees, from their numbers alone."""
    if share >= 1:
        return np.ones(len(row), bool)
    h = (row.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(32))) / 2.0**64 < share


@dataclass
class _Growing:
    """A tree while it grows: its nodes with gradient, curvature and rows, and the best cut of those that were looked at."""

    tree: Tree
    sums: list[tuple[float, float, float]]
    best: dict[int, tuple | None] = field(default_factory=dict)
    #: Of each node the turns on its way, which decide between equal gains.
    way: list[str] = field(default_factory=lambda: [""])

    @classmethod
    def root(cls) -> _Growing:
        return cls(Tree([EMPTY], [0], [0.0], [EMPTY], [EMPTY], [0.0], [0.0], [0.0]), [(0.0, 0.0, 0.0)])

    def _split(self, node: int) -> None:
        f, cut, _, left, total = self.best[node]
        t = self.tree
        t.feature[node], t.cut[node], t.left[node], t.right[node] = f, cut, len(t.feature), len(t.feature) + 1
        for sums in (left, tuple(a - b for a, b in zip(total, left))):
            for values, new in ((t.feature, EMPTY), (t.cut, 0), (t.at, 0.0), (t.left, EMPTY), (t.right, EMPTY), (t.value, 0.0), (t.cover, 0.0), (t.gain, 0.0)):
                values.append(new)
            self.sums.append(sums)
        self.way += [self.way[node] + "l", self.way[node] + "r"]

    def selected(self, leaves: int) -> tuple[list[int], list[int]]:
        """The cuts that growing leaf by leaf makes, best first, and the nodes it must look at to go on surely.

        A node whose cut is made but whose children aren't known yet lets the next best be made as well:
        a round looks at all of them, and makes are settled once none is missing.
        """
        made, missing, count = [], [], 1
        heap = [(-self.best[0][2], "", 0)] if self.best.get(0) else []
        while heap and count < leaves:
            *_, node = heapq.heappop(heap)
            made.append(node)
            count += 1
            if self.tree.feature[node] == EMPTY:
                self._split(node)
            for child in (self.tree.left[node], self.tree.right[node]):
                if child not in self.best:
                    missing.append(child)
                elif self.best[child]:
                    heapq.heappush(heap, (-self.best[child][2], self.way[child], child))
        if count >= leaves and made:  # the last cut's children aren't needed
            last = {self.tree.left[made[-1]], self.tree.right[made[-1]]}
            missing = [m for m in missing if m not in last] if set(missing) - last else []
        return made, missing

    def finished(self, made: list[int], setting: Setting, cuts: list[np.ndarray]) -> Tree:
        """The tree of the cuts made, with leaf values."""
        keep, old, out = set(made), [0], Tree([], [], [], [], [], [], [], [])
        for node in old:  # grows while it is read
            g, h, n = self.sums[node]
            split = node in keep
            f, cut = (self.tree.feature[node], self.tree.cut[node]) if split else (EMPTY, 0)
            out.feature.append(f)
            out.cut.append(cut)
            out.at.append(float(cuts[f][cut - 1]) if split and cut > 0 else -math.inf)
            out.left.append(len(old) if split else EMPTY)
            out.right.append(len(old) + 1 if split else EMPTY)
            out.value.append(0.0 if split else -setting.step * g / (h + setting.l2))
            out.cover.append(n)
            out.gain.append(self.best[node][2] if split else 0.0)
            if split:
                old += [self.tree.left[node], self.tree.right[node]]
        return out


def _best_cut(hist: np.ndarray, setting: Setting, allowed: np.ndarray) -> tuple | None:
    """feature, bin, gain, sums of the left side and of all, of the best cut; the first among equals. hist: feature, bin, (g, h, n)."""
    total = hist[0].sum(0)
    left = np.cumsum(hist, 1)[:, :-1]
    right = total - left
    gain = (left[..., 0] ** 2 / (left[..., 1] + setting.l2) + right[..., 0] ** 2 / (right[..., 1] + setting.l2) - total[0] ** 2 / (total[1] + setting.l2)) / 2
    fine = (left[..., 2] >= setting.least_rows) & (right[..., 2] >= setting.least_rows) & allowed[:, None]
    gain = np.where(fine, gain.round(9), -np.inf)  # so that the order of sums decides nothing
    f, cut = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, cut] > setting.least_gain:
        return int(f), int(cut), None, None, tuple(total.tolist())
    return int(f), int(cut), float(gain[f, cut]), tuple(left[f, cut].tolist()), tuple(total.tolist())


def fit(rows: DataFrame, width: int, jobs: list[tuple[Setting, int]], folds: int, bins: int = 32, seed: int = 42) -> list[Model]:
    """A model for each job (setting, fold that it doesn't see; -1 sees all) of rows: x (array of width doubles, null or
    NaN: missing), y (0 or 1), fold (0 to folds - 1), row (a number that stays the row's).

    Cut points come from the rows a model sees. Missing values have a bin of their own, on the left of every
    cut. Without rows of both classes a model has no trees. On the driver: cuts and summaries of columns
    and trees, none of which grows with the rows.
    """
    sums, counts = column_summaries(rows, width, folds)
    skips = sorted({skip for _, skip in jobs})
    cuts: dict[int, list[np.ndarray]] = {}
    for skip in skips:
        seen = [f for f in range(folds) if f != skip]
        pairs = [[np.concatenate([sums[f][j][k] for f in seen]) if seen else np.zeros(0) for k in (0, 1)] for j in range(width)]
        cuts[skip] = [cut_points(*summary(*p), bins) for p in pairs]
    models, draws = [], []
    for m, (setting, skip) in enumerate(jobs):
        n, p = sum(counts[f] for f in range(folds) if f != skip) + np.zeros(2)
        share = min(max(p / n, 1e-6), 1 - 1e-6) if n else 0.5
        models.append(Model(setting, math.log(share / (1 - share))))
        draws.append(np.random.default_rng([seed, m]))
        models[-1].alive = bool(0 < p < n)

    def prepare(batches):
        import pyarrow as pa

        for batch in batches:
            x = _rows(batch.column(0), width)
            packed = np.concatenate([_binned(x, cuts[s]) for s in skips], 1)
            start = np.tile([m.base for m in models], (len(x), 1))
            columns = [batch.column(1), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array([r.tobytes() for r in start], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "fold", "row", "bins", "margins"])

    schema = "y double, fold int, row long, bins binary, margins binary"
    ready = rows.select("x", F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"), F.col("row").cast("long").alias("row"))
    ready = ready.coalesce(1) if counts[:, 0].sum() <= SMALL else ready
    table = stored(ready.mapInArrow(prepare, schema), "binned")
    tasks, since = table.rdd.getNumPartitions(), 0
    for t in range(max((s.trees for s, _ in jobs), default=0)):
        alive = [m for m, model in enumerate(models) if model.alive and t < model.setting.trees]
        if not alive:
            break
        if t - since >= REFRESH:
            table, since = stored(_moved(table, models, skips, width, jobs, since), "margins"), t
        growing = {m: _Growing.root() for m in alive}
        allowed = {m: _columns(draws[m], width, models[m].setting.columns) for m in alive}
        open_ = {m: [0] for m in alive}
        while open_:
            found = _round(table, models, skips, width, jobs, since, t, growing, open_, bins, allowed, tasks)
            for m, node, best in found:
                g = growing[m]
                if node == 0:
                    g.sums[0] = best[4]
                g.best[node] = best if best[2] is not None else None
            open_ = {m: missing for m in open_ if (missing := growing[m].selected(models[m].setting.leaves)[1])}
        for m in alive:
            made, _ = growing[m].selected(models[m].setting.leaves)
            models[m].trees.append(growing[m].finished(made, models[m].setting, cuts[jobs[m][1]]))
        release_exchanges(rows.sparkSession)  # a tree is several passes, whose plans and exchanges nobody holds now
    return models


def _columns(draw, width: int, share: float) -> np.ndarray:
    out = np.ones(width, bool)
    if share < 1:
        out[draw.permutation(width)[max(1, math.ceil(share * width)) :]] = False
    return out


def _read(batch, width: int, n_skips: int, n_models: int):
    y, fold, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, n_skips, width)
    margins = np.frombuffer(b"".join(batch.column(4).to_pylist())).reshape(-1, n_models)
    return y, fold, row, bins, margins


def _moved(table: DataFrame, models: list[Model], skips: list[int], width: int, jobs: list, since: int) -> DataFrame:
    """table with margins that have the trees since the last time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            _, _, _, bins, margins = _read(batch, width, len(skips), len(models))
            margins = margins.copy()
            for m, model in enumerate(models):
                own = bins[:, skips.index(jobs[m][1])]
                for tree in model.trees[since:]:
                    margins[:, m] += np.array(tree.value)[_walk(tree, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r.tobytes() for r in margins], pa.binary())], names=batch.schema.names)

    return table.mapInArrow(run, table.schema)


def _round(table, models, skips, width, jobs, since, t, growing, open_, bins, allowed, tasks) -> list[tuple[int, int, tuple]]:
    """model, node and best cut of the open nodes of all models: one pass over the table."""
    places = [(m, node) for m, nodes in open_.items() for node in nodes]
    trees, cells = {m: growing[m].tree for m in open_}, bins + 1

    def gather(batches):
        hist = np.zeros((len(places), width, cells, 3))
        first = {m: next(i for i, p in enumerate(places) if p[0] == m) for m in open_}
        for batch in batches:
            y, fold, row, packed, margins = _read(batch, width, len(skips), len(models))
            for m, nodes in open_.items():
                model, own = models[m], packed[:, skips.index(jobs[m][1])]
                use = np.flatnonzero((fold != jobs[m][1]) & _chosen(row, t, model.setting.rows))
                at = np.full(len(trees[m].feature), -1)
                at[nodes] = np.arange(len(nodes))
                slot = at[_walk(trees[m], own[use])]
                use, slot = use[slot >= 0], slot[slot >= 0]
                margin, own = margins[use, m].copy(), own[use]
                for tree in model.trees[since:]:
                    margin += np.array(tree.value)[_walk(tree, own)]
                p = _sigmoid(margin)
                g, h = p - y[use], p * (1 - p)
                for j in range(width):
                    cell, size = slot * cells + own[:, j], len(nodes) * cells
                    for k, w in enumerate((g, h, None)):
                        hist[first[m] : first[m] + len(nodes), j, :, k] += np.bincount(cell, w, size).reshape(len(nodes), cells)
        for i in range(len(places)):
            yield i, hist[i].tobytes()

    settings = [models[m].setting for m, _ in places]
    masks = [allowed[m] for m, _ in places]

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for key, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, at, gain, left, total = _best_cut(np.frombuffer(state).reshape(width, cells, 3), settings[key], masks[key])
                values = [key, f, at, gain, list(left) if left else None, list(total)]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["key", "f", "at", "gain", "left", "total"])

    states = gathered(table, gather)
    states = states.select("key", "state") if tasks == 1 else merged(states, added, 1 if tasks <= FAN else 2)
    found = states.mapInArrow(cut, "key int, f int, at int, gain double, left array<double>, total array<double>")
    return [(*places[r["key"]], (r["f"], r["at"], r["gain"], tuple(r["left"]) if r["left"] else None, tuple(r["total"]))) for r in found.collect()]


# ---------------------------------------------------------------- scores


def margins(model: Model, x: np.ndarray) -> np.ndarray:
    """The margin of each row of x."""
    out = np.full(len(x), model.base)
    for tree in model.trees:
        out += np.array(tree.value)[ends(tree, x)]
    return out


def ends(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x; missing values go left."""
    node, feature, at = np.zeros(len(x), np.int32), np.array(tree.feature), np.array(tree.at)
    left, right = np.array(tree.left), np.array(tree.right)
    rows = np.flatnonzero(feature[node] >= 0)
    while len(rows):
        here = node[rows]
        value = x[rows, feature[here]]
        node[rows] = np.where(np.isnan(value) | (value <= at[here]), left[here], right[here])
        rows = rows[feature[node[rows]] >= 0]
    return node


def gain_shares(model: Model, width: int) -> np.ndarray:
    """Each feature's share of the gain of all cuts; zeros without cuts."""
    out = np.zeros(width)
    for tree in model.trees:
        for f, gain in zip(tree.feature, tree.gain):
            if f != EMPTY:
                out[f] += gain
    return out / out.sum() if out.sum() > 0 else out


def probability(models: list[Model], x: Column, which: Column, width: int) -> Column:
    """The probability that the model of number which gives to the row's features x."""
    @F.pandas_udf("double")
    def score(features: pd.Series, number: pd.Series) -> pd.Series:
        rows = np.array([np.asarray(v, float) for v in features]).reshape(len(features), width)
        out = np.zeros(len(rows))
        for m in np.unique(number.to_numpy()).tolist():
            own = number.to_numpy() == m
            out[own] = _sigmoid(margins(models[m], rows[own]))
        return pd.Series(out)

    return score(x, which)
