"""Toxic passages as maximal scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quern.llm.common import _BYTE, _LOWER, _power_tables, blocks, clean_text, mix, text_bytes, written

PREFIX = 5
THRESHOLD = 0.3
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def tokens(docs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the fingerprints of its words (runs of letters and digits, A-Z lower-cased) and of their
    first bytes; 0 for words no longer than those."""
    out = []
    for a, b in blocks(docs):
        part = docs[a:b]
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        power, inverse = _power_tables(len(data))
        inside = _IN_WORD[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[0::2], edge[1::2]
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=total[1:])
        words = mix((total[ends] - total[starts]) * inverse[starts])
        heads = mix((total[np.minimum(starts + PREFIX, ends)] - total[starts]) * inverse[starts] + np.uint64(1))
        heads[ends - starts <= PREFIX] = 0
        cuts = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in part]))[:-1]
        out += zip(np.split(words, cuts), np.split(heads, cuts))
    return out


def maximal_segments(at: list[int], weights: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first and last word, score) of a text in time linear in its hits.

    Word at[i] has weights[i] > 0, every other word has other < 0. The algorithm is that of Ruzzo and
    Tompa: a list of candidates, each with the sums before and after it, where a new candidate takes
    in those behind which its own total is higher.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for i, w in zip(at, weights):
        total += other * (i - last - 1)
        first, before = i, total
        total += w
        last = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((first, last, before, total))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class Model:
    """Token weights (log-odds of toxic against other texts), the weight of all other tokens, K of the
    extreme-value law and the logistic curve from the calibrated sum to a probability."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, other: float, k: float = 1.0, curve=(0.0, 1.0)):
        order = np.argsort(keys)
        self.keys, self.weights, self.other, self.k, self.curve = keys[order], weights[order], other, k, curve

    def _weight(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], 0.0)

    def segments(self, words: np.ndarray, heads: np.ndarray) -> list[tuple[int, int, float]]:
        w = self._weight(words)
        w = np.where(w > 0, w, self._weight(heads))
        at = np.flatnonzero(w > 0)
        return maximal_segments(at.tolist(), w[at].tolist(), self.other) if len(at) else []

    def significant(self, segments, n: int) -> list[tuple[int, int, float]]:
        """Those with an expected number below 1 in a text of n words, with their excess over that."""
        base = max(0.0, math.log(self.k * max(n, 1)))
        return [(a, b, s - base) for a, b, s in segments if s > base]

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * x))))


def _evidence(model: Model, segments, n: int) -> float:
    """The excess of all significant segments, 50 at most; else how far the best one falls short, 5 at most."""
    if over := sum(x for _, _, x in model.significant(segments, n)):
        return min(50.0, over)
    best = max((s for _, _, s in segments), default=0.0)
    return max(-5.0, best - max(0.0, math.log(model.k * max(n, 1)))) if best > 0 else -5.0


def _counts(training: DataFrame) -> DataFrame:
    """token, toxic, clean: in how many training texts of each kind a word or a word's head stands."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), np.int64)
            held: tuple[list, list] = ([], [])
            for y, (words, heads) in zip(label, tokens(text_bytes(batch.column(0)))):
                held[y].append(np.unique(np.concatenate([words, heads[heads != 0]])))
            for y in (0, 1):
                if held[y]:
                    key, n = np.unique(np.concatenate(held[y]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n * y), pa.array(n * (1 - y))], names=["token", "toxic", "clean"])

    rows = training.select("text", "toxic").mapInArrow(run, "token long, toxic long, clean long")
    return rows.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _fit_curve(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic regression of the label on one number, from counts; a little ridge keeps it finite.

    Newton steps, each halved until the penalised likelihood grows, so it converges from any counts.
    """
    if not rows:
        return -3.0, 1.0
    x, n, y = (np.array(c, float) for c in zip(*rows))
    design, ridge = np.stack([np.ones_like(x), x], axis=1), 1e-2

    def likelihood(beta: np.ndarray) -> float:
        z = design @ beta
        return float((y * z - n * np.logaddexp(0, z)).sum() - ridge / 2 * (beta @ beta))

    share = (y.sum() + 0.5) / (n.sum() + 1)
    beta = np.array([math.log(share / (1 - share)), 0.0])
    now = likelihood(beta)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (y - n * p) - ridge * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-9 and likelihood(beta + size * step) <= now:
            size /= 2
        if size <= 1e-9 or np.abs(size * step).max() < 1e-9:
            break
        beta = beta + size * step
        now = likelihood(beta)
    return float(beta[0]), float(max(beta[1], 0.0))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 50_000, prior: float = 500.0, least_z: float = 3.0) -> Model:
    """Learn the model from the labelled rows that aren't held out.

    At most about most_rows of them are used, drawn by a hash of doc_id; that bounds what is broadcast
    (12 bytes of data a row), the counts and the model on the driver. A token's weight is its log-odds between toxic and other texts under a
    Dirichlet prior of one half plus prior times its share of all counts; tokens with a z-score of
    least_z or more stay. All other tokens together have the log-odds of what is left of either side.
    No labels, or labels of one kind: no token, and every text gets the same low score.
    """
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").where(~F.coalesce(held_out(), F.lit(False)))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = chosen.count()
    if n > most_rows:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < int(1e6 * most_rows / n))
    training = written(docs.select("doc_id", clean_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "training")
    counts = written(_counts(training), "token_counts", 500)
    n1, n0, size = counts.agg(F.sum("toxic"), F.sum("clean"), F.count("*")).first()
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -0.01, 1.0, (-3.0, 0.0))
    a = F.lit(0.5) + F.lit(prior / (n1 + n0)) * (F.col("toxic") + F.col("clean"))
    a0 = 0.5 * size + prior
    odds = lambda y, total: F.log((y + a) / (F.lit(total + a0) - y - a))
    weight = odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)
    z = weight / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    rows = counts.select("token", "toxic", "clean", weight.alias("weight"), z.alias("z")).where((F.col("z") >= least_z) & (F.col("weight") > 0)).collect()
    keys = np.array([r.token for r in rows], np.int64).view(np.uint64)
    m1, m0 = sum(r.toxic for r in rows) / n1, sum(r.clean for r in rows) / n0
    other = min(-0.005, math.log((1 - min(m1, 0.99)) / (1 - min(m0, 0.99))))
    model = Model(keys, np.array([r.weight for r in rows]), other)

    def best(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(len(w), model.segments(w, h)) for w, h in tokens(text_bytes(batch.column(0)))]
            scores = pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), scores], names=["toxic", "n", "scores"])

    seen = written(training.mapInArrow(best, "toxic int, n long, scores array<double>"), "training_scores", 500)
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    k = seen.where("toxic = 0 and n > 0").agg(F.count("*") / F.sum(F.col("n") * F.exp(-top))).first()[0]
    model.k = float(k or 1.0)
    base = F.greatest(F.lit(0.0), F.log(F.lit(model.k) * F.greatest(F.col("n"), F.lit(1))))
    excess = F.aggregate("scores", F.lit(0.0), lambda t, s: t + F.greatest(s - base, F.lit(0.0)))
    short = F.when(top > 0, F.greatest(F.lit(-5.0), top - base)).otherwise(F.lit(-5.0))
    x = F.when(excess > 0, F.least(F.lit(50.0), excess)).otherwise(short)
    bins = seen.groupBy(F.round(x, 1).alias("x")).agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).collect()
    model.curve = _fit_curve([(r.x, r.n, r.y) for r in bins])
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """scored, stored."""
    return written(scored(docs, model, keep), "scored", 500)


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and passages (first and last word and excess score of each significant segment).

    keep: the columns to carry along, all by default; text is read whole, null as empty. A column named
    score or passages is replaced; whoever needs theirs carries all columns as one struct.
    Whoever runs it sets the rows of an Arrow batch, as rows hold whole texts.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("score", "passages")]
    passage = ArrayType(StructType().add("first", "long").add("last", "long").add("score", "double"))
    schema = StructType([docs.schema[c] for c in keep]).add("score", "double").add("passages", passage)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for words, heads in tokens(text_bytes(batch.column(len(keep)))):
                segments = model.segments(words, heads)
                scores.append(model.probability(_evidence(model, segments, len(words))))
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in model.significant(segments, len(words))])
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array(passages, kind)], names=[*keep, "score", "passages"])

    source = docs.select(*(F.col(f"`{c}`") for c in keep), clean_text().alias("_scored"))
    return source.mapInArrow(run, schema)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; see fit and score."""
    rows = score(docs, fit(docs, labels), ["doc_id"])
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"), "passages")
