"""Evaluation of scores as grouped aggregates: exact with ties, in one table however many groups.

Scores are first counted by value (group, score, positives, negatives), which the tasks do before any
exchange; ranks and cumulative sums then run over the distinct scores of a group, in parts of their
order (see ordered), so that no task holds all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import resample
from quern.operators.ordered import drawn_places, score_part, with_before
from quern.operators.select import draw


def score_counts(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*(by or []), F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def _window(by: list[str] | None):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def _placed(df: DataFrame, label: str, score: str, by: list[str], descending: bool = False) -> DataFrame:
    """score_counts with before_p, before_n (positives and negatives of smaller, or larger, scores), all_p and all_n."""
    order = [F.desc("s") if descending else F.asc("s")]
    return with_before(score_counts(df, label, score, by), by, score_part(F.col("s")), order, ["p", "n"], descending)


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """auc: the share of pairs of a positive and a negative that the score orders rightly, ties half."""
    by = by or []
    rows = _placed(df, label, score, by).withColumn("won", F.col("p") * (F.col("before_n") + F.col("n") / F.lit(2.0)))
    total = rows.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return total.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / F.col("n_pos") / F.col("n_neg"))).drop("won")


def average_precision(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """ap: the mean precision at each step of recall, without interpolation."""
    by = by or []
    tp, fp = F.col("before_p") + F.col("p"), F.col("before_n") + F.col("n")
    rows = _placed(df, label, score, by, descending=True).withColumn("part", F.col("p") * tp / (tp + fp))
    return rows.groupBy(*by).agg(F.try_divide(F.sum("part"), F.sum("p")).alias("ap"))


def curves(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """threshold, tpr, fpr, precision at each distinct score: the points of the ROC and precision-recall curves."""
    by = by or []
    tp, fp = F.col("before_p") + F.col("p"), F.col("before_n") + F.col("n")
    rows = _placed(df, label, score, by, descending=True)
    return rows.select(*by, F.col("s").alias("threshold"), F.try_divide(tp, F.col("all_p")).alias("tpr"), F.try_divide(fp, F.col("all_n")).alias("fpr"), (tp / (tp + fp)).alias("precision"))


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    y, call = F.col(label), F.col(score) >= threshold
    rows = df.where(y.isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & call).alias("tp"), F.count_if((y == 0) & call).alias("fp"), F.count_if((y == 0) & ~call).alias("tn"), F.count_if((y == 1) & ~call).alias("fn"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
    )


def evaluate(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: n, auc, ap, f1, precision, sensitivity, specificity, mcc, brier."""
    c = confusion(df, label, score, threshold)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    zero = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1.0).otherwise(b))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.join(roc_auc(df, label, score)).join(average_precision(df, label, score)).select(
        (tp + fp + tn + fn).cast("long").alias("n"), "auc", "ap", zero(2 * tp, 2 * tp + fp + fn).alias("f1"), zero(tp, tp + fp).alias("precision"),
        zero(tp, tp + fn).alias("sensitivity"), zero(tn, tn + fp).alias("specificity"), zero(tp * tn - fp * fn, root).alias("mcc"), "brier",
    )


def threshold_grid(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """i, threshold, sensitivity, specificity at the 91 thresholds 0.05 to 0.95.

    Each row is counted once, at the largest grid threshold that its score reaches; the counts at a
    threshold are the sums from it on. Nothing is multiplied by the grid.
    """
    by = by or []
    step = F.expr(" + ".join(f"CASE WHEN `{score}` >= {round(0.05 + 0.01 * i, 2)}D THEN 1 ELSE 0 END" for i in range(91)))
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counted = rows.groupBy(*by, step.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    w = _window(by)
    grid = F.explode(F.sequence(F.lit(0), F.lit(91)))
    full = counted.select(*by).distinct() if by else df.sparkSession.range(1).select()
    full = full.select(*by, grid.alias("reached")).join(counted, [*by, "reached"], "left").na.fill(0, ["p", "n"])
    full = full.withColumns({"tp": F.sum("p").over(w.orderBy(F.desc("reached"))), "fp": F.sum("n").over(w.orderBy(F.desc("reached"))), "pos": F.sum("p").over(w), "neg": F.sum("n").over(w)})
    i = F.col("reached") - 1
    return full.where("reached > 0").select(*by, i.alias("i"), F.round(F.lit(0.05) + F.lit(0.01) * i, 2).alias("threshold"), F.try_divide("tp", "pos").alias("sensitivity"), (1 - F.try_divide("fp", "neg")).alias("specificity"))


def youden_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The first grid threshold with the largest sensitivity + specificity - 1."""
    j = F.round(F.col("sensitivity") + F.col("specificity") - 1, 9)
    return threshold_grid(df, label, score).withColumn("j", j).orderBy(F.desc("j"), "i").limit(1).select("threshold", "j")


def panel_thresholds(df: DataFrame, label: str, score: str, by: str, least: int = 30) -> DataFrame:
    """by, threshold, own: each group's own first best threshold, or that of all rows where it has one class or too few rows."""
    j = F.round(F.col("sensitivity") + F.col("specificity") - 1, 9)
    best = threshold_grid(df, label, score, [by]).withColumn("j", j).groupBy(by).agg(F.max_by("threshold", F.struct("j", -F.col("i"))).alias("own_threshold"))
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    enough = rows.groupBy(by).agg(((F.count("*") >= least) & (F.count_distinct(label) == 2)).alias("own"))
    overall = youden_threshold(df, label, score).first()
    threshold = F.when(F.col("own"), F.col("own_threshold")).otherwise(F.lit(overall.threshold if overall else 0.5))
    return enough.join(best, by, "left").select(by, threshold.alias("threshold"), "own")


def panel_sensitivity_thresholds(df: DataFrame, label: str, score: str, by: str, least_sensitivity: float = 0.90, least: int = 30) -> DataFrame:
    """by, threshold, own: each group's highest threshold with enough sensitivity, or that of all rows where it has one class or too few rows."""
    own = threshold_grid(df, label, score, [by]).groupBy(by).agg(F.max(F.when(F.col("sensitivity") >= least_sensitivity, F.col("threshold"))).alias("own_threshold"))
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    enough = rows.groupBy(by).agg(((F.count("*") >= least) & (F.count_distinct(label) == 2)).alias("own"))
    overall = sensitivity_threshold(df, label, score, least_sensitivity).first()
    threshold = F.when(F.col("own"), F.coalesce("own_threshold", F.lit(0.05))).otherwise(F.lit(overall.threshold))
    return enough.join(own, by, "left").select(by, threshold.alias("threshold"), "own")


def sensitivity_threshold(df: DataFrame, label: str, score: str, least: float = 0.90) -> DataFrame:
    """The highest grid threshold with enough sensitivity, 0.05 if there is none."""
    return threshold_grid(df, label, score).agg(F.coalesce(F.max(F.when(F.col("sensitivity") >= least, F.col("threshold"))), F.lit(0.05)).alias("threshold"))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 5) -> DataFrame:
    """bin, n, mean_score, share_positive over equal parts of 0 to 1."""
    part = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(part.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share_positive"))


def mid_rank(values: Column, by: list[Column | str] | None = None) -> Column:
    """Average rank with ties."""
    by = by or [F.lit(1)]
    return F.rank().over(Window.partitionBy(*by).orderBy(values)) + (F.count("*").over(Window.partitionBy(*by, values)) - 1) / F.lit(2.0)


def mid_ranks(df: DataFrame, value: str, by: list[str], name: str = "mid_rank") -> DataFrame:
    """df with the average rank with ties of each row's value within its group; null where the value is."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_s")).agg(F.count("*").alias("_n"))
    ranks = with_before(counts, by, score_part(F.col("_s")), [F.col("_s")], ["_n"])
    rank = F.col("before__n") + (F.col("_n") + 1) / F.lit(2.0)
    ranks = ranks.select(*(F.col(b).alias(f"_b_{i}") for i, b in enumerate(by)), "_s", rank.alias(name))
    same = F.col(value).cast("double") == F.col("_s")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{i}"))
    return df.join(ranks, same, "left").select(*df.columns, name)


def delong(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """auc_a, auc_b, delta, z for two scores of the same rows.

    z is 0 if the difference has no variance; all are null if a class is absent, and z is null if one
    has a single row. A row's placement is the share of the other class that its score beats, ties half.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(label).alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    parts = rows
    for s in "ab":
        beats = lambda x: (F.col(f"before_{x}") + F.col(x) / F.lit(2.0)) / F.col(f"all_{x}")
        placed = _placed(rows, "y", s, [])
        placed = placed.select(F.col("s").alias(s), F.when(F.col("all_n") > 0, beats("n")).alias(f"pos_{s}"), F.when(F.col("all_p") > 0, 1 - beats("p")).alias(f"neg_{s}"))
        parts = parts.join(placed, s).withColumn(f"v{s}", F.when(F.col("y") == 1, F.col(f"pos_{s}")).otherwise(F.col(f"neg_{s}")))
    side = lambda y, f, *c: f(*(F.when(F.col("y") == y, F.col(x)) for x in c))
    variance = F.lit(0.0)
    for y in (1, 0):
        spread = side(y, F.var_samp, "va") + side(y, F.var_samp, "vb") - 2 * side(y, F.covar_samp, "va", "vb")
        variance = variance + F.try_divide(spread, F.count_if(F.col("y") == y))
    out = parts.agg(side(1, F.avg, "va").alias("auc_a"), side(1, F.avg, "vb").alias("auc_b"), variance.alias("v"))
    delta = F.col("auc_a") - F.col("auc_b")
    return out.select("auc_a", "auc_b", delta.alias("delta"), F.when(F.col("v") <= 1e-18, 0.0).otherwise(delta / F.sqrt(F.greatest("v", F.lit(1e-18)))).alias("z"))


def normal_p(z: Column) -> Column:
    """Two-sided p of a z: 2 (1 - Phi(|z|)), by a rational approximation of the error function (error below 1.5e-7).

    Fixed values: Abramowitz and Stegun, Handbook of Mathematical Functions, 7.1.26.
    """
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.when(x == 0, 1.0).otherwise(poly * F.exp(-x * x))


def resamples(df: DataFrame, key: Column, rounds: int, seed: int = 42) -> DataFrame:
    """round and df's columns: rounds resamples with replacement, as many rows each as df has.

    The rows are numbered by their drawn order, and draw k of a round takes row md5(seed, round, k) mod n.
    The draws are a distributed range, not an array in a row.
    """
    rows = drawn_places(df, [], draw(seed, key), key).withColumn("_i", F.col("place") - 1).select(*df.columns, "_i")
    n = max(df.count(), 1)
    draws = df.sparkSession.range(rounds * n).select(F.floor(F.col("id") / n).cast("long").alias("round"), (F.col("id") % n).alias("_k"))
    index = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "round", "_k")), 1, 8), 16, 10).cast("long") % n
    return draws.select("round", index.alias("_i")).join(rows, "_i").drop("_i")


def bootstrap_auc(df: DataFrame, label: str, score: str, key: Column, rounds: int = 50, seed: int = 42) -> DataFrame:
    """round, auc of resamples with replacement; a resample of one class has none.

    Scores of very many rows are better resampled by Poisson weights: see poisson_auc.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).alias("y"), F.col(score).alias("s"), key.alias("_key"))
    return roc_auc(resamples(rows, F.col("_key"), rounds, seed), "y", "s", ["round"]).where("auc is not null").select("round", "auc")


def bootstrap_metrics(df: DataFrame, label: str, score: str, key: Column, threshold: float = 0.5, rounds: int = 50, seed: int = 42) -> DataFrame:
    """round, auc, ap, f1, sensitivity, specificity of resamples with replacement; those of one class are left out."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).alias("y"), F.col(score).alias("s"), key.alias("_key"))
    drawn = resamples(rows, F.col("_key"), rounds, seed).groupBy("round", "s").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    placed = with_before(drawn, ["round"], score_part(F.col("s")), [F.desc("s")], ["p", "n"], descending=True)
    tp, fp, call = F.col("before_p") + F.col("p"), F.col("before_n") + F.col("n"), F.col("s") >= threshold
    behind = F.col("all_n") - F.col("before_n") - F.col("n")
    sums = placed.groupBy("round").agg(
        F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum(F.col("p") * (behind + F.col("n") / F.lit(2.0))).alias("won"), F.sum(F.col("p") * tp / (tp + fp)).alias("steps"),
        F.sum(F.when(call, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(call, F.col("n")).otherwise(0)).alias("fp"),
    ).where("pos > 0 and neg > 0")
    wrong = F.col("fp") + F.col("pos") - F.col("tp")
    return sums.select(
        "round", (F.col("won") / F.col("pos") / F.col("neg")).alias("auc"), (F.col("steps") / F.col("pos")).alias("ap"), (2 * F.col("tp") / (2 * F.col("tp") + wrong)).alias("f1"),
        (F.col("tp") / F.col("pos")).alias("sensitivity"), (1 - F.col("fp") / F.col("neg")).alias("specificity"),
    )


def metric_intervals(resampled: DataFrame, metrics: tuple[str, ...] = ("auc", "ap", "f1", "sensitivity", "specificity"), level: float = 0.95) -> DataFrame:
    """metric, lo, hi: percentiles of each metric over the rounds."""
    return interval(resampled.unpivot(["round"], list(metrics), "metric", "value"), "value", level, ["metric"])


def paired_bootstrap(df: DataFrame, label: str, a: str, b: str, key: Column, rounds: int = 50, seed: int = 42) -> DataFrame:
    """delta, lo, hi, p of the difference of two scores' AUC on the same resamples; p = 2 min(P(d <= 0), P(d >= 0)), at most 1."""
    rows = df.where(F.col(label).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(label).alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), key.alias("_key"))
    drawn = resamples(rows, F.col("_key"), rounds, seed).unpivot(["round", "y"], ["a", "b"], "which", "s")
    auc = roc_auc(drawn, "y", "s", ["round", "which"]).where("auc is not null")
    d = auc.groupBy("round").agg((F.max(F.when(F.col("which") == "a", F.col("auc"))) - F.max(F.when(F.col("which") == "b", F.col("auc")))).alias("d"))
    share = lambda c: F.avg(c.cast("double"))
    whole = roc_auc(rows.unpivot(["y"], ["a", "b"], "which", "s"), "y", "s", ["which"])
    delta = whole.agg((F.max(F.when(F.col("which") == "a", F.col("auc"))) - F.max(F.when(F.col("which") == "b", F.col("auc")))).alias("delta"))
    p = F.least(F.lit(1.0), 2 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0)))
    return delta.crossJoin(d.agg(F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"), p.alias("p")))


def poisson_auc(df: DataFrame, label: str, score: str, key: Column, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """round, auc of resamples by Poisson(1) weights: no numbering, no join, one pass whatever the rounds."""
    return resample.poisson_metrics(df, label, score, key, rounds, seed=seed).where("auc is not null").select("round", "auc")


def interval(resamples: DataFrame, value: str = "auc", level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """lo, hi: percentiles with linear interpolation."""
    tail = (1 - level) / 2
    return resamples.groupBy(*(by or [])).agg(F.percentile(value, F.lit(tail)).alias("lo"), F.percentile(value, F.lit(1 - tail)).alias("hi"))


def baseline_table(df: DataFrame, label: str, scores: dict[str, int], by: str, least: int = 10) -> DataFrame:
    """by, baseline, coverage, n, auc of each score (with its direction) where both classes and enough rows are there."""
    long = df.unpivot([by, label], list(scores), "baseline", "value")
    sign = F.element_at(F.create_map(*(F.lit(x) for s, d in scores.items() for x in (s, float(d)))), F.col("baseline"))
    long = long.withColumn("signed", F.col("value") * sign)
    coverage = long.groupBy(by, "baseline").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"), F.count("value").alias("n"))
    auc = roc_auc(long, label, "signed", [by, "baseline"])
    return coverage.join(auc, [by, "baseline"]).where((F.col("n") >= least) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(by, "baseline", "coverage", "n", "auc")
