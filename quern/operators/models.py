"""Models: imputation, an ensemble of boosted trees that grow by level and by leaf, isotonic calibration, stacking."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import boosting, ordered, select, stats

#: Settings of the ensemble's two learners: trees that grow level by level (pyspark.ml), and leaf by leaf (boosting).
LEVEL = {"maxDepth": 4, "maxIter": 8, "stepSize": 0.2}
LEAF = boosting.Setting(trees=8, leaves=8, step=0.4)
#: Fits that run side by side: a fit is many short jobs, whose tasks fill each other's pauses.
TOGETHER = 6


def fill_values(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, object]:
    """Exact medians and the most frequent values (ties: the smallest), from the training rows only."""
    out: dict[str, object] = {}
    if numeric:
        row = train.agg(*(F.median(c).alias(c) for c in numeric)).first()
        out |= {c: row[c] if row[c] is not None else 0.0 for c in numeric}
    for c in categorical:
        first = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        out[c] = first[0] if first else ""
    return out


def fold_fills(df: DataFrame, numeric: list[str], fold: str, k: int) -> list[dict[str, float]]:
    """For each fold the exact medians of the other folds' values, of those columns that lack values (null or NaN) anywhere.

    Values are counted by fold once, and the counts are added up in parts of their order, for all columns and folds at once.
    """
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in numeric}
    lacks = df.agg(*(F.count_if(x.isNull()).alias(f"_{i}") for i, x in enumerate(number.values()))).first() if numeric else ()
    open_ = [c for c, n in zip(numeric, lacks) if n]
    fills = [dict.fromkeys(open_, 0.0) for _ in range(k)]
    if not open_:
        return fills
    names = [f"_{i}" for i in range(len(open_))]
    long = df.select(F.col(fold).alias("_fold"), *(number[c].alias(x) for c, x in zip(open_, names))).unpivot(["_fold"], names, "_name", "s").where("s IS NOT NULL")
    sums = [f"n_{i}" for i in range(k)]
    counts = long.groupBy("_name", "s").agg(*(F.count_if(F.col("_fold") == i).alias(c) for i, c in enumerate(sums)))
    most = F.lit(sys.float_info.max)
    rows = ordered.with_before(counts, ["_name"], ordered.score_part(F.least(F.greatest("s", -most), most)), [F.asc("s")], sums)
    middle = []
    for i in range(k):
        own, before, size = (sum((F.col(f"{x}{c}") for j, c in enumerate(sums) if j != i), F.lit(0)) for x in ("", "before_", "all_"))
        for at in (F.floor((size - 1) / 2), F.floor(size / 2)):
            middle.append(F.max(F.when((before <= at) & (at < before + own), F.col("s"))).alias(f"m_{len(middle)}"))
    for r in rows.groupBy("_name").agg(*middle).collect():  # a row a column
        for i in range(k):
            if r[f"m_{2 * i}"] is not None:
                fills[i][open_[names.index(r._name)]] = 0.5 * r[f"m_{2 * i}"] + 0.5 * r[f"m_{2 * i + 1}"]
    return fills


def preprocessor(numeric: list[str], categorical: list[str]) -> list:
    """Stages to one feature vector; categories not seen in training have a column of their own."""
    stages: list = []
    if categorical:
        indexed, hot = [f"_i_{c}" for c in categorical], [f"_h_{c}" for c in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=hot)]
        return [*stages, VectorAssembler(inputCols=[*numeric, *hot], outputCol="features", handleInvalid="keep")]
    return [VectorAssembler(inputCols=numeric, outputCol="features", handleInvalid="keep")]


def probability(column: str = "probability") -> Column:
    return F.get(vector_to_array(F.col(column)), F.lit(1))


def category_levels(train: DataFrame, categorical: list[str]) -> dict[str, list[str]]:
    """The values of each category in the training rows, in order; a category has few."""
    return {c: sorted(r[0] for r in train.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().collect()) for c in categorical}


def feature_array(numeric: list[str], levels: dict[str, list[str]]) -> Column:
    """The numeric columns and one of 0 or 1 for each value of the categories, as an array; absent numbers stay absent."""
    marks = [(F.col(c).cast("string").eqNullSafe(F.lit(v))).cast("double") for c, values in levels.items() for v in values]
    return F.array(*(F.col(c).cast("double") for c in numeric), *marks)


def leaf_rows(df: DataFrame, label: str, numeric: list[str], levels: dict[str, list[str]], fold: Column) -> DataFrame:
    return df.select(feature_array(numeric, levels).alias("x"), F.col(label).alias("y"), fold.cast("int").alias("fold"), F.lit(0).alias("row"))


def _width(numeric: list[str], levels: dict[str, list[str]]) -> int:
    return len(numeric) + sum(map(len, levels.values()))


def fit_level(ready: DataFrame, numeric: list[str], categorical: list[str], seed: int = 42) -> PipelineModel:
    """The learner that grows by level, on rows without absent values and with a label column."""
    return Pipeline(stages=[*preprocessor(numeric, categorical), GBTClassifier(seed=seed, **LEVEL)]).fit(ready)


class Ensemble:
    """Mean of the probabilities of the two learners (p_level, p_leaf), after the training rows' imputation."""

    def __init__(self, level: PipelineModel, leaf: boosting.Model, numeric: list[str], levels: dict[str, list[str]], fills: dict[str, object]):
        self.level, self.leaf, self.numeric, self.levels, self.fills = level, leaf, numeric, levels, fills

    @classmethod
    def fit(cls, train: DataFrame, label: str, numeric: list[str], categorical: list[str], seed: int = 42) -> Ensemble:
        fills = fill_values(train, numeric, categorical)
        ready = train.na.fill(fills).withColumn("label", F.col(label).cast("double"))
        levels = category_levels(ready, categorical)
        (leaf,) = boosting.fit(leaf_rows(ready, "label", numeric, levels, F.lit(0)), _width(numeric, levels), [(LEAF, -1)], 1, seed=seed)
        return cls(fit_level(ready, numeric, categorical, seed), leaf, numeric, levels, fills)

    def score(self, df: DataFrame) -> DataFrame:
        """df with p_level, p_leaf and p_ensemble."""
        filled = self.level.transform(df.na.fill(self.fills)).withColumn("p_level", probability()).select(*df.columns, "p_level")
        leaf = boosting.probability([self.leaf], feature_array(self.numeric, self.levels), F.lit(0), _width(self.numeric, self.levels))
        return filled.withColumn("p_leaf", leaf).withColumn("p_ensemble", (F.col("p_level") + F.col("p_leaf")) / F.lit(2.0))

    def importances(self, names: list[str]) -> dict[str, float]:
        """Mean over the learners of the numeric features' shares of the gain of all cuts."""
        level, leaf = self.level.stages[-1].featureImportances.toArray(), boosting.gain_shares(self.leaf, _width(self.numeric, self.levels))
        return {n: float(level[i] + leaf[i]) / 2 for i, n in enumerate(names)}

    def save(self, path: str) -> None:
        """Both learners and the fill values, in one folder."""
        self.level.write().overwrite().save(f"{path}/level")
        told = {"leaf": self.leaf.to_json(), "numeric": self.numeric, "levels": self.levels, "fills": self.fills}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/ensemble")

    @classmethod
    def load(cls, path: str) -> Ensemble:
        told = json.loads(SparkSession.getActiveSession().read.text(f"{path}/ensemble").first()[0])
        return cls(PipelineModel.load(f"{path}/level"), boosting.Model.from_json(told["leaf"]), told["numeric"], told["levels"], told["fills"])


def out_of_fold(df: DataFrame, label: str, numeric: list[str], categorical: list[str], fold: str = "fold", k: int = 5) -> DataFrame:
    """df with p_level, p_leaf and p_ensemble, each row scored by models that were fitted on the other folds.

    The leaf-wise models of all folds are fitted at once; for them an absent number is a value of its
    own, for the others it is filled with the other folds' median.
    """
    medians, sizes = fold_fills(df, numeric, fold, k), fold_sizes(df, fold)
    fills = [medians[i] | fill_values(df.where(F.col(fold) != i), [], categorical) for i in range(k)]

    def fitted(i: int):
        if i == 0:
            return leaf_models(df, label, numeric, categorical, fold, k)
        train = in_parts(df.where(F.col(fold) != i - 1), sum(n for f, n in sizes.items() if f != i - 1))
        return fit_level(_filled(train, fills[i - 1]).withColumn("label", F.col(label).cast("double")), numeric, categorical)

    (models, levels), *by_level = side_by_side(df, fitted, k + 1)
    scored = df.withColumn("p_leaf", boosting.probability(models, feature_array(numeric, levels), F.col(fold).cast("int"), _width(numeric, levels)))
    parts = None
    for i, model in enumerate(by_level):
        part = model.transform(_filled(scored.where(F.col(fold) == i), fills[i])).withColumn("p_level", probability()).select(*df.columns, "p_level", "p_leaf")
        parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("p_ensemble", (F.col("p_level") + F.col("p_leaf")) / F.lit(2.0))


def _filled(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    return df.na.fill(fills) if fills else df


def fold_sizes(df: DataFrame, fold: str) -> dict[int, int]:
    return {r[0]: r[1] for r in df.where(F.col(fold).isNotNull()).groupBy(fold).count().collect()}


def in_parts(df: DataFrame, n: int) -> DataFrame:
    """df of n rows in no more parts than its rows fill (boosting.SMALL each), as a fit passes over it many times."""
    return df.coalesce(max(1, math.ceil(n / boosting.SMALL)))


def side_by_side(df: DataFrame, fit: Callable[[int], object], n: int) -> list:
    """fit(0) to fit(n - 1), TOGETHER at a time, as jobs of df's session."""
    with ThreadPool(min(TOGETHER, n)) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(fit), range(n), chunksize=1)


def leaf_models(df: DataFrame, label: str, numeric: list[str], categorical: list[str], fold: str = "fold", k: int = 5) -> tuple[list[boosting.Model], dict[str, list[str]]]:
    """The leaf-wise model for each fold, fitted on the other folds, and the categories' values (null: none of them)."""
    levels = category_levels(df, categorical)
    return boosting.fit(leaf_rows(df, label, numeric, levels, F.col(fold)), _width(numeric, levels), [(LEAF, i) for i in range(k)], k), levels


def isotonic(df: DataFrame, label: str, score: str):
    """Calibration on held-out rows: (model, function that adds a calibrated column to a table)."""
    model = IsotonicRegression(labelCol="_y", featuresCol="_x", predictionCol="calibrated").fit(df.select(F.col(label).cast("double").alias("_y"), F.col(score).alias("_x")))
    return model, lambda t: model.transform(t.withColumn("_x", F.col(score))).drop("_x")


def clipped_logit(p: Column, edge: float = 1e-4) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log(q / (1 - q))


def stack(df: DataFrame, label: str, scores: list[str], c: float = 1.0, n: int | None = None) -> PipelineModel:
    """Logistic regression with an L2 penalty on the logits of scores; c is the inverse strength over n rows."""
    n = n or df.count()
    logits = df.select(F.col(label).cast("double").alias("label"), *(clipped_logit(F.col(s)).alias(f"_l_{s}") for s in scores))
    learner = LogisticRegression(elasticNetParam=0.0, regParam=1.0 / (c * max(n, 1)), standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=[f"_l_{s}" for s in scores], outputCol="features"), learner]).fit(logits)


def stacked(model: PipelineModel, df: DataFrame, scores: list[str]) -> DataFrame:
    ready = df.select("*", *(clipped_logit(F.col(s)).alias(f"_l_{s}") for s in scores))
    return model.transform(ready).withColumn("p_stack", probability()).select(*df.columns, "p_stack")


def stacked_out_of_fold(df: DataFrame, label: str, scores: list[str], fold: str = "fold", k: int = 5, c: float = 1.0) -> DataFrame:
    """df with p_stack, each row scored by the stack that was fitted on the other folds."""
    parts, sizes = None, fold_sizes(df, fold)

    def fitted(i: int) -> PipelineModel:
        n = sum(size for f, size in sizes.items() if f != i)
        return stack(in_parts(df.where(F.col(fold) != i), n), label, scores, c, n)

    for i, model in enumerate(side_by_side(df, fitted, k)):
        scored = stacked(model, df.where(F.col(fold) == i), scores)
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def fold_aucs(scored: DataFrame, label: str, scores: list[str], fold: str = "fold") -> DataFrame:
    """fold, learner, auc, n_rows of each score in each fold."""
    long = scored.unpivot([fold, label], scores, "learner", "_s")
    auc = stats.roc_auc(long, label, "_s", [fold, "learner"])
    return auc.select(fold, "learner", "auc", (F.col("n_pos") + F.col("n_neg")).alias("n_rows"))


def leave_one_out_scores(df: DataFrame, label: str, numeric: list[str], key: str, most: int = 200) -> DataFrame:
    """key, label, p of a table of a few rows: each row is scored by a logistic regression on all the others."""
    rows = select.leave_one_out(df.na.fill(fill_values(df, numeric, [])), key, most).withColumn("label", F.col(label).cast("double"))
    stages, parts = preprocessor(numeric, []), None
    for r in rows.select("fold").collect():
        others = rows.where(F.col("fold") != r.fold)
        model = Pipeline(stages=[*stages, LogisticRegression(regParam=1.0 / most)]).fit(others)
        one = model.transform(rows.where(F.col("fold") == r.fold)).select(key, F.col("label").cast("int").alias("y"), probability().alias("p"))
        parts = one if parts is None else parts.union(one)
    return parts


def binary_calls(df: DataFrame, score: str, youden: Column, sensitive: Column) -> DataFrame:
    """df with pred_youden and pred_sens90: whether the score reaches either threshold."""
    return df.withColumns({"pred_youden": (F.col(score) >= youden).cast("int"), "pred_sens90": (F.col(score) >= sensitive).cast("int")})


@dataclass(frozen=True)
class Scorer:
    """A fitted ensemble with its calibration and thresholds (of all rows, and of single panels)."""

    ensemble: Ensemble
    calibrated: object
    thresholds: DataFrame
    columns: tuple[str, ...]

    @classmethod
    def fit(cls, fit: DataFrame, held: DataFrame, label: str, numeric: list[str], categorical: list[str], panel: str, least_sensitivity: float = 0.90) -> Scorer:
        """The ensemble learns from fit; calibration and each panel's thresholds from held."""
        ensemble = Ensemble.fit(fit, label, numeric, categorical)
        _, calibrated = isotonic(ensemble.score(held), label, "p_ensemble")
        scored = calibrated(ensemble.score(held)).persist()
        both = stats.panel_thresholds(scored, label, "calibrated", panel)
        high = stats.panel_sensitivity_thresholds(scored, label, "calibrated", panel, least_sensitivity)
        return cls(ensemble, calibrated, both.select(panel, "threshold").join(high.select(panel, F.col("threshold").alias("sensitive")), panel).persist(), (*numeric, *categorical))

    def score(self, df: DataFrame, panel: str) -> DataFrame:
        """df with P_raw_ensemble, P_pathogenic (calibrated), pred_youden and pred_sens90 by the panel's thresholds; a panel that
        wasn't held has the thresholds' mean."""
        out = self.calibrated(self.ensemble.score(df)).withColumnsRenamed({"p_ensemble": "P_raw_ensemble", "calibrated": "P_pathogenic"})
        mean = self.thresholds.agg(F.avg("threshold"), F.avg("sensitive")).first()
        out = out.join(F.broadcast(self.thresholds), panel, "left")
        calls = binary_calls(out, "P_pathogenic", F.coalesce("threshold", F.lit(mean[0])), F.coalesce("sensitive", F.lit(mean[1])))
        return calls.drop("threshold", "sensitive")


def choose_strength(df: DataFrame, label: str, scores: list[str], fold: str = "fold", k: int = 5, among: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> tuple[float, dict[float, float]]:
    """The first inverse strength with the best out-of-fold AUC, and the AUC of each."""
    found = {c: stats.roc_auc(stacked_out_of_fold(df, label, scores, fold, k, c), label, "p_stack").first().auc or 0.0 for c in among}
    return max(among, key=lambda c: (round(found[c], 12), -among.index(c))), found


def ablation(df: DataFrame, label: str, base: list[str], more: list[str], key: str, fold: str = "fold", k: int = 5, rounds: int = 50) -> DataFrame:
    """One row: AUC out of fold of the stack on base and on base and more, their difference, its test and interval."""
    small = stacked_out_of_fold(df, label, base, fold, k).select(key, F.col(label).alias("y"), F.col("p_stack").alias("p_base"))
    large = stacked_out_of_fold(df, label, [*base, *more], fold, k).select(key, F.col("p_stack").alias("p_more"))
    return _compared(small.join(large, key).persist(), key, rounds)


def _compared(rows: DataFrame, key: str, rounds: int) -> DataFrame:
    test = stats.delong(rows, "y", "p_more", "p_base")
    drawn = stats.paired_bootstrap(rows, "y", "p_more", "p_base", F.col(key), rounds)
    n = rows.agg(F.count("*").alias("n"))
    return n.crossJoin(test).crossJoin(drawn.select("lo", "hi")).select(
        "n", F.col("auc_b").alias("auc_base"), F.col("auc_a").alias("auc_more"), "delta", "z", stats.normal_p(F.col("z")).alias("p"), "lo", "hi"
    )


def panel_evaluation(train: DataFrame, test: DataFrame, label: str, base: list[str], more: list[str], key: str, panel: str, strength: float = 1.0, least: int = 10, rounds: int = 50) -> DataFrame:
    """panel, n, auc_base, auc_more, delta, z, p, lo, hi of stacks fitted on train, on each test panel with both classes and enough rows."""
    small, large = stack(train, label, base, strength), stack(train, label, [*base, *more], strength)
    a = stacked(small, test, base).withColumnRenamed("p_stack", "p_base")
    scored = stacked(large, a, [*base, *more]).select(panel, key, F.col(label).alias("y"), "p_base", F.col("p_stack").alias("p_more")).persist()
    enough = scored.groupBy(panel).agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes")).where((F.col("n") >= least) & (F.col("classes") == 2))
    out = None
    for name in sorted(r[0] for r in enough.collect()):  # a few panels
        row = _compared(scored.where(F.col(panel) == name), key, rounds).select(F.lit(name).alias(panel), "*")
        out = row if out is None else out.union(row)
    return out if out is not None else _compared(scored.limit(0), key, 1).select(F.lit("").alias(panel), "*").limit(0)


def permutation_importance(model: Ensemble, df: DataFrame, label: str, columns: list[str], key: str, seed: int = 42) -> list[tuple[str, float]]:
    """Loss of AUC when a column's values are dealt anew among the rows by a drawn order; largest loss first."""
    base = stats.roc_auc(model.score(df), label, "p_ensemble").first().auc or 0.0
    out = []
    for c in columns:
        placed = lambda s: ordered.drawn_places(df, [], select.draw(s, F.col(key)), key)
        values = placed(seed + 1).select("place", F.col(c).alias("_v"))
        dealt = placed(seed).join(values, "place").withColumn(c, F.col("_v")).select(df.columns)
        out.append((c, base - (stats.roc_auc(model.score(dealt), label, "p_ensemble").first().auc or 0.0)))
    return sorted(out, key=lambda x: -x[1])
