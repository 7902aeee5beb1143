"""Queries that fit models; their rows follow from the fit and have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import attribution, models, select, stats, tuning
from quern.plans.features import _labelled
from quern.plans.registry import query, table
from quern.sources.work import forget, release_exchanges, stored


def _vectors(spark, sf_dir):
    """The rows with a column for each value of the vector, as many as the longest has, and the columns' names."""
    e = table(spark, sf_dir, "embeddings")
    names = [f"x{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    values = (F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(names))
    return e.select("vec_id", (F.col("label") % 2).cast("int").alias("y"), *values), names


def _out_of_fold(rows, names):
    """Every row's scores by the ensemble of the other four folds, stored, as later steps read them several times.

    What the fits read is stored as well: their hundreds of jobs plan a scan, not the way to the folds.
    """
    rows = stored(select.stratified_folds(rows, "y", F.col("vec_id")), "folds")
    scored = models.out_of_fold(rows, "y", names, [])
    release_exchanges(rows.sparkSession)
    out = stored(scored.select("vec_id", "fold", "y", "p_level", "p_leaf", "p_ensemble"), "scores")
    forget(rows)
    release_exchanges(rows.sparkSession)
    return out


@query()
def gbt_oof(spark, sf_dir):
    return _out_of_fold(*_vectors(spark, sf_dir))


@query()
def category_oof(spark, sf_dir):
    """Both learners on numbers and categories, out of fold: whether a customer's balance is above the middle of its range."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 4500).cast("int").alias("y"), F.length("c_name").cast("double").alias("name"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    rows = select.stratified_folds(c, "y", F.col("c_custkey"), k=3).persist()
    scored = models.out_of_fold(rows, "y", ["name"], ["c_mktsegment", "nation"], k=3)
    return scored.select("c_custkey", "fold", "y", "p_level", "p_leaf", "p_ensemble")


def _leaf_attributions(spark, sf_dir):
    rows, names = _vectors(spark, sf_dir)
    rows = select.stratified_folds(rows, "y", F.col("vec_id")).persist()
    fitted, levels = models.leaf_models(rows, "y", names, [])
    x = rows.select("vec_id", "y", "fold", models.feature_array(names, levels).alias("x"))
    return attribution.attributions(x, fitted, names, "vec_id", "fold"), names


@query()
def shapley_values(spark, sf_dir):
    """The ten strongest features of each row's margin, by the model of the other folds."""
    found, names = _leaf_attributions(spark, sf_dir)
    return attribution.strongest(found, names, "vec_id")


@query()
def shapley_groups(spark, sf_dir):
    """Mean absolute Shapley values of the features, and of their groups: each eighth of the vector."""
    found, names = _leaf_attributions(spark, sf_dir)
    return attribution.mean_attributions(found, names, "vec_id", {n: f"g{8 * i // len(names)}" for i, n in enumerate(names)})


#: A space whose fits are short.
_SPACE = tuning.SPACE | {"trees": tuning.Range(2, 6, whole=True), "leaves": tuning.Range(2, 12, whole=True)}


def _history(spark, sf_dir):
    rows, names = _vectors(spark, sf_dir)
    rows = select.stratified_folds(rows, "y", F.col("vec_id"), k=3)
    x = rows.select(models.feature_array(names, {}).alias("x"), "y", "fold", F.col("vec_id").alias("row")).persist()
    return tuning.history_table(spark, tuning.search(x, len(names), trials=16, together=8, space=_SPACE))


@query()
def search_trials(spark, sf_dir):
    """The history of a search of settings for the vectors' labels: eight even draws, then eight where good ones are dense."""
    return _history(spark, sf_dir).withColumn("settings", F.to_json("settings"))


@query()
def setting_importances(spark, sf_dir):
    """What the history of that search says of each setting."""
    return tuning.importances(_history(spark, sf_dir), _SPACE)


@query()
def balanced_group_kfold(spark, sf_dir):
    """Customers dealt to folds by the labels of their orders: most uneven classes of customers first."""
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return select.balanced_group_folds(o, "o_custkey", "y")


@query()
def isotonic_calibration(spark, sf_dir):
    """Calibration by the held rows, which the model has not seen, of the others' scores, each out of fold."""
    rows, names = _vectors(spark, sf_dir)
    rows = select.hold_out(rows, "y", F.col("vec_id"), 0.3).persist()
    fit, held = rows.where("not held"), rows.where("held")
    final = models.Ensemble.fit(fit, "y", names, [])
    _, calibrated = models.isotonic(final.score(held), "y", "p_ensemble")
    scored = calibrated(_out_of_fold(fit, names))
    return scored.select("vec_id", "y", F.col("p_ensemble").alias("p"), "calibrated")


@query()
def stacking(spark, sf_dir):
    """The two learners' out-of-fold scores stacked, each row by the stack of the other folds."""
    scored = _out_of_fold(*_vectors(spark, sf_dir))
    stacks = models.stacked_out_of_fold(scored, "y", ["p_level", "p_leaf"]).select("y", "p_stack")
    return stats.evaluate(stored(stacks, "stacks"), "y", "p_stack")


def _two_scores(spark, sf_dir):
    """Labelled documents with two scores within 0 to 1 and a fold."""
    rows = select.stratified_folds(_labelled(spark, sf_dir), "y", F.col("doc_id"))
    return rows.withColumns({c: F.least(F.greatest(F.col(c), F.lit(0.01)), F.lit(0.99)) for c in "st"}).persist()


@query()
def stack_ablation(spark, sf_dir):
    """The stack with and without the second score, out of fold, at the strength that does best."""
    rows = _two_scores(spark, sf_dir)
    best, _ = models.choose_strength(rows, "y", ["s", "t"])
    return models.ablation(rows, "y", ["s"], ["t"], "doc_id", rounds=20).withColumn("strength", F.lit(best))


@query()
def stack_evaluation(spark, sf_dir):
    """Stacks fitted on four folds and compared on each language's rows of the fifth."""
    rows = _two_scores(spark, sf_dir)
    return models.panel_evaluation(rows.where("fold < 4"), rows.where("fold = 4"), "y", ["s"], ["t"], "doc_id", "lang", rounds=20)
