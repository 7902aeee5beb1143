"""Checks that stop a flow, and checks that report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.schema import TARGET, feature_group


def check_features(columns: list[str], feature_set: str) -> list[str]:
    """The columns, if a model may see them: no label, no metadata, no rule scores, and none of the tools' scores in core."""
    wrong = [c for c in columns if c == TARGET or feature_group(c) is None or (feature_set == "core" and feature_group(c) == "insilico")]
    if wrong:
        raise ValueError(f"not features of {feature_set}: {wrong}")
    return columns


def enrichment_report(before: DataFrame, after: DataFrame, prefix: str = "enrich_") -> DataFrame:
    """check, subject, value: columns that enrichment lost (1), new columns without a value (1), and the coverage of all others."""
    lost = [(c, 1.0) for c in before.columns if c not in after.columns]
    new = [c for c in after.columns if c.startswith(prefix)]
    spark = after.sparkSession
    missing = spark.createDataFrame(lost, "subject string, value double").select(F.lit("lost").alias("check"), "subject", "value")
    if not new:
        return missing
    shares = after.agg(*(F.avg(F.col(f"`{c}`").isNotNull().cast("double")).alias(c) for c in new)).unpivot([], new, "subject", "value")
    empty = F.coalesce(F.col("value") == 0, F.lit(False))
    return missing.union(shares.select(F.when(empty, "empty").otherwise("coverage").alias("check"), "subject", F.when(empty, 1.0).otherwise(F.col("value")).alias("value")))


def complete_and_known(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, all_known, any_known of a column."""
    return df.groupBy(*by).agg(F.bool_and(F.col(column).isNotNull()).alias("all_known"), F.bool_or(F.col(column).isNotNull()).alias("any_known"))


def incomplete_report(df: DataFrame, required: list[str], by: list[str]) -> DataFrame:
    """by, n_dropped, n_kept: the rows that lack a required column, by label and source."""
    full = F.lit(True)
    for c in required:
        full = full & F.col(c).isNotNull()
    return df.groupBy(*by).agg(F.count_if(~full).alias("n_dropped"), F.count_if(full).alias("n_kept"))
