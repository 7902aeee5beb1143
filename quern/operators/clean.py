"""Checks and removal of columns: null rates, ranges, no spread, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import comoments


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: null_rate, least, most, spread (sample standard deviation); one pass over the table."""
    one = []
    for c in columns:
        x = F.col(c).cast("double")
        one.append(F.struct(F.lit(c).alias("column"), F.avg(x.isNull().cast("int")).alias("null_rate"), F.min(x).alias("least"), F.max(x).alias("most"), F.stddev_samp(x).alias("spread")))
    return df.agg(F.array(*one).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def degenerate(profile: DataFrame) -> DataFrame:
    """Columns that are null throughout or have one value."""
    return profile.where((F.col("null_rate") == 1) | (F.col("least") == F.col("most")))


def low_spread(profile: DataFrame, threshold: float = 0.01) -> DataFrame:
    return profile.where(F.col("spread") < threshold)


def out_of_range(profile: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns with values beyond their bounds."""
    limits = F.create_map(*(F.lit(x) for c, b in bounds.items() for x in (c, list(b)))) if bounds else None
    if limits is None:
        return profile.limit(0)
    b = F.element_at(limits, F.col("column"))
    return profile.where((F.col("least") < b[0]) | (F.col("most") > b[1]))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """left, right, r for each pair of columns over the rows that have both, in one pass; null where a column has no spread."""
    return comoments.pair_statistics(df, columns).select("left", "right", "r")


def correlated_columns(df: DataFrame, columns: list[str], most: float = 0.95, last: str = "enrich_") -> list[str]:
    """The later column of every pair whose correlation is above most; columns with the prefix last come last.

    Null counts as 0 here. Only names of columns come to the driver.
    """
    order = sorted(columns, key=lambda c: c.startswith(last))
    filled = df.select(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(c) for c in order))
    found = {r["right"] for r in correlations(filled, order).where(F.abs("r") > most).select("right").distinct().collect()}
    return [c for c in order if c in found]


def drop_incomplete(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with all required columns, and the others."""
    full = F.lit(True)
    for c in required:
        full = full & F.col(c).isNotNull()
    return df.where(full), df.where(~full)


def consistency_findings(df: DataFrame, columns: list[str], label: str, key: list[str], bounds: dict[str, tuple[float, float]], expected: list[str]) -> DataFrame:
    """check, subject, value of all that is wrong: missing and extra columns, values out of range, columns more than half
    null, repeated keys, a label mean further than 0.10 from one half."""
    spark = df.sparkSession
    names = [("missing", c, 1.0) for c in expected if c not in df.columns] + [("extra", c, 1.0) for c in df.columns if c not in expected]
    found = spark.createDataFrame(names, "check string, subject string, value double")
    profile = column_profile(df, columns)
    ranged = out_of_range(profile, bounds).select(F.lit("range").alias("check"), F.col("column").alias("subject"), F.col("most").alias("value"))
    nulls = profile.where("null_rate > 0.5").select(F.lit("nulls"), "column", "null_rate")
    hashed = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in key)))
    repeats = df.agg((F.count("*") - F.count_distinct(hashed)).cast("double").alias("value")).where("value > 0").select(F.lit("duplicates"), F.lit(",".join(key)), "value")
    balance = df.agg(F.avg(F.col(label).cast("double")).alias("value")).where(F.abs(F.col("value") - 0.5) > 0.10).select(F.lit("balance"), F.lit(label), "value")
    return found.union(ranged).union(nulls).union(repeats).union(balance)
