"""Report tables: dataset summary, main results, circularity, ablations, comparisons, feature counts, the bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.schema import group_table
from quern.operators import stats
from quern.sources import sinks


def dataset_summary(df: DataFrame, by: list[str], label: str, gene: str, source: str) -> DataFrame:
    """Rows, classes, genes and sources (JSON) of each cell."""
    per = df.groupBy(*by, source).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    sources = per.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(source).alias("source"), "n")))).alias("sources"), F.sum("n").alias("n"), F.sum("p").alias("n_pos"))
    genes = df.groupBy(*by).agg(F.count_distinct(gene).alias("n_genes"))
    return sources.join(genes, by).withColumn("n_neg", F.col("n") - F.col("n_pos"))


def scheme_counts(df: DataFrame, schemes: list[str], label: str, group: str) -> DataFrame:
    """scheme, side, n_pos, n_neg, n_groups of the sides (_split_<scheme>) of every scheme."""
    long = df.unpivot([label, group], [F.col(f"_split_{s}").alias(s) for s in schemes], "scheme", "side")
    return long.groupBy("scheme", "side").agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"), F.count_distinct(group).alias("n_groups"))


def wide_counts(df: DataFrame, row: str, column: str, names: dict[str, str]) -> DataFrame:
    """Rows of each value of row (rows) and column (columns, named by names), 0 where there are none."""
    wide = df.groupBy(row).pivot(column, list(names)).count().na.fill(0)
    return wide.select(row, *(F.col(c).alias(n) for c, n in names.items()))


def interval_text(value: str, lo: str, hi: str):
    return F.format_string("%.3f (%.3f–%.3f)", value, lo, hi)


def wide_results(results: DataFrame, cells: list[str]) -> DataFrame:
    """One row a panel, one column a cell (scheme/feature set) with the value and its interval."""
    shown = results.withColumns({"cell": F.concat_ws("/", "scheme", "feature_set"), "shown": interval_text("auc", "lo", "hi")})
    return shown.groupBy("panel").pivot("cell", cells).agg(F.first("shown"))


def independent_difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Difference of two independent values with the widest interval their own allow."""
    x, y = (t.select(on, *(F.col(c).alias(f"{c}_{s}") for c in ("auc", "lo", "hi"))) for t, s in ((a, "a"), (b, "b")))
    d = x.join(y, on)
    return d.select(on, (F.col("auc_a") - F.col("auc_b")).alias("difference"), (F.col("lo_a") - F.col("hi_b")).alias("lo"), (F.col("hi_a") - F.col("lo_b")).alias("hi"))


def circularity(results: DataFrame, full: DataFrame, core: DataFrame, by: str = "panel", key: str = "doc_id") -> DataFrame:
    """Type 1: for each panel, how much of the score's discrimination the tools' features explain, on the same rows.

    full, core: by, key, y, p of the test rows under either feature set. Returns by, n, auc_full, auc_core,
    delta, z, p of the paired test for every panel that results names, but for those with one class.
    """
    a = full.select(by, key, F.col("y"), F.col("p").alias("p_full"))
    pairs = a.join(core.select(by, key, F.col("p").alias("p_core")), [by, key])
    out = None
    for name in sorted(r[0] for r in results.select(by).distinct().collect()):  # a few panels
        mine = pairs.where(F.col(by) == name)
        test = stats.delong(mine, "y", "p_full", "p_core")
        row = mine.agg(F.count("*").alias("n")).crossJoin(test).select(F.lit(name).alias(by), "n", F.col("auc_a").alias("auc_full"), F.col("auc_b").alias("auc_core"), "delta", "z", stats.normal_p(F.col("z")).alias("p")).where("z is not null")
        out = row if out is None else out.unionByName(row)
    return out


def stacked_tables(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Tables of several cells or models under one another, by name, with the cell's name in a column; what one lacks is null.

    The ablation table and the comparison table are such unions.
    """
    out = None
    for cell, t in tables.items():
        t = t.withColumn(name, F.lit(cell))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def group_importances(importances: DataFrame, groups: DataFrame) -> DataFrame:
    """feature_group, importance: the sum over the features of each group, largest first. groups: feature, feature_group."""
    joined = importances.join(F.broadcast(groups), "feature", "left")
    return joined.groupBy(F.coalesce("feature_group", F.lit("other")).alias("feature_group")).agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"), "feature_group")


def fold_summary(folds: DataFrame, value: str = "auc", by: list[str] | None = None) -> DataFrame:
    """mean and spread (population standard deviation) of a value over the folds."""
    return folds.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"), F.count(value).alias("n_folds"))


def bundle(root: str, tables: dict[str, DataFrame], notes: dict[str, str], most_rows: int = 1000) -> str:
    """Write report tables as delimited files and one summary.md with all of them; returns the summary's text.

    A table with more than most_rows rows is in the summary by name only. Tables lie at root/<name>, the
    summary and the provenance (rows and checksum of each) at root.
    """
    lines, sources = ["# Summary", ""], {}
    for name, t in tables.items():
        sinks.delimited(t.coalesce(1), f"{root}/{name}")
        rows = [r.asDict() for r in t.limit(most_rows + 1).collect()]
        lines += [f"## {name}", "", notes.get(name, ""), "", sinks.markdown(rows) if len(rows) <= most_rows else f"more than {most_rows} rows: see {name}", ""]
        sources[name] = sinks.provenance(name, t)
    text, spark = "\n".join(lines), next(iter(tables.values())).sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/summary.md")
    sinks.report(sources, spark, f"{root}/provenance.json")
    return text


def feature_count_table(cells: dict[str, list[str]], spark) -> DataFrame:
    """Features of each group (rows) in each cell (columns), 0 where a cell has none."""
    rows = [(cell, group, n) for cell, columns in cells.items() for group, n in group_table(columns).items()]
    long = spark.createDataFrame(rows, "cell string, feature_group string, n long")
    return long.groupBy("feature_group").pivot("cell", sorted(cells)).agg(F.first("n")).na.fill(0)
