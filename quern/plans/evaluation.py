"""Queries of error types, thresholds by panel, ranks, extremes and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import features as fx
from quern.functions.schema import select_features
from quern.operators import report, stats
from quern.plans.features import _context, _D, _labelled, _rounded
from quern.plans.registry import query, table


@query(f"WITH {_D} SELECT lang, CASE WHEN (s >= 0.5)::INT = y THEN 'correct' WHEN s >= 0.5 THEN 'false_positive' ELSE 'false_negative' END AS error_type, count(*) AS n, round(avg(t), 6) AS mean_other FROM d GROUP BY ALL")
def error_types(spark, sf_dir):
    call = (F.col("s") >= 0.5).cast("int")
    kind = F.when(call == F.col("y"), "correct").when(call == 1, "false_positive").otherwise("false_negative")
    return _labelled(spark, sf_dir).groupBy("lang", kind.alias("error_type")).agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean_other"))


_PANEL = f"""WITH {_D}, g AS (SELECT i, round(0.05 + 0.01 * i, 2)::DOUBLE AS threshold FROM range(91) t(i)),
    e AS (SELECT lang, i, threshold, sum((s >= threshold AND y = 1)::INT) / sum(y) + sum((s < threshold AND y = 0)::INT) / (count(*) - sum(y)) - 1 AS j, sum(y) AS p, count(*) - sum(y) AS n FROM g, d GROUP BY ALL),
    f AS (SELECT i, threshold, sum((s >= threshold AND y = 1)::INT) / sum(y) + sum((s < threshold AND y = 0)::INT) / (count(*) - sum(y)) - 1 AS j FROM g, d GROUP BY ALL),
    a AS (SELECT lang, threshold FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(j, 9) DESC, i) AS rn FROM e WHERE p > 0 AND n > 0 AND p + n >= 30) WHERE rn = 1),
    b AS (SELECT threshold FROM f ORDER BY round(j, 9) DESC, i LIMIT 1)
    SELECT l.lang, coalesce(a.threshold, b.threshold) AS threshold, a.threshold IS NOT NULL AS own FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN a USING (lang), b"""


@query(_PANEL)
def panel_thresholds(spark, sf_dir):
    return stats.panel_thresholds(_labelled(spark, sf_dir), "y", "s", "lang")


@query(f"WITH {_D} SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY t) + (count(*) OVER (PARTITION BY lang, t) - 1) / 2.0 AS mid_rank FROM d")
def mid_ranks(spark, sf_dir):
    return stats.mid_ranks(_labelled(spark, sf_dir), "t", ["lang"]).select("doc_id", "mid_rank")


@query("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS best_so_far FROM orders")
def running_max(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("best_so_far"))


@query("SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1")
def extreme_rows(spark, sf_dir):
    dear, cheap = F.struct("o_totalprice", -F.col("o_orderkey")), F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", dear).alias("dearest"), F.min_by("o_orderkey", cheap).alias("cheapest"))


@query(f"WITH {_D} SELECT doc_id, t FROM d ORDER BY t DESC, doc_id LIMIT 25")
def top_scores(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "t").orderBy(F.desc("t"), "doc_id").limit(25)


@query(f"""WITH {_D}, c AS (SELECT lang, source, count(*) AS n, sum(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT lang, to_json(list({{'source': source, 'n': n}} ORDER BY source)) AS sources, sum(n)::BIGINT AS n, sum(p)::BIGINT AS n_pos, count(*) AS n_genes, (sum(n) - sum(p))::BIGINT AS n_neg FROM c GROUP BY lang""")
def dataset_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return report.dataset_summary(rows, ["lang"], "quality", "source", "source")


@query("""WITH c AS (SELECT l_returnflag AS panel, l_linestatus AS cell, avg(l_discount) AS m, stddev_samp(l_discount) / sqrt(count(*)) * 1.96 AS h FROM lineitem GROUP BY ALL),
    s AS (SELECT panel, cell, format('{:.3f} ({:.3f}–{:.3f})', m, m - h, m + h) AS shown FROM c)
    SELECT panel, max(shown) FILTER (WHERE cell = 'F') AS "F/core", max(shown) FILTER (WHERE cell = 'O') AS "O/core" FROM s GROUP BY panel""")
def pivot_report(spark, sf_dir):
    h = F.stddev_samp("l_discount") / F.sqrt(F.count("*")) * 1.96
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("panel"), F.col("l_linestatus").alias("scheme")).agg(F.avg("l_discount").alias("auc"), h.alias("h"))
    results = cells.select("panel", "scheme", F.lit("core").alias("feature_set"), "auc", (F.col("auc") - F.col("h")).alias("lo"), (F.col("auc") + F.col("h")).alias("hi"))
    return report.wide_results(results, ["F/core", "O/core"])


@query("""SELECT feature_group, core, "full" FROM (VALUES ('sequence', 57, 57), ('context', 114, 114), ('biochemical', 35, 35), ('conservation', 3, 3), ('gene_constraint', 3, 3), ('population', 11, 11),
    ('enrichment', 149, 149), ('insilico', 0, 10), ('other', 1, 1)) t(feature_group, core, "full")""")
def feature_count_table(spark, sf_dir):
    """How many columns of each group a panel has under either feature set once it is annotated and enriched."""
    rows = _context(spark, sf_dir).withColumnRenamed("doc_id", "_variant_id")
    rows = fx.enrich(fx.annotate(rows.withColumns({"label": F.lit(1), "bases": F.col("context")})))
    columns = [c for c in rows.columns if c != "bases"]
    return report.feature_count_table({s: select_features(columns, s) for s in ("core", "full")}, spark)
