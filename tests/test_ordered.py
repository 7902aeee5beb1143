"""Orders in parts: numbering of one panel with all rows, scores near 1, splits of a pool."""

import random

from pyspark.sql import functions as F

from quern.operators import ordered, panels, select, stats


def test_numbers_of_one_panel(spark):
    """All rows share the first column; some keys are null or equal: numbers are dense, in order, and dealt over ranges."""
    rows = spark.range(4000).select(F.lit("all").alias("panel"), F.when(F.col("id") % 50 > 0, F.col("id") % 1300).alias("key"), "id").repartition(8)
    out = ordered.numbered(rows, ["panel", "key"])
    got = sorted(out.collect(), key=lambda r: r.row_id)
    assert out.columns == ["panel", "key", "id", "row_id"] and [r.row_id for r in got] == list(range(4000))
    keys = [(r.key is not None, r.key or 0) for r in got]
    assert keys == sorted(keys) and {r.id for r in got} == set(range(4000))
    assert ordered.numbered(rows.limit(0), ["panel"]).count() == 0


def test_scores_near_one_have_many_parts(spark):
    """Probabilities from 0.9993 to 1: no part has one in a hundred of the rows; parts never fall as scores grow."""
    draw = random.Random(1)
    scores = [1 - draw.random() * 7e-4 for _ in range(20_000)] + [draw.uniform(-3, 3) for _ in range(2000)] + [0.0, 0.5, 1.0, 2.0, 1e300, 5e-324, -1.0, 1 - 2**-53]
    df = spark.createDataFrame([(s,) for s in scores], "s double").withColumn("part", ordered.score_part(F.col("s")))
    near = df.where("s > 0.9993 and s < 1").groupBy("part").count()
    assert near.agg(F.max("count")).first()[0] < 200 and near.count() > 1000
    rows = sorted((r.s, r.part) for r in df.collect())
    assert [p for _, p in rows] == sorted(p for _, p in rows)
    auc = stats.roc_auc(df.where("s > 0.9993 and s < 1").withColumn("y", (F.col("s") > 0.99965).cast("int")), "y", "s").first().auc
    assert auc == 1.0


def test_split_by_gene_fills_both_sides(spark):
    pool = spark.createDataFrame([(i, f"g{i % 30}", i % 2) for i in range(600)], "VariationID long, GeneSymbol string, label int")
    got = panels.with_splits(pool, {"train": [100, 100], "test": [40, 40]})
    assert set(got.columns) == {"VariationID", "GeneSymbol", "label", "_split_variant", "_split_gene", "_split_gene_note"} and got.count() == 600
    counts = {(r._split_gene, r.label): r["count"] for r in got.groupBy("_split_gene", "label").count().collect()}
    assert all(counts[side, y] <= most for side, most in (("train", 100), ("test", 40)) for y in (0, 1) if (side, y) in counts)
    assert panels.shared_genes(got).count() == 0


def one_by_one(groups, k):
    """Every group to the fold after which the shares spread least: the rule that classes shorten."""
    total, load, out = [max(sum(g[i] for g in groups), 1) for i in (0, 1)], [[0, 0] for _ in range(k)], []
    for p, n in sorted(groups, key=lambda g: -abs(g[0] - g[1])):
        fold = min(range(k), key=lambda f: (spread([[a + p * (f == i), b + n * (f == i)] for i, (a, b) in enumerate(load)], total), sum(load[f])))
        load[fold] = [load[fold][0] + p, load[fold][1] + n]
        out.append(fold)
    return load, total


def spread(load, total):
    def deviation(i):
        shares = [x[i] / total[i] for x in load]
        mean = sum(shares) / len(shares)
        return (sum((v - mean) ** 2 for v in shares) / len(shares)) ** 0.5

    return deviation(0) + deviation(1)


def test_classes_spread_no_more_than_groups_one_by_one():
    """Skewed groups: one with half of all rows, a few large ones, thousands of one or two rows."""
    draw = random.Random(5)
    for case in range(6):
        groups = [(400 * case, 100), (30, 90), (0, 70)] + [(draw.randrange(3), draw.randrange(3)) for _ in range(1500)] + [(1, 0)] * 700
        classes: dict = {}
        for g in groups:
            classes[g] = classes.get(g, 0) + 1
        dealt, load = select.deal_classes([(*c, m) for c, m in classes.items()], 5), [[0, 0] for _ in range(5)]
        for (p, n), runs in dealt.items():
            assert sum(take for take, _ in runs) == classes[p, n]
            for take, fold in runs:
                load[fold] = [load[fold][0] + p * take, load[fold][1] + n * take]
        other, total = one_by_one(groups, 5)
        assert spread(load, total) <= spread(other, total) + 2e-3
    assert sum(map(len, select.deal_classes([(1, 0, 10**9), (0, 1, 10**9)], 5).values())) < 2000


def test_balanced_group_folds(spark):
    rows = [(f"g{i % 97 if i % 3 else 0}", i % 2) for i in range(3000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, y int")
    got = {r.g: r.fold for r in select.balanced_group_folds(df, "g", "y", 4).collect()}
    assert set(got) == {g for g, _ in rows} and set(got.values()) == {0, 1, 2, 3}
    sizes = [sum(got[g] == f and y is not None for g, y in rows) for f in range(4)]
    assert max(sorted(sizes)[:3]) - min(sizes) <= 45
