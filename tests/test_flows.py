"""Settings, sources and sinks outside the engine, model flows and the stream, on small inputs."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import columns, models, report, rules, select, stats, validate
from quern.settings import Target, from_yaml, settings
from quern.sources import fetch, readers, sinks
from quern.streaming.scoring import score_stream


def test_settings(tmp_path):
    assert settings() == settings({})
    path = tmp_path / "s.yaml"
    path.write_text("seed: 7\ntargets:\n  cftr:\n    test: 5\n  new: {train: 1, test: 2}\n")
    s = from_yaml(str(path), {"rounds": "50"})
    assert (s.seed, s.rounds, s.targets["cftr"], s.targets["new"], s.targets["general"]) == (7, 50, Target(70, 5), Target(1, 2), Target(1500, 1000))
    with pytest.raises(ValueError):
        settings({"no": {"such": 1}})


def test_download(tmp_path):
    source, target = tmp_path / "a", tmp_path / "b" / "c"
    source.write_bytes(b"x" * 3_000_000)
    fetch.download(source.as_uri(), str(target))
    assert target.read_bytes() == source.read_bytes()
    source.write_bytes(b"new")
    assert fetch.download(source.as_uri(), str(target)) is None and target.stat().st_size == 3_000_000
    with pytest.raises(OSError):
        fetch.download((tmp_path / "none").as_uri(), str(tmp_path / "d"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_patience_and_hops():
    tries, waits = [], []

    def ask(key):
        tries.append(key)
        if len(tries) < 3:
            raise fetch.Passing
        return key * 2

    assert fetch.patiently(ask, pause=waits.append)(4) == 8 and waits == [5.0, 10.0]
    with pytest.raises(fetch.Passing):
        fetch.patiently(lambda k: (_ for _ in ()).throw(fetch.Passing()), tries=2, pause=waits.append)(1)
    way = fetch.in_hops({"g": "t"}.get, {"t": "p"}.get, {"p": "SEQ"}.get)
    assert way("g") == "SEQ" and way("x") is None
    assert fetch.canonical_or_longest([{"seq": "AAAA"}, {"seq": "AA", "canonical": 1}]) == "AA"
    assert fetch.canonical_or_longest([{"seq": "AB"}, {"seq": "CD"}, {"seq": None}]) == "AB" and fetch.canonical_or_longest([]) is None


def test_delimited_oddities(spark, tmp_path):
    """Gzip, quotes, short and long rows, tokens for missing values, an empty file."""
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write('VariationID\tStart\tName\n1\t5\t"a\tb"\n2\n3\t7\tx\ty\n4\tnan\tN/A\n')
    rows = readers.delimited(spark, str(tmp_path / "t.tsv.gz"), "VariationID STRING, Name STRING, Start BIGINT", sep="\t").orderBy("VariationID").collect()
    assert [tuple(r) for r in rows] == [("1", "a\tb", 5), ("2", None, None), ("4", None, None)]
    (tmp_path / "e.csv").write_text("a,b\n")
    assert readers.delimited(spark, str(tmp_path / "e.csv"), "a INT, b STRING").count() == 0


def test_whole_cache_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"G1": "ATG", "G2": None}, indent=2))
    assert [tuple(r) for r in fetch.cached_sequences(spark, str(tmp_path / "c.json"), whole=True).collect()] == [("G1", "ATG")]


def test_resumed_asks_only_for_what_is_missing(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "key string").where("key is not null")
    log = tmp_path / "asked"

    def ask(key):
        with open(log, "a") as f:
            f.write(key)
        if key == "b" and log.read_text().count("b") < 2:
            raise fetch.Passing
        return [] if key == "c" else [(key + "1",), (key + "2",)]

    path = f"file://{tmp_path}/store"
    first = fetch.resumed(spark, keys, ask, "v STRING", path)
    assert sorted((r.key, r.state, r.v or "") for r in first.collect()) == [("a", "found", "a1"), ("a", "found", "a2"), ("b", "failed", ""), ("c", "empty", "")]
    second = fetch.resumed(spark, keys, ask, "v STRING", path)
    assert sorted((r.key, r.state) for r in second.collect()) == [("a", "found"), ("a", "found"), ("b", "found"), ("b", "found"), ("c", "empty")]
    assert sorted(log.read_text()) == ["a", "b", "b", "c"]


def test_sinks(spark, tmp_path, capsys):
    a = tmp_path / "a.txt"
    a.write_text("1")
    for text in ("1", "2"):
        a.write_text(text)
        sinks.copied(spark, a.as_uri(), f"file://{tmp_path}/stable.txt")
        assert (tmp_path / "stable.txt").read_text() == text
    log = sinks.logger("quern.test", str(tmp_path / "log"))
    assert sinks.logger("quern.test", str(tmp_path / "log")) is log and len(log.handlers) == 2
    log.info("told")
    assert (tmp_path / "log").read_text().count("told") == 1
    assert {"python", "pyspark"} <= set(sinks.environment())
    table = spark.createDataFrame([("x", 0.12345)], "name string, auc double")
    text = report.bundle(f"file://{tmp_path}/out", {"table1": table, "table2": table.limit(0)}, {"table1": "a note"})
    assert "| x | 0.123 |" in text and "a note" in text
    assert json.loads(spark.read.text(f"file://{tmp_path}/out/provenance.json").first()[0])["table1"]["rows"] == 1
    assert readers.delimited(spark, f"file://{tmp_path}/out/table1", "name STRING, auc DOUBLE").first().auc == 0.12345


def test_checks(spark):
    with pytest.raises(ValueError):
        validate.check_features(["pli", "cadd_phred"], "core")
    with pytest.raises(ValueError):
        validate.check_features(["label"], "full")
    assert validate.check_features(["pli", "cadd_phred"], "full") == ["pli", "cadd_phred"]
    with pytest.raises(ValueError):
        columns.split_sides(spark.range(1), "gene", "train")
    with pytest.raises(ValueError):
        select.leave_one_out(spark.range(10), "id", most=5)


def test_group_folds(spark):
    """Whole groups, even classes; a single group's rows are dealt one by one."""
    r = random.Random(2)
    rows = [(i, f"g{r.randint(0, 60)}", int(r.random() < 0.3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, y int")
    folds = select.group_folds(df, "g", "y", 5)
    assert folds.count() == folds.select("g").distinct().count()
    sums = df.join(folds, "g").groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    assert len(sums) == 5 and max(s.p for s in sums) <= 1.3 * min(s.p for s in sums)
    alone = select.group_folds(df.withColumn("g", F.lit("one")), "g", "y", 5, key="id")
    assert alone.count() == 3000 and alone.select("fold").distinct().count() == 5


@pytest.fixture(scope="module")
def variants(spark):
    r, rows = random.Random(5), []
    for i in range(240):
        y = i % 2
        rows.append((i, f"p{i % 3}", f"g{i % 40}", y, r.gauss(y, 0.8), r.gauss(0, 1) if i % 9 else None, r.choice("AB") if r.random() < 0.2 else "AB"[y], r.gauss(0.8 * y, 1.0)))
    df = spark.createDataFrame(rows, "id long, panel string, gene string, y int, x double, z double, c string, rule double")
    return select.stratified_folds(df, "y", F.col("id"), 2).persist()


def test_ensembles_with_categories(spark, variants, tmp_path):
    """Medians and modes from training, unseen categories, saved and loaded."""
    train, test = variants.where("fold = 0"), variants.where("fold = 1").withColumn("c", F.when(F.col("id") % 5 == 0, "new").otherwise(F.col("c")))
    model = models.Ensemble.fit(train, "y", ["x", "z"], ["c"])
    scored = model.score(test)
    assert scored.count() == 120 and stats.roc_auc(scored, "y", "p_ensemble").first().auc > 0.8
    assert model.fills["c"] in "AB" and abs(model.fills["z"]) < 1
    model.save(f"file://{tmp_path}/model")
    again = models.Ensemble.load(f"file://{tmp_path}/model").score(test)
    assert {r.id: r.p_ensemble for r in again.collect()} == pytest.approx({r.id: r.p_ensemble for r in scored.collect()})


def test_scorer(variants):
    fit, held = variants.where("fold = 0"), variants.where("fold = 1")
    scorer = models.Scorer.fit(fit, held, "y", ["x", "z"], ["c"], "panel")
    got = scorer.score(held.withColumn("panel", F.when(F.col("id") < 6, "other").otherwise(F.col("panel"))), "panel").collect()
    limits = {r.panel: (r.threshold, r.sensitive) for r in scorer.thresholds.collect()}
    assert len(got) == 120 and set(limits) == {"p0", "p1", "p2"}
    for r in got:
        if r.panel in limits:
            assert (r.pred_youden, r.pred_sens90) == (int(r.P_pathogenic >= limits[r.panel][0]), int(r.P_pathogenic >= limits[r.panel][1]))
        assert 0 <= r.P_pathogenic <= 1 and r.P_raw_ensemble is not None


def test_stacks(variants):
    """Choice of strength, ablation and the test panels' evaluation agree with the scores' own AUC."""
    rows = variants.withColumns({"a": 1 / (1 + F.exp(-F.col("x"))), "c_score": 1 / (1 + F.exp(-F.col("rule")))})
    best, found = models.choose_strength(rows, "y", ["a", "c_score"], k=2)
    assert set(found) == {0.01, 0.1, 1.0, 10.0} and found[best] == max(found.values())
    row = models.ablation(rows, "y", ["a"], ["c_score"], "id", k=2, rounds=10).first()
    assert row.n == 240 and row.auc_more > row.auc_base and row.lo <= row.delta <= row.hi and 0 <= row.p <= 1
    table = models.panel_evaluation(rows.where("fold = 0"), rows.where("fold = 1 and (panel <> 'p2' or y = 1)"), "y", ["a"], ["c_score"], "id", "panel", best, rounds=10).collect()
    assert [r.panel for r in table] == ["p0", "p1"] and all(r.delta == pytest.approx(r.auc_more - r.auc_base) for r in table)


def test_leave_one_out_scores(variants):
    rows = variants.where("id < 12")
    got = models.leave_one_out_scores(rows, "y", ["x", "rule"], "id").collect()
    assert sorted(r.id for r in got) == list(range(12)) and all(0 < r.p < 1 for r in got)


def test_permutation_importances(variants):
    model = models.Ensemble.fit(variants.where("fold = 0"), "y", ["x", "z"], [])
    lost = dict(models.permutation_importance(model, variants.where("fold = 1"), "y", ["x", "z"], "id"))
    assert lost["x"] > lost["z"]


def test_delong_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.2, 0.3), (1, 0.4, 0.1)], "y int, a double, b double")
    row = stats.delong(df, "y", "a", "b").first()
    assert (row.auc_a, row.auc_b, row.z) == (None, None, None)
    assert stats.delong(df.limit(0), "y", "a", "b").count() == 1


def test_ranks_in_parts(spark):
    """Negative, zero, tiny, huge and tied scores; nulls; groups that are null."""
    r = random.Random(3)
    rows = [(i, r.choice(["g", None]), r.choice([0.0, -1.5, -1e300, 1e-300, 2.0, r.gauss(0, 1), r.random(), None]), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, s double, y int")
    got = {x.id: x.mid_rank for x in stats.mid_ranks(df, "s", ["g"]).collect()}
    for i, g, s, _ in rows:
        others = [t for _, h, t, _ in rows if h == g and t is not None]
        assert got[i] == (None if s is None else sum(t < s for t in others) + (sum(t == s for t in others) + 1) / 2)
    auc = {x.g: x.auc for x in stats.roc_auc(df, "y", "s", ["g"]).collect()}
    for g in ("g", None):
        pos, neg = ([s for _, h, s, y in rows if h == g and s is not None and y == k] for k in (1, 0))
        assert auc[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))


def test_stream(spark, tmp_path):
    """Files that arrive are scored once each."""
    rule = [rules.Rule("HIGH", 2.0, F.col("x") > 1)]
    paths = [f"file://{tmp_path}/{n}" for n in ("in", "out", "state")]
    for part in ([(1, 0.5), (2, 1.5)], [(3, 2.5), (4, None)]):
        spark.createDataFrame(part, "id long, x double").write.mode("append").parquet(paths[0])
        score_stream(spark, paths[0], "id long, x double", rule, *paths[1:]).awaitTermination()
    got = sorted((r.id, r.logit, r.rules) for r in spark.read.parquet(paths[1]).collect())
    assert got == [(1, 0.0, ""), (2, 2.0, "HIGH"), (3, 2.0, "HIGH"), (4, 0.0, "")]


def test_command_line(spark, tmp_path, capsys):
    from quern.__main__ import main

    assert main(["list"]) == 0 and "roc_auc" in capsys.readouterr().out.split()
    assert main(["sql", "union_by_name"]) == 0 and capsys.readouterr().out.startswith("SELECT")
    assert main(["sql", "none"]) == 2 and main(["run", "none", "--data", "x", "--out", "y"]) == 2
    assert main(["run", "union_by_name", "--data", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out").count() > 25
