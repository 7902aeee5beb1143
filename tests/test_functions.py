"""Hand-checked values of parsing, lookups, windows, rules and statistics."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import features, parse, residues
from quern.functions.schema import SETS, feature_group, select_features
from quern.operators import panels, rules, select, stats
from quern.sources import readers


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize(
    ("text", "label", "confidence"),
    [
        ("Pathogenic", 1, "hard"), ("Benign", 0, "hard"), ("Conflicting interpretations of pathogenicity", None, None), ("Pathogenic/Benign", None, None), (None, None, None),
        ("Likely pathogenic", 1, "likely"), ("Pathogenic/Likely pathogenic", 1, "likely"), ("Pathogenic; risk factor", None, None),
    ],
)
def test_labels(spark, text, label, confidence):
    c = F.lit(text).cast("string")
    r = one(spark, label=parse.label_of(c), confidence=parse.confidence_of(c))
    assert (r.label, r.confidence) == (label, confidence)


def test_names(spark):
    name = F.lit("NM_004985.5(KRAS):c.35G>T (p.Gly12Val)")
    ref, alt = parse.nucleotides_of(name)
    r = one(spark, ref=ref, alt=alt, yes=parse.is_missense(name), no=parse.is_missense(F.lit("NM_000527.5(LDLR):c.907T>A (p.Cys303Ter)")), null=parse.is_missense(F.lit(None).cast("string")))
    assert tuple(r) == ("G", "T", True, False, False)


@pytest.mark.parametrize(("text", "expected"), [("p.D266V", ("D", "V", 266)), ("p.Sec10Cys", ("U", "C", 10)), ("p.?", ("X", "X", -1)), (None, ("X", "X", -1)), ("x (p.Asp266Val)", ("D", "V", 266))])
def test_protein_changes(spark, text, expected):
    a, b, p = parse.protein_change(F.lit(text).cast("string"))
    assert tuple(one(spark, a=a, b=b, p=p)) == expected


def test_distances():
    table = residues.distance_table()
    assert len(table) == 400
    assert (table["CW"], table["IL"], table["AV"], table["KE"], table["VA"]) == (215, 5, 64, 56, 64)
    assert all(table[a + b] == table[b + a] for a, b in table)


def test_windows(spark):
    r = one(spark, a=features.window(F.lit("MKTAYIAKQR"), F.lit(3)), n=features.window(F.lit("ATGAAATTTGGG"), F.lit(2), pad="N", step=3))
    assert r.a == list("XXXMKAYIAK")
    assert r.n == list("NNATGTTTGG")


def test_enrichment(spark):
    row = spark.range(1).select(F.lit("A").alias("ref_aa"), F.lit("V").alias("alt_aa"), F.lit("C").alias("ref_nuc"), F.lit("T").alias("alt_nuc"), F.lit(100).alias("aa_position"), F.array(*[F.lit("G")] * 10).alias("context"))
    out = features.enrich(row)
    new = [c for c in out.columns if c.startswith("enrich_")]
    r = out.first()
    assert len(new) == 149
    assert r.enrich_delta_hydro == pytest.approx(2.4)
    assert (r.enrich_grantham_dist, r.enrich_is_conservative, r.enrich_is_radical, r.enrich_is_transition, r.enrich_is_ct_transition, r.enrich_codon_position) == (64.0, 1, 0, 1, 1, 1)
    assert (r.enrich_codon_degeneracy_ref, r.enrich_ctx_mean_hydro, r.enrich_ctx_std_hydro, r.enrich_burial_change) == (4, pytest.approx(-0.4), pytest.approx(0, abs=1e-9), -1)
    assert features.enrich(out).columns == out.columns


def scored(spark, **values):
    base = {"af": None, "pop": None, "cons": None, "pli": None, "ref": "X", "alt": "X"} | values
    df = spark.createDataFrame([tuple(base.values())], "af double, pop double, cons double, pli double, ref string, alt string")
    table = rules.substitution_rules(*(F.col(c) for c in ("af", "pop", "cons", "pli", "ref", "alt")))
    r = rules.evidence(df, table).first()
    return r.logit, r.rules


def test_rules(spark):
    assert scored(spark, af=0.06, pli=0.99) == (-6.0, "BA1")
    assert scored(spark, af=0.02, pop=0.006, pli=0.95, ref="C", alt="W") == (1.0, "BS1,BS2,GENE_INTOL,RADICAL_SUB")
    assert scored(spark, ref="K", alt="E") == (2.0, "CHARGE_REV")
    assert scored(spark, ref="I", alt="L") == (-1.0, "CONSERV_SUB")
    assert scored(spark) == (0.0, "")


def test_statistics(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0)], "y int, s double")
    assert stats.roc_auc(df, "y", "s").first().auc == pytest.approx(0.875)
    turned = df.withColumn("s", -F.col("s"))
    assert stats.roc_auc(turned, "y", "s").first().auc == pytest.approx(0.125)
    ranks = df.select(stats.mid_rank(F.col("s")).alias("r")).collect()
    assert sorted(r.r for r in ranks) == [1, 2.5, 2.5, 4]
    r = stats.delong(df.withColumn("t", F.col("s")), "y", "s", "t").first()
    assert (r.delta, r.z) == (0, 0)
    p = one(spark, p=stats.normal_p(F.lit(1.96)), zero=stats.normal_p(F.lit(0.0)))
    assert p.p == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-6) and p.zero == 1
    empty = stats.roc_auc(df.where("false"), "y", "s").collect()
    assert [r.auc for r in empty] == [None]


def test_tool_summary(spark):
    c = features.tool_summary(F.lit(60.0), F.lit(0.2), F.lit(None).cast("double"))
    r = one(spark, **c)
    assert (r.silico_mean, r.silico_variance, r.silico_n_tools) == (pytest.approx(0.9), pytest.approx(0.01), 2)


def test_feature_groups():
    assert feature_group("_x") is None and feature_group("label") is None and feature_group("track_c_logit") is None
    assert feature_group("cadd_phred") == "insilico" and feature_group("aa_ctx_up1_hydro") == "context"
    assert select_features(["cadd_phred", "pli", "aa_ctx_up1"], "core") == ["pli"]
    assert "insilico" in SETS["full"]
    with pytest.raises(ValueError):
        select_features([], "none")


def test_null_safe_removal(spark):
    train = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    test = spark.createDataFrame([(1, None), (2, "c"), (None, None)], "a int, b string")
    assert sorted(map(str, select.without_rows_of(test, train, ["a", "b"]).collect())) == sorted(map(str, test.where("a is null or b = 'c'").collect()))


def test_delimited(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text('VariationID\tStart\tName\tOther\n1\t5\t"a ""q"""\tx\n2\tNA\n3\tx\tb\tc\td\n')
    rows = readers.delimited(spark, str(path), "VariationID STRING, Name STRING, Start BIGINT, label INT", sep="\t").orderBy("VariationID").collect()
    assert [tuple(r) for r in rows] == [("1", 'a "q"', 5, None), ("2", None, None, None)]
    assert readers.optional(spark, str(tmp_path / "none"), "a INT").count() == 0


def test_fasta(spark, tmp_path):
    path = tmp_path / "p.fasta"
    path.write_text(">sp|A GN=G1 x\nMKT\nAY\n>sp|B GN=G1\nMK\n>sp|C\nQQ\n>sp|D GN=G2\nRR\n")
    assert sorted(map(tuple, readers.fasta(spark, str(path)).collect())) == [("G1", "MKTAY"), ("G2", "RR")]


def test_panels(spark):
    rows = [(str(i), "GRCh38", "single nucleotide variant", "reviewed by expert panel", "Pathogenic" if i % 2 else "Benign", f"c.{i}A>G (p.Lys{i}Glu)", f"G{i % 7}", "1", i) for i in range(1, 200)]
    raw = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None, None, None, None, None)], readers.VARIANTS)
    found = panels.labelled(raw)
    assert found.count() == 199
    pool = panels.with_splits(panels.panel(found, "general"), {"train": [20, 20], "test": [10, 10]})
    assert pool.count() == 199 and panels.shared_genes(pool).isEmpty()
    counts = {(r._split_variant, r.label): r["count"] for r in pool.groupBy("_split_variant", "label").count().collect()}
    assert counts["train", 1] == 20 and counts["test", 0] == 10
    assert panels.overlapping_ids(pool).isEmpty()
