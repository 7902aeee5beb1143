"""A transparent scorer: a table of weighted rules, evaluated as one expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.features import POPULATIONS, known_or_null
from quern.functions.nulls import row_mean, row_values
from quern.functions.residues import distance, letter, prop
from quern.functions.schema import CONSERVATION

#: The tools whose mean the rules PP3 and BP4 judge.
PP3_TOOLS = ("cadd_phred", "revel_score", "polyphen2_hdiv", "polyphen2_hvar", "sift_score", "alphamissense")


@dataclass(frozen=True)
class Rule:
    name: str
    weight: float
    when: Column
    decides: bool = False
    """A rule that decides stands alone: no other counts."""


def evidence(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with logit, score, n_fired and rules (names in order, comma-joined)."""
    fired = F.array_compact(F.array(*(F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.name).alias("n"), F.lit(r.weight).alias("w"))) for r in rules if not r.decides)))
    for r in (r for r in rules if r.decides):
        fired = F.when(F.coalesce(r.when, F.lit(False)), F.array(F.struct(F.lit(r.name).alias("n"), F.lit(r.weight).alias("w")))).otherwise(fired)
    out = df.withColumn("_fired", fired)
    out = out.withColumns({"logit": F.aggregate("_fired", F.lit(0.0), lambda t, x: t + x["w"]), "n_fired": F.size("_fired"), "rules": F.array_join(F.transform("_fired", lambda x: x["n"]), ",")})
    return out.withColumn("score", 1 / (1 + F.exp(-F.col("logit")))).drop("_fired")


def substitution_rules(af: Column, population_max: Column, conservation_max: Column, intolerance: Column, ref: Column, alt: Column, silico: list[Column] | None = None) -> list[Rule]:
    """The rule table; silico, scores that all grow with damage, only where the feature set has them.

    Fixed values: the weights and thresholds below.
    """
    charge = lambda x: F.when(x.isin("R", "K"), 1).when(x.isin("D", "E"), -1).otherwise(0)
    d, known = distance(ref, alt), (ref != "X") & (alt != "X")
    rules = [
        Rule("BA1", -6.0, af > 0.05, decides=True),
        Rule("BS1", -2.0, af > 0.01),
        Rule("BS2", -1.0, population_max > 0.005),
    ]
    if silico:
        mean = row_mean(*silico)
        rules += [Rule("PP3", 1.0, mean > 0.7), Rule("BP4", -1.0, mean < 0.3)]
    return rules + [
        Rule("CONS_HIGH", 2.0, conservation_max > 2.5),
        Rule("GENE_INTOL", 2.0, intolerance > 0.9),
        Rule("RADICAL_SUB", 2.0, d > 150),
        Rule("CHARGE_REV", 2.0, charge(ref) * charge(alt) < 0),
        Rule("CONSERV_SUB", -1.0, (d < 30) & (charge(ref) == charge(alt)) & known & (prop(ref, "polar") == prop(alt, "polar"))),
    ]


def normalised_tools(df: DataFrame) -> list[Column]:
    """The tools' scores, all growing with damage within 0 to 1: the scaled one over 40 up to 1, the inverse one turned."""
    out = []
    for name in PP3_TOOLS:
        x = known_or_null(df, name)
        out.append(F.when(x.isNotNull(), F.least(x / F.lit(40.0), F.lit(1.0))) if name == "cadd_phred" else 1 - x if name == "sift_score" else x)
    return out


def column_rules(df: DataFrame, feature_set: str = "core") -> list[Rule]:
    """The rule table over a table's own columns: whichever populations, conservation scores and (in full) tools it has."""
    highest = lambda names: F.array_max(row_values(*(known_or_null(df, c) for c in names)))
    silico = normalised_tools(df) if feature_set == "full" else None
    return substitution_rules(
        known_or_null(df, "maf_global"), highest([f"maf_{p}" for p in POPULATIONS]), highest(sorted(CONSERVATION)), known_or_null(df, "pli"), letter(F.col("ref_aa")), letter(F.col("alt_aa")), silico
    )


def rule_counts(scored: DataFrame) -> DataFrame:
    """How often each rule fired."""
    return scored.where("rules <> ''").select(F.explode(F.split("rules", ",")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
