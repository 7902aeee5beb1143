"""From raw records to labelled panels with both split schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.parse import confidence_of, is_missense, label_of, nucleotides_of
from quern.operators.ordered import drawn_places
from quern.operators.select import draw, group_split, keep_first, variant_split

#: Review levels that count, and the panels' genes.
REVIEWED = ("criteria provided, multiple submitters, no conflicts", "reviewed by expert panel", "practice guideline")
CANCER = ("BRCA1", "BRCA2", "PALB2", "RAD51C", "RAD51D", "BRIP1", "MLH1", "MSH2", "MSH6", "PMS2", "TP53", "PTEN", "STK11", "CDH1", "VHL", "RET", "APC", "SMAD4", "BMPR1A", "ATM", "CHEK2", "NBN", "NF1", "NF2", "MEN1", "SDHA", "SDHB", "SDHC", "SDHD", "BAP1", "MUTYH", "FLCN", "FH")
PANELS = {"cancer": CANCER, "pah": ("PAH",), "cftr": ("CFTR",)}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def labelled(raw: DataFrame, reviewed: tuple[str, ...] | None = REVIEWED, assembly: str = "GRCH38", kind: str = "single nucleotide variant") -> DataFrame:
    """Missense records of one assembly with a label: one row a VariationID, the first by position and name."""
    rows = raw.where((F.upper(strip(F.col("Assembly"))) == assembly) & (F.lower(strip(F.col("Type"))) == kind))
    if reviewed:
        rows = rows.where(F.lower(strip(F.col("ReviewStatus"))).isin(*reviewed))
    significance, name = F.col("ClinicalSignificance"), F.col("Name")
    ref, alt = nucleotides_of(name)
    rows = rows.withColumns({"label": label_of(significance), "label_confidence": confidence_of(significance), "ReferenceAllele": ref, "AlternateAllele": alt})
    rows = rows.where(F.col("label").isNotNull() & is_missense(name)).drop("Assembly", "Type")
    return keep_first(rows, ["VariationID"], [F.col("Start"), name, significance])


def supplemented(rows: DataFrame, more: DataFrame, seed: int = 42, extra: int = 500) -> DataFrame:
    """rows with negatives of more (of genes that have positives, new ids) up to the deficit and extra, where negatives are fewer."""
    n = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("b")).first()
    if n.b >= n.p:
        return rows
    genes = rows.where("label = 1").select("GeneSymbol").distinct()
    new = more.where("label = 0").join(genes, "GeneSymbol", "left_semi").join(rows, "VariationID", "left_anti")
    chosen = new.orderBy(draw(seed, F.col("VariationID")), "VariationID").limit(n.p - n.b + extra)
    return rows.unionByName(chosen, allowMissingColumns=True)


def with_any_star(pool: DataFrame, raw: DataFrame, name: str, target: int) -> DataFrame:
    """pool with negatives of any review level, where it is a single gene's and less than half of target; new ids only."""
    if len(PANELS.get(name, ())) != 1 or pool.count() >= 0.5 * target:
        return pool
    more = panel(labelled(raw, reviewed=None).where("label = 0"), name).join(pool, "VariationID", "left_anti")
    return pool.unionByName(more.select(*pool.columns))


def panel(rows: DataFrame, name: str, general_excludes: bool = True) -> DataFrame:
    """The rows of a panel; the general one is all but the others' genes."""
    gene = F.coalesce(F.col("GeneSymbol"), F.lit(""))
    if name == "general":
        others = sorted({g for genes in PANELS.values() for g in genes})
        rows = rows.where(~gene.isin(*others)) if general_excludes else rows
    else:
        rows = rows.where(gene.isin(*PANELS[name]))
    return rows.withColumn("panel", F.lit(name))


def with_splits(pool: DataFrame, targets: dict[str, list[int]], seed: int = 42) -> DataFrame:
    """pool with _split_variant and _split_gene (train, test, unused); a single gene can't be divided by gene."""
    (train, _), (test, _) = targets["train"], targets["test"]
    share = test / (train + test)
    by_row = variant_split(pool, "label", train, test, F.col("VariationID"), seed).withColumnRenamed("side", "_split_variant")
    if pool.select("GeneSymbol").distinct().count() < 2:
        return by_row.withColumns({"_split_gene": F.col("_split_variant"), "_split_gene_note": F.lit("single gene: same as variant")})
    groups = group_split(pool, "GeneSymbol", F.col("label") == 1, share, (train + test, train + test), seed).select("GeneSymbol", "in_test")
    sided = by_row.join(groups, "GeneSymbol")
    sided = sided.withColumn("_stratum", F.concat_ws("/", F.col("in_test").cast("string"), F.col("label").cast("string")))
    placed = drawn_places(sided, ["_stratum"], draw(seed, F.col("VariationID")), "VariationID")
    place = F.col("place")
    limit = F.when(F.col("in_test"), F.lit(test)).otherwise(F.lit(train))
    side = F.when(place > limit, "unused").when(F.col("in_test"), "test").otherwise("train")
    return placed.withColumn("_split_gene", side).withColumn("_split_gene_note", F.lit(None).cast("string")).drop("_stratum", "in_test", "place", "group_size")


def overlapping_ids(panels: DataFrame) -> DataFrame:
    """Ids that stand in several panels."""
    return panels.groupBy("VariationID").agg(F.count_distinct("panel").alias("n")).where("n > 1")


def shared_genes(pool: DataFrame, side: str = "_split_gene") -> DataFrame:
    """Genes on both sides: empty if the split keeps genes apart."""
    train, test = (pool.where(F.col(side) == s).select("GeneSymbol") for s in ("train", "test"))
    return train.intersect(test)
