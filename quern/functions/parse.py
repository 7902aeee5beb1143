"""Parsing of labels, names and changes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classifications with one of these are left out.
EXCLUDED = ("conflicting", "uncertain", "not provided", "drug response", "association", "protective", "other", "risk factor")
#: Fixed patterns of names: a substitution of a nucleotide, a protein change in three letters, what isn't a substitution.
NUCLEOTIDES = r"(?i)c\.\d+([ACGT])>([ACGT])"
MISSENSE = r"p\.[A-Z][a-z]{2}\d+[A-Z][a-z]{2}"
NOT_MISSENSE = r"(?i)p\..*(?:Ter|\*|fs|del|ins|dup|Ext|Met1\?|=)"
THREE_LETTERS = r"p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2})"
ONE_LETTER = r"p\.([A-Z])(\d+)([A-Z])(?![a-z])"
#: One-letter codes of the residues' three-letter codes.
RESIDUES = dict(
    Ala="A", Arg="R", Asn="N", Asp="D", Cys="C", Gln="Q", Glu="E", Gly="G", His="H", Ile="I", Leu="L", Lys="K",
    Met="M", Phe="F", Pro="P", Ser="S", Thr="T", Trp="W", Tyr="Y", Val="V", Sec="U", Ter="*", Pyl="O", Xaa="X",
)


def label_of(text: Column, positive: str = "pathogenic", negative: str = "benign", excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """1 or 0 by which of two words a classification has; null with both, neither or an excluded word."""
    s = F.lower(F.trim(text))
    yes, no = s.contains(positive), s.contains(negative)
    out = s.rlike("|".join(excluded))
    return F.when(out | (yes & no), F.lit(None)).when(yes, 1).when(no, 0)


def confidence_of(text: Column, suffix: str = "") -> Column:
    """'likely' or 'hard' where label_of gives a label, with a suffix for a stricter review level."""
    word = F.when(F.lower(text).contains("likely"), F.lit(f"likely{suffix}")).otherwise(F.lit(f"hard{suffix}"))
    return F.when(label_of(text).isNotNull(), word)


def nucleotides_of(name: Column) -> tuple[Column, Column]:
    """Reference and other nucleotide of a name, N without one."""
    part = lambda g: F.coalesce(F.nullif(F.upper(F.regexp_extract(name, NUCLEOTIDES, g)), F.lit("")), F.lit("N"))
    return part(1), part(2)


def is_missense(name: Column) -> Column:
    """Whether a name states the change of one residue; null is not."""
    return F.coalesce(name.contains("p.") & ~name.rlike(NOT_MISSENSE) & name.rlike(MISSENSE), F.lit(False))


def protein_change(text: Column) -> tuple[Column, Column, Column]:
    """Residue, other residue and position of a protein change; X, X and -1 without one.

    Three-letter codes come first; only if they give no known pair of residues, one-letter codes.
    """
    three, one = THREE_LETTERS, ONE_LETTER
    codes = F.create_map(*(F.lit(x) for pair in RESIDUES.items() for x in pair))
    valid = "".join(sorted(set(RESIDUES.values()) - {"*"}))
    get = lambda p, g: F.regexp_extract(text, p, g)
    long_ok = (F.coalesce(F.element_at(codes, get(three, 1)), F.lit("X")) != "X") & (F.coalesce(F.element_at(codes, get(three, 3)), F.lit("X")) != "X")
    short_ok = get(one, 1).rlike(f"^[{valid}]$") & get(one, 3).rlike(f"^[{valid}]$")
    long_ok, short_ok = F.coalesce(long_ok, F.lit(False)), F.coalesce(short_ok, F.lit(False))
    residue = lambda g: F.when(long_ok, F.element_at(codes, get(three, g))).when(short_ok, get(one, g)).otherwise(F.lit("X"))
    position = F.when(long_ok, get(three, 2).try_cast("int")).when(short_ok, get(one, 2).try_cast("int")).otherwise(F.lit(-1))
    return residue(1), residue(3), position


def change_or_null(text: Column) -> tuple[Column, Column, Column]:
    """As protein_change, but all three null where no whole change is stated."""
    ref, alt, position = protein_change(text)
    whole = (ref != "X") & (alt != "X") & (position >= 0)
    return tuple(F.when(whole, c) for c in (ref, alt, position))


def last_part(text: Column, separator: str) -> Column:
    return F.trim(F.element_at(F.split(text, separator), -1))


def frequency(genome: Column, exome: Column, population: str) -> Column:
    """Allele count over number in the first matching population with a number above 0, genome before exome."""

    def of(source: Column) -> Column:
        hits = F.filter(source["populations"], lambda p: (F.lower(p["id"]) == population) & (p["an"] > 0))
        hit = F.get(hits, 0)
        return hit["ac"] / hit["an"]

    return F.coalesce(of(genome), of(exome))
