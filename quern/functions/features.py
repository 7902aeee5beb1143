"""Feature blocks: each gives named column expressions, so all of them are one projection.

Residue letters are ref_aa, alt_aa, nucleotides ref_nuc, alt_nuc, the position aa_position, the ten
neighbours an array (five before, five behind). Letters should come from residues.letter, which makes
null an unknown residue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.nulls import flag, num, row_count, row_mean, row_variance
from quern.functions.residues import distance, prop

SEVEN = ("hydro", "mw", "charge", "polar", "vol", "arom", "blosum")
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
#: The ten neighbours' names, five before (farthest first) and five behind.
NEIGHBOURS = [f"up{i}" for i in range(5, 0, -1)] + [f"dn{i}" for i in range(1, 6)]
Features = dict[str, Column]


def window(sequence: Column, position: Column, size: int = 5, pad: str = "X", step: int = 1) -> Column:
    """The letters around a 1-based position: size before and size behind, pad beyond either end.

    step 3 reads around the codon of a residue at that position instead.
    """
    before = (position - 1) * step
    behind = before + step

    def at(i: Column) -> Column:
        index = F.when(i < 0, before + i).otherwise(behind + i - 1)
        inside = (position > 0) & (index >= 0) & (index < F.length(sequence))
        return F.when(F.coalesce(inside, F.lit(False)), F.upper(F.substring(sequence, index.cast("int") + 1, F.lit(1)))).otherwise(F.lit(pad))

    offsets = [*range(-size, 0), *range(1, size + 1)]
    return F.array(*(at(F.lit(i)) for i in offsets))


def one_hot(value: Column, letters: str, prefix: str) -> Features:
    return {f"{prefix}_{x}": flag(value == x) for x in letters}


def one_hot_letter(df: DataFrame, prefix: str, letters: str, pad: str) -> Column:
    """The letter that one-hot columns stand for, pad if none is set."""
    return F.coalesce(*(F.when(F.col(f"{prefix}_{x}") == 1, F.lit(x)) for x in letters if f"{prefix}_{x}" in df.columns), F.lit(pad))


def transitions(ref: Column, alt: Column) -> Features:
    pair = F.concat(ref, alt)
    ts = flag(pair.isin("AG", "GA", "CT", "TC"))
    return {"is_transition": ts, "is_transversion": 1 - ts, "is_ct_transition": flag(pair.isin("CT", "GA"))}


def log_position(position: Column) -> Column:
    return F.when(position > 0, F.log1p(position.cast("double")))


def substitution(ref: Column, alt: Column) -> Features:
    """Block A: properties of either residue, their differences and distance."""
    out: Features = {}
    for p in SEVEN:
        a, b = prop(ref, p), prop(alt, p)
        out |= {f"ref_{p}": a, f"alt_{p}": b, f"delta_{p}": b - a, f"abs_delta_{p}": F.abs(b - a)}
    return out | {"grantham_dist": distance(ref, alt)}


def substitution_flags(ref: Column, alt: Column) -> Features:
    """Block B: what kind of change it is."""
    q1, q2, p1, p2 = prop(ref, "charge"), prop(alt, "charge"), prop(ref, "polar"), prop(alt, "polar")
    h1, h2 = prop(ref, "hydro"), prop(alt, "hydro")
    return {
        "is_conservative": flag((q1 == q2) & (p1 == p2)), "is_radical": flag(distance(ref, alt) > 100), "is_charge_reversal": flag(q1 * q2 < 0),
        "gains_charge": flag((q1 == 0) & (q2 != 0)), "loses_charge": flag((q1 != 0) & (q2 == 0)),
        "hydro_to_polar": flag((h1 > 0) & (h2 <= 0)), "polar_to_hydro": flag((h1 <= 0) & (h2 > 0)),
        "same_polarity_class": flag(p1 == p2), "same_charge_sign": flag((q1 >= 0) == (q2 >= 0)),
    }


def neighbours(context: Column) -> Features:
    """Block E: properties of the ten neighbours."""
    return {f"ctx_{n}_{p}": prop(F.get(context, F.lit(k)), p) for k, n in enumerate(NEIGHBOURS) for p in SEVEN}


def neighbour_summary(context: Column) -> Features:
    """Block F: mean and population standard deviation of hydropathy and charge around."""
    out: Features = {}
    for p in ("hydro", "charge"):
        values = [prop(F.get(context, F.lit(k)), p) for k in range(10)]
        mean = sum(values[1:], values[0]) / F.lit(10.0)
        squares = [(v - mean) * (v - mean) for v in values]
        out |= {f"ctx_mean_{p}": mean, f"ctx_std_{p}": F.sqrt(sum(squares[1:], squares[0]) / F.lit(10.0))}
    return out


def codon(ref: Column, alt: Column, position: Column) -> Features:
    """Blocks G and H: place in the codon (a proxy), degeneracy and codon usage."""
    place = F.when(position > 0, F.pmod(position - 1, F.lit(3)) + 1).otherwise(0)
    a, b = prop(ref, "rscu_mean"), prop(alt, "rscu_mean")
    x, y = prop(ref, "rscu_max"), prop(alt, "rscu_max")
    return {
        "codon_position": place.cast("int"), "codon_degeneracy_ref": prop(ref, "degeneracy").cast("int"), "codon_degeneracy_alt": prop(alt, "degeneracy").cast("int"),
        "ref_mean_rscu": a, "alt_mean_rscu": b, "delta_mean_rscu": b - a, "abs_delta_mean_rscu": F.abs(b - a),
        "ref_max_rscu": x, "alt_max_rscu": y, "delta_max_rscu": y - x, "codon_usage_pressure": x - a,
    }


def structure(ref: Column, alt: Column, context: Column) -> Features:
    """Block I: propensities, their differences, breakers, burial and what the neighbours favour."""
    out: Features = {}
    for p in ("alpha", "beta", "turn", "rsa"):
        a, b = prop(ref, p), prop(alt, p)
        out |= {f"ref_{p}": a, f"alt_{p}": b, f"delta_{p}": b - a}
        if p != "turn":
            out[f"abs_delta_{p}"] = F.abs(b - a)
    change = out["delta_rsa"]
    out["helix_breaker"] = flag((out["ref_alpha"] >= 1.0) & (out["alt_alpha"] < 0.70))
    out["sheet_breaker"] = flag((out["ref_beta"] >= 1.0) & (out["alt_beta"] < 0.60))
    out["burial_change"] = F.signum(change)
    for p in ("alpha", "beta"):
        values = [prop(F.get(context, F.lit(k)), p) for k in range(10)]
        out[f"ctx_mean_{p}"] = sum(values[1:], values[0]) / F.lit(10.0)
        high = [(v > 1.0).cast("double") for v in values]
        out[f"ctx_share_{p}"] = sum(high[1:], high[0]) / F.lit(10.0)
    return out


#: The registry of enrichment blocks: expressions from residues, nucleotides, position and neighbours.
ENRICHERS: tuple[Callable[..., Features], ...] = (
    lambda r, a, n, m, p, c: substitution(r, a),
    lambda r, a, n, m, p, c: substitution_flags(r, a),
    lambda r, a, n, m, p, c: transitions(n, m),
    lambda r, a, n, m, p, c: {"log_position": log_position(p)},
    lambda r, a, n, m, p, c: neighbours(c),
    lambda r, a, n, m, p, c: neighbour_summary(c),
    lambda r, a, n, m, p, c: codon(r, a, p),
    lambda r, a, n, m, p, c: structure(r, a, c),
)


def enrich(df: DataFrame, context: str = "context", prefix: str = "enrich_") -> DataFrame:
    """df with all enrichment columns (149); of clashing names the new column wins."""
    args = [F.col(x) for x in ("ref_aa", "alt_aa", "ref_nuc", "alt_nuc", "aa_position", context)]
    new = {f"{prefix}{k}": v for block in ENRICHERS for k, v in block(*args).items()}
    return df.drop(*new).select("*", *(v.alias(k) for k, v in new.items()))


def population(af: Column) -> Features:
    """Frequency, its logarithm and how rare it is; unknown counts as 0."""
    af = F.coalesce(af, F.lit(0.0))
    return {"maf_global": af, "maf_log10": F.log10(af + F.lit(1e-6)), "is_rare": flag(af < 0.0001), "is_very_rare": flag(af < 0.000001), "is_common": flag(af > 0.01)}


def tool_summary(cadd: Column, sift: Column, *others: Column) -> Features:
    """Mean, variance and number of scores that all grow with damage: the scaled one over 40 up to 1, the inverse one turned."""
    scaled = F.when(cadd.isNotNull(), F.least(cadd / F.lit(40.0), F.lit(1.0)))
    values = (scaled, 1 - sift, *others)
    return {"silico_mean": row_mean(*values), "silico_variance": row_variance(*values), "silico_n_tools": row_count(*values)}


#: Populations with a frequency of their own, and the columns that blocks pass through.
POPULATIONS = ("afr", "amr", "eas", "fin", "nfe", "sas")
CONSERVATION = ("phylop_score", "phastcons_score", "gerp_score")
CONSTRAINTS = ("pli", "loeuf", "mis_z")
TOOLS = {"cadd_raw": "cadd_raw", "cadd_phred": "cadd_phred", "revel_score": "revel_score", "polyphen2_hdiv": "polyphen2_hdiv", "polyphen2_hvar": "polyphen2_hvar", "sift_score": "sift_score", "alphamissense": "am_pathogenicity"}


def known_or_null(df: DataFrame, name: str) -> Column:
    """A column as a double, null where the table has none or a value isn't a number."""
    return num(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("double")


def context_one_hots(context: Column, letters: str, prefix: str) -> Features:
    """A column for each neighbour and letter: 10 x 20 for residues, 10 x 4 for nucleotides; none is set beyond an end."""
    return {f"{prefix}_ctx_{n}_{x}": flag(F.get(context, F.lit(k)) == x) for k, n in enumerate(NEIGHBOURS) for x in letters}


def sequence_block(ref_nuc: Column, alt_nuc: Column, ref: Column, alt: Column, position: Column) -> Features:
    """Letters, one-hots, kind of substitution, position: 57 columns. A position that isn't known is null."""
    purines, pyrimidines = ("A", "G"), ("C", "T")
    within = (ref_nuc.isin(*purines) & alt_nuc.isin(*purines)) | (ref_nuc.isin(*pyrimidines) & alt_nuc.isin(*pyrimidines))
    out: Features = {"ref_nuc": ref_nuc, "alt_nuc": alt_nuc, "ref_aa": ref, "alt_aa": alt}
    for side, nuc, aa in (("ref", ref_nuc, ref), ("alt", alt_nuc, alt)):
        out |= one_hot(nuc, "ACGT", f"{side}_nuc") | one_hot(aa, AMINO_ACIDS, f"{side}_aa")
    out |= {"is_transition": flag(within), "is_transversion": 1 - flag(within), "is_ct_transition": flag((ref_nuc == "C") & (alt_nuc == "T"))}
    return out | {"aa_position": F.when(position > 0, position.cast("double")), "aa_position_log": log_position(position)}


def context_block(residues: Column, bases: Column) -> Features:
    """Nucleotides around as one-hots, residues around as properties, and their summary: 114 columns."""
    encoded = {f"aa_{k}": v for k, v in neighbours(residues).items()}
    return context_one_hots(bases, "ACGT", "nuc") | encoded | neighbour_summary(residues)


def biochemical_block(ref: Column, alt: Column) -> Features:
    """Properties of either residue, differences, distance and six kinds of change: 35 columns."""
    kinds = substitution_flags(ref, alt)
    six = ("is_conservative", "is_charge_reversal", "gains_charge", "loses_charge", "hydro_to_polar", "polar_to_hydro")
    return substitution(ref, alt) | {k: kinds[k] for k in six}


def conservation_block(df: DataFrame) -> Features:
    """Conservation and constraint as they are, null where they aren't known: 6 columns."""
    return {c: known_or_null(df, c) for c in (*CONSERVATION, *CONSTRAINTS)}


def population_block(df: DataFrame) -> Features:
    """The frequency, how rare it is, and that of each population: 11 columns."""
    of_all = {k if k.startswith("maf_") else f"maf_{k}": v for k, v in population(known_or_null(df, "gnomad_af_global")).items()}
    return of_all | {f"maf_{p}": known_or_null(df, f"gnomad_af_{p}") for p in POPULATIONS}


def tool_block(df: DataFrame) -> Features:
    """Seven tools' scores, their mean, variance (of two or more) and number: 10 columns."""
    scores = {k: known_or_null(df, c) for k, c in TOOLS.items()}
    n = row_count(*scores.values())
    return scores | {"silico_mean": row_mean(*scores.values()), "silico_variance": F.when(n > 1, row_variance(*scores.values())), "silico_n_tools": n}


def annotate(df: DataFrame, residues: str = "context", bases: str = "bases") -> DataFrame:
    """df with the six blocks from ref_nuc, alt_nuc, ref_aa, alt_aa, aa_position, the neighbours and the joined scores."""
    letters = [F.col(c) for c in ("ref_nuc", "alt_nuc", "ref_aa", "alt_aa")]
    new = sequence_block(*letters, F.col("aa_position")) | context_block(F.col(residues), F.col(bases)) | biochemical_block(*letters[2:])
    new |= conservation_block(df) | population_block(df) | tool_block(df)
    return df.select(*(c for c in df.columns if c not in new), *(v.alias(k) for k, v in new.items()))
