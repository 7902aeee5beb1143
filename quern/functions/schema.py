"""Groups of columns by the blocks that make them, and the feature sets made of groups."""

from __future__ import annotations

from dataclasses import dataclass

from quern.functions.features import AMINO_ACIDS, NEIGHBOURS, POPULATIONS, SEVEN


@dataclass(frozen=True)
class Block:
    """A group's columns: those of these names, and those whose names begin so."""

    group: str | None
    names: frozenset[str] = frozenset()
    prefixes: tuple[str, ...] = ()

    def has(self, column: str) -> bool:
        return column in self.names or column.startswith(self.prefixes or ("\0",))


def _each(*parts) -> frozenset[str]:
    """All names of a part from each list, joined by underscores."""
    out = [""]
    for options in parts:
        out = [f"{a}_{b}" if a else b for a in out for b in options]
    return frozenset(out)


#: Columns that come from outside and are known by name.
TOOLS = frozenset("cadd_raw cadd_phred revel_score polyphen2_hdiv polyphen2_hvar sift_score alphamissense am_pathogenicity silico_mean silico_variance silico_n_tools".split())
CONSERVATION = frozenset("phylop_score phastcons_score gerp_score phylop_primate phastcons_primate gerp_rs phylop_primate_rank".split())
CONSTRAINTS = frozenset(("pli", "loeuf", "mis_z"))
#: External scores compared as baselines, and their direction.
BASELINES = {"revel_score": 1, "alphamissense": 1, "cadd_phred": 1, "polyphen2_hvar": 1, "sift_score": -1, "silico_mean": 1}
CATEGORICAL = ("ref_aa", "alt_aa", "ref_nuc", "alt_nuc")
CHANGES = frozenset("grantham_dist is_conservative is_radical is_charge_reversal gains_charge loses_charge hydro_to_polar polar_to_hydro".split())
#: The raw letters around, which models don't see.
RAW_CONTEXT = _each(("aa", "nuc"), ("ctx",), NEIGHBOURS)
TARGET = "label"
#: The blocks, and the prefixes by which their further columns are known. The rules' columns are no features.
BLOCKS = (
    Block("insilico", TOOLS),
    Block("conservation", CONSERVATION),
    Block("gene_constraint", CONSTRAINTS),
    Block("population", _each(("maf",), POPULATIONS), ("maf_", "gnomad_af")),
    Block("enrichment", prefixes=("enrich_",)),
    Block("context", RAW_CONTEXT, ("ctx_", *sorted(f"{c}_" for c in RAW_CONTEXT))),
    Block("biochemical", _each(("ref", "alt"), SEVEN) | CHANGES, ("delta_", "abs_delta_")),
    Block("sequence", frozenset(CATEGORICAL) | _each(("ref", "alt"), ("aa", "nuc"), AMINO_ACIDS + "BJOUXZ"), ("is_transition", "is_transversion", "is_ct_transition", "aa_position", "codon_")),
    Block(None, prefixes=("track_c_", "_")),
    Block(None, frozenset({TARGET})),
)
SETS = {"full": {b.group for b in BLOCKS if b.group} | {"other"}}
SETS["core"] = SETS["full"] - {"insilico"}


def feature_group(column: str) -> str | None:
    """The group of a column; None for metadata, the target and rule scores."""
    return next((b.group for b in BLOCKS if b.has(column)), "other")


def select_features(columns: list[str], feature_set: str = "core", drop_raw_context: bool = True) -> list[str]:
    """The columns of a feature set, in their order."""
    if feature_set not in SETS:
        raise ValueError(f"no feature set {feature_set!r}; there are {sorted(SETS)}")
    return [c for c in columns if feature_group(c) in SETS[feature_set] and not (drop_raw_context and c in RAW_CONTEXT)]


def group_table(columns: list[str]) -> dict[str, int]:
    """How many columns each group has."""
    out: dict[str, int] = {}
    for c in columns:
        if group := feature_group(c):
            out[group] = out.get(group, 0) + 1
    return dict(sorted(out.items()))
