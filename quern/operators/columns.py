"""Choosing, naming, aligning and numbering of columns and rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.nulls import num
from quern.operators.ordered import numbered


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that there are, in that order."""
    return df.select(*(F.col(f"`{c}`") for c in wanted if c in df.columns))


def first_existing(df: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The first of the names that is a column, null of a type if none is."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast(kind))


def without(df: DataFrame, names: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """df without columns of these names or with these prefixes."""
    return df.drop(*(c for c in df.columns if c in names or c.startswith(prefixes or ("\0",))))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed; names of absent columns are passed over. With the mapping turned round names are restored."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def anonymised(df: DataFrame, columns: list[str], prefix: str = "f") -> tuple[DataFrame, dict[str, str]]:
    """df with columns named f0, f1, ..., and the mapping from the new to the old names."""
    back = {f"{prefix}{i}": c for i, c in enumerate(columns)}
    return renamed(df, {c: n for n, c in back.items()}), back


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns as doubles: absent ones are null, others go."""
    return df.select(*((num(F.col(f"`{c}`")) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in columns))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns as doubles; null for what isn't a number."""
    return df.withColumns({c: num(c) for c in columns})


def of_type(df: DataFrame, *types: type[T.DataType]) -> list[str]:
    """The names of the columns of these types; numbers if none are given."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types or (T.NumericType,))]


def harmonised(frames: list[DataFrame], last: Callable[[str], bool], label: str = "label") -> DataFrame:
    """All rows under all columns: names with an underscore first as they come, then the others sorted, those that last picks
    sorted behind them, the label at the end. What a frame lacks is null."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    plain = [c for c in names if not c.startswith("_") and c != label]
    order = [c for c in names if c.startswith("_")] + sorted(c for c in plain if not last(c)) + sorted(c for c in plain if last(c)) + [c for c in names if c == label]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select(*(F.col(f"`{c}`") for c in order))


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of right put beside those of left by a key; of clashing names right's stay. Rows are never paired by their place."""
    new = [c for c in right.columns if c != key]
    return left.drop(*new).join(right, key, "left").select(*(c for c in left.columns if c not in new), *new)


def row_ids(panels: DataFrame, panel: str = "panel", key: str = "_variant_id", name: str = "_row_id") -> DataFrame:
    """Dense numbers from 0 on over all panels, in the order of panel and key."""
    return numbered(panels, [panel, key], name)


def metadata(df: DataFrame) -> DataFrame:
    """df with _variant_id, _gene, _source and _protein_change: a source that isn't stated is the first one, a change that
    isn't stated is the name if that has one."""
    name = first_existing(df, ["Name"])
    change = F.coalesce(first_existing(df, ["ProteinChange"]), F.when(name.contains("p."), name), F.lit(""))
    return df.withColumns({
        "_variant_id": first_existing(df, ["VariationID"]).cast("string"), "_gene": first_existing(df, ["GeneSymbol"]),
        "_source": F.coalesce(first_existing(df, ["source"]), F.lit("ClinVar")), "_protein_change": change,
    })


def first_note(df: DataFrame, column: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The first known value of a column in an order, one row (of each group)."""
    note = F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))
    return df.groupBy(*(by or [])).agg(note.alias(column))


def split_sides(df: DataFrame, scheme: str, side: str) -> DataFrame:
    """The rows of one side of a split scheme, with _split_scheme; a table without that split is refused."""
    column = f"_split_{scheme}"
    if column not in df.columns:
        raise ValueError(f"no column {column}: the panel has no {scheme} split")
    return df.where(F.col(column) == side).withColumn("_split_scheme", F.lit(scheme))
