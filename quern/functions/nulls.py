"""Null rules: NaN is null, comparisons with null are false, text that isn't a number is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts that delimited files use for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | str) -> Column:
    """As a double; null for NaN and for what isn't a number."""
    x = _column(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def flag(condition: Column) -> Column:
    """1 if the condition holds, 0 if it doesn't or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def known(c: Column | str) -> Column:
    """Text, null if it is one of the tokens for a missing value."""
    c = _column(c)
    return F.when(~c.isin(*NA_TOKENS), c)


def row_values(*columns: Column) -> Column:
    """The values of a row that aren't null, as an array."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def row_mean(*columns: Column) -> Column:
    a = row_values(*columns)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a))


def row_variance(*columns: Column) -> Column:
    """Population variance of a row's values, null without any."""
    a, mean = row_values(*columns), row_mean(*columns)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / F.size(a))


def row_count(*columns: Column) -> Column:
    return F.size(row_values(*columns))
