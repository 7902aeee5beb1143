"""Places of regular-expression matches in whole texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, list[int]]]) -> DataFrame:
    """df with a column for each name: array of struct(start, end, g<n>...) of the leftmost matches of its
    pattern that don't overlap, in code points, end exclusive, g0 the match and g<n> its groups asked for.

    A text without a match costs one search; with some, one more splits it there and one takes them out,
    and groups are read from the matches, which must match again when they stand alone. The starts are sums of the lengths before, taken in two
    levels (blocks of about the square root of their number), so many matches don't cost their square.
    """
    hits, pieces, lengths = ({n: f"_{k}_{n}" for n in patterns} for k in ("hits", "pieces", "lengths"))
    found = df.withColumns({f"_any_{n}": F.col(text).rlike(p) for n, (p, _) in patterns.items()})
    columns = {pieces[n]: F.when(F.col(f"_any_{n}"), F.split(text, p, -1)) for n, (p, _) in patterns.items()}
    for n, (p, _) in patterns.items():
        columns[hits[n]] = F.when(F.col(f"_any_{n}"), F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    found = found.withColumns(columns)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x)

    def length(n: str) -> Column:
        return F.transform(hits[n], lambda h, i: (F.length(F.get(pieces[n], i)) + F.length(h)).cast("long"))

    def sums(n: str) -> Column:
        side = F.col(f"_side_{n}")
        return F.transform(F.sequence(F.lit(0), side), lambda b: total(F.slice(lengths[n], b * side + 1, side)))

    def before(n: str) -> Column:
        return F.transform(f"_sums_{n}", lambda _, b: total(F.slice(f"_sums_{n}", F.lit(1), b)))

    found = found.withColumns({lengths[n]: length(n) for n in patterns})
    found = found.withColumns({f"_side_{n}": F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths[n]))).cast("int")) for n in patterns})
    found = found.withColumns({f"_sums_{n}": sums(n) for n in patterns})
    found = found.withColumns({f"_before_{n}": before(n) for n in patterns})

    def span(n: str, p: str, groups: list[int]) -> Column:
        def one(h, i):
            block = F.floor(i / F.col(f"_side_{n}")).cast("int")
            start = F.get(f"_before_{n}", block) + total(F.slice(lengths[n], block * F.col(f"_side_{n}") + 1, i % F.col(f"_side_{n}"))) + F.length(F.get(pieces[n], i))
            fields = [start.alias("start"), (start + F.length(h)).alias("end"), h.alias("g0")]
            return F.struct(*fields, *(F.regexp_extract(h, p, g).alias(f"g{g}") for g in groups if g))

        return F.transform(hits[n], one)

    kinds = {n: f"array<struct<start:bigint,end:bigint,g0:string{''.join(f',g{g}:string' for g in groups if g)}>>" for n, (_, groups) in patterns.items()}
    found = found.withColumns({n: F.coalesce(span(n, p, groups), F.array().cast(kinds[n])) for n, (p, groups) in patterns.items()})
    return found.drop(*[c for c in found.columns if c.startswith("_") and c not in df.columns])


def tagged(matches: Column, kind: str, rank: int) -> Column:
    """Spans as struct(start, rank, kind, end), which sort by start, then kind."""
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans), 256)
