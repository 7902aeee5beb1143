"""Places and running sums in an order, without a task that holds all rows of a group.

An order is cut into parts by a monotone function of its key: the first digits of a drawn md5, which
are even by construction, or the logarithm of a score. Windows run within a part; the totals of the
parts before it, a few thousand rows however long the table, give what stands before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.work import stored

#: Parts of a drawn order: three hexadecimal digits. Parts of a factor of two of a score.
DIGITS = 3
PARTS = 1024


def score_part(score: Column) -> Column:
    """A whole number that doesn't fall as the score grows: by its logarithm, in steps of a factor of 2 to the 1/1024.

    From one half to 1 it is the logarithm of what the score lacks to 1, so that probabilities near 1 are told
    apart as finely as those near 0; larger scores come after, negative ones are mirrored.
    """
    x = F.abs(score)
    size = F.when(x <= 0.5, F.log2(x)).when(x < 1, -F.log2(1 - x)).otherwise(F.log2(x) + 60)
    size = F.floor(size * PARTS) + F.lit(1100 * PARTS)
    return F.when(score > 0, size).when(score < 0, -size).otherwise(F.lit(0)).cast("long")


def with_before(rows: DataFrame, by: list[str], part: Column, order: list[Column], sums: list[str], descending: bool = False) -> DataFrame:
    """rows with before_<c>, the sum of each column c over the rows of the group that come earlier, and all_<c>, over all its rows.

    part must not fall (or, descending, not rise) along order, in which rows of a group don't tie. Null
    is a group of its own.
    """
    parted = rows.withColumn("_part", part)
    totals = parted.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    earlier = group.orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(b).alias(f"_b_{i}") for i, b in enumerate(by)), F.col("_part").alias("_p"),
        *(F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums), *(F.sum(f"_t_{c}").over(group).alias(f"all_{c}") for c in sums),
    )
    same = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{i}"))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parted.join(offsets, same)
    before = [(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"before_{c}") for c in sums]
    return joined.select(*rows.columns, *before, *(f"all_{c}" for c in sums))


def drawn_places(df: DataFrame, by: list[str], drawn: Column, key: Column | str) -> DataFrame:
    """df with place (from 1) in the order of drawn, an md5 in hexadecimal, then key, within its group, and group_size."""
    rows = df.withColumns({"_drawn": drawn, "_one": F.lit(1).cast("long")})
    part = F.conv(F.substring("_drawn", 1, DIGITS), 16, 10).cast("int")
    placed = with_before(rows, by, part, [F.col("_drawn"), F.col(key) if isinstance(key, str) else key], ["_one"])
    return placed.select(*df.columns, (F.col("before__one") + 1).alias("place"), F.col("all__one").alias("group_size"))


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """df with dense numbers from 0 on in the order of the columns, null first; among equal rows in any order.

    Rows are dealt by ranges of the order and stored with their seats in their range; the ranges' counts, a
    row a task, say where each begins. So no task holds more than a range, however many rows share the
    first column, and no window runs over rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("_seat", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_seat", 33)), "numbered")
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_seat").alias("_first"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_seat") + F.col("_shift")).cast("long").alias(name))
