"""Duplicates, deterministic sampling, splits and folds.

Every draw is an order by md5 of seed and id, so that it is the same whatever the partitioning and can
be repeated by any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordered import DIGITS, drawn_places, with_before


def draw(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in ids)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order, as one aggregate: what tasks keep before the exchange is a row a key."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def value_counts(df: DataFrame, column: Column, name: str = "value", top: int | None = None) -> DataFrame:
    counts = df.groupBy(column.alias(name)).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), name).limit(top) if top else counts


def sample_up_to(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """n rows without replacement, all if there are fewer."""
    return df.orderBy(draw(seed, key), key).limit(n)


def variant_split(df: DataFrame, strata: str, n_train: int, n_test: int, key: Column, seed: int = 42) -> DataFrame:
    """df with side (train, test, unused): in each stratum the first n_train rows of the drawn order, then n_test.

    A stratum that is too small is divided in the same ratio (half to even).
    """
    rows = drawn_places(df, [strata], draw(seed, key), key)
    size, place = F.col("group_size"), F.col("place")
    short = size < n_train + n_test
    train = F.when(short, F.bround(size * F.lit(float(n_train)) / F.lit(float(n_train + n_test)), 0)).otherwise(F.lit(float(n_train)))
    end = F.when(short, size.cast("double")).otherwise(F.lit(float(n_train + n_test)))
    side = F.when(place <= train, "train").when(place <= end, "test").otherwise("unused")
    return rows.select(*df.columns, side.alias("side"))


def group_split(df: DataFrame, group: str, positive: Column, test_share: float, targets: tuple[int, int], seed: int = 42) -> DataFrame:
    """group, n_p, n_b, in_test: whole groups go to the test side in a drawn order until it has enough of both classes.

    Enough is test_share of what there is, or of the target if that is smaller. The running sums only
    grow, so membership is a condition on the sums before a group, which parts of the drawn order give.
    """
    groups = df.groupBy(group).agg(F.count_if(positive).alias("n_p"), F.count_if(~positive).alias("n_b"))
    total = groups.agg(F.coalesce(F.sum("n_p"), F.lit(0)).alias("p"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("b")).first()
    need_p, need_b = (math.floor(test_share * min(n, t) + 0.5) for n, t in zip((total.p, total.b), targets))
    groups = groups.withColumn("_drawn", draw(seed, F.col(group)))
    part = F.conv(F.substring("_drawn", 1, DIGITS), 16, 10).cast("int")
    summed = with_before(groups, [], part, [F.col("_drawn"), F.col(group)], ["n_p", "n_b"])
    done = (F.col("before_n_p") >= need_p) & (F.col("before_n_b") >= need_b)
    return summed.select(group, "n_p", "n_b", (~done).alias("in_test"))


def stratified_folds(df: DataFrame, label: str, key: Column, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold (0 to k - 1), even within each label."""
    rows = drawn_places(df, [label], draw(seed, key), key)
    return rows.select(*df.columns, ((F.col("place") - 1) % k).cast("int").alias("fold"))


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, key: str | None = None, seed: int = 42) -> DataFrame:
    """group, fold: whole groups dealt so that sizes and labels are even over the folds.

    The groups are ordered by their positives, then by their others, then drawn, all falling, and
    dealt to and fro (0 to k - 1, k - 1 to 0), so each fold gets as many large groups as any. A table
    of one group has none to keep apart: with key, each of its rows is a group (key, fold).
    """
    counts = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("n_p"), F.count_if(F.col(label) == 0).alias("n_b"), F.lit(1).cast("long").alias("_one"))
    if key and counts.count() < 2:
        return group_folds(df.select(F.col(key), label), key, label, k, seed=seed)
    counts = counts.withColumn("_drawn", draw(seed, F.col(group)))
    part = F.struct("n_p", "n_b", F.substring("_drawn", 1, DIGITS))
    placed = with_before(counts, [], part, [F.desc("_drawn"), F.desc(group)], ["_one"], descending=True)
    place, turn = F.col("before__one") % k, F.floor(F.col("before__one") / k) % 2
    return placed.select(group, F.when(turn == 0, place).otherwise(k - 1 - place).cast("int").alias("fold"))


def deal_classes(classes: list[tuple[int, int, int]], k: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For each class (positives, others, groups) of groups alike the runs (groups, fold) in which they are dealt.

    The most uneven classes come first, equally uneven ones by turns. Each time the fold is chosen after which the folds' shares of
    positives and of others spread least (mean of their standard deviations), among equals the one with the fewest rows.
    Of a class with many groups a run takes an 8k-th of what is left, so the work follows the number of
    classes and the logarithm of their sizes; the last ones are dealt one by one.
    """
    total = [max(sum(c[i] * c[2] for c in classes), 1) for i in (0, 1)]
    load = [[0, 0] for _ in range(k)]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def spread(fold: int, add: tuple[int, int]) -> float:
        value = 0.0
        for i in (0, 1):
            shares = [(x[i] + (add[i] if f == fold else 0)) / total[i] for f, x in enumerate(load)]
            mean = sum(shares) / k
            value += math.sqrt(sum((v - mean) ** 2 for v in shares) / k)
        return value

    left = {(p, n): groups for p, n, groups in classes}
    for uneven in sorted({abs(p - n) for p, n in left}, reverse=True):
        level = sorted((c for c in left if abs(c[0] - c[1]) == uneven), key=lambda c: (-c[0] - c[1], c[0]))
        while level:
            for c in level:
                take = max(1, left[c] // (8 * k))
                fold = min(range(k), key=lambda f: (round(spread(f, (c[0] * take, c[1] * take)), 12), sum(load[f]), f))
                load[fold] = [load[fold][0] + c[0] * take, load[fold][1] + c[1] * take]
                out.setdefault(c, []).append((take, fold))
                left[c] -= take
            level = [c for c in level if left[c]]
    return out


def balanced_group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """group, fold: whole groups dealt so that the folds' shares of both labels spread least, large and uneven groups first.

    Groups with the same counts are alike, so only the classes of counts come to the driver (a few
    thousand pairs of numbers, whatever the groups), are dealt there (deal_classes), and the groups of a class
    take its runs in a drawn order. Rows without a label count for neither.
    """
    counts = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("n_p"), F.count_if(F.col(label) == 0).alias("n_b"))
    classes = [(r["n_p"], r["n_b"], r["m"]) for r in counts.groupBy("n_p", "n_b").agg(F.count("*").alias("m")).collect()]
    runs = []
    for (p, n), dealt in deal_classes(classes, k).items():
        first = 1
        for take, fold in dealt:
            runs.append((p, n, first, first + take, fold))
            first += take
    places = drawn_places(counts, ["n_p", "n_b"], draw(seed, F.col(group)), group)
    table = df.sparkSession.createDataFrame(runs, "n_p long, n_b long, _first long, _stop long, fold int")
    inside = (F.col("place") >= F.col("_first")) & (F.col("place") < F.col("_stop"))
    return places.join(F.broadcast(table), ["n_p", "n_b"]).where(inside).select(group, "fold")


def leave_one_out(df: DataFrame, key: str, most: int = 200) -> DataFrame:
    """df with fold: each row is a fold of its own, in the order of key. For tables of at most most rows, as every fold is a fit."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for a fit each, {most} at most")
    return df.withColumn("fold", (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))


def pseudo_group(key: Column, n: int = 20, prefix: str = "TRAIN_G", seed: int = 42) -> Column:
    """A drawn group for each key, as a name with two digits."""
    number = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") % n
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 2, "0"))


def hold_out(df: DataFrame, label: str, key: Column, share: float = 0.15, seed: int = 42) -> DataFrame:
    """df with held: a stratified share of the rows."""
    rows = drawn_places(df, [label], draw(seed, key), key)
    return rows.select(*df.columns, (F.col("place") <= F.ceil(F.col("group_size") * F.lit(share))).alias("held"))


def group_hold_out(df: DataFrame, group: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """The groups of the first share of the drawn order."""
    groups = df.select(group).distinct()
    n = math.ceil(share * groups.count())
    return groups.orderBy(draw(seed, F.col(group)), group).limit(n)


def without_rows_of(test: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """test without the rows that equal a row of train in all columns, null equal to null."""
    known = train.select(*(F.col(c).alias(f"_{c}") for c in columns)).distinct()
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return test.join(known, same, "left_anti")


def with_fallback(df: DataFrame, exact: DataFrame, keys: list[str], coarse: list[str], value: str) -> DataFrame:
    """df with value and method: exact's value by all keys, else the median of its values by the coarse keys."""
    precise = exact.groupBy(*keys).agg(F.min(value).alias("_precise"))
    medians = exact.groupBy(*coarse).agg(F.median(value).alias("_median"))
    joined = df.join(precise, keys, "left").join(medians, coarse, "left")
    method = F.when(F.col("_precise").isNotNull(), "precise").when(F.col("_median").isNotNull(), "coarse").otherwise("failed")
    return joined.withColumns({value: F.coalesce("_precise", "_median"), "method": method}).drop("_precise", "_median")


def left_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if either side repeats a key or a left row finds none."""
    for side in (left, right):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{keys} repeat")
    if not left.join(right, keys, "left_anti").isEmpty():
        raise ValueError(f"rows without a match on {keys}")
    return left.join(right, keys, "left")
