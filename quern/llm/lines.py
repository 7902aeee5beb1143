"""Removal of repeated line runs by a suffix array over line identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import clean_text, forget, release_exchanges, text_bytes, written

LEAST_WORDS = 50
#: Lines of a stretch that is compared whole.
SHORT = 64


def _line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line (number), key (128-bit fingerprint of the line), words of each line with a word."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for number, line in enumerate(text.split(b"\n")):
                    if words := len(line.split()):
                        rows.append((doc, number, xxhash.xxh3_128_digest(line), words))
            if rows:
                doc, number, key, words = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, batch.column(0).type), pa.array(number, pa.int32()), pa.array(key, pa.binary()), pa.array(words, pa.int32())],
                    names=["doc_id", "line", "key", "words"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text()).mapInArrow(run, f"doc_id {kind}, line int, key binary, words int")


def dense_ranks(df: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, int]:
    """df in the order of columns, with its rows' numbers from 1 on as name, and how many there are.

    Ranges are dealt to tasks and sorted there; monotonically_increasing_id holds a row's task and its
    place in it, and the tasks' sizes, a row a task, give the numbers before.
    """
    ordered = written(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    first, rows = 1, []
    for p, n in sizes:
        rows.append((p, first))
        first += n
    starts = df.sparkSession.createDataFrame(rows, "_part long, _first long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_first") + place).drop("_part", "_first", "_at")
    return numbered, first - 1


def live_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, line, key, words, pos, at, left: the lines that may belong to a repeated run.

    A run of lines can occur twice only if each of its lines does, so stretches of consecutive lines
    (with a word) that all occur elsewhere too are kept, if they have least_words words together. pos
    numbers them by doc_id, then line; at is a line's place in its stretch, left how many lines the
    stretch has from it on.
    """
    lines = written(_line_rows(docs.where("doc_id is not null")), "lines", 500)
    twice = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    repeated = lines.join(written(twice, "repeated"), "key").groupBy("doc_id", "line").agg(F.min(F.struct("key", "words")).alias("x"))
    repeated = written(repeated.select("doc_id", "line", "x.*"), "repeated_lines")
    enough = repeated.groupBy("doc_id").agg(F.sum("words").alias("total")).where(F.col("total") >= least_words).select("doc_id")
    by_doc = Window.partitionBy("doc_id").orderBy("line")
    numbered = lines.select("doc_id", "line").join(enough, "doc_id", "left_semi").distinct()
    numbered = numbered.withColumn("nth", F.row_number().over(by_doc))
    stretch = numbered.join(repeated, ["doc_id", "line"]).withColumn("run", F.col("nth") - F.row_number().over(by_doc))
    by_run = Window.partitionBy("doc_id", "run")
    stretch = stretch.withColumn("total", F.sum("words").over(by_run)).where(F.col("total") >= least_words)
    stretch = stretch.withColumns({"at": F.row_number().over(by_run.orderBy("line")) - 1, "n": F.count("*").over(by_run)})
    stretch = stretch.select("doc_id", "line", "key", "words", F.col("at").cast("long").alias("at"), (F.col("n") - F.col("at")).alias("left"))
    live = written(dense_ranks(stretch, ["doc_id", "line"], "pos")[0], "live")
    forget(lines, repeated)
    return live


def _in_stretch(function: str, column: str, lines: int):
    """lag or lead of a column by so many lines of a stretch, null beyond its ends."""
    return getattr(F, function)(column, lines).over(Window.partitionBy("first").orderBy("pos"))


def prefix_doubling(ids: DataFrame) -> list[DataFrame]:
    """pos, left, first, rank of every suffix of the stretches by its first 1, 2, 4, ... lines, from ids (the same, rank of the line itself).

    Round k ranks the pairs of ranks of pos and of pos + 2^k (0 behind the stretch's end), which orders
    suffixes by their first 2^(k+1) lines; it ends when no rank is split any more, so suffixes of equal
    rank in the last table are equal. Equal pairs are made one row before they are sorted, so a line
    that all documents share is one row there too.
    """
    levels, known, step = [ids], ids.select("rank").distinct().count(), 1
    longest = ids.agg(F.max("left")).first()[0] or 0
    while step < longest:
        pairs = written(levels[-1].withColumn("next", F.coalesce(_in_stretch("lead", "rank", step), F.lit(0))), "pairs")
        ranks, count = dense_ranks(pairs.select("rank", "next").distinct(), ["rank", "next"], "fresh")
        if count == known:
            break
        levels.append(written(pairs.join(ranks, ["rank", "next"]).select("pos", "left", "first", F.col("fresh").alias("rank")), "suffixes"))
        forget(pairs)
        known, step = count, 2 * step
    release_exchanges(ids.sparkSession)
    return levels


def _compared_in_short(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """sa, lcp of pairs of suffixes of short stretches: the stretches' lines beside one another."""
    short = ids.where(f"left + pos - first <= {SHORT}").groupBy("first").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("x"))
    short = written(short.select("first", F.col("x.rank").alias("ranks")), "stretches")
    for x in "ab":
        pairs = pairs.join(short.select(F.col("first").alias(f"first_{x}"), F.col("ranks").alias(f"ranks_{x}")), f"first_{x}")
    at = lambda x, k: F.get(f"ranks_{x}", (F.col(x) - F.col(f"first_{x}")).cast("int") + k)
    n = F.least("left_a", "left_b").cast("int")
    differs = F.array_position(F.transform(F.sequence(F.lit(0), n - 1), lambda k: at("a", k) == at("b", k)), False)
    return pairs.select("sa", F.when(differs > 0, differs - 1).otherwise(n).cast("long").alias("lcp"))


def _compared_by_levels(active: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """sa, lcp of pairs of suffixes of any stretches: the highest level at which they have the same rank, then on by that many
    lines, and so on. A round of look-ups for each bit of the result, each row a few numbers whatever a stretch's length."""
    firsts = active.select(F.explode(F.array("first_a", "first_b")).alias("first")).distinct()
    ranks = [t.join(firsts, "first", "left_semi").select("pos", F.struct(F.lit(k).alias("k"), "rank").alias("x")) for k, t in enumerate(levels)]
    ranks = reduce(DataFrame.union, ranks).groupBy("pos").agg(F.sort_array(F.collect_list("x")).alias("x")).select("pos", F.col("x.rank").alias("ranks"))
    ranks, top = written(ranks, "all_ranks"), len(levels) - 1
    active = active.select("sa", "a", "b", "left_a", "left_b", F.lit(0).cast("long").alias("off"), F.lit(top).alias("below"))
    done = None
    while True:
        for x in "ab":
            place = ranks.select((F.col("pos")).alias(f"at_{x}"), F.col("ranks").alias(f"ranks_{x}"))
            active = active.withColumn(f"at_{x}", F.col(x) + F.col("off")).join(place, f"at_{x}")
        same = F.filter(F.sequence(F.lit(0), F.col("below")), lambda k: F.get("ranks_a", k) == F.get("ranks_b", k))
        active = active.withColumn("k", F.coalesce(F.array_max(same), F.lit(-1)))
        rest = F.least(F.col("left_a"), F.col("left_b")) - F.col("off")
        gain = F.when(F.col("k") < 0, F.lit(0)).when(F.col("k") == top, rest).otherwise(F.least(F.pow(F.lit(2.0), F.col("k")).cast("long"), rest))
        active = active.withColumns({"off": F.col("off") + gain, "over": (F.col("k") <= 0) | (F.col("k") == top) | (gain == rest)})
        active = written(active.select("sa", "a", "b", "left_a", "left_b", "off", "over", F.greatest(F.col("k") - 1, F.lit(0)).alias("below")), "compared")
        ended = active.where("over").select("sa", F.col("off").alias("lcp"))
        done = ended if done is None else done.union(ended)
        active = active.where("not over").drop("over")
        if active.isEmpty():
            return done


def common_prefixes(order: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """sa, lcp: how many lines the suffixes sa - 1 and sa have in common.

    order: sa, pos, rank (of the last level) of all suffixes; levels: see prefix_doubling. Suffixes of
    equal rank are equal. If the same line stands before both suffixes of a pair, the suffixes one line
    earlier are neighbours too and have one line more in common; so lines are compared only where
    the lines before differ, and the other pairs count down from there. Stretches of up to SHORT lines
    are compared whole, longer ones by the levels, so that no long stretch is copied for each neighbour.
    """
    lines = levels[0].select("pos", "left", "first", _in_stretch("lag", "rank", 1).alias("before"))
    there = written(order.join(lines, "pos"), "suffix_order")
    above = there.select((F.col("sa") + 1).alias("sa"), *(F.col(c).alias(f"{n}_a") for c, n in (("pos", "pos"), ("left", "left"), ("first", "first"), ("before", "before"), ("rank", "rank"))))
    pairs = there.join(above, "sa").select(
        "sa", F.col("pos").alias("b"), F.col("left").alias("left_b"), F.col("first").alias("first_b"), F.col("pos_a").alias("a"), "left_a", "first_a",
        (~F.coalesce(F.col("before") == F.col("before_a"), F.lit(False))).alias("new"), (F.col("rank") == F.col("rank_a")).alias("equal"),
    )
    pairs = written(pairs, "neighbours")
    active = pairs.where("new and not equal").drop("new", "equal")
    is_short = " and ".join(f"left_{x} + {x} - first_{x} <= {SHORT}" for x in "ab")
    done, long = _compared_in_short(active.where(is_short), levels[0]), active.where(f"not ({is_short})")
    if not long.isEmpty():
        done = done.union(_compared_by_levels(long, levels))
    counted = pairs.join(done, "sa", "left").withColumn("known", F.when(F.col("equal"), F.col("left_b")).otherwise(F.col("lcp")))
    last = F.last(F.when(F.col("known").isNotNull(), F.struct("b", "known")), ignorenulls=True).over(Window.partitionBy("first_b").orderBy("b"))
    return counted.withColumn("from", last).select("sa", (F.col("from.known") - (F.col("b") - F.col("from.b"))).alias("lcp"))


def _narrowed(entries) -> list[tuple[int, int]]:
    """Of (common prefix, pos) those that no other beats in both: longer prefixes first, pos falling."""
    out: list[tuple[int, int]] = []
    for c, pos in sorted(entries, key=lambda e: (-e[0], e[1])):
        if c > 0 and (not out or pos < out[-1][1]):
            out.append((c, pos))
    return out


def scan(pos, joins, carry) -> list[int]:
    """For each suffix the longest prefix in common with one before it here (or in carry) that is earlier in the text.

    pos: the suffixes' places in the text, in the order of the scan; joins[i]: lines in common of i - 1
    and i (of the first: not used). carry: (common prefix with the first suffix, pos) of what lies before.
    An interval of the suffix array whose suffixes share a prefix ends where joins falls below it: the
    stack holds the open ones, each with the first place in the text that it has.
    """
    out, stack, floor = [], [], None
    for i, p in enumerate(pos):
        reach = joins[i] if i else 0
        floor = None if not i else reach if floor is None else min(floor, reach)
        while stack and stack[-1][0] > p:
            reach = min(reach, stack.pop()[1])
        best = reach if stack else 0
        stack.append((p, reach))
        for c, q in carry:
            c = c if floor is None else min(c, floor)
            if c <= best:
                break
            if q < p:
                best = c
                break
        out.append(best)
    return out


def _after(held, least: int, entries) -> list[tuple[int, int]]:
    """What is held behind a chunk: what was held before it, as far as its least common prefix lets through, and its own entries."""
    return _narrowed([*((min(c, least), q) for c, q in held), *entries])


def carried(sums: DataFrame, fan: int = 256) -> DataFrame:
    """chunk, side, held: for each chunk what those before it (side 0) or behind it (side 1) hand on, from the chunks' summaries
    (chunk, side, least, entries).

    A scan by a tree: groups of fan chunks are summed up in tasks, their sums are scanned the same way,
    and each group then goes through its chunks from what it was handed. No task and no driver holds
    more than fan summaries.
    """

    def ordered(pdf):
        return pdf.sort_values("chunk", ascending=not pdf["side"].iloc[0])

    def through(pdf, held):
        import pandas as pd

        rows = []
        for r in ordered(pdf).itertuples():
            rows.append((r.chunk, r.side, [list(e) for e in held]))
            held = _after(held, r.least, [tuple(e) for e in r.entries])
        return pd.DataFrame(rows, columns=["chunk", "side", "held"]), held

    def summed(pdf):
        import pandas as pd

        held = through(pdf, [])[1]
        return pd.DataFrame([(pdf["above"].iloc[0], pdf["side"].iloc[0], int(pdf["least"].min()), [list(e) for e in held])], columns=["chunk", "side", "least", "entries"])

    schema = "chunk long, side int, held array<array<long>>"
    if sums.agg(F.max("chunk")).first()[0] in (None, *range(fan)):
        return sums.groupBy("side").applyInPandas(lambda pdf: through(pdf, [])[0], schema)
    grouped = sums.withColumn("above", F.floor(F.col("chunk") / fan))
    above = written(grouped.groupBy("above", "side").applyInPandas(summed, "chunk long, side int, least long, entries array<array<long>>"), "sums")
    handed = written(carried(above, fan).withColumnRenamed("chunk", "above"), "handed")

    def within(pdf, held):
        return through(pdf, [tuple(e) for e in held["held"].iloc[0]])[0]

    return grouped.groupBy("above", "side").cogroup(handed.groupBy("above", "side")).applyInPandas(within, schema)


def earlier_copies(table: DataFrame, chunk: int = 50_000, fan: int = 256) -> DataFrame:
    """pos, copied: how many lines from pos on also occur at an earlier place; rows with 1 or more.

    table: sa, pos, lcp (with the suffix before), next (with the suffix behind). The suffix array is
    scanned in chunks, once in either direction. What a chunk needs from those before it is, for each
    length of common prefix, the earliest place: few numbers a chunk, which a first pass gives and
    carried hands on; so no interval, however large, has to fit into one task.
    """
    import numpy as np

    table = written(table.withColumn("chunk", F.floor(F.col("sa") / chunk)), "suffix_array")

    def summary(pdf):
        import pandas as pd

        pdf = pdf.sort_values("sa")
        pos, lcp, behind = (pdf[c].to_numpy() for c in ("pos", "lcp", "next"))
        rows = []
        for side, joins, places in ((0, behind, pos), (1, lcp[::-1], pos[::-1])):
            reach = np.minimum.accumulate(joins[::-1])[::-1]
            rows.append((pdf["chunk"].iloc[0], side, int(joins.min()), [list(e) for e in _narrowed(zip(reach.tolist(), places.tolist()))]))
        return pd.DataFrame(rows, columns=["chunk", "side", "least", "entries"])

    sums = written(table.groupBy("chunk").applyInPandas(summary, "chunk long, side int, least long, entries array<array<long>>"), "sums")

    def copied(pdf, held):
        import pandas as pd

        pdf = pdf.sort_values("sa")
        carry = {r.side: [tuple(e) for e in r.held] for r in held.itertuples()}
        pos, lcp, behind = pdf["pos"].tolist(), pdf["lcp"].tolist(), pdf["next"].tolist()
        forth = scan(pos, lcp, carry.get(0, []))
        back = scan(pos[::-1], behind[::-1], carry.get(1, []))[::-1]
        best = np.maximum(forth, back)
        return pd.DataFrame({"pos": pdf["pos"].to_numpy()[best > 0], "copied": best[best > 0]})

    return table.groupBy("chunk").cogroup(written(carried(sums, fan), "carried").groupBy("chunk")).applyInPandas(copied, "pos long, copied long")


def copied_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, cuts: the ranges of lines (first, last) of each document that repeat earlier ones."""
    live = live_lines(docs, least_words)
    ids, _ = dense_ranks(live.select("key").distinct(), ["key"], "rank")
    ids = written(live.join(ids, "key").select("pos", "left", "rank", (F.col("pos") - F.col("at")).alias("first")), "ids")
    levels = prefix_doubling(ids.select("pos", "left", "first", "rank"))
    order = written(dense_ranks(levels[-1].select("rank", "pos"), ["rank", "pos"], "sa")[0].select("sa", "pos", "rank"), "order")
    shared = written(common_prefixes(order, levels), "common")
    table = order.join(shared, "sa", "left").join(shared.select((F.col("sa") - 1).alias("sa"), F.col("lcp").alias("next")), "sa", "left")
    copies = earlier_copies(table.select("sa", "pos", F.coalesce("lcp", F.lit(0)).alias("lcp"), F.coalesce("next", F.lit(0)).alias("next")))
    marked = live.join(copies, "pos", "left").select("doc_id", (F.col("pos") - F.col("at")).alias("first"), "at", "line", "words", F.coalesce("copied", F.lit(0)).alias("copied"))
    runs = marked.groupBy("doc_id", "first").agg(F.sort_array(F.collect_list(F.struct("at", "line", "words", "copied"))).alias("x"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            docs_, cuts = [], []
            for doc, x in zip(batch.column(0), batch.column(1)):
                line, words, copied = (np.asarray(x.values.field(k)) for k in (1, 2, 3))
                total = np.concatenate([[0], np.cumsum(words)])
                at = np.flatnonzero(copied > 0)
                at = at[total[at + copied[at]] - total[at] >= least_words]
                change = np.zeros(len(line) + 1, int)
                np.add.at(change, at, 1)
                np.add.at(change, at + copied[at], -1)
                gone = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
                starts, ends = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:]) - 1
                if len(starts):
                    docs_.append(doc)
                    cuts.append([{"first": int(a), "last": int(b)} for a, b in zip(line[starts], line[ends])])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([d.as_py() for d in docs_], batch.column(0).type), pa.array(cuts, kind)], names=["doc_id", "cuts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = runs.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, cuts array<struct<first:int,last:int>>")
    cuts = written(found.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("cuts"))).alias("cuts")), "cuts", 500)
    forget(live, ids, order, shared, *levels[1:])
    release_exchanges(docs.sparkSession)
    return cuts


def cut_texts(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """row (all columns of docs), text and removed (number of lines) after drop_repeated_lines."""
    cuts = copied_lines(docs, least_words).withColumnRenamed("doc_id", "of")
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(cuts.hint("merge"), F.col("row")["doc_id"] == F.col("of"), "left")
    text, lines, n = F.col("row")["text"], F.split(F.col("row")["text"], "\n"), F.size("cuts")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1)["last"] + 1)
    end = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get("cuts", i)["first"])
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, begin(i) + 1, F.greatest(end(i) - begin(i), F.lit(0))))
    removed = F.aggregate("cuts", F.lit(0), lambda total, c: total + c["last"] - c["first"] + 1)
    whole = F.col("cuts").isNull()
    return joined.select("row", F.when(whole, text).otherwise(F.array_join(F.flatten(kept), "\n")).alias("text"), F.when(whole, F.lit(0)).otherwise(removed).alias("removed"))


def drop_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the later copies of repeated line runs deleted, and lines_removed.

    A run is one or more consecutive lines (split at line feeds; lines without a word are passed over
    and don't break a run); it counts if it has least_words words. Each line that belongs to such a run
    whose lines also occur in order at an earlier place (smaller doc_id, then line) is deleted, with
    wordless lines inside. Lines are equal if their bytes are (128-bit fingerprints). Null and empty
    texts and rows without doc_id stay as they are. doc_id is meant to be unique: rows that repeat it
    count as one text and get the same cuts. A column named lines_removed is replaced, all others keep
    their values whatever they are called.
    """
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "lines_removed"]
    return cut_texts(docs, least_words).select(*columns, F.col("removed").alias("lines_removed"))


LINE_RUNS_SQL = r"""
    WITH a AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
    ), b AS (
        SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words FROM a
    ), t AS MATERIALIZED (
        SELECT doc_id, line, l, words, row_number() OVER d AS nth, sum(words) OVER d AS total FROM b WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY line)
    ), m AS (
        SELECT x.doc_id AS d, x.nth AS i, y.doc_id AS e, y.nth AS j FROM t x JOIN t y ON x.l = y.l AND (y.doc_id < x.doc_id OR (y.doc_id = x.doc_id AND y.nth < x.nth))
    ), g AS (
        SELECT *, i - row_number() OVER (PARTITION BY d, e, i - j ORDER BY i) AS run FROM m
    ), c AS (
        SELECT d, i, max(n) AS n FROM (SELECT d, i, count(*) OVER (PARTITION BY d, e, i - j, run ORDER BY i DESC) AS n FROM g) GROUP BY d, i
    ), k AS (
        SELECT d, x.line AS first, y.line AS last FROM c JOIN t x ON x.doc_id = d AND x.nth = i JOIN t y ON y.doc_id = d AND y.nth = i + n - 1 WHERE y.total - x.total + x.words >= 50
    ), z AS (
        SELECT b.doc_id, b.line, b.l, EXISTS (SELECT 1 FROM k WHERE d = b.doc_id AND b.line BETWEEN first AND last) AS gone FROM b WHERE b.doc_id IN (SELECT d FROM k)
    ), o AS (
        SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS kept, count(*) FILTER (WHERE gone)::INT AS n FROM z GROUP BY doc_id
    )
    SELECT documents.* REPLACE (CASE WHEN n > 0 THEN kept ELSE text END AS text), coalesce(n, 0)::INT AS lines_removed FROM documents LEFT JOIN o USING (doc_id)
"""
