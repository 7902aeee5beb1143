"""A Merkle tree over a dataset's rows: digests of rows, of groups and of the whole, and a proof for each row.

Nodes of a group are numbered in order; every ARITY neighbours (the last run may be shorter) have a
parent, until one is left. How many children a parent has follows from the group's size alone, so a task
that holds some of them knows when it holds all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.llm.conversations import CRC_SQL, CRC_TABLE_SQL

ARITY, SHIFT = 8, 3
#: Rows of a part, the most a task holds at once.
PART_ROWS = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a task reads: runs (where a group's rows begin in a part), tails (proofs of unresolved nodes, from above) and nodes.
RUN, TAIL, NODE = 0, 1, 2


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(*columns: str, replaced: dict[str, Column] | None = None) -> Column:
    """sha256 of the columns' values one after the other: a byte count, a colon and the value in UTF-8, or - for null."""
    values = ((replaced or {}).get(c, F.col(f"`{c}`")).cast("string") for c in columns)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


# ---------------------------------------------------------------- within a task


def width(size: int, level: int) -> int:
    """Nodes of a level of a group of size leaves."""
    return size + (1 << SHIFT * level) - 1 >> SHIFT * level


class Frontier:
    """Partial parents by (group, level, number), each with its children's digests by place.

    A parent whose arity is met is an event: its digest goes to its own parent, and so on up. What is
    left are partial parents whose other children lie in other tasks.
    """

    def __init__(self, keep: bool = False):
        self.partial: dict[tuple, dict[int, str]] = {}
        self.size: dict[object, int] = {}
        self.roots: dict[object, str] = {}
        #: Children of the parents made here, for proofs.
        self.runs: dict[tuple, list[str]] | None = {} if keep else None

    def add(self, group, size: int, level: int, number: int, digest: str) -> None:
        self.size[group] = size
        while True:
            nodes = width(size, level)
            if nodes == 1:
                self.roots[group] = digest
                return
            parent = number >> SHIFT
            key = (group, level + 1, parent)
            children = self.partial.setdefault(key, {})
            children[number & ARITY - 1] = digest
            if len(children) < min(ARITY, nodes - (parent << SHIFT)):
                return
            run = [children[i] for i in range(len(children))]
            del self.partial[key]
            if self.runs is not None:
                self.runs[key] = run
            level, number, digest = level + 1, parent, sha256("".join(run))

    def unresolved(self) -> Iterator[tuple]:
        """(group, size, level, number, digest) of the children of partial parents."""
        for (group, level, parent), children in self.partial.items():
            for place, digest in children.items():
                yield group, self.size[group], level - 1, parent << SHIFT | place, digest

    def path(self, group, level: int, number: int, tails: dict[tuple, str], known: dict[tuple, str]) -> str:
        """The way of a node to its group's root: for each level its place among its siblings and their digests."""
        if width(self.size[group], level) == 1:
            return ""
        key = (group, level + 1, number >> SHIFT)
        run = self.runs.get(key)
        if run is None:
            return tails[group, level, number]
        if key not in known:
            known[key] = self.path(group, level + 1, number >> SHIFT, tails, known)
        place = number & ARITY - 1
        return f"{place}{''.join(run[:place] + run[place + 1 :])};{known[key]}"


def siblings(path: str) -> str:
    return "".join(step[1:] for step in path.split(";"))


def folded(path: str, digest: str) -> str:
    """The digest at the end of a path that begins with digest."""
    for step in path.split(";")[:-1]:
        cut = 1 + 64 * int(step[0])
        digest = sha256(step[1:cut] + digest + step[cut:])
    return digest


class Part(NamedTuple):
    """What a task reads of one part; schema is the rows' Arrow schema."""

    schema: object
    part: int
    runs: dict
    tails: dict
    nodes: list


def _parts(batches) -> Iterator[Part]:
    """The parts of a task's rows (part, kind, grp, level, number, size, digest, more, top, origin, key), sorted by part and kind."""
    at = None
    for batch in batches:
        for part, kind, grp, level, number, size, digest, more, top, origin, key in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None or at.part != part:
                if at is not None:
                    yield at
                at = Part(batch.schema, part, {}, {}, [])
            if kind == RUN:
                at.runs[grp] = (number, size, digest, more, top)
            elif kind == TAIL:
                at.tails[grp, level, number] = more
            else:
                if at.runs:  # a leaf: its number is its seat, from where its group's rows begin
                    shift, size, *_ = at.runs[grp]
                    number += shift
                at.nodes.append((grp, size, level, number, digest, more, origin, key))
    if at is not None:
        yield at


# ---------------------------------------------------------------- tables


class Forest(NamedTuple):
    """Trees by group: leaves by part (part, grp, number: seats, digest, more, key), where groups begin in parts, the rounds' nodes, and how many parts the leaves and each round have."""

    leaves: DataFrame
    runs: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame
    parts: list[int]


def _rows(df: DataFrame, types: dict[str, str], kind: int, **values: Column) -> DataFrame:
    """df's columns of these names, or values, else null, as rows for a task."""
    columns = {"kind": F.lit(kind), **values}
    return df.select(*(columns.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()))


def _types(grp: str, key: str) -> dict[str, str]:
    return {"part": "int", "kind": "int", "grp": grp, "level": "int", "number": "long", "size": "long", "digest": "string", "more": "string", "top": "string", "origin": "int", "key": key}


def _dealt(types: dict[str, str], parts: int, *tables: DataFrame) -> DataFrame:
    """Rows by part; those of a single part, which is bounded, are read by one task without an exchange."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    dealt = rows.repartition(parts, "part") if parts > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions("part", "kind", "grp", "level", "number").select(*types)


def _ranged(rows: DataFrame, parts: int, *order) -> DataFrame:
    """rows in order, in so many parts."""
    return (rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)).sortWithinPartitions(*order)


def _resolved(rows: DataFrame, grp: str) -> DataFrame:
    """One round: nodes whose parents stay partial in their part, and roots (done)."""

    def run(batches):
        for part in _parts(batches):
            frontier, kind = Frontier(), part.schema.field
            for group, size, level, number, digest, *_ in part.nodes:
                frontier.add(group, size, level, number, digest)
            out = [(*x, part.part, False) for x in frontier.unresolved()]
            out += [(g, frontier.size[g], 0, 0, digest, part.part, True) for g, digest in frontier.roots.items()]
            names = {"grp": "grp", "size": "size", "level": "level", "number": "number", "digest": "digest", "origin": "part"}
            yield from _batches(out, {**{n: kind(c).type for n, c in names.items()}, "done": "bool"})

    return rows.mapInArrow(run, f"grp {grp}, size long, level int, number long, digest string, origin int, done boolean")


def _batches(rows: list[tuple], columns: dict[str, object], size: int = 10_000):
    """Rows as Arrow batches of at most size rows; columns has their names and types."""
    import pyarrow as pa

    for a in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[a : a + size]), columns.values())], names=list(columns))


def forest(leaves: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> Forest:
    """The trees of leaves (grp, digest, more, key and the columns of order), a group each, in the order given.

    Leaves are dealt by ranges of (group, order, a number that tells equal rows apart), so a group with
    most rows has parts as even as others. A round resolves what lies within a part and leaves at most
    14 nodes a level and group at a part's edges; these are dealt to at most a fourth of the parts for the
    next round, until nothing is unresolved. Only counts of rows come to the driver.
    """
    grp, key = (leaves.schema[c].dataType.simpleString() for c in ("grp", "key"))
    types = _types(grp, key)
    numbered = written(leaves.withColumn("_nth", F.monotonically_increasing_id()), "leaves")
    parts = [max(1, -(-numbered.count() // part_rows))]
    ranged = _ranged(numbered, parts[0], "grp", *order, "_nth")
    seats = ranged.select("grp", "digest", "more", "key", F.monotonically_increasing_id().alias("number"))
    seats = written(seats.withColumn("part", F.shiftright("number", 33).cast("int")), "seats")
    counts = seats.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(counts.select("part", "grp", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("number"), F.sum("n").over(group).alias("size")), "runs")
    nodes = _resolved(_dealt(types, parts[0], _rows(runs, types, RUN), _rows(seats, types, NODE, level=F.lit(0))), grp)
    rounds, roots = [], None
    while True:
        found = written(nodes, "nodes")
        done = found.where("done").select("grp", "size", "digest")
        roots = done if roots is None else roots.unionByName(done)
        left = found.where("not done").count()
        if not left:
            return Forest(seats, runs, rounds, roots, parts)
        parts.append(max(1, min(-(-left // part_rows), parts[-1] // 4)))
        position = F.expr(f"number * CAST(power({ARITY}, level) AS BIGINT)")
        ranged = _ranged(found.where("not done").drop("done"), parts[-1], "grp", position, "level").withColumn("part", F.spark_partition_id())
        rounds.append(written(ranged, "unresolved"))
        nodes = _resolved(_dealt(types, parts[-1], _rows(rounds[-1], types, NODE)), grp)


def _tails(rows: DataFrame, grp: str) -> DataFrame:
    """The paths of a round's nodes, for the parts that they came from."""

    def run(batches):
        for part in _parts(batches):
            frontier, known, out, kind = Frontier(keep=True), {}, [], part.schema.field
            for group, size, level, number, digest, *_ in part.nodes:
                frontier.add(group, size, level, number, digest)
            for group, _, level, number, _, _, origin, _ in part.nodes:
                out.append((origin, group, level, number, frontier.path(group, level, number, part.tails, known)))
            yield from _batches(out, {n: kind(n).type for n in ("part", "grp", "level", "number", "more")}, 1000)

    return rows.mapInArrow(run, f"part int, grp {grp}, level int, number long, more string")


def leaf_rows(trees: Forest, above: DataFrame | None, fields: str, make) -> DataFrame:
    """A row for each leaf, with the columns of fields: make(key, digest, more, path, root), the root that above tells.

    above (grp, digest, more, top) tells of each group its root, the root's path above it and what that
    path ends with; without it a path ends at the group's root. Proofs go down the rounds: a round's
    nodes get the paths of its unresolved nodes from the round after it, joined by part.
    """
    grp, key = (trees.leaves.schema[c].dataType.simpleString() for c in ("grp", "key"))
    types, tails = _types(grp, key), None
    for nodes, parts in zip(reversed(trees.rounds), reversed(trees.parts)):
        rows = [_rows(nodes, types, NODE)] + ([_rows(tails, types, TAIL)] if tails is not None else [])
        tails = written(_tails(_dealt(types, parts, *rows), grp), "tails")
    runs = trees.runs
    if above is not None:
        runs = runs.alias("r").join(above.alias("a"), F.col("r.grp").eqNullSafe(F.col("a.grp")), "left").select("r.*", "a.digest", "a.more", "a.top")
    rows = [_rows(runs, types, RUN), _rows(trees.leaves, types, NODE, level=F.lit(0))]
    if tails is not None:
        rows.append(_rows(tails, types, TAIL))

    columns = dict(x.split() for x in fields.split(", "))

    def run(batches):
        for part in _parts(batches):
            frontier, known, kind = Frontier(keep=True), {}, part.schema.field
            for group, size, _, number, digest, *_ in part.nodes:
                frontier.add(group, size, 0, number, digest)
            for a in range(0, len(part.nodes), 2000):
                out = []
                for group, _, _, number, digest, more, _, name in part.nodes[a : a + 2000]:
                    _, _, subroot, upper, top = part.runs[group]
                    out.append((name, *make(digest, more, frontier.path(group, 0, number, part.tails, known) + (upper or ""), subroot, top)))
                yield from _batches(out, {"key": kind("key").type, **{c: "bool" if t == "boolean" else t for c, t in columns.items()}})

    return _dealt(types, trees.parts[0], *rows).mapInArrow(run, f"key {key}, {fields}")


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def _trees(docs: DataFrame, tampered: Column | None, part_rows: int) -> tuple[Forest, DataFrame]:
    """The trees of docs by lang, and of each lang the root, its path and the whole's root."""
    changed = F.when(tampered, row_digest(*LEAF, replaced={"text": F.translate("text", UPPER, LOWER)})) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), row_digest(*LEAF).alias("digest"), changed.alias("more"))
    trees = forest(leaves, ["key", "digest"], part_rows)
    subroots = trees.roots.select(F.lit(0).alias("grp"), F.col("grp").alias("key"), "digest", F.lit(None).cast("string").alias("more"))
    whole = forest(subroots, ["key"], part_rows)
    top = whole.roots.select("grp", "digest", F.lit(None).cast("string").alias("more"), F.col("digest").alias("top"))
    langs = leaf_rows(whole, top, "digest string, more string, top string", lambda digest, more, path, subroot, top: (digest, path, top))
    return trees, written(langs.withColumnRenamed("key", "grp"), "langs")


def manifest_paths(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, leaf, path and root of each row of docs; folded(path, leaf) is the root, siblings(path) what proves it."""
    trees, above = _trees(docs, None, part_rows)
    out = leaf_rows(trees, above, "leaf string, path string, root string", lambda digest, more, path, subroot, top: (digest, path, top))
    return written(out.withColumnRenamed("key", "doc_id"), "paths", 1000)


def manifest(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The Merkle manifest of docs (doc_id, source, lang, n_chars, text), a row each, checked against tampered texts.

    Returns doc_id, leaf, subroot (of the row's lang), root, proof_sha256 (of the siblings on the way up),
    folded_root (what the row as it is now folds to) and verified. Rows whose crc32(doc_id) is divisible by three are
    tampered with: A-Z of their texts are lower-cased.

    Leaves of a lang are in order of doc_id, null first, of equal doc_id by digest; equal rows are leaves
    of their own. Null and empty texts differ. Langs are in order of their bytes, null first. Other
    columns are left out; an empty table gives an empty one.
    """
    trees, above = _trees(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, part_rows)

    def made(digest, more, path, subroot, top):
        end = folded(path, more or digest)
        return digest, subroot, top, sha256(siblings(path)), end, end == top

    fields = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return written(leaf_rows(trees, above, fields, made).withColumnRenamed("key", "doc_id"), "manifest")


_VALUES_SQL = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}) END" for c in LEAF[:-1]) + ", CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen({0}), ':', {0}) END"
_LEAF_SQL = f"sha256(concat({_VALUES_SQL}))"
_CRC_SQL = CRC_SQL.format("doc_id::VARCHAR")

MANIFEST_SQL = rf"""
    WITH RECURSIVE {CRC_TABLE_SQL.strip()}, digests AS (
        SELECT doc_id, lang, {_LEAF_SQL.format("text")} AS leaf,
            CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_LEAF_SQL.format(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
        FROM documents, crc_table
    ), leaves AS (
        SELECT *, row_number() OVER () AS id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
        FROM digests
    ), nodes AS (
        SELECT t, 0 AS level, i, leaf AS digest, n FROM leaves
        UNION ALL
        SELECT t, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY t, level, i // 8, n
    ), above AS (
        SELECT 0 AS level, t AS i, digest, count(*) OVER () AS n FROM nodes WHERE n = 1
        UNION ALL
        SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM above WHERE n > 1 GROUP BY level, i // 8, n
    ), runs AS (
        SELECT t, level, i // 8 AS parent, string_agg(digest, '' ORDER BY i) AS run FROM nodes WHERE n > 1 GROUP BY t, level, i // 8
    ), top_runs AS (
        SELECT level, i // 8 AS parent, string_agg(digest, '' ORDER BY i) AS run FROM above WHERE n > 1 GROUP BY level, i // 8
    ), steps AS (
        SELECT id, r.level, (l.i >> 3 * r.level) & 7 AS place, run FROM leaves l JOIN runs r ON r.t = l.t AND r.parent = l.i >> 3 * r.level + 3
        UNION ALL
        SELECT id, 100 + r.level, (l.t >> 3 * r.level) & 7, run FROM leaves l JOIN top_runs r ON r.parent = l.t >> 3 * r.level + 3
    ), paths AS (
        SELECT id, list(place || substr(run, 1, 64 * place) || substr(run, 64 * place + 65) ORDER BY level) AS path FROM steps GROUP BY id
    ), proved AS (
        SELECT l.*, s.digest AS subroot, w.digest AS root, coalesce(path, []) AS path FROM leaves l JOIN nodes s ON s.t = l.t AND s.n = 1 JOIN above w ON w.n = 1 LEFT JOIN paths p ON p.id = l.id
    ), checked AS (
        SELECT *, list_reduce([coalesce(tampered, leaf)] || path, lambda a, s: sha256(concat(substr(s, 2, 64 * substr(s, 1, 1)::INT), a, substr(s, 2 + 64 * substr(s, 1, 1)::INT)))) AS folded_root
        FROM proved
    )
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM checked"""
