"""Repair of a conversation's structure: the cheapest edits that make its roles follow a grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import SPACE, written

#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
FAULTS = ("", "blank", "duplicate", "truncated")


# ---------------------------------------------------------------- three machines, composed as they are needed


class Arc(NamedTuple):
    """An arc of the edit transducer: what it reads (None: nothing), the role it writes ("": none) and its weight (cost, label)."""

    write: str
    role: str | None
    cost: int
    label: str


def edit_arcs(symbol: tuple[str, str]) -> list[Arc]:
    """The edit transducer's arcs that read a row, given as (role's initial, fault)."""
    initial, fault = symbol
    delete = Arc("", None, DELETE, "D")
    if fault in ("blank", "duplicate"):
        return [delete]
    more = TRUNCATED if fault == "truncated" else 0
    return [delete, Arc(initial, None, more, "K"), *(Arc(r, ROLES[r], REROLE + more, "R") for r in ROLES)]


#: Its arcs that read nothing, and how many may follow one another: more than two return to a role written before at a cost.
INSERTS = [Arc(r, ROLES[r], INSERT, "I") for r in ROLES]
MOST_INSERTS = 2

#: The role grammar (s?(ua)+)? as an acceptor: state to role's initial to state. It begins in 0.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)


class Path(NamedTuple):
    """The best path to a state: cost, rank of its labels among those of the states of the row before, labels since.

    steps are its labels in reverse as nested pairs; seen is what was gathered along it.
    """

    cost: int
    rank: int
    since: str
    steps: tuple | None
    seen: object


class Repair:
    """Shortest paths through (input, edits, grammar) over weights (cost, labels), row by row.

    A state of the composition is (row, inserts at this row, grammar state); it is made when a path
    reaches it. Inserts of a row come first, fewest first, then the arcs that read the row: that is a
    topological order, as inserts are counted. Of the paths to a state the one with the least cost
    stays, among equal costs the one whose labels come first. Labels aren't compared at length: paths
    that have read the same rows are ranked once a row, and neither's labels begin the other's, because
    each ends with an arc that reads; so rank and the labels since decide. What is held follows from the
    grammar's states, beside the labels themselves. gather(seen, role, row) follows what is written;
    row is None for an insert, role None for a row kept as it is.
    """

    def __init__(self, start, gather):
        self.gather = gather
        self.layer: dict[int, Path] = {0: Path(0, 0, "", None, start)}
        self.arcs: dict[tuple[str, str], list[Arc]] = {}

    def _with_inserts(self) -> list[tuple[int, Path]]:
        """States that inserts reach from the layer, with the layer's own; of each the best path only."""
        best, frontier = dict(self.layer), self.layer
        for _ in range(MOST_INSERTS):
            reached: dict[int, Path] = {}
            for state, path in frontier.items():
                for arc in INSERTS:
                    to = GRAMMAR[state].get(arc.write)
                    if to is not None and (to not in best or best[to].cost > path.cost + arc.cost):
                        new = path._replace(cost=path.cost + arc.cost, since=path.since + arc.label, steps=(path.steps, arc.label), seen=(path.seen, arc.role))
                        if to not in reached or new[:3] < reached[to][:3]:
                            reached[to] = new
            best.update(reached)
            frontier = reached
        return list(best.items())

    def _gathered(self, path: Path):
        """What the path has seen, inserts included, which are only noted until a path with them stays."""
        roles, seen = [], path.seen
        for _ in range(path.since.count("I")):
            seen, role = seen
            roles.append(role)
        for role in reversed(roles):
            seen = self.gather(seen, role, None)
        return seen

    def read(self, symbol: tuple[str, str], row) -> None:
        """The next row, its symbol (role's initial, fault) and what gather needs of it."""
        arcs = self.arcs.get(symbol) or self.arcs.setdefault(symbol, edit_arcs(symbol))
        best: dict[int, tuple] = {}
        for state, path in self._with_inserts():
            for arc in arcs:
                to = state if arc.label == "D" else GRAMMAR[state].get(arc.write)
                if to is not None:
                    key = (path.cost + arc.cost, path.rank, path.since + arc.label)
                    if to not in best or key < best[to][0]:
                        best[to] = (key, path, arc)
        ranks = {key: i for i, key in enumerate(sorted(key[1:] for key, _, _ in best.values()))}
        layer = {}
        for to, (key, path, arc) in best.items():
            seen = self._gathered(path)
            if arc.label != "D":
                seen = self.gather(seen, arc.role, row)
            layer[to] = Path(key[0], ranks[key[1:]], "", (path.steps, arc.label), seen)
        self.layer = layer

    def best(self) -> tuple[int, str, object]:
        """Cost, labels and what was gathered along the best path that the grammar accepts."""
        path = min((p for state, p in self._with_inserts() if state in FINAL), key=lambda p: p[:3])
        labels, steps = [], path.steps
        while steps:
            steps, label = steps
            labels.append(label)
        return path.cost, "".join(reversed(labels)), self._gathered(path)


class Joined:
    """The sha256 of lines joined by line ends, and whether there is one yet; copied where paths part."""

    __slots__ = ("digest", "some")

    def __init__(self, digest=None, some: bool = False):
        self.digest, self.some = digest or hashlib.sha256(), some

    def add(self, role: str | None, row: tuple[str, str] | None) -> "Joined":
        out = Joined(self.digest.copy(), True)
        text = f"{role or row[0]}:{row[1] if row else ''}"
        out.digest.update((f"\n{text}" if self.some else text).encode("utf-8", "surrogatepass"))
        return out


def repaired(rows: Iterator[tuple[str, str, str]]) -> tuple[int, str, str]:
    """Cost, audit and digest of the repaired conversation of rows (role, text, fault) in order."""
    machine = Repair(Joined(), Joined.add)
    for role, text, fault in rows:
        machine.read((role[:1], fault), (role, text))
    cost, audit, joined = machine.best()
    return cost, audit, joined.digest.hexdigest()


# ---------------------------------------------------------------- tables


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of turns, damaged by crc32(`conv_id:turn`) % 20 as follows; null values count as a blank.

    0 marks the row as gone, 1 empties its text, 2 takes [.!?] out of it, 3 repeats the row, 4 makes
    user its role; others stay as they are.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        "conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when((kind == 1) | (kind == 0), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, gone) with fault, dealt by conversation and in order within each task.

    A row's first fault counts: blank (no character but white space), duplicate (role and text of an
    earlier row), truncated (its last such character isn't one of . ! ?). Rows that are gone have none.
    The order is by turn, null first; of equal turns by role and text.
    """
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")
    solid = rf"[^{SPACE}]"
    fault = (
        F.when(F.col("gone"), "").when(~F.col("text").rlike(solid), "blank").when(F.col("nth") > 1, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated").otherwise("")
    )
    rows = turns.repartition("conv_id").withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault)
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text", "nth").drop("nth")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """One conversation as its rows arrive."""

    def __init__(self, key):
        self.key = key
        self.machine = Repair(Joined(), Joined.add)
        self.faults = dict.fromkeys(FAULTS, 0)
        self.turns, self.low, self.high, self.at = 0, None, None, None
        self.illegal, self.before = 0, None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.at:
            self.low = turn if self.low is None else self.low
            self.high = self.at = turn
            self.turns += 1
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = role[:1]
        self.machine.read((role[:1], fault), (role, text))

    def row(self) -> tuple:
        cost, audit, joined = self.machine.best()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.key, gaps, *(self.faults[f] for f in FAULTS[1:]), self.illegal, cost, audit, joined.digest.hexdigest()


def repair_rows(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text, gone, whole numbers of turns): its faults and its repair.

    Columns: gaps (turns missing between the first and the last), counts of faults, illegal (adjacent
    rows whose initials aren't su, ua or au), cost, audit (edits' initials: K keep, R rerole, D delete,
    I insert; of equally cheap ones the first in order) and repaired_sha256. Rows that are gone only tell that their
    conversation was there; one without other rows has zeros, an empty audit and the empty text's digest.
    A null conv_id is a conversation. A role that is empty or begins with another letter than s, u or a
    must be changed. Conversations are streamed: a task holds the paths of one at a time and no rows.
    """

    def run(batches):
        import pyarrow as pa

        at, out, kind = None, [], None

        def emitted():
            arrays = [pa.array(x, k) for x, k in zip(zip(*out), (kind, *[pa.int64()] * 6, pa.string(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *(x.split()[0] for x in RESULT.split(", "))])

        for batch in batches:
            kind = batch.column(0).type
            for key, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at.key != key:
                    if at is not None:
                        out.append(at.row())
                    at = _Conversation(key)
                if not gone:
                    at.add(turn, role, text, fault)
            if len(out) >= 1000:
                yield emitted()
        if at is not None:
            out.append(at.row())
            yield emitted()

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = with_faults(turns).select("conv_id", "turn", "role", "text", "gone", "fault")
    return rows.mapInArrow(run, f"conv_id {kind}, {RESULT}")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Faults and repair of every conversation after its turns were damaged; see damaged, with_faults and repair_rows.

    Other columns are left out, repeated rows are rows, an empty table gives an empty one.
    """
    return written(repair_rows(damaged(turns)), "repairs", 2000)


#: crc32 of a text of ASCII characters in SQL: a table of 256 numbers made by the polynomial, then a step a character.
CRC_TABLE_SQL = """
    crc_table AS (
        SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) AS x(i)
    )"""
CRC_SQL = "xor(4294967295, list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"

REPAIR_SQL = rf"""
    WITH RECURSIVE {CRC_TABLE_SQL.strip()}, turns AS (
        SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {CRC_SQL.format("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
        FROM conversations, crc_table
    ), damaged AS (
        SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM turns, range(2) AS x(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
    ), ordered AS (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
    ), faulty AS (
        SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
            CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
        FROM ordered
    ), inserted(g, h, k, lines) AS (
        VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, 'user:'), (1, 2, 1, 'user:'), (3, 2, 1, 'user:'), (2, 3, 1, 'assistant:'),
            (0, 3, 2, 'user:' || chr(10) || 'assistant:'), (1, 3, 2, 'user:' || chr(10) || 'assistant:')
    ), grammar(h, letter, state) AS (
        VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
    ), edits AS (
        SELECT c, i, h, h AS state, 'D' AS label, 2 AS cost, NULL AS line FROM faulty, (SELECT DISTINCT unnest([0, 1, 2, 3]) AS h)
        UNION ALL
        SELECT c, i, h, state, 'K', CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, role || ':' || text FROM faulty JOIN grammar ON initial = letter WHERE fault IN ('', 'truncated')
        UNION ALL
        SELECT c, i, h, state, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, CASE letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
        FROM faulty, grammar WHERE letter <> 's' AND fault IN ('', 'truncated')
    ), paths AS (
        SELECT DISTINCT c, 0::BIGINT AS i, 0 AS g, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM turns
        UNION ALL
        SELECT p.c, p.i + 1, e.state, min({{'cost': (best.cost + 5 * n.k + e.cost)::BIGINT, 'audit': best.audit || repeat('I', n.k) || e.label,
            'lines': best.lines || CASE WHEN n.k > 0 THEN [n.lines] ELSE []::VARCHAR[] END || CASE WHEN e.line IS NOT NULL THEN [e.line] ELSE []::VARCHAR[] END}})
        FROM paths p JOIN inserted n ON p.g = n.g JOIN edits e ON e.c = p.c AND e.i = p.i + 1 AND e.h = n.h
        GROUP BY p.c, p.i, e.state
    ), ended AS (
        SELECT p.c, min({{'cost': best.cost + 5 * n.k, 'audit': best.audit || repeat('I', n.k), 'lines': best.lines || CASE WHEN n.k > 0 THEN [n.lines] ELSE []::VARCHAR[] END}}) AS best
        FROM paths p JOIN inserted n ON p.g = n.g WHERE n.h IN (0, 3) AND p.i = (SELECT count(*) FROM faulty f WHERE f.c = p.c) GROUP BY p.c
    ), counted AS (
        SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faulty GROUP BY c
    )
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
    FROM (SELECT DISTINCT c, conv_id FROM turns) JOIN ended USING (c) LEFT JOIN counted USING (c)"""
