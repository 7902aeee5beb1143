"""Repaired conversations against all edits tried out, and against SQL on tables with nulls, ties and repeats."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from quern.llm import conversations as conv

EMPTY = hashlib.sha256(b"").hexdigest()


def brute_force(rows):
    """The least (cost, audit) of all edits whose roles match the grammar; deleting all rows costs two each."""
    best = None

    def go(i, out, cost, audit, inserts):
        nonlocal best
        if cost > min(2 * len(rows), best[0] if best else 99):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
        if inserts < 3:
            for r in ("user", "assistant"):
                go(i, [*out, (r, "")], cost + 5, audit + "I", inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, out, cost + 2, audit + "D", 0)
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                go(i + 1, [*out, (role, text)], cost + more, audit + "K", 0)
                for r in ("user", "assistant"):
                    go(i + 1, [*out, (r, text)], cost + 1 + more, audit + "R", 0)

    go(0, [], 0, "", 0)
    return best[0], best[1], hashlib.sha256("\n".join(f"{a}:{b}" for a, b in best[2]).encode()).hexdigest()


def test_cheapest_edits():
    draw = random.Random(3)
    for _ in range(500):
        rows = [(draw.choice(["user", "assistant", "system", "user", "assistant", " "]), f"t{draw.randrange(9)}", draw.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(draw.randrange(7))]
        assert conv.repaired(iter(rows)) == brute_force(rows)


def test_inserts_where_deleting_costs_more():
    """Truncated rows cost five each to keep, six to change, two to delete; blank ones must go."""
    rows = [("user", "a", ""), ("assistant", "b", ""), ("assistant", "c", ""), ("assistant", "d", "blank"), ("system", "e", "truncated")]
    assert conv.repaired(iter(rows))[:2] == brute_force(rows)[:2] == (6, "KDKDD")


def test_long_conversation_holds_paths_only():
    cost, audit, _ = conv.repaired((("user", "text", "") for _ in range(30_001)))
    assert (cost, len(audit), audit.count("R")) == (15_002, 30_001, 15_000)


def kinds(i, t):
    return zlib.crc32(f"{i}:{t}".encode()) % 20


@pytest.fixture(scope="module")
def turns():
    """Conversations with nulls, equal turns, repeats, odd roles, blanks of other kinds, and one that loses all rows."""
    gone = next(i for i in range(1000, 9000) if kinds(i, 0) == 0)
    draw, rows = random.Random(4), [(gone, 0, "user", "x."), (None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi.")]
    for i in range(40):
        for t in range(draw.randrange(1, 12)):
            role = draw.choice(["user", "assistant", "system", "tool", None, "user", "assistant"])
            text = draw.choice(["Yes.", "no", "Well!\n\t", "a\xa0", "\xa0", "\x0b\x0c", None, "Why? ", "été.", f"{t}."])
            rows += [(i, draw.choice([t, t, None, t + 1, t * 3]), role, text)] * draw.choice([1, 1, 1, 2])
    return gone, rows


def test_operator_equals_sql(spark, turns):
    gone, rows = turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    mine = df.selectExpr("*", "'mine' AS fault", "1 AS gone", "2 AS nth", "3 AS kind", "4 AS copy")
    got = {r.conv_id: r for r in conv.repair_conversations(mine).collect()}
    assert (got[gone].cost, got[gone].audit, got[gone].repaired_sha256, got[gone].gaps) == (0, "", EMPTY, 0)
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = c.execute(conv.REPAIR_SQL)
    names = [d[0] for d in cursor.description]
    expected = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert len(got) == len(expected) == len({r[0] for r in rows})
    for row in expected:
        assert got[row["conv_id"]].asDict() == row
    assert conv.repair_conversations(df.where("conv_id < 0")).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    from quern.llm.queries import QUERIES

    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cursor = c.execute(conv.REPAIR_SQL)
    names = [d[0] for d in cursor.description]
    got = sorted(tuple(r[n] for n in names) for r in QUERIES["op12_conversation_repair"](spark, folder).collect())
    assert got == sorted(cursor.fetchall())
