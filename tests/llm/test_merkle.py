"""Merkle manifests against a plain version and SQL: small parts, one group with most rows, many groups, ties, nulls."""

import hashlib
import zlib

import duckdb
import pytest

from quern.llm import merkle

LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found = {x: sorted((r[0] is not None, r[0] or 0, leaf(r, r[4]), k) for k, r in enumerate(rows) if r[2] == x) for x in langs}
    trees = {x: levels([n[2] for n in nodes]) for x, nodes in found.items()}
    top, out = levels([trees[x][-1][0] for x in langs]), []
    for t, x in enumerate(langs):
        for i, (_, _, own, k) in enumerate(found[x]):
            steps, (doc_id, *_, text), now = path(trees[x], i) + path(top, t), rows[k], own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                now = leaf(rows[k], None if text is None else text.translate(LOWER))
            for before, after in steps:
                now = digest(*before, now, *after)
            proof = digest(*(s for before, after in steps for s in before + after))
            out.append((doc_id, own, trees[x][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n, langs):
    return [(i, "s" if i % 3 else None, langs[min(i * i % 7, len(langs) - 1)], i if i % 5 else None, f"Text {i} É" if i % 4 else None) for i in range(n)]


ODD = [(None, None, None, None, None), (None, None, None, None, None), (7, "s", None, 1, "A"), (7, "s", None, 1, "A"), (7, "s", None, 1, "a"), (1, "", "", 0, ""), (2, "x", "é", 3, "lone"), (3, "x", "z", 3, "B")]


@pytest.mark.parametrize("part_rows, rows", [
    (12, ODD + [(100 + i, *r) for i, *r in rows_of(150, ["en", "en", "en", "de", None])]),
    (12, [(i, "s", f"l{i % 70:03}", i, f"T{i}") for i in range(100)]),
    (1 << 14, ODD),
], ids=["one hot lang", "many langs", "one part"])
def test_manifest(spark, part_rows, rows):
    """part_rows 12: most parents are resolved in later rounds."""
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS grp", "1 AS digest", "2 AS part", "3 AS `a.b`")
    got = sorted(map(tuple, merkle.manifest(docs, part_rows).collect()), key=str)
    assert got == plain(rows)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paths_prove_leaves(spark):
    rows = rows_of(90, ["en", "de"])
    for r in merkle.manifest_paths(spark.createDataFrame(rows, SCHEMA), 20).collect():
        assert merkle.folded(r.path, r.leaf) == r.root
        assert merkle.folded(r.path, digest("other")) != r.root


def test_tasks_resolve_what_they_hold():
    """Children in any order; what lies beyond a task's edge stays open, everything else becomes its ancestors."""
    whole = levels([digest(str(i)) for i in range(100)])
    for order in (range(100), reversed(range(100))):
        tree = merkle.Frontier()
        for i in order:
            tree.add("g", 100, 0, i, whole[0][i])
        assert tree.roots == {"g": whole[-1][0]} and not tree.partial
    part = merkle.Frontier()
    for i in range(10, 75):
        part.add("g", 100, 0, i, whole[0][i])
    opened = {(level, i) for _, _, level, i, _ in part.unresolved()}
    assert opened == {(0, i) for i in (*range(10, 16), 72, 73, 74)} | {(1, i) for i in range(2, 9)}


def test_query_equals_sql(spark):
    from quern.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = c.execute(merkle.MANIFEST_SQL)
    names = [d[0] for d in cursor.description]
    rows = QUERIES["op11_merkle_manifest"](spark, folder).collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(cursor.fetchall())
