"""Odd inputs to every operator and pipeline stage, and the learned scores computed another way."""

import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import by_id, made, words

import corpus_pipeline
from quern.llm import decontam, lines, neardup, packing, pii, quality, secrets, shards, tokens, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
CLASHING = ("cuts", "row", "removed", "lines_removed", "score", "passages", "document", "bucket", "rep", "text_a", "kept", "doc", "slot", "found", "words", "hash", "n", "x", "_scored")


def documents(spark, rows):
    """documents with nulls, repeats and columns of clashing names."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def odd_documents(spark):
    long = words(4000, 1)
    texts = [None, "", " \n ", "one", long, long, long.replace("a", "b", 3), words(60, 4) + "\n" + words(3, 5), words(60, 4) + "\n" + words(3, 6), "tie", "tie"]
    rows = [(i, t, "l", None if i % 2 else "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return documents(spark, [*rows, (None, "no id", None, None, 5), (None, None, None, None, None), (9, "tie", "l", None, 3)]).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, odd_documents, name):
    """Columns of clashing names keep their values, rows without doc_id stay, an empty table gives an empty one."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_documents, FOLDER)
    if name != "packing":
        assert out.columns == odd_documents.columns
        rows = out.collect()
        assert all(r[c] == f"mine {c}" for r in rows for c in CLASHING)
        assert sum(r.doc_id is None for r in rows) == 2
        assert sum(r.doc_id == 9 for r in rows) == 2
        expected = {"toxicity": 14, "line_dedup": 14 - 1, "near_dedup": 14 - 4, "decontamination": 14}
        assert len(rows) == expected[name]
    else:
        assert out.select("doc_id").distinct().count() == 12
    empty = stage(spark, documents(spark, []), FOLDER)
    assert empty.count() == 0


def test_operators_on_odd_documents(spark, odd_documents):
    n = odd_documents.count()
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, 0), (3, 0)], "doc_id long, toxic int").withColumn("score", F.lit("x"))
    items = spark.createDataFrame([(1, words(60, 4)), (None, "one"), (2, None)], "item_id long, text string").withColumn("hash", F.lit("x"))
    for out in (
        secrets.find_secrets(odd_documents), pii.find_personal(odd_documents), quality.host_rules(odd_documents), lines.drop_repeated_lines(odd_documents),
        neardup.near_duplicates(odd_documents), toxicity.toxic_scores(odd_documents, labels),
    ):
        assert out.count() == n
    assert {r.doc_id for r in decontam.benchmark_leaks(odd_documents, items).collect()} == {7, 8}
    pieces = packing.best_fit_pack(odd_documents).collect()
    order = shards.training_order(odd_documents).collect()
    assert sum(r.piece == 0 for r in pieces) == n == sum(r.start == 0 for r in order)
    assert sum(r.length for r in pieces) == sum(r.length for r in order)
    assert sum(r.n for r in quality.host_rules(odd_documents).groupBy("kept").agg(F.count("*").alias("n")).collect()) == n


def test_string_ids(spark, odd_documents):
    docs = odd_documents.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id")))
    for out in (packing.best_fit_pack(docs), shards.training_order(docs), neardup.near_duplicates(docs), lines.drop_repeated_lines(docs), secrets.find_secrets(docs), pii.find_personal(docs)):
        assert dict(out.dtypes)["doc_id"] == "string" and out.count()


def test_training_order_of_changing_partitions(spark):
    """Rows behind an exchange, and none at all."""
    docs = made(spark, [words(30, i) for i in range(40)])
    got = shards.training_order(docs.repartition(3)).collect()
    encoder = tokens.WordTokenizer(tokens.default_tokenizer(), 1000).tokenizer
    whole = {i: [*encoder.encode(words(30, i), add_special_tokens=False).ids, 1] for i in range(40)}
    ends = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0)
        assert r.crc32 == zlib.crc32(b"".join(x.to_bytes(2, "little") for x in whole[r.doc_id][r.start : r.start + r.length]))
        ends[r.doc_id] = r.start + r.length
    assert ends == {i: len(x) for i, x in whole.items()}
    assert shards.training_order(made(spark, [])).count() == 0


def test_feistel_refuses_what_is_beyond():
    import numpy as np

    for bad in ([35], [5, 40], [-1]):
        with pytest.raises(ValueError):
            shards.feistel(np.array(bad), 35, 7)


def brute_segments(w, a=0):
    """All maximal scoring segments by their definition: the best segment, then those left and right of it."""
    best = max(((sum(w[i:j]), i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, i, j = best
    return brute_segments(w[:i], a) + [(a + i, a + j - 1, best[0])] + brute_segments(w[j:], a + j)


def test_all_maximal_segments():
    r = random.Random(14)
    for _ in range(300):
        other = -r.uniform(0.1, 1.5)
        w = [r.uniform(0.2, 3.0) if r.random() < 0.4 else other for _ in range(r.randint(1, 28))]
        at = [i for i, x in enumerate(w) if x > 0]
        found = toxicity.maximal_segments(at, [w[i] for i in at], other) if at else []
        expected = brute_segments(w)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected]
        assert [s for *_, s in found] == pytest.approx([s for *_, s in expected])


def test_scores_computed_another_way(spark):
    """The counts, weights and scores of the small table in plain Python."""
    docs = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())
    labels = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{FOLDER}/labels.parquet' GROUP BY doc_id").fetchall())
    split = {d: re.findall(rb"[A-Za-z0-9\x80-\xff]+", t.encode().lower()) for d, t in docs.items()}
    keys = {}

    def key(word):
        if word not in keys:
            whole, head = toxicity.tokens([word])[0]
            keys[word] = int(whole[0]), int(head[0])
        return keys[word]

    training = [d for d in docs if d in labels and zlib.crc32(str(d).encode()) % 4 != 2]
    counts, sums = {}, [0, 0]
    for d in training:
        for k in {k for word in split[d] for k in key(word) if k}:
            counts.setdefault(k, [0, 0])[labels[d]] += 1
            sums[labels[d]] += 1
    prior, size = 500.0, len(counts)
    weights, mass = {}, [0, 0]
    for k, (clean, toxic) in counts.items():
        a, a0 = 0.5 + prior * (clean + toxic) / sum(sums), 0.5 * size + prior
        weight = math.log((toxic + a) / (sums[1] + a0 - toxic - a)) - math.log((clean + a) / (sums[0] + a0 - clean - a))
        if weight > 0 and weight / math.sqrt(1 / (toxic + a) + 1 / (clean + a)) >= 3:
            weights[k] = weight
            mass[0], mass[1] = mass[0] + clean, mass[1] + toxic
    model = toxicity.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert dict(zip(model.keys.tolist(), model.weights.tolist())) == pytest.approx(weights)
    other = min(-0.005, math.log((1 - min(mass[1] / sums[1], 0.99)) / (1 - min(mass[0] / sums[0], 0.99))))
    assert model.other == pytest.approx(other)

    def kadane(d):
        w = [max(weights.get(key(x)[0], 0), 0) or weights.get(key(x)[1], 0) or other for x in split[d]]
        return w, max((x for *_, x in toxicity.maximal_segments([i for i, x in enumerate(w) if x > 0], [x for x in w if x > 0], other)), default=0.0)

    clean = [d for d in training if not labels[d] and split[d]]
    assert model.k == pytest.approx(len(clean) / sum(len(split[d]) * math.exp(-kadane(d)[1]) for d in clean))
    got = by_id(toxicity.toxic_scores(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")), "score", "predicted")
    for d in docs:
        w, best = kadane(d)
        base = max(0.0, math.log(model.k * max(len(w), 1)))
        if len(w) < 400:
            segments = [s for *_, s in brute_segments(w) if s > 0] if best > 0 else []
        else:
            segments = [s for *_, s in toxicity.maximal_segments([i for i, x in enumerate(w) if x > 0], [x for x in w if x > 0], other)]
        over = sum(s - base for s in segments if s > base)
        x = min(50.0, over) if over else max(-5.0, best - base) if best > 0 else -5.0
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.curve[0] + model.curve[1] * x))))
        assert got[d][0] == pytest.approx(p) and got[d][1] == int(p >= 0.3)


def test_pages_with_nulls_repeats_and_clashing_columns(spark):
    page = "y" * 1500
    rows = [(1, "http://a.com/", page), (None, "http://a.com/", page), (2, None, None), (2, None, None), (3, "http://b.com", page), (3, "http://b.com", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("mine") for c in ("stored", "payload_digest", "urlkey", "position", "part")})
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in warc.capture_histories(pages).collect())
    assert got == [(-1, "revisit", 3), (1, "revisit", 3), (2, "response", -1), (2, "response", -1), (3, "response", -1), (3, "response", -1)]




def test_curve_is_the_best_one():
    """The gradient of the penalised likelihood vanishes, also where Newton's whole steps run away."""
    import numpy as np

    r = np.random.default_rng(9)
    for _ in range(40):
        x = np.round(np.concatenate([r.normal(-3, 1.5, 400), r.normal(r.uniform(0, 30), r.uniform(0.1, 20), 60), [50.0, -5.0]]), 1)
        y = (r.random(len(x)) < 1 / (1 + np.exp(-(x - r.uniform(-2, 6))))).astype(int)
        rows = [(float(v), int((x == v).sum()), int(y[x == v].sum())) for v in np.unique(x)]
        a, b = toxicity._fit_curve(rows)
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        assert abs((y - p).sum() - 1e-2 * a) < 1e-3 and abs(((y - p) * x).sum() - 1e-2 * b) < 1e-2
    assert toxicity._fit_curve([]) == (-3.0, 1.0)
