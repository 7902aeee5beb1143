"""Partitions searched apart, archives that a failed task left, and hosts judged by their posterior."""

import random

from pyspark.sql import functions as F

from quern.llm import decontam, quality, warc


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


def cuts(spark, items):
    tests = spark.createDataFrame(items, "item_id long, text string").select("item_id", decontam.words_of(F.col("text")).alias("words"))
    tests = tests.select("item_id", F.least(F.size("words"), F.lit(5)).alias("width"), "words")
    return {r["part"]: r["cut"] for r in decontam.item_sketches(tests, 5, 0.8).groupBy("part").agg(F.max("hash").alias("cut")).collect()}


def test_small_items_dont_move_other_partitions_cut_offs(spark):
    """An item of one shingle has any hash; documents meet the partition of large items with the same few hashes as before."""
    large = [(i, words(400, i)) for i in range(5)]
    alone, both = cuts(spark, large), cuts(spark, [*large, *((100 + i, words(3, 50 + i)) for i in range(20))])
    (part,) = alone
    assert both[part] == alone[part] and both[0] > alone[part]
    ordered = sorted((cut, p, 1) for p, cut in both.items())
    hashes = spark.createDataFrame([(alone[part],), (alone[part] + 1,), (both[0],), (2**63 - 1,)], "h long")
    got = [r[0] for r in hashes.select(decontam.partitions_of(F.col("h"), ordered)).collect()]
    assert got == [[part, 0], [0], [0], None]
    docs = [(1, words(50, 900) + " " + large[2][1] + " " + words(50, 901)), (2, words(40, 902) + " " + words(3, 57) + " x"), (3, words(500, 903))]
    items = spark.createDataFrame([*large, *((100 + i, words(3, 50 + i)) for i in range(20))], "item_id long, text string")
    found = decontam.benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 2), (2, 107)]


def test_archives_of_failed_tasks_arent_read(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.com/{i}", words(50, i)) for i in range(20)], "page_id long, url string, html string")
    archives = warc.write_archives(pages.repartition(2), path, most_bytes=3_000)
    first = sorted(r.archive for r in archives.collect())
    stale = f"{tmp_path}/archives/captures-000000-00099.warc.gz"
    with open(f"{tmp_path}/archives/{first[0]}", "rb") as f, open(stale, "wb") as g:
        g.write(f.read())
    assert warc.read_archives(spark, path, archives).count() == 20
    assert warc.read_archives(spark, path).count() > 20


def test_hosts_are_judged_against_the_others(spark):
    """A host that fails three times as often as others for sure is kept out, a small one with the same share isn't."""
    bad = lambda i: words(20, i) + " ### $$$"
    rows = [(i, bad(i) if i % 100 < 2 else words(30, i), f"h{i // 500}") for i in range(5000)]
    rows += [(5000 + i, bad(i) if i % 10 < 4 else words(30, i), "worse") for i in range(200)] + [(6000 + i, bad(i) if i < 1 else words(30, i), "small") for i in range(3)]
    got = {r.host: r for r in quality.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("host").agg(F.min("kept").alias("kept"), F.first("host_failed").alias("failed")).collect()}
    assert got["worse"].failed == ["symbols"] and not got["worse"].kept
    assert all(not r.failed for h, r in got.items() if h != "worse") and got["small"].kept


def test_stages_with_dots_in_names_and_without_sizes(spark):
    """Extra columns with dots and back-ticks keep their names and values; n_chars may be absent."""
    import corpus_pipeline

    rows = [(1, words(60, 1) + "\n" + words(60, 2), "x"), (2, words(60, 3) + "\n" + words(60, 2), "y"), (3, words(120, 4), "z"), (4, words(120, 4), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"a.b": F.lit(1), "c`d": F.lit("e")})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and all(r["a.b"] == 1 and r["c`d"] == "e" for r in out.collect()), name
