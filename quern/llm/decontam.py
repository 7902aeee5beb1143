"""Benchmark decontamination: short test items found inside long documents by MinHash containment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WORDS, clean_text, written

#: Sketches of up to this many rows are broadcast (16 bytes of data each), larger ones joined by exchange.
MOST_BROADCAST = 200_000
_SPACES = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Lower-cased words; none: an empty array."""
    return F.filter(F.split(F.lower(F.btrim(text, F.lit(_SPACES))), WORDS), lambda w: w != "")


def _hashed(words: str, width: int) -> Column:
    last = F.size(words) - width
    one = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))


def _strings(words: str, width: Column) -> Column:
    last = F.size(words) - width
    one = lambda i: F.array_join(F.slice(words, i + 1, width), " ")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<string>"))


def sketch_size(n: Column, containment: float, miss: float = 1e-6) -> Column:
    """How many of an item's n smallest shingle hashes to look for.

    Of n shingles at most (1 - containment) n may be absent, so one more than that is sure to meet one
    that is there; for larger items as many as leave a chance of miss of finding none.
    """
    enough = math.ceil(math.log(miss) / math.log(1 - containment)) if containment < 1 else 1
    sure = F.floor(n * (1 - containment) + 1e-9) + 1
    return F.least(sure, F.lit(enough)).cast("int")


def item_sketches(tests: DataFrame, width: int, containment: float) -> DataFrame:
    """part, item_id, hash: the smallest shingle hashes of each item (item_id, width, words).

    Items are partitioned by the number of their shingles, in powers of two (part). A partition's
    sketches are as long as its largest item needs (sketch_size).
    """
    by_width = [F.when(F.col("width") == w, _hashed("words", w)) for w in range(1, width + 1)]
    hashed = tests.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(*by_width))))).alias("hashes"))
    part = F.floor(F.log2(F.size("hashes") + F.lit(0.5))).cast("int")
    largest = F.lit(2.0) ** (F.col("part") + 1) - 1
    length = F.least(F.size("hashes"), sketch_size(largest, containment))
    return hashed.withColumn("part", part).select("part", "item_id", F.explode(F.slice("hashes", F.lit(1), length)).alias("hash"))


def partitions_of(found: Column, cuts: list[tuple[int, int, int]]) -> Column:
    """The partitions that a document's shingle hash is looked up in: those whose largest hash isn't below it; null if none.

    cuts: (largest hash, part, hashes) of the partitions, ascending. A partition of large items has its
    own small cut-off, whatever hashes the small items' have.
    """
    out = F.lit(None).cast("array<int>")
    for i in reversed(range(len(cuts))):
        out = F.when(found <= F.lit(cuts[i][0]), F.array(*(F.lit(part) for _, part, _ in cuts[i:]))).otherwise(out)
    return out


def benchmark_leaks(docs: DataFrame, items: DataFrame, containment: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for each document that contains an item.

    An item is contained if that share of its distinct shingles of width words (lower-cased) occurs in
    the document, wherever and among however much else; an item of fewer words is one shingle of all
    of them, one without words is contained in nothing.

    Items are partitioned by size and each partition has MinHash sketches of its own length, the
    smallest shingle hashes of its items (item_sketches). A document has a sketch for each partition:
    those of its shingle hashes that don't exceed the partition's largest (partitions_of), so a long
    document meets the large items' sketches with few of its shingles; items of a few shingles have any
    hashes, and are looked for with nearly all. One hash in common makes a candidate, whose share is then counted on the
    shingles themselves. Null or empty texts contain nothing. Rows that repeat a doc_id or an item_id
    count as one text, their shingles together; rows without one are left out, as are other columns.
    """
    tests = items.where("item_id is not null").select("item_id", words_of(clean_text()).alias("words")).where("size(words) > 0")
    tests = tests.select("item_id", F.least(F.size("words"), F.lit(width)).alias("width"), "words")
    parts = tests.select("item_id", "width", F.explode(F.array_distinct(_strings("words", F.col("width")))).alias("shingle"))
    parts = parts.distinct()
    sized = written(parts.join(parts.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id"), "items")
    sketches = written(item_sketches(tests, width, containment), "sketches")
    cuts = sorted((r["cut"], r["part"], r["n"]) for r in sketches.groupBy("part").agg(F.max("hash").alias("cut"), F.count("*").alias("n")).collect())  # a row a power of two
    n = sum(c[2] for c in cuts)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_shared long, n_item long, containment double"
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    widths = sorted(r["width"] for r in sized.select("width").distinct().collect())
    words = docs.where("doc_id is not null").select("doc_id", words_of(clean_text()).alias("words"))
    hashes = F.explode(F.concat(*(_hashed("words", w) for w in widths)) if len(widths) > 1 else _hashed("words", widths[0]))
    rows = words.select("doc_id", hashes.alias("hash")).select("doc_id", "hash", F.explode(partitions_of(F.col("hash"), cuts)).alias("part"))
    found = rows.join(F.broadcast(sketches) if n <= MOST_BROADCAST else sketches, ["part", "hash"]).select("doc_id", "item_id")
    candidates = written(found.distinct(), "candidates")
    near = words.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = candidates.join(sized.select("item_id", "width").distinct(), "item_id").select("doc_id", "width").distinct()
    mine = near.join(asked, "doc_id").select("doc_id", "width", F.explode(F.array_distinct(_strings("words", F.col("width")))).alias("shingle"))
    mine = mine.join(sized.select("width", "shingle").distinct(), ["width", "shingle"], "left_semi").distinct()
    both = mine.join(sized, ["width", "shingle"]).join(candidates, ["doc_id", "item_id"], "left_semi")
    counted = both.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("n_item").alias("n_item"))
    share = F.round(F.col("n_shared") / F.col("n_item"), 6)
    return counted.where(F.col("n_shared") >= F.lit(containment) * F.col("n_item") - 1e-9).withColumn("containment", share)


DECONTAMINATION_SQL = r"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), v AS (
        SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark
    ), i AS (
        SELECT DISTINCT item_id, least(len(ws), 5) AS width, array_to_string(ws[k:k + least(len(ws), 5) - 1], ' ') AS shingle
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM v WHERE len(ws) > 0)
    ), d AS (
        SELECT DISTINCT doc_id, width, array_to_string(ws[k:k + width - 1], ' ') AS shingle
        FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS k FROM w, (SELECT DISTINCT width FROM i))
    ), n AS (
        SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id
    )
    SELECT doc_id, item_id, count(*) AS n_shared, n_item, round(count(*) / n_item, 6) AS containment
    FROM d JOIN i USING (width, shingle) JOIN n USING (item_id)
    GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""
