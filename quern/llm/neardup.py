"""Near-duplicate groups by min-max hashing, with every link confirmed on whole shingle sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from quern.llm.common import clean_text, forget, release_exchanges, shingle_sets, text_bytes, written
from quern.llm.graph import components, united

ROWS = 7
#: Buckets of more members are dealt anew by their rarest shingles before their members meet.
SMALL_BUCKET = 24
#: Leaders of a bucket in the first round that searches it, and how many times as many each round has.
LEADERS = 64
MORE = 8
#: Members of a bucket that one task compares with its leaders.
SHARE = 512
#: A profile counts shingles in so many groups, each up to 8: a bit for each.
GROUPS = 128
_NUMBERS = GROUPS * 8 // 64
#: Rows of a table of frequencies that one task looks sets up in.
TABLE = 1_000_000


def bands_needed(threshold: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    """Bands such that a pair at the threshold shares none with a probability of miss at most; even."""
    n = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    return n + n % 2


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(1729)
    return draw.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), draw.integers(0, 2**32, n, dtype=np.uint32)


def min_max_signature(fingerprints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima under each permutation, then the maxima: two values for one evaluation of a hash."""
    x = (fingerprints >> np.uint64(32)).astype(np.uint32)
    low = high = None
    for i in range(0, len(x), 2048):
        h = a[:, None] * x[None, i : i + 2048] + b[:, None]
        lo, hi = h.min(axis=1), h.max(axis=1)
        low = lo if low is None else np.minimum(low, lo)
        high = hi if high is None else np.maximum(high, hi)
    return np.concatenate([low, high])


def profile(fingerprints: np.ndarray) -> tuple[np.ndarray, int]:
    """How many shingles fall into each of GROUPS groups, as that many set bits of 8 each, and how many exceed 8.

    Two sets share at most the smaller count of each group, which is the number of bits set in both,
    and at most the smaller excess besides. So profiles bound what two sets have in common, exactly.
    """
    counts = np.bincount((fingerprints & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    bits = np.packbits(counts[:, None] > np.arange(8), bitorder="little")
    return bits.view(np.int64), int(np.maximum(counts - 8, 0).sum())


def most_common() -> Column:
    """The bound of two profiles (k_a, k_b: bits; o_a, o_b: excess) on what the sets share."""
    total = F.least("o_a", "o_b").cast("int")
    for i in range(_NUMBERS):
        total = total + F.bit_count(F.get("k_a", F.lit(i)).bitwiseAND(F.get("k_b", F.lit(i))))
    return total


def signatures(docs: DataFrame, threshold: float, words: int = 5) -> DataFrame:
    """doc_id, n, set_key (fingerprint of the whole set, null if it is empty), bands, k and o (profile)."""
    n_bands = bands_needed(threshold)
    a, b = _permutations(n_bands * ROWS // 2)
    weights = np.random.default_rng(4104).integers(1, 2**63, (n_bands, ROWS), dtype=np.uint64) | np.uint64(1)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sizes, keys, bands, bits, excess = [], [], [], [], []
            for s in shingle_sets(text_bytes(batch.column(1)), words):
                sizes.append(len(s))
                if not len(s):
                    for column in (keys, bands, bits, excess):
                        column.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(s))
                rows = min_max_signature(s, a, b).reshape(n_bands, ROWS).astype(np.uint64)
                h = (rows * weights).sum(axis=1, dtype=np.uint64)
                bands.append((h ^ (h >> np.uint64(29))).view(np.int64))
                k, o = profile(s)
                bits.append(k)
                excess.append(o)
            many = pa.list_(pa.int64())
            columns = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, many), pa.array(bits, many), pa.array(excess, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "set_key", "bands", "k", "o"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text()).mapInArrow(run, f"doc_id {kind}, n long, set_key binary, bands array<long>, k array<long>, o long")


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """The pairs (a, b) of documents (doc_id, text) whose whole sets are similar enough."""
    percent = round(threshold * 100)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep, last, mine = [], None, None
            for s, t in zip(text_bytes(batch.column(2)), shingle_sets(text_bytes(batch.column(3)), words)):
                if s != last:
                    last, mine = s, next(shingle_sets([s], words))
                same = len(np.intersect1d(mine, t, assume_unique=True))
                keep.append(100 * same >= percent * (len(mine) + len(t) - same) and same > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _shares(members: str) -> Column:
    """Over how many tasks a bucket is dealt: one for each SHARE of its members."""
    return F.ceil(F.col(members) / SHARE).cast("int")


def _mixed(entries: DataFrame, linked: DataFrame) -> DataFrame:
    """The entries of buckets with members of several components, with component and the bucket's members."""
    labelled = entries.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("bucket").agg(F.count("*").alias("members"), F.max("was").alias("was"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    mixed = mixed.select("bucket", "members", F.explode(F.sequence(F.lit(0), _shares("was") - 1)).alias("share"))
    return labelled.withColumn("share", F.pmod(F.xxhash64("rep"), _shares("was")).cast("int")).join(mixed, ["bucket", "share"]).drop("share")


def _dealt_anew(texts: DataFrame, large: DataFrame, threshold: float, words: int, kind: DataType) -> DataFrame:
    """rep, n, m, k, o, bucket, was: the rarest shingles (arrays bucket and was) of the members (rep) of large buckets, as buckets of their own.

    Sets of which one has n shingles and that share the threshold's part of it have one in common
    among the n - ceil(threshold n) + 1 shingles of each that come first in one order of all. With
    the rarest among these members first, a passage that all of them share comes last, and members
    with enough shingles of their own have no partner at all. So no pair is lost and none is made
    because of the passage. m is how many shingles of rep any other member has, k and o their profile;
    was is how many members have the shingle.

    A member's set stays one row. The shingles' frequencies are cut into tables of at most about TABLE
    rows, and each task looks a share of the sets up in one table, so neither a frequent shingle nor a
    large group gathers in one task and no shingle of a member is a row.
    """
    percent, name = round(threshold * 100), kind.simpleString()

    def sets_of(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(text_bytes(batch.column(1)), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "n", "s"])

    def tally(batches):
        import pyarrow as pa

        for batch in batches:
            shingles, times = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(times)], names=["bucket", "times"])

    members = texts.join(large.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = written(members.mapInArrow(sets_of, f"rep {name}, n long, s array<long>"), "sets", 500)
    counted = sets.select("s").mapInArrow(tally, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("df"))
    shared = written(counted.where("df > 1"), "frequencies", 500)
    tables = max(1, -(-shared.count() // TABLE))
    shares = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // (4 * TABLE * tables)))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for rep, n, s in zip(batch.column(0), batch.column(1), batch.column(2)):
                s = s.values.to_numpy(zero_copy_only=False)
                table = s % tables
                order = np.argsort(table, kind="stable")
                used, first = np.unique(table[order], return_index=True)
                parts = np.split(s[order], first[1:]) if len(used) else []
                same = [pa.array([x.as_py()] * len(used), x.type) for x in (rep, n)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(used, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["rep", "n", "part", "s"])

    def looked_up(left, right):
        import pyarrow as pa

        left = left.combine_chunks()
        order = np.argsort(known := right.column("bucket").to_numpy())
        known, df = known[order], right.column("df").to_numpy()[order]
        found, times = [], []
        for s in left.column("s"):
            s = s.values.to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
            hit = known[at] == s if len(known) else np.zeros(len(s), bool)
            found.append(s[hit])
            times.append(df[at[hit]])
        many = pa.list_(pa.int64())
        return pa.table({"rep": left.column("rep"), "n": left.column("n"), "s": pa.array(found, many), "df": pa.array(times, many)})

    def first(batches):
        import pyarrow as pa

        many = pa.list_(pa.int64())
        for batch in batches:
            buckets, was, m, bits, excess = [], [], [], [], []
            for n, s, df in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                s, df = s.values.to_numpy(zero_copy_only=False), df.values.to_numpy(zero_copy_only=False)
                most = n - -(-n * percent // 100) + 1 - (n - len(s))  # what others don't have comes first and makes no bucket
                rarest = np.lexsort((s, df))[: max(0, most)]
                buckets.append(s[rarest])
                was.append(df[rarest])
                m.append(len(s))
                k, o = profile(s.view(np.uint64))
                bits.append(k)
                excess.append(o)
            columns = [pa.array(m, pa.int64()), pa.array(bits, many), pa.array(excess, pa.int64()), pa.array(buckets, many), pa.array(was, many)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["rep", "n", "m", "k", "o", "bucket", "was"])

    pieces = sets.mapInArrow(cut, f"rep {name}, n long, part long, s array<long>").withColumn("share", F.pmod(F.xxhash64("rep"), F.lit(shares)))
    table = shared.select(F.pmod("bucket", F.lit(tables)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), "bucket", "df")
    pairs = pieces.groupBy("part", "share").cogroup(table.groupBy("part", "share"))
    mine = pairs.applyInArrow(looked_up, f"rep {name}, n long, s array<long>, df array<long>")
    mine = mine.groupBy("rep", "n").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("df")).alias("df"))
    dealt = mine.mapInArrow(first, f"rep {name}, n long, m long, k array<long>, o long, bucket array<long>, was array<long>")
    dealt = written(dealt, "dealt", 500)
    forget(sets, shared)
    return dealt


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents are linked if the Jaccard similarity of their sets of word shingles reaches threshold
    (whole percents); component_id is the smallest doc_id reachable by links, kept is whether that is
    the document itself. Texts with equal sets form one class, which its smallest doc_id stands for.
    A null or empty text, or one without words, has an empty set and stays alone. doc_id may be of any
    type with an order; rows that repeat one are judged by their own text each. A row without doc_id
    belongs to the class of its text if a row with one has that too, else it stays alone and is kept.
    Other columns are left out.

    Candidates share a band of the min-max signature; a pair at the threshold is missed by all bands
    with a probability of at most one in a million, and nothing later loses any. A bucket's members
    are first compared with its smallest member. Buckets that this leaves in several components are
    searched again: those of more than SMALL_BUCKET members are dealt anew by their rarest shingles
    (see _dealt_anew); then all are searched from leaders, the members with the most links so far,
    MORE times as many each round (all members where those are fewer), until a bucket is of one
    component or all its members have led. Members of a large bucket are dealt over tasks, each with
    the bucket's leaders. Copies by the thousand so cost a few comparisons each, not a pair each.
    Before texts are read, pairs are ruled out by their sizes and by their profiles (see profile),
    which bound what they share exactly.
    """
    kind = docs.schema["doc_id"].dataType
    all_docs = written(signatures(docs, threshold, words), "signatures", 500)
    one = F.min(F.struct("doc_id", "n", "bands", "k", "o")).alias("x")
    classes = all_docs.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(one)
    classes = written(classes.select("set_key", F.col("x.doc_id").alias("rep"), "x.n", "x.bands", "x.k", "x.o"), "classes")
    entries = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("was"), F.min("rep").alias("leader")).where("was > 1")
    shared = written(shared, "shared")
    entries = written(entries.join(shared, "bucket"), "entries")
    percent = round(threshold * 100)

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes n and whose shingles that others have (m of them, profile k and o) allow the similarity."""
        enough = lambda most: (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
        return pairs.where(enough(F.least("m_a", "m_b")) & enough(most_common()))

    def side(df: DataFrame, x: str, *more) -> DataFrame:
        return df.select(*more, F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "m", "k", "o")))

    whole = classes.select("rep", "n", F.col("n").alias("m"), "k", "o")
    first = entries.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    first = alike(first.join(side(whole, "a"), "a").join(side(whole, "b"), "b"))
    tested = written(first.select("a", "b"), "candidates")
    members = entries.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", clean_text().alias("text")).join(members.hint("merge"), "doc_id", "left_semi")
    texts = written(texts, "texts")
    links = written(_confirmed(tested, texts, threshold, words), "links", 500)
    linked = written(components(links), "components")
    left = written(_mixed(entries.where("rep <> leader").select("bucket", "was", "rep", F.lit(False).alias("dealt")), linked), "mixed")
    large = written(left.where(f"members > {SMALL_BUCKET}").select("rep").distinct(), "large")
    profiles = whole.withColumn("dealt", F.lit(False))
    more = left.where(f"members <= {SMALL_BUCKET}").select("bucket", "was", "rep", "dealt")
    if not large.isEmpty():
        anew = _dealt_anew(texts, large, threshold, words, kind)
        profiles = profiles.union(anew.select("rep", "n", "m", "k", "o", F.lit(True)))
        buckets = anew.select(F.explode(F.arrays_zip("bucket", "was")).alias("x"), "rep")
        more = more.union(buckets.select("x.bucket", "x.was", "rep", F.lit(True)))
    more, leaders_each = written(more, "entries"), LEADERS
    forget(entries, left, shared)
    entries, used = more, [more]
    while True:
        left = written(_mixed(entries, linked), "mixed")
        forget(*used)
        release_exchanges(docs.sparkSession)
        if left.isEmpty():
            break
        degrees = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
        salt = F.when(F.col("members") <= leaders_each, F.xxhash64("rep")).otherwise(F.pmod(F.xxhash64("rep", "bucket"), F.lit(leaders_each)))
        ranked = left.join(degrees, "rep", "left").groupBy("bucket", "members", salt.alias("salt"))
        leaders = ranked.agg(F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("order"), "rep", "dealt", "component")).alias("x"))
        leaders = written(leaders.select("bucket", "members", "x.*"), "leaders")
        ahead = leaders.withColumn("share", F.explode(F.sequence(F.lit(0), _shares("members") - 1)))
        behind = left.withColumn("share", F.pmod(F.xxhash64("rep"), _shares("members")).cast("int"))
        sides = (side(df.join(profiles, ["rep", "dealt"]), x, "bucket", "share", F.col("component").alias(f"c_{x}")) for df, x in ((ahead, "a"), (behind, "b")))
        pairs = alike(next(sides).join(next(sides), ["bucket", "share"]).where("c_a <> c_b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
        if not pairs.isEmpty():
            found = written(_confirmed(pairs, texts, threshold, words), "links", 500)
            if not found.isEmpty():
                links = links.union(found)
                linked = united(linked, found)
            tested = tested.union(pairs)
        entries = left.join(leaders.select("bucket", "rep"), ["bucket", "rep"], "left_anti").select("bucket", "was", "rep", "dealt")
        used, leaders_each = [left, leaders], MORE * leaders_each
    groups = classes.select("set_key", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    groups = written(groups.select("set_key", F.coalesce("component", "rep").alias("component_id")), "groups")
    result = all_docs.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(groups, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


NEAR_DUPLICATES_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), s AS MATERIALIZED (
        SELECT DISTINCT doc_id, array_to_string(ws[k:k + least(len(ws), 5) - 1], ' ') AS shingle
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0)
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), p AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
    ), l AS (
        SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)
    ), e AS MATERIALIZED (
        SELECT a, b FROM l UNION ALL SELECT b, a FROM l
    ), r(doc_id, reached) AS (
        SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.reached FROM r JOIN e ON e.a = r.doc_id
    ), c AS (
        SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
    )
    SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = c.doc_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
