"""Best-fit packing of token pieces into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import clean_text, text_bytes, written
from quern.llm.tokens import default_tokenizer, word_tokenizer

CAPACITY = 4096
PIECES = "piece int, start long, length long, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """One row for each piece of at most capacity ids of each document; end_id closes a document.

    A null or empty text is the end id alone. Repeated rows are documents of their own, doc_id may be
    null and of any type. Other columns are left out. part and nth number the pieces of a length within the task that made them.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, seen = word_tokenizer(path), defaultdict(int)
        part, close = TaskContext.get().partitionId(), np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(text_bytes(batch.column(1)))):
                ids = np.concatenate([ids, close])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    rows.append((doc, piece, start, len(cut), zlib.crc32(cut), part, seen[len(cut)]))
                    seen[len(cut)] += 1
            if rows:
                kinds = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                arrays = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(x.split()[0] for x in PIECES.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text()).mapInArrow(run, f"doc_id {kind}, {PIECES}")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, none more often than counted, with the largest sum up to room.

    Bit i of a set is whether some combination sums to i; the lengths come in order, longest first,
    and the sets before each are kept to read the combination back. Stops when room is met exactly.
    """
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for length in lengths:
        most = min(counts[length], room // length)
        if not most:
            continue
        steps.append((length, reach))
        chunk = 1
        while most:
            take = min(chunk, most)
            reach |= reach << length * take & mask
            most -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> total & 1:
            total -= length
            used[length] = used.get(length, 0) + 1
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings (how many of each length) and how many bins get each.

    Each filling holds the longest length left and the fullest combination that fits beside it. It is
    removed as many times as what is left allows, so the number of fillings follows the number of
    different lengths, not the number of pieces.
    """
    left, out = dict(counts), []
    order = sorted(left, reverse=True)
    while order:
        longest = order[0]
        left[longest] -= 1
        filling = fullest(order, left, capacity - longest)
        left[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        bins = min(left[length] // n for length, n in filling.items())
        for length, n in filling.items():
            left[length] -= n * bins
        out.append((filling, bins))
        order = [x for x in order if left[x]]
    return out


def _places(fillings: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, copies a bin, first bin, offset in the bin)."""
    rows, taken, first_bin = defaultdict(list), defaultdict(int), 0
    for filling, bins in fillings:
        offset = 0
        for length in sorted(filling, reverse=True):
            n = filling[length]
            rows[length].append((taken[length], n, first_bin, offset))
            taken[length] += n * bins
            offset += n * length
        first_bin += bins
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns length, part, nth at least, length 1 to capacity).

    Only the number of pieces of each length, at most capacity numbers, comes to the driver; the
    fillings go back to the tasks, which place each piece by its rank among those of its length. Ranks
    come from counts by task and length, so a length that most pieces have is still dealt over tasks.
    An empty table gives an empty table.
    """
    by_part = pieces.groupBy("part", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(minimum_bin_slack(counts, capacity))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "part", "nth")
    names = ranked.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema.fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at, rows = np.flatnonzero(length == value), places[int(value)]
                first, n, bin_, start = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
                nth = rank[at] - first
                sequence[at], offset[at] = bin_ + nth // n, start + nth % n * value
            keep = [i for i, x in enumerate(names) if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(names[i] for i in keep), "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. See token_pieces and pack.
    """
    pieces = written(token_pieces(docs, capacity, tokenizer, end_id), "pieces", 500)
    packed = pack(pieces, capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
