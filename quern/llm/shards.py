"""Training-order token shards: fixed-stride binary files in the order of a keyed permutation."""

from __future__ import annotations

import contextlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import clean_text, fresh_path, small_batches, text_bytes, written
from quern.llm.tokens import default_tokenizer, word_tokenizer

#: Ids of a sequence, sequences of a shard, rounds of the permutation.
STRIDE = 2048
PER_SHARD = 2048
ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the indexes 0 to n - 1 under a keyed permutation of them.

    A balanced Feistel network permutes the numbers of an even count of bits that hold n; what falls
    beyond n walks on along its cycle until it is below, which keeps the map one to one. The domain is
    less than four times n, so walks are short. An index that isn't below n is refused, as its cycle
    may hold no number below n.
    """
    if len(index) and not 0 <= index.min() <= index.max() < n:
        raise ValueError(f"an index is not below {n}")
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, ROUNDS, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    slot = once(index.astype(np.uint64))
    while (out := slot >= n).any():
        slot[out] = once(slot[out])
    return slot.astype(np.int64)


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs only selects from files, so that two passes over it see the same partitions."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName().startswith("Relation") or plan.nodeName().startswith("LogicalRelation")


def _sequence_counts(docs: DataFrame, stride: int, tokenizer: str) -> list[tuple[int, int]]:
    """Task and number of sequences of each task that has documents, in order: a row a task."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, total = word_tokenizer(tokenizer), 0
        for batch in batches:
            total += sum(len(ids) + 1 for ids in encoder.encode(text_bytes(batch.column(1))))
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([-(-total // stride)], pa.int64())})

    with small_batches(docs.sparkSession):
        rows = docs.mapInArrow(run, "part int, n long").collect()
    return sorted((r.part, r.n) for r in rows)


def token_sequences(docs: DataFrame, stride: int, tokenizer: str, end_id: int, slot_of, per_shard: int) -> tuple[DataFrame, str]:
    """slot, shard, ids (16-bit, little-endian), pieces of each sequence of stride ids, and the type of pieces.

    docs: doc_id and the text. A task's documents, each closed by end_id, follow one another without gaps; the last sequence of a
    task may be shorter. pieces says which document's ids stand where. slot_of(task, numbers) gives the
    slots of a task's sequences.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, nth = word_tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        if len(encoder.ends) > 1 << 16:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        held, pieces, size, doc_type = [], [], 0, None

        def batch_of(rows):
            nonlocal nth
            slot = slot_of(part, np.arange(nth, nth + len(rows)))
            nth += len(rows)
            field = pa.struct([("doc_id", doc_type), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int32()), ("crc32", pa.int64())])
            ids, pieces_ = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array(ids, pa.binary()), pa.array(pieces_, pa.list_(field))], names=["slot", "shard", "ids", "pieces"])

        for batch in batches:
            doc_type, rows = batch.column(0).type, []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(text_bytes(batch.column(1)))):
                ids, start = np.append(ids.astype("<u2"), np.array([end_id], "<u2")), 0
                while start < len(ids):
                    cut = ids[start : start + stride - size]
                    pieces.append({"doc_id": doc, "start": start, "length": len(cut), "offset": size, "crc32": zlib.crc32(cut)})
                    held.append(cut)
                    start, size = start + len(cut), size + len(cut)
                    if size == stride:
                        rows.append((b"".join(x.tobytes() for x in held), pieces))
                        held, pieces, size = [], [], 0
            if rows:
                yield batch_of(rows)
        if size:
            yield batch_of([(b"".join(x.tobytes() for x in held), pieces)])

    pieces_type = f"array<struct<doc_id:{kind},start:long,length:int,offset:int,crc32:long>>"
    return docs.mapInArrow(run, f"slot long, shard long, ids binary, pieces {pieces_type}"), pieces_type


def write_shards(docs: DataFrame, path: str, key: int = 7, stride: int = STRIDE, per_shard: int = PER_SHARD, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the shards of all documents at path; returns the index: doc_id, start, length, crc32, slot, shard, offset.

    A first pass counts the sequences of each task (a row a task on the driver), which gives each an
    index and the permutation a slot; a second makes them. Encoding twice costs less than storing all
    ids once more. Both passes must see the same partitions: docs that isn't a plain scan of files is
    stored first, files are divided alike in both, and a pass that meets other sequences than were
    counted is refused. Shards are ranges of per_shard slots; a shard is one partition and one file of
    rows of 4 + 2 * stride bytes: the number of ids, then the ids, 0 behind the last. It is written
    beside its place and moved there whole, so a task that runs again, or a run that starts again,
    replaces it. Null and empty texts are end_id alone; doc_id may be null, repeated and of any type;
    other columns are left out. An empty table makes no shard.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    docs = docs.select("doc_id", clean_text().alias("text"))
    if not _is_scan(docs):
        docs = written(docs, "documents")
    with same_partitions(spark):
        return _write(docs, path, key, stride, per_shard, tokenizer, end_id)


@contextlib.contextmanager
def same_partitions(spark: SparkSession):
    """Files are divided by the cores there are when a pass is planned: hold that number, should executors come or go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _write(docs: DataFrame, path: str, key: int, stride: int, per_shard: int, tokenizer: str, end_id: int) -> DataFrame:
    n, first = 0, {}
    for part, count in _sequence_counts(docs, stride, tokenizer):
        first[part], n = (n, count), n + count

    def slot_of(part: int, numbers: np.ndarray) -> np.ndarray:
        start, count = first.get(part, (0, 0))
        if numbers[-1] >= count:
            raise ValueError(f"task {part} makes more than the {count} sequences counted")
        return feistel(numbers + start, n, key)

    placed, pieces_type = token_sequences(docs, stride, tokenizer, end_id, slot_of, per_shard)
    shards = max(1, -(-n // per_shard))

    def store(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        shard, rows, where, stream = None, 0, "", None

        def close():
            if stream is not None:
                stream.close()
                system.move(where, f"{folder}/shard-{shard:08d}.bin")

        for batch in batches:
            for s, slot, ids in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if s != shard:
                    close()
                    shard, rows, where = s, 0, f"{folder}/.shard-{s:08d}.{uuid.uuid4().hex}"
                    stream = system.open_output_stream(where)
                if slot != shard * per_shard + rows:
                    raise ValueError(f"slot {slot} isn't the next of shard {shard}")
                stream.write((len(ids) // 2).to_bytes(4, "little") + ids + bytes(2 * stride - len(ids)))
                rows += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3)], names=["slot", "shard", "pieces"])
        close()

    ordered = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    index = written(ordered.mapInArrow(store, f"slot long, shard long, pieces {pieces_type}"), "shard_index", 500)
    if index.count() != n:
        raise ValueError(f"{index.count()} sequences were written, {n} counted")
    return index.select("slot", "shard", F.explode("pieces").alias("p")).select("p.doc_id", "p.start", "p.length", "p.crc32", "slot", "shard", "p.offset")


def read_shards(spark: SparkSession, path: str, stride: int = STRIDE, per_shard: int = PER_SHARD, first_slot: int = 0) -> DataFrame:
    """slot, ids of the sequences from first_slot on, in order within each shard.

    A row stands at a fixed place in its shard, so reading goes on at any slot; shards before it are
    not opened.
    """
    width = 4 + 2 * stride
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], "slot long, ids binary")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                slot = max(number * per_shard, first_slot)
                with system.open_input_file(f"{folder}/shard-{number:08d}.bin") as file:
                    file.seek((slot - number * per_shard) * width)
                    while data := file.read(256 * width):
                        rows = [data[i : i + width] for i in range(0, len(data), width)]
                        ids = [r[4 : 4 + 2 * int.from_bytes(r[:4], "little")] for r in rows]
                        yield pa.RecordBatch.from_arrays([pa.array(range(slot, slot + len(rows)), pa.int64()), pa.array(ids, pa.binary())], names=["slot", "ids"])
                        slot += len(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path)
    numbers = files.select(F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long").alias("number"))
    return numbers.where((F.col("number") + 1) * per_shard > first_slot).mapInArrow(run, "slot long, ids binary")


def training_order(docs: DataFrame, path: str | None = None, key: int = 7) -> DataFrame:
    """Write the shards, read them back and return their index with the checksum of each row as read.

    Returns doc_id, start, length, crc32 (of the piece's 16-bit ids as made), slot, shard, offset and
    row_ids, row_crc32 (number and checksum of the row's ids as read). An empty table gives no row.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    index = write_shards(docs, path, key)
    rows = read_shards(spark, path).select("slot", (F.octet_length("ids") / 2).cast("int").alias("row_ids"), F.crc32("ids").alias("row_crc32"))
    rows = written(rows, "rows_read")
    return index.join(rows, "slot").select("doc_id", "start", "length", "crc32", "slot", "shard", "offset", "row_ids", "row_crc32")
