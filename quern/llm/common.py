"""Shared pieces of the text operators: input tables, durable intermediate tables, word hashing."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.work import forget, fresh_path, release_exchanges, remove_work_tables, shared_dir, stored  # noqa: F401

#: White space that separates words, as a Java character class.
SPACE = r"\x20\x09-\x0D"
WORDS = rf"[{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """df as a table in the shared folder (see work.stored).

    batch: rows of an Arrow batch on the way through Python, where a row may hold a very long text.
    """
    with small_batches(df.sparkSession, batch) if batch else contextlib.nullcontext():
        return stored(df, label)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Arrow batches of few rows for the jobs run inside, as a row may hold a very long text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def clean_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(column) -> list[bytes]:
    """The rows of an Arrow string column as bytes; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- word and shingle fingerprints

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = _SEED.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 2**64)
        tables = []
        for base in (_BASE, inverse):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(docs: list[bytes]) -> list[np.ndarray]:
    """For each text the 64-bit fingerprints of its words, A-Z lower-cased.

    Words are maximal runs of bytes other than ASCII white space. All texts are hashed together with
    one prefix sum, so the cost is a few array passes over the bytes.
    """
    if not docs:
        return []
    data = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    n = len(data)
    power, inverse = _power_tables(n)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[data]] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    cuts = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in docs]))
    return np.split(hashes, cuts[:-1])


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles of size words; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out += words[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(mix(out))


def blocks(docs: list[bytes], limit: int = 1 << 18):
    """Index ranges of consecutive texts of about limit bytes together."""
    start = size = 0
    for i, d in enumerate(docs):
        if size and size + len(d) > limit:
            yield start, i
            start, size = i, 0
        size += len(d) + 1
    if docs:
        yield start, len(docs)


def shingle_sets(docs: list[bytes], size: int = 5):
    """The shingle set of each text, in order."""
    for a, b in blocks(docs):
        for words in word_hashes(docs[a:b]):
            yield shingle_set(words, size)
