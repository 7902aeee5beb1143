"""States that tasks gather from all their rows and that add up: a small one a task and key, merged by a tree.

A state is a byte string. A task that has read its rows gives one for each key; the states of FAN
neighbours are merged by key first, then what is left: a task reads at most FAN states of a key, or a
FAN-th of them all, and holds two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 256
SCHEMA = "task int, key int, state binary"


def gathered(df: DataFrame, gather: Callable[[Iterable], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """task, key, state: what gather makes of the Arrow batches of each task of df."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for key, state in gather(batches):
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([key], pa.int32()), pa.array([state], pa.binary())], names=["task", "key", "state"])

    return df.mapInArrow(run, SCHEMA)


def merged(states: DataFrame, merge: Callable[[bytes, bytes], bytes], levels: int = 2) -> DataFrame:
    """key, state: the states of all tasks, merged by key two at a time, in order of the tasks; levels 1 is enough for FAN tasks."""

    def run(batches):
        import pyarrow as pa

        def row(task, key, state):
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([key], pa.int32()), pa.array([state], pa.binary())], names=["task", "key", "state"])

        at, state = None, None
        for batch in batches:
            for task, key, more in zip(*(c.to_pylist() for c in batch.columns)):
                if at == (task, key):
                    state = merge(state, more)
                    continue
                if at is not None:
                    yield row(*at, state)
                at, state = (task, key), more
        if at is not None:
            yield row(*at, state)

    for group in (F.floor(F.col("task") / FAN).cast("int"), F.lit(0))[-levels:]:
        level = states.select(group.alias("task"), "key", F.col("task").alias("_t"), "state")
        dealt = level.repartition("task", "key").sortWithinPartitions("task", "key", "_t").select("task", "key", "state")
        states = dealt.mapInArrow(run, SCHEMA)
    return states.select("key", "state")


def added(a: bytes, b: bytes) -> bytes:
    """The sum of two states that are arrays of doubles."""
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


def numbers(batch, columns: range) -> np.ndarray:
    """Columns of an Arrow batch as doubles, a row each; null is NaN."""
    out = np.empty((batch.num_rows, len(columns)))
    for i, c in enumerate(columns):
        out[:, i] = batch.column(c).to_numpy(zero_copy_only=False)
    return out
