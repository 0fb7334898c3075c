"""Sums of arrays over tasks, for fits that pass over staged blocks.

A task adds up what it sees and returns only the rows of the sum that it
touched. While the tasks' returns are together small (a counted number of
tasks times a fixed size) they go to the driver as they are; else they are
first added per range of rows in the cluster. Both ways add in the order of
the tasks, so the sum does not depend on which one is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 1 << 13          # rows that are summed together
DIRECT = 64 << 20        # bytes up to which all tasks' sums go to the driver
SUMS = "part int, source int, cols binary, sums binary"


def partial_sums(total: np.ndarray, touched: np.ndarray) -> pa.RecordBatch:
    """The touched rows of a task's ``total``, one batch row per range."""
    from pyspark import TaskContext

    cols = np.flatnonzero(touched).astype(np.int32)
    starts = np.flatnonzero(np.diff(cols // RANGE, prepend=-1))
    pieces = [cols[s:e] for s, e in zip(starts, [*starts[1:], len(cols)])]
    source = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([int(p[0]) // RANGE for p in pieces], pa.int32()), pa.array([source] * len(pieces), pa.int32()),
         pa.array([p.tobytes() for p in pieces], pa.binary()),
         pa.array([total[p].tobytes() for p in pieces], pa.binary())], names=["part", "source", "cols", "sums"])


def few_tasks(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``df`` in no more than so many tasks for each core: what a task returns
    grows with the columns it saw, not with its rows, so many small tasks would
    hand over the same sums many times. Rows stream, none is moved."""
    return df.coalesce(per_core * df.sparkSession.sparkContext.defaultParallelism)


def task_count(df: DataFrame) -> int:
    """Partitions that hold rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def summed(partials: DataFrame, rows: int, width: int, tasks: int | None = None) -> np.ndarray:
    """Sum of the tasks' partial sums, ``rows`` x ``width``."""
    def add(table: pa.Table) -> pa.Table:
        total, touched = np.zeros((RANGE, width)), np.zeros(RANGE, dtype=bool)
        part = table.column("part")[0].as_py()
        for _, cols, sums in sorted(zip(*(table.column(c).to_pylist() for c in ("source", "cols", "sums")))):
            at = np.frombuffer(cols, np.int32) - part * RANGE
            total[at] += np.frombuffer(sums).reshape(-1, width)
            touched[at] = True
        at = np.flatnonzero(touched)
        return pa.table({"part": pa.array([part], pa.int32()), "source": pa.array([0], pa.int32()),
                         "cols": pa.array([(at + part * RANGE).astype(np.int32).tobytes()], pa.binary()),
                         "sums": pa.array([total[at].tobytes()], pa.binary())})

    if tasks is None or tasks * rows * width * 8 > DIRECT:
        partials = partials.groupBy("part").applyInArrow(add, SUMS)
    out = np.zeros((rows, width))
    for _, cols, sums in sorted((r["source"], bytes(r["cols"]), bytes(r["sums"])) for r in partials.collect()):
        out[np.frombuffer(cols, np.int32)] += np.frombuffer(sums).reshape(-1, width)
    return out


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of an Arrow list column; a null list is empty."""
    import pyarrow.compute as pc

    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), lens


def parts(flat: np.ndarray, lens: np.ndarray, most: int = 1 << 18):
    """Runs of rows of list values, (values, lengths), with ``most`` values at
    most (or one row), so that a batch of long rows needs no more memory than
    one of short rows."""
    ends = np.cumsum(lens)
    row = start = 0
    while row < len(lens):
        to = max(row + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield flat[start:ends[to - 1]], lens[row:to]
        row, start = to, int(ends[to - 1])


def counted(flat: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, times) of the distinct values (below ``n``) of every row."""
    keys = np.repeat(np.arange(len(lens)), lens) * n + flat
    keys.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    keys, times = keys[first], np.diff(first, append=len(keys))
    return keys // n, keys % n, times
