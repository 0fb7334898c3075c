"""K-means over dense vectors, all starts in step (M2).

The vectors are staged once as binary records of about ``_RECORD`` bytes, so
that an Arrow batch of them is one matrix, small whatever the table's size, and
nothing is cached. One Spark job serves one Lloyd step of every start that has
not settled: a task multiplies its rows with all centres at once and returns
sums, counts and costs per centre, so ten starts cost the passes of the slowest
one. First centres are drawn by squared distance (k-means++) from a bounded
sample, ``SAMPLE`` rows of least hash; the steps and costs cover every row. The
lowest cost wins, the first of equals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, stage
from .partials import SUMS, few_tasks, lists, partial_sums, summed, task_count

SAMPLE = 10_000
_RECORD = 2_048          # bytes: the batches of a task have thousands of records
_ROWS = 1_024            # rows multiplied at once
_TASKS = 4               # tasks of a step for every core
_BLOCK = "rows int, data binary"


@dataclass
class Start:
    centres: np.ndarray
    cost: float            # of the assignment to ``centres``
    steps: int
    settled: bool


def dense(column, dim: int, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, which rows are vectors) of an Arrow list column: rows that are
    null, of another length or with a null or non-finite component are none."""
    flat, lens = lists(column)
    right = lens == dim
    matrix = np.full((len(lens), dim), np.nan, dtype=kind)
    matrix[right] = flat[np.repeat(right, lens)].astype(kind).reshape(-1, dim)
    return matrix, np.isfinite(matrix).all(axis=1)


def block_kind(vectors: DataFrame) -> type:
    """Single precision holds an array<float> as it is, in half the memory."""
    return np.float32 if vectors.dtypes[0][1] == "array<float>" else np.float64


def records(matrix: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(rows, bytes) of runs of rows, of about ``_RECORD`` bytes each."""
    width = matrix.shape[1] * matrix.itemsize
    per = max(1, _RECORD // max(1, width))
    ends = np.minimum(np.arange(0, len(matrix) + per, per), len(matrix))
    raw = pa.py_buffer(np.ascontiguousarray(matrix).view(np.uint8).ravel())
    data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)), raw])
    return pa.array(np.diff(ends).astype(np.int32)), data


def matrix_of(rows: int, data: pa.Array, dim: int) -> np.ndarray:
    """The rows of records; the bytes are not copied."""
    if not rows or not dim:
        return np.zeros((rows, dim))
    data = data.cast(pa.large_binary())
    _, ends, raw = data.buffers()
    ends = np.frombuffer(ends, np.int64)[data.offset:data.offset + len(data) + 1]
    raw = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]]
    return raw.view(np.float32 if raw.size == rows * dim * 4 else np.float64).reshape(rows, dim)


def blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """The rows of one list column that are vectors, as a staged table."""
    kind = block_kind(vectors)

    def pack(batches):
        for batch in batches:
            matrix, right = dense(batch.column(0), dim, kind)
            if right.any():
                yield pa.RecordBatch.from_arrays(list(records(matrix[right])), names=["rows", "data"])
    return stage(vectors.mapInArrow(pack, _BLOCK), "blocks")


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance) of rows; of equals the first."""
    d = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    k = d.argmin(axis=1)
    return k, np.maximum(d[np.arange(len(x)), k] + (x * x).sum(axis=1), 0.0)


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """First centres of one start, from sample rows."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        far = nearest(x, np.array(centres))[1]
        total = far.sum()
        centres.append(x[rng.choice(len(x), p=far / total) if total > 0 else rng.integers(len(x))])
    return np.array(centres)


def _add(total: np.ndarray, x: np.ndarray, centres: np.ndarray, k: int, price: bool) -> None:
    """Adds the rows' sums and counts (and with ``price`` costs) per centre of
    every start: all starts' distances in one product, all their sums in another."""
    dim = x.shape[1]
    square = (centres * centres).sum(axis=1)[:, None]
    for from_ in range(0, len(x), _ROWS):
        some = x[from_:from_ + _ROWS].astype(np.float64, copy=False)
        d = (square - 2 * (centres @ some.T)).reshape(-1, k, len(some))
        least, at = d[:, 0].copy(), np.zeros((len(d), len(some)), dtype=np.int16)
        for j in range(1, k):       # of equals the first
            np.copyto(at, j, where=d[:, j] < least)
            np.minimum(least, d[:, j], out=least)
        member = np.stack([at == j for j in range(k)], axis=1).astype(np.float64)
        flat = member.reshape(-1, len(some))
        total[:, :dim] += flat @ some
        total[:, dim] += flat.sum(axis=1)
        if price:
            far = np.maximum(least + (some * some).sum(axis=1), 0.0)
            total[:, dim + 1] += (member * far[:, None, :]).sum(axis=2).ravel()


def lloyd(data: DataFrame, firsts: list[np.ndarray], max_steps: int, tol: float = 1e-4) -> list[Start]:
    """Lloyd steps of all starts over records (rows, data) until no centre
    moves by more than ``tol`` or ``max_steps`` are done. An empty cluster
    keeps its centre."""
    sc, data = data.sparkSession.sparkContext, few_tasks(data.select("rows", "data"), _TASKS)
    tasks = task_count(data)
    k, dim = firsts[0].shape
    starts = [Start(c, np.inf, 0, False) for c in firsts]

    def step(live: list[Start], price: bool = False) -> np.ndarray:
        shared = sc.broadcast(np.concatenate([s.centres for s in live]))
        n = len(live)

        def task(batches):
            total = np.zeros((n * k, dim + 2))
            for batch in batches:
                rows = int(batch.column(0).to_numpy().sum())
                _add(total, matrix_of(rows, batch.column(1), dim), shared.value, k, price)
            yield partial_sums(total, np.ones(n * k, dtype=bool))

        out = summed(data.mapInArrow(task, SUMS), n * k, dim + 2, tasks)
        shared.destroy()
        return out.reshape(n, k, dim + 2)

    while live := [s for s in starts if not s.settled and s.steps < max_steps]:
        for s, sums in zip(live, step(live)):
            counts = sums[:, dim:dim + 1]
            moved = np.where(counts > 0, sums[:, :dim] / np.maximum(counts, 1), s.centres)
            s.settled = bool((((moved - s.centres) ** 2).sum(axis=1) <= tol * tol).all())
            s.centres, s.steps = moved, s.steps + 1
    for s, sums in zip(starts, step(starts, price=True)):
        s.cost = float(sums[:, dim + 1].sum())
    return starts


def least_hashes(hashed: DataFrame, column: str) -> pa.Array:
    """``column`` of the ``SAMPLE`` rows of least ``h``. The hashes alone are
    ordered first: every task would else hand over SAMPLE whole rows."""
    last = hashed.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    few = hashed.where(F.col("h") <= F.lit(last)).orderBy("h").limit(SAMPLE).select(column).toArrow()
    return few.column(0).combine_chunks()


def from_sample(data: DataFrame, sample: np.ndarray, k: int, starts: int, max_steps: int, seed: int) -> list[Start]:
    """All starts over records, their first centres from sample rows."""
    if not len(sample):
        raise ValueError("no vectors to cluster")
    return lloyd(data, [plus_plus(sample, k, seed + s) for s in range(starts)], max_steps)


def fit(vectors: DataFrame, dim: int, k: int, starts: int, max_steps: int, seed: int) -> list[Start]:
    """All starts over ``vectors`` (a staged table with one list column)."""
    column = vectors.columns[0]
    hashed = vectors.where(F.col(column).isNotNull()).withColumn("h", F.xxhash64(column))
    sample, right = dense(least_hashes(hashed, column), dim)
    data = blocks(vectors, dim)
    try:
        return from_sample(data, sample[right], k, starts, max_steps, seed)
    finally:
        release(data)


def best(starts: list[Start]) -> Start:
    return min(starts, key=lambda s: s.cost)
