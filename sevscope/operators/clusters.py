"""Ticket clusters (M1, M2): text or given vectors to a saved cluster model.

A ``ClusterModel`` gives prepared tickets a ``cluster``: the nearest centre of
the vector of an ``embedding`` column, or of a vector of the whole text. Text
vectors are unit-length TF-IDF over hashed Unicode words (2^18 slots), reduced
to ``DIM`` dense columns by a seeded random projection (``SIGNS`` columns a slot
with random signs), so that k-means passes over short dense rows and a centre
is a few hundred numbers. The model is fitted once per batch, saved with the
signal model and applied to later batches and streams.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MLConfig
from ..functions import words
from ..session import is_staged, release, stage
from . import kmeans
from .partials import SUMS, counted, few_tasks, lists, partial_sums, parts, summed

#: Text between words: everything but letters, numbers and underscore.
WORD_GAP = r"[^\p{L}\p{N}_]+"
VECTOR = "__vector"
DIM, SIGNS = 256, 4


def weight_stages(cfg: MLConfig, terms: str = "__tf", vector: str = VECTOR):
    """M1: hashed term frequencies -> IDF -> unit length."""
    return [
        IDF(inputCol=terms, outputCol="__tfidf", minDocFreq=cfg.min_doc_freq),
        Normalizer(inputCol="__tfidf", outputCol=vector, p=2.0),
    ]


def word_slots(text: Column, num_features: int) -> Column:
    """Hashed slots of all words of a text, in order."""
    return words.hashed_slots(F.lower(text), num_features)


def inverse_frequencies(slots: DataFrame, num_features: int, min_doc_freq: int) -> np.ndarray:
    """log((rows + 1) / (rows with the slot + 1)) by slot, 0 below
    ``min_doc_freq``, over a frame with one column of slots."""
    n = num_features

    def count(batches):
        total, touched = np.zeros((n + 1, 1)), np.zeros(n + 1, dtype=bool)
        touched[n] = True
        for batch in batches:
            for flat, lens in parts(*lists(batch.column(0))):
                total[:n, 0] += np.bincount(counted(flat, lens, n)[1], minlength=n)
                total[n, 0] += len(lens)
        touched[:n] = total[:n, 0] > 0
        yield partial_sums(total, touched)

    held = summed(few_tasks(slots).mapInArrow(count, SUMS), n + 1, 1)[:, 0]
    return np.where(held[:n] >= max(1, min_doc_freq), np.log((held[n] + 1) / (held[:n] + 1)), 0.0)


def projection(num_features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For every slot ``SIGNS`` columns and their entries, by the seed."""
    rng = np.random.default_rng(seed)
    return (rng.integers(DIM, size=(num_features, SIGNS)),
            rng.choice([-1.0, 1.0], size=(num_features, SIGNS)) / np.sqrt(SIGNS))


def project(flat: np.ndarray, lens: np.ndarray, weight: np.ndarray, table) -> np.ndarray:
    """Projected unit-length TF-IDF rows of slot lists; a row without weighted
    words is zero."""
    done = [_projected(*part, weight, table) for part in parts(flat, lens)]
    return np.concatenate(done) if done else np.zeros((0, DIM))


def _projected(flat: np.ndarray, lens: np.ndarray, weight: np.ndarray, table) -> np.ndarray:
    n, where, entry = len(weight), *table
    row, slot, times = counted(flat, lens, n)
    value = times * weight[slot]
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(lens)))
    value = value / np.where(norm > 0, norm, 1.0)[row]
    out = np.zeros(len(lens) * DIM)
    for s in range(SIGNS):
        out += np.bincount(row * DIM + where[slot, s], weights=value * entry[slot, s], minlength=len(out))
    return out.reshape(-1, DIM)


_TABLES: dict[tuple[int, int], tuple] = {}


def _table(num_features: int, seed: int):
    if (num_features, seed) not in _TABLES:
        _TABLES[num_features, seed] = projection(num_features, seed)
    return _TABLES[num_features, seed]


@dataclass
class ClusterModel:
    """Centres, and for texts the slots' weights and the projection's seed."""
    centres: np.ndarray
    costs: list                         # of all starts
    weight: np.ndarray | None = None    # None: vectors are given
    seed: int = 0

    def cluster(self) -> Column:
        """The nearest centre's number; null without a vector."""
        centres, weight, seed = self.centres, self.weight, self.seed
        if weight is None:
            @F.arrow_udf("int")
            def given(vector: pa.Array) -> pa.Array:
                x, right = kmeans.dense(vector, centres.shape[1])
                return pa.array(kmeans.nearest(np.where(right[:, None], x, 0.0), centres)[0].astype(np.int32), mask=~right)
            return given("embedding")

        @F.arrow_udf("int")
        def of_text(slots: pa.Array) -> pa.Array:
            x = project(*lists(slots), weight, _table(len(weight), seed))
            return pa.array(kmeans.nearest(x, centres)[0].astype(np.int32))
        return of_text(word_slots(F.col("full_text"), len(weight)))

    def assign_vectors(self, table: DataFrame) -> DataFrame:
        """The table of ``fit_words`` with ``cluster`` in the vectors' place; no
        row waits for its cluster in the JVM, as it would beside a function."""
        others, centres = [c for c in table.columns if c not in ("h", "data")], self.centres

        def nearest(batches):
            for batch in batches:
                x = kmeans.matrix_of(batch.num_rows, batch.column("data"), DIM)
                found = pa.array(kmeans.nearest(x, centres)[0].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.select(others).columns, found], names=[*others, "cluster"])

        return table.select(*others, "data").mapInArrow(nearest, f"{_schema(table, others)}, cluster int")

    def save(self, spark: SparkSession, path: str) -> None:
        meta = json.dumps({"centres": self.centres.tolist(), "costs": self.costs, "seed": self.seed,
                           "slots": None if self.weight is None else len(self.weight)})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        if self.weight is not None:
            at = np.flatnonzero(self.weight)
            spark.createDataFrame(pa.table({"slot": pa.array(at, pa.int64()), "weight": pa.array(self.weight[at])})) \
                 .coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ClusterModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        slots, weight = meta.pop("slots"), None
        if slots is not None:
            rows = spark.read.parquet(f"{path}/weights").toPandas()
            weight = np.zeros(slots)
            weight[rows["slot"].to_numpy()] = rows["weight"].to_numpy()
        return cls(np.array(meta["centres"]), meta["costs"], weight, meta["seed"])


def fit(prepared: DataFrame, cfg: MLConfig | None = None) -> ClusterModel:
    """Cluster model of prepared tickets, from ``embedding`` where present
    (rows without one are left out of the fit), else from ``full_text``."""
    cfg = cfg or MLConfig()
    if "embedding" in prepared.columns:
        vectors = prepared.select("embedding").where(F.col("embedding").isNotNull())
        if not is_staged(prepared):
            vectors = stage(vectors, "vectors")
        length = vectors.select(F.max(F.size("embedding"))).first()[0]
        starts = kmeans.fit(vectors, length or 0, cfg.clusters, cfg.kmeans_starts, cfg.kmeans_iter, cfg.seed)
        release(vectors)
        return ClusterModel(kmeans.best(starts).centres, [s.cost for s in starts])
    slots = stage(prepared.select(word_slots(F.col("full_text"), cfg.num_features).alias("word_slots")), "word_slots")
    model, table = fit_words(slots, cfg)
    release(slots, table)
    return model


def _schema(table: DataFrame, columns: list) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in table.select(columns).dtypes)


def fit_words(found: DataFrame, cfg: MLConfig) -> tuple[ClusterModel, DataFrame]:
    """Cluster model of texts, from a staged table with the column
    ``word_slots``, and a staged table with their vectors in its place: the
    bytes of ``DIM`` numbers, as k-means passes over them."""
    others = [c for c in found.columns if c != "word_slots"]
    weight, seed = inverse_frequencies(found.select("word_slots"), cfg.num_features, cfg.min_doc_freq), cfg.seed

    def vectors_of(batches):
        for batch in batches:
            row, kept = 0, batch.select(others)
            for flat, lens in parts(*lists(batch.column("word_slots"))):
                x = project(flat, lens, weight, _table(len(weight), seed))
                ends = np.arange(len(x) + 1, dtype=np.int32) * DIM
                bytes_ = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x.ravel())])
                yield pa.RecordBatch.from_arrays(
                    [*kept.slice(row, len(x)).columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel())), bytes_],
                    names=[*others, VECTOR, "data"])
                row += len(x)

    kinds = [k for k in (_schema(found, others), f"{VECTOR} array<double>, data binary") if k]
    made = found.mapInArrow(vectors_of, ", ".join(kinds))
    table = stage(made.select(*others, F.xxhash64(VECTOR).alias("h"), "data"), "vectors")
    few = kmeans.least_hashes(table, "data")
    starts = kmeans.from_sample(table.select(F.lit(1).alias("rows"), "data"), kmeans.matrix_of(len(few), few, DIM),
                                cfg.clusters, cfg.kmeans_starts, cfg.kmeans_iter, cfg.seed)
    return ClusterModel(kmeans.best(starts).centres, [s.cost for s in starts], weight, seed), table


def assign(model: ClusterModel, prepared: DataFrame) -> DataFrame:
    """``prepared`` with ``cluster``; NULL where a given vector is missing."""
    return prepared.withColumn("cluster", model.cluster())
