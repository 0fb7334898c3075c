"""Helpers shared by the operators: whole texts as bytes, size-checked
broadcasts, digests and connected components over edge tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevscope.session import stage

#: Rows up to which a counted table may be broadcast (a few MB of long keys).
BROADCAST_ROWS = 200_000
#: Partitions of a table of at most so many rows.
FEW = 8


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


def keeping_columns(docs: DataFrame, made: tuple[str, ...], apply) -> DataFrame:
    """``apply(docs)`` with the columns of ``docs``: columns that carry the name
    of one of ``apply``'s own results are hidden from it and keep their values."""
    hidden = {c: f"__own_{c}" for c in docs.columns if c in made}
    out = apply(docs.withColumnsRenamed(hidden))
    return out.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def row_number_of_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; a null key falls in the fold
    of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a staged table, cheap to count) marked for broadcast while it
    has at most ``limit`` rows; larger ones are left to a shuffle join."""
    return F.broadcast(df) if df.count() <= limit else df


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, name: str, small: bool) -> DataFrame:
    """``pairs(u, v)`` with the least ``v`` of each ``u`` as ``m``. The minima
    of a counted small table are broadcast; else they are a table of their own,
    so that both join sides come straight from an exchange and a hub with very
    many neighbours can be split at run time."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(F.broadcast(few(low, small)) if small else stage(low, name), "u")


def few(df: DataFrame, small: bool) -> DataFrame:
    """``df`` in a few partitions where its counted size is small."""
    return df.coalesce(FEW) if small else df


def _roots(batches):
    """(node, root) of a counted small edge table, in one task."""
    import pyarrow as pa

    place: dict = {}
    edges, kind = [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            edges.append((place.setdefault(u, len(place)), place.setdefault(v, len(place))))
    nodes = list(place)
    forest = Forest(len(nodes))
    for a, b in edges:
        forest.union(a, b)
    least: dict[int, object] = {}
    found = [forest.find(k) for k in range(len(nodes))]
    for node, root in zip(nodes, found):
        least[root] = min(node, least.get(root, node))
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([least[r] for r in found], kind)],
                                         names=["node", "root"])


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge table, root being the
    least node reachable. Alternates large-star and small-star steps; each
    round's edges are a table in the shared folder, so lineage stays short and
    nothing but two numbers a round reaches the driver. A counted small table
    (``BROADCAST_ROWS``) is joined up in one task. Null ends are ignored.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct())
    e = stage(e, "cc")
    before = _state(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    small = before[0] <= BROADCAST_ROWS
    if small:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_roots, f"node {kind}, root {kind}")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "cc_min", small).where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = stage(few(large, small), "cc_large")
        stars = _star(large, "cc_min", small)
        e = stage(few(stars.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(stars.select("u", F.col("m").alias("v"))).distinct(), small), "cc")
        now = _state(e)
        if now == before:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def byte_slices(batches, column: int, limit: int = 1 << 20):
    """The Arrow batches cut so that a binary column holds at most ``limit``
    bytes in each (or a single row), which bounds a task's working arrays."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        ends, at = np.cumsum(sizes.astype(np.int64)), 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def block_pairs(df: DataFrame, keys: list[str], spread: str, size: int) -> DataFrame:
    """Rows of groups, with groups over ``size`` rows cut into blocks.

    Adds ``own`` (the row's block), ``lo`` and ``hi``: each row is repeated for
    every block of its group, so that any two rows of a group meet in exactly
    one (keys, lo, hi). Small groups have the one block pair (0, 0). ``df``
    must be a staged table, it is read twice."""
    big = stage(df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > size)
                .select(*keys, F.ceil(F.col("n") / size).cast("int").alias("blocks")), "blocks")
    out = df.join(broadcast_if_small(big), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("own", F.pmod(F.xxhash64(spread, F.lit("block")), F.col("blocks")).cast("int"))
    return (out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .drop("other", "blocks"))


class Forest:
    """Union-find over the places of a small group; counts nothing away: every
    union that connects two trees is an edge of a spanning forest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
