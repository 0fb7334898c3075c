"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits by random directions: at every level a node sends vectors
below its upper cut to the left and vectors above its lower cut to the right,
so vectors between the cuts (``SPILL`` of the node) go both ways. Cuts are
quantiles of a bounded sample (``SAMPLE`` vectors taken by a hash); nodes that
hold too few sample vectors use the level's overall quantiles. The depth follows
the number of rows of a vector's label, so leaves keep about ``LEAF`` vectors at
every size; larger leaves are cut into blocks whose pairs are all compared, so
nothing is capped.

Cuts inside a dense group would part its linked pairs at every level, so dense
groups stay out of the trees. A ball is a centre of sample vectors with at least
``MIN_CORE`` of them within the threshold's angle. Every vector within that angle
of a centre is of the core of the first such ball; a vector that links with it is
within twice the angle, by the triangle inequality, and meets it there. So all
pairs with a core vector are compared, exactly once, in the ball of the lower
number; the trees hold the other vectors only.

Within a leaf, vectors of equal label and length are compared by cosine in
double precision. A pair of the trees is counted only in the first tree and leaf that both
share, which makes link counts exact sums over leaves without shuffling pairs;
a leaf passes on its counts and a spanning forest of its links, not all pairs.

Identical vectors of a label are one class with a weight, so copies are never
expanded. Components are joined over classes.

Defined results: a vector that is null, empty, zero, or holds null or
non-finite components, a null label or a null id links with nothing and is
its own component (a null id has a null component and is not kept); vectors
of different lengths do not link; repeated ids are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sevscope.llm.common import block_pairs, broadcast_if_small, connected_components
from sevscope.session import stage

THRESHOLD = 0.93
TREES, LEAF, SPILL = 12, 256, 0.10
SAMPLE, MIN_FIT, MIN_CORE = 20_000, 64, 16
BLOCK = 1024


class Trees:
    """Directions and cuts of a forest for vectors of one length."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int):
        rng = np.random.Generator(np.random.PCG64([seed, sample.shape[1]]))
        self.depth, self.trees = depth, trees
        self.directions = rng.standard_normal((sample.shape[1], trees * depth))
        shadow = sample @ self.directions
        quantiles = [0.5 - spill / 2, 0.5 + spill / 2]
        self.general = np.quantile(shadow, quantiles, axis=0) if len(sample) else np.zeros((2, trees * depth))
        self.cuts: list[list[dict[int, tuple[float, float]]]] = []
        for t in range(trees):
            levels, held = [], {0: np.arange(len(sample))}
            for level in range(depth):
                p, cuts, below = shadow[:, t * depth + level], {}, {}
                for node, rows in held.items():
                    if len(rows) < MIN_FIT:
                        continue
                    lo, hi = np.quantile(p[rows], quantiles)
                    cuts[node] = (float(lo), float(hi))
                    below[2 * node], below[2 * node + 1] = rows[p[rows] <= hi], rows[p[rows] >= lo]
                levels.append(cuts)
                held = below
            self.cuts.append(levels)

    def route(self, unit: np.ndarray, depth: int):
        """For each tree: (row numbers, leaf numbers), a row once per leaf at
        ``depth``."""
        shadow = unit @ self.directions
        for t in range(self.trees if depth else 1):
            rows, nodes = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
            for level in range(depth):
                c = t * self.depth + level
                lo = np.full(len(nodes), self.general[0, c])
                hi = np.full(len(nodes), self.general[1, c])
                known = self.cuts[t][level]
                if known:
                    names, at = np.unique(nodes, return_inverse=True)
                    table = np.array([known.get(int(x), tuple(self.general[:, c])) for x in names])
                    lo, hi = table[at, 0], table[at, 1]
                p = shadow[rows, c]
                left, right = p <= hi, p >= lo
                rows = np.concatenate([rows[left], rows[right]])
                nodes = np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
            yield t, rows, nodes


def find_balls(unit: np.ndarray, threshold: float, least: int = MIN_CORE) -> np.ndarray:
    """Centres of the dense groups of a sample: the mean of a vector's
    neighbours, while at least ``least`` vectors that are in no ball yet are
    within the threshold of it. Vectors with most neighbours come first."""
    near = np.concatenate([np.zeros(0, np.int64), *((unit[a:a + BLOCK] @ unit.T >= threshold).sum(axis=1)
                                                    for a in range(0, len(unit), BLOCK))])
    free, rest, centres = np.ones(len(unit), dtype=bool), unit, []
    for i in np.argsort(-near, kind="stable"):
        if near[i] < least:
            break
        if not free[i]:
            continue
        mine = rest[rest @ unit[i] >= threshold]
        if len(mine) < least:
            continue
        centre = mine.sum(axis=0)
        centre /= np.sqrt(centre @ centre)
        inside = unit @ centre >= threshold
        if (inside & free).sum() >= least:
            centres.append(centre)
            free &= ~inside
            rest = unit[free]
    return np.array(centres).reshape(-1, unit.shape[1])


def _unit(blobs) -> np.ndarray:
    x = np.stack([np.frombuffer(b, dtype=np.float64) for b in blobs])
    x = x / np.abs(x).max(axis=1, keepdims=True)      # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(batches):
    """Arrow pass: the vector column as the bytes of its doubles."""
    for batch in batches:
        vectors = batch.column(batch.num_columns - 1)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum([0, *(len(v) for v in vectors)])
        blobs = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(blobs, pa.binary())],
                                         names=batch.schema.names[:-1] + ["vector"])


_ROUTED = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("dim", T.IntegerType()),
    T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.LongType()),
    T.StructField("code", T.LongType()), T.StructField("n", T.LongType()), T.StructField("core", T.BooleanType()),
    T.StructField("vector", T.BinaryType()), T.StructField("leaves", T.BinaryType())])
BALL = -1   # the tree number of balls


def _route(side, threshold: float):
    """Arrow pass over classes with the depth of their label: one row per ball
    and per tree and leaf that a vector reaches, with all its leaves (tree
    number and leaf number pairs)."""
    reach = 2 * min(1.0, max(-1.0, threshold)) ** 2 - 1 - 1e-9 if threshold > 0 else -2.0

    def run(batches):
        forest, balls = side.value
        none = np.zeros(0, dtype=np.int64).tobytes()
        for batch in batches:
            d = batch.to_pydict()
            groups: dict[tuple, list] = {}
            for i, key in enumerate(zip(d["label"], d["dim"], d["depth"])):
                groups.setdefault((key[0] if key[:2] in balls else None, *key[1:]), []).append(i)
            for (label, dim, depth), at in groups.items():
                at = np.array(at)
                blobs = [d["vector"][i] for i in at]
                unit = _unit(blobs)
                met, out = np.full(len(at), -1), []
                if label is not None:
                    cosine = unit @ balls[label, dim].T
                    core = cosine >= threshold
                    met = np.where(core.any(axis=1), core.argmax(axis=1), -1)
                    last = np.where(met < 0, cosine.shape[1], met)
                    rows, ball = np.nonzero((cosine >= reach) & (np.arange(cosine.shape[1]) < last[:, None]))
                    own = np.flatnonzero(met >= 0)
                    rows, ball = np.concatenate([own, rows]), np.concatenate([met[own], ball])
                    out.append((BALL, rows, ball, np.arange(len(rows)) < len(own), [none] * len(rows)))
                loose = np.flatnonzero(met < 0)
                trees = forest.get(dim)
                routed = (list(trees.route(unit[loose], depth)) if trees is not None
                          else [(0, np.arange(len(loose)), np.zeros(len(loose), dtype=np.int64))])
                leaves = [[] for _ in loose]
                for t, rows, nodes in routed:
                    for r, leaf in zip(rows.tolist(), nodes.tolist()):
                        leaves[r] += (t, leaf)
                packed = [np.array(o, dtype=np.int64).tobytes() for o in leaves]
                out += [(t, loose[rows], nodes, np.zeros(len(rows), dtype=bool), [packed[r] for r in rows])
                        for t, rows, nodes in routed]
                for t, rows, nodes, core, kept in out:
                    pick = at[rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d["label"][i] for i in pick], pa.string()),
                        pa.array(np.full(len(rows), dim), pa.int32()), pa.array(np.full(len(rows), t), pa.int32()),
                        pa.array(nodes, pa.int64()), pa.array([d["code"][i] for i in pick], pa.int64()),
                        pa.array([d["n"][i] for i in pick], pa.int64()), pa.array(core, pa.bool_()),
                        pa.array([blobs[r] for r in rows], pa.binary()),
                        pa.array(kept, pa.binary())], names=_ROUTED.names)
    return run


def _met_before(leaves: list, a: np.ndarray, b: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Of pairs of places (a, b) in a leaf, those that also share an earlier
    leaf: one of an earlier tree, or a lower one of this tree."""
    early = [o[(o[:, 0] < tree) | ((o[:, 0] == tree) & (o[:, 1] < leaf))] for o in leaves]
    width = max((len(o) for o in early), default=0)
    if not width:
        return np.zeros(len(a), dtype=bool)
    table = np.full((len(early), width, 2), -1, dtype=np.int64)
    for k, o in enumerate(early):
        table[k, :len(o)] = o
    out = np.zeros(len(a), dtype=bool)
    for i in range(width):
        x = table[a, i]
        for j in range(width):
            y = table[b, j]
            out |= (x[:, 0] == y[:, 0]) & (x[:, 1] == y[:, 1]) & (x[:, 0] >= 0)
    return out


def _compare(threshold: float):
    """Group function: per vector of a leaf (or pair of its blocks) the weight
    of its new links, and a spanning forest of the links. Rows are
    (code, links) or (code, other)."""
    def run(group: pa.Table) -> pa.Table:
        d = group.to_pydict()
        n = len(d["code"])
        unit = _unit(d["vector"])
        own = np.array(d["own"])
        leaves = [np.frombuffer(x, dtype=np.int64).reshape(-1, 2) for x in d["leaves"]]
        weight = np.array(d["n"], dtype=np.int64)
        core, ball = np.array(d["core"], dtype=bool), d["tree"][0] == BALL
        lo, hi = d["lo"][0], d["hi"][0]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        links, part, edges = np.zeros(n, dtype=np.int64), np.arange(n), []
        for s in range(0, len(left), 256):
            rows = left[s:s + 256]
            near = unit[rows] @ unit[right].T >= threshold
            if lo == hi:
                near &= rows[:, None] < right[None, :]
            if ball:
                near &= core[rows][:, None] | core[right][None, :]
            else:
                x, y = np.nonzero(near)
                for k in range(0, len(x), 100_000):
                    x_, y_ = x[k:k + 100_000], y[k:k + 100_000]
                    met = _met_before(leaves, rows[x_], right[y_], d["tree"][0], d["leaf"][0])
                    near[x_[met], y_[met]] = False
            links[rows] += np.where(near, weight[right], 0).sum(axis=1)
            links[right] += np.where(near, weight[rows][:, None], 0).sum(axis=0)
            for k in np.flatnonzero(near.any(axis=1)):
                i, others = rows[k], right[near[k]]
                parts, first = np.unique(part[others], return_index=True)
                for p, j in zip(parts.tolist(), others[first].tolist()):
                    if p != part[i]:
                        edges.append((int(i), j))
                        part[part == p] = part[i]
        hit = np.flatnonzero(links)
        code = d["code"]
        return pa.table({
            "code": pa.array([code[i] for i in hit] + [code[i] for i, _ in edges], pa.int64()),
            "links": pa.array(links[hit].tolist() + [None] * len(edges), pa.int64()),
            "other": pa.array([None] * len(hit) + [code[j] for _, j in edges], pa.int64())})
    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL,
                    sample: int = SAMPLE, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(key, n_links, component_id, kept) for every vector."""
    spark = vectors.sparkSession
    v = F.col(embedding)
    valid = (F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0)
             & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
             & F.exists(v, lambda x: x != 0))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"),
                          F.coalesce(valid, F.lit(False)).alias("ok"))
    rows = rows.withColumn("code", F.when(F.col("ok"), F.xxhash64("label", "v")))
    packed = T.StructType([T.StructField("code", T.LongType()), T.StructField("label", T.StringType()),
                           T.StructField("dim", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("least", vectors.schema[key].dataType), T.StructField("vector", T.BinaryType())])
    classes = stage(rows.where("ok").groupBy("code", "label", "v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
                    .select("code", "label", F.size("v").alias("dim"), "n", "least", "v").mapInArrow(_pack, packed),
                    "rp_classes")
    level = F.greatest(F.lit(0.0), F.ceil(F.log2(F.count("*") / F.lit(leaf)))).cast("int")
    depths = stage(classes.groupBy("label", "dim").agg(level.alias("depth")), "rp_depths")
    depth = depths.agg(F.max("depth")).first()[0] or 0
    ins = classes.join(broadcast_if_small(depths), ["label", "dim"]).select("code", "label", "dim", "n", "depth", "vector")
    forest, balls = {}, {}
    if depth:
        taken = ins.select("code", "label", "dim", "depth", "vector").orderBy(F.xxhash64("code")).limit(sample).toPandas()
        for dim, part in taken.groupby("dim"):
            forest[int(dim)] = Trees(_unit(part["vector"]), depth, trees, spill, seed)
        for (name, dim), part in taken[taken["depth"] > 0].groupby(["label", "dim"]):
            centres = find_balls(_unit(part["vector"]), threshold)
            if len(centres):
                balls[name, int(dim)] = centres
    side = spark.sparkContext.broadcast((forest, balls))
    routed = stage(ins.mapInArrow(_route(side, threshold), _ROUTED), "rp_leaves")
    keys = ["label", "dim", "tree", "leaf"]
    found = stage(block_pairs(routed, keys, "code", block).groupBy(*keys, "lo", "hi")
                  .applyInArrow(_compare(threshold), "code long, links long, other long"), "rp_links")
    roots = connected_components(found.where("other IS NOT NULL"), "code", "other")
    links = found.where("links IS NOT NULL").groupBy("code").agg(F.sum("links").alias("links"))
    placed = stage(classes.select("code", "n", "least").join(roots.withColumnRenamed("node", "code"), "code", "left")
                   .join(links, "code", "left").withColumn("root", F.coalesce("root", "code")), "rp_placed")
    least = stage(placed.groupBy("root").agg(F.min("least").alias("component")), "rp_least")
    facts = stage(placed.join(least, "root").select(
        "code", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "rp_facts")
    out = rows.select("id", "code").join(broadcast_if_small(facts), "code", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
