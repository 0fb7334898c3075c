"""Exact percentiles that never gather a whole column in one task.

Spark's ``percentile`` is exact but merges every distinct value of the column
in a single final task. That is fine below a checked row count; above it this
module finds the same values (Spark's interpolation:
``(hi - pos) * v_lo + (pos - lo) * v_hi`` at ``pos = p * (n - 1)``, or ``v_lo``
when both neighbours are equal) with bounded work per task:

1. per column, ``percentile_approx`` gives ``B`` bucket boundaries (partial
   aggregation, small sketches);
2. ``Bucketizer`` assigns rows to buckets and one aggregate counts rows per
   (column, bucket) - at most ``columns x B`` rows reach the driver;
3. the running counts locate the bucket and local rank of every order
   statistic needed; only those buckets are scanned, first collapsed to
   distinct values (so a value held by a third of all rows is one row), then
   ranked by a window per bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 2_000_000   # below this, Spark's percentile (one merge task) is used
MAX_BUCKETS = 100_000


def _positions(n: int, probs):
    out = []
    for p in probs:
        pos = p * (n - 1)
        out.append((pos, math.floor(pos), math.ceil(pos)))
    return out


def _interp(pos, lo, hi, v_lo, v_hi):
    if lo == hi or v_lo == v_hi:
        return v_lo
    return (hi - pos) * v_lo + (pos - lo) * v_hi


def exact_quantiles(df: DataFrame, cols: dict[str, Column], probs,
                    small_rows: int = SMALL_ROWS, bucket_rows: int | None = None) -> dict:
    """``{name: [q(p) for p in probs]}`` (``None`` for an all-NULL column)."""
    probs = list(probs)
    names = list(cols)
    wide = df.select(*[c.cast("double").alias(n) for n, c in cols.items()])
    counts = wide.agg(*[F.count(n).alias(n) for n in names]).first().asDict()
    if all(counts[n] <= small_rows for n in names):
        arr = F.array(*[F.lit(float(p)) for p in probs])
        row = wide.agg(*[F.percentile(n, arr).alias(n) for n in names]).first()
        return {n: (list(row[n]) if row[n] is not None else [None] * len(probs)) for n in names}
    return _bucketed(wide, names, counts, probs, bucket_rows or max(1, small_rows // 4))


def _bucketed(wide: DataFrame, names, counts, probs, bucket_rows: int) -> dict:
    spark = wide.sparkSession
    live = [n for n in names if counts[n] > 0]
    result = {n: [None] * len(probs) for n in names}
    if not live:
        return result
    b = {n: int(min(MAX_BUCKETS, max(2, math.ceil(counts[n] / bucket_rows)))) for n in live}
    # 1) approximate boundaries per column
    sketches = wide.agg(*[
        F.percentile_approx(n, F.array(*[F.lit(i / b[n]) for i in range(1, b[n])]),
                            max(10_000, 10 * b[n])).alias(n) for n in live]).first()
    splits = {}
    for n in live:
        inner = sorted(set(float(x) for x in sketches[n]))
        splits[n] = [-math.inf] + inner + [math.inf]
    # 2) bucket counts
    bcols = [f"{n}__b" for n in live]
    bucketed = Bucketizer(inputCols=live, outputCols=bcols,
                          splitsArray=[splits[n] for n in live],
                          handleInvalid="keep").transform(wide.select(*live))
    long = bucketed.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("k"), F.col(n).alias("v"), F.col(f"{n}__b").cast("int").alias("b"))
        for n in live])).alias("s")).select("s.*").where(F.col("v").isNotNull())
    per_bucket = long.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    table = {}
    for r in per_bucket:
        table.setdefault(r["k"], []).append((r["b"], r["n"]))
    # 3) locate every needed rank
    wanted = []  # (k, rank, bucket, local_rank)
    for n in live:
        rows = sorted(table.get(n, []))
        needed = sorted({r for _, lo, hi in _positions(counts[n], probs) for r in (lo, hi)})
        run, i = 0, 0
        for bk, cnt in rows:
            while i < len(needed) and needed[i] < run + cnt:
                wanted.append((n, needed[i], bk, needed[i] - run))
                i += 1
            run += cnt
    tdf = spark.createDataFrame(wanted, "k string, r long, b int, lr long")
    targets = tdf.select("k", "b").distinct()
    distinct = (long.join(F.broadcast(targets), ["k", "b"], "left_semi")
                .groupBy("k", "b", "v").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("k", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn("cum", F.sum("n").over(w))
    hit = ranked.join(F.broadcast(tdf), ["k", "b"]).where(
        (F.col("lr") < F.col("cum")) & (F.col("lr") >= F.col("cum") - F.col("n")))
    value = {(r["k"], r["r"]): r["v"] for r in hit.select("k", "r", "v").collect()}
    for n in live:
        result[n] = [_interp(pos, lo, hi, value[(n, lo)], value[(n, hi)])
                     for pos, lo, hi in _positions(counts[n], probs)]
    return result


def exact_quantile(df: DataFrame, col: Column | str, prob: float, **kw):
    c = F.col(col) if isinstance(col, str) else col
    return exact_quantiles(df, {"x": c}, [prob], **kw)["x"][0]
