"""Batch statistics behind the three severity signals.

Two partial aggregates over the prepared tickets: hours per cluster and
overall (a row per cluster plus one reach the driver), and the histogram of
the rule score, which stays a table. The rule score's percentile rank is
computed on its distinct values, never by ranking the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GID_CLUSTER, GID_ALL = 0, 1  # grouping_id() values, see collect_stats()


@dataclass
class BatchStats:
    n: int
    hours_min: float
    hours_max: float
    hours_mean: float
    hours_std: float
    clusters: list           # [(cluster, n, mean_hours)] non-null clusters


def collect_stats(df: DataFrame) -> BatchStats:
    rows = (df.select("cluster", "resolution_hours")
            .groupingSets([["cluster"], []], "cluster")
            .agg(F.grouping_id().alias("gid"),
                 F.count(F.lit(1)).alias("n"),
                 F.avg("resolution_hours").alias("mean_h"),
                 F.min("resolution_hours").alias("min_h"),
                 F.max("resolution_hours").alias("max_h"),
                 F.stddev_pop("resolution_hours").alias("std_h"))).collect()
    glob = [r for r in rows if r["gid"] == GID_ALL]
    if not glob or glob[0]["n"] == 0:
        raise ValueError("empty ticket table")
    g = glob[0]
    clusters = sorted((r["cluster"], r["n"], r["mean_h"]) for r in rows
                      if r["gid"] == GID_CLUSTER and r["cluster"] is not None)
    if not clusters:
        raise ValueError("no ticket has a cluster: the cluster column is NULL everywhere")
    return BatchStats(n=g["n"], hours_min=g["min_h"], hours_max=g["max_h"],
                      hours_mean=g["mean_h"], hours_std=g["std_h"] or 0.0, clusters=clusters)


def rule_histogram(df: DataFrame) -> DataFrame:
    """(rule_tenths, n): one row per distinct rule score."""
    return df.groupBy("rule_tenths").agg(F.count(F.lit(1)).alias("n"))


def score_bucket(t: Column) -> Column:
    """Signed number of binary digits: -32 .. 32, growing with the score."""
    return (F.signum(t) * F.length(F.bin(F.abs(t.cast("long"))))).cast("int")


def _bucket_starts(spark) -> DataFrame:
    """The least score of every bucket."""
    b = F.col("id").cast("int")
    start = (F.when(b > 0, F.pow(F.lit(2.0), b - 1))
             .when(b < 0, -(F.pow(F.lit(2.0), -b) - 1)).otherwise(0.0)).cast("long")
    return spark.range(-32, 33).select(start.alias("rule_tenths"), F.lit(0).cast("long").alias("n"))


def rank_table(histogram: DataFrame) -> DataFrame:
    """W1 on distinct scores: (bucket, rule_tenths, until, n, less).

    ``less`` counts the tickets below the score and ``n`` those at it; the row
    speaks for unseen scores up to ``until`` (exclusive, NULL: no end of its
    bucket). Every one of the 65 buckets has a row for its least score, so a
    score between, below or above the seen ones finds its place too. The
    table has a row per distinct score, however far apart they lie; running
    sums go bucket by bucket, over the buckets' totals across them."""
    spark = histogram.sparkSession
    seen = histogram.where(F.col("rule_tenths").isNotNull()).select(F.col("rule_tenths").cast("long"), "n")
    rows = (seen.unionByName(_bucket_starts(spark)).groupBy("rule_tenths").agg(F.sum("n").alias("n"))
            .withColumn("bucket", score_bucket(F.col("rule_tenths"))))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (rows.groupBy("bucket").agg(F.sum("n").alias("m"))
              .select("bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("below")))
    within = Window.partitionBy("bucket").orderBy("rule_tenths")
    return (rows.withColumns({
                "own": F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "until": F.lead("rule_tenths").over(within)})
            .join(totals, "bucket")
            .select("bucket", "rule_tenths", "until", "n", (F.col("below") + F.col("own")).alias("less")))


def exact_norm(total: int) -> Column:
    """Percentile rank with ties averaged, times 3, of a seen score:
    ``3 * (less + (n + 1) / 2) / total``."""
    return F.lit(3.0) * (F.col("less") + (F.col("n") + 1) / 2.0) / F.lit(float(total))


def gap_norm(total: int) -> Column:
    """The same for an unseen score after a row (no ticket at it)."""
    return F.lit(3.0) * (F.col("less") + F.col("n") + 0.5) / F.lit(float(total))


def moments(values: DataFrame, value: str, count: str) -> tuple:
    """(mean, population std, min, max) of values with their counts."""
    v, c = F.col(value), F.col(count)
    first = values.agg((F.sum(v * c) / F.sum(c)).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if first["mean"] is None:
        return None, None, None, None
    d = v - F.lit(float(first["mean"]))
    var = values.agg((F.sum(c * d * d) / F.sum(c)).alias("var")).first()["var"]
    return first["mean"], var ** 0.5, first["lo"], first["hi"]


def cluster_ranks(clusters: list) -> dict:
    """Clusters ordered by mean hours (ties by id) -> severity 0..k-1."""
    ordered = sorted(clusters, key=lambda r: (r[2], r[0]))
    return {c: i for i, (c, _, _) in enumerate(ordered)}


def weighted_moments(pairs) -> tuple:
    """(mean, population std) of values given as (value, count) pairs."""
    total = sum(c for _, c in pairs)
    if total == 0:
        return None, None
    mean = sum(v * c for v, c in pairs) / total
    var = sum(c * (v - mean) ** 2 for v, c in pairs) / total
    return mean, var ** 0.5
