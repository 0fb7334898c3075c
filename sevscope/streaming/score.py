"""Structured Streaming scoring of tickets.

Both modes are stateless per row, so they run as plain stream projections
(plus stream-static joins) with no state store:

* ``fixed``  - the interactive single-ticket rules: a lone ticket has rule
  percentile 3 and resolution severity 0, its cluster severity comes from the
  rule score (F11), the signals are centred at 1.5 (F12) and bucketed by fixed
  cuts (F10). A ticket without a usable time gets no score and falls to
  ``critical``, as in the reference.
* ``frozen`` - a ``SignalModel`` fitted on a batch and loaded from storage;
  every ticket gets the label it would get in that batch, whenever it arrives.

``run_available`` drives a stream with ``trigger(availableNow=True)`` into a
Parquet sink with a checkpoint in the shared folder (exactly-once file sink,
restartable after a lost executor or driver) and returns the sink as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SINGLE_CENTRE, AuditConfig
from ..functions import severity as sev
from ..operators import fusion
from ..session import shared_path
from ..sources import raw as sources

FIXED_COLUMNS = ("ticket_id", "rule_score", "cluster_severity", "inferred_severity_score",
                 "inferred_severity", "severity_delta")


def score_fixed(tickets: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """X1 fixed mode over raw tickets (no statistics)."""
    cfg = cfg or AuditConfig()
    prepared = fusion.prepare_signals(tickets, cfg)
    w_rule, w_cluster, w_res = (float(w) for w in cfg.weights)
    rule_norm = F.lit(3.0)  # percentile rank of a single value, times 3
    res_sev = F.when(F.col("hours_parsed").isNull(), F.lit(None).cast("double")) \
               .otherwise(F.lit(0.0))  # min-max of one value
    df = prepared.withColumns({
        "cluster_severity": sev.single_cluster_severity(F.col("rule_score")),
        "resolution_severity": res_sev,
    })
    score = (F.lit(w_rule) * (rule_norm - SINGLE_CENTRE)
             + F.lit(w_cluster) * (F.col("cluster_severity").cast("double") - SINGLE_CENTRE)
             + F.lit(w_res) * (F.col("resolution_severity") - SINGLE_CENTRE))
    df = df.withColumn("inferred_severity_score", score)
    df = df.withColumn("inferred_severity_numeric", sev.bucket_single(F.col("inferred_severity_score")))
    return df.withColumns({
        "inferred_severity": sev.severity_name(F.col("inferred_severity_numeric")),
        "severity_delta": F.col("inferred_severity_numeric") - F.col("priority_numeric"),
    })


def predict_fixed(tickets: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """The fixed rules as a mismatch predictor: severities two or more apart."""
    out = score_fixed(tickets, cfg)
    return out.withColumn("prediction", F.coalesce(F.abs("severity_delta") >= 2, F.lit(False)).cast("int"))


def score_frozen(tickets: DataFrame, model: fusion.SignalModel) -> DataFrame:
    """X1 frozen mode over raw tickets: rule terms, the fitted median and, where
    the tickets bring none, the cluster model's cluster; then the projection."""
    return model.transform(model.prepare(tickets))


def run_available(stream: DataFrame, name: str, spark: SparkSession | None = None,
                  out: str | None = None) -> DataFrame:
    """Process everything available now into a Parquet sink; return it.
    Re-running with the same ``out`` resumes from its checkpoint: files
    already committed are not processed again."""
    spark = spark or stream.sparkSession
    out = out or shared_path(spark, "streams", name)
    q = (stream.writeStream.format("parquet")
         .option("path", out)
         .option("checkpointLocation", out + "-checkpoint")
         .outputMode("append")
         .queryName(f"sevscope_{name}_{abs(hash(out)) % 10**8}")
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {q.exception()}")
    return spark.read.parquet(out)


def stream_raw(spark: SparkSession, path: str, fmt: str, scorer: Callable[[DataFrame], DataFrame], columns,
               name: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw CSV or JSON ticket files as a stream: (scored tickets, quarantine).

    Two exactly-once file sinks with a checkpoint each over the same files:
    readable records are normalised and scored, unreadable ones (broken JSON,
    too few or too many CSV fields) are kept as they stand, with their file."""
    good, bad = sources.raw_ticket_stream(spark, path, fmt)
    out = out or shared_path(spark, "streams", name)
    scored = run_available(scorer(good).select(*columns), name, spark, out=f"{out}/scored")
    quarantine = run_available(bad, f"{name}_quarantine", spark, out=f"{out}/quarantine")
    return scored, quarantine


def stream_tickets(spark: SparkSession, source: DataFrame,
                   scorer: Callable[[DataFrame], DataFrame], columns, name: str) -> DataFrame:
    return run_available(scorer(source).select(*columns), name, spark)
