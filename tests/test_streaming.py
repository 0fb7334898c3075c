"""Streaming: frozen model equals batch labels; a restart does not reprocess."""

import tempfile

from sevscope.config import MLConfig, preset
from sevscope.operators import fusion
from sevscope.sources.tickets import ticket_stream, tickets
from sevscope.streaming import score as stream


def test_restart_is_exactly_once(spark, small_dir):
    cfg = preset("documented")
    out = tempfile.mkdtemp(prefix="sevscope-stream-") + "/sink"
    cols = stream.FIXED_COLUMNS
    first = stream.run_available(
        stream.score_fixed(ticket_stream(spark, small_dir), cfg)
        .select(*cols), "restart", spark, out=out).count()
    again = stream.run_available(
        stream.score_fixed(ticket_stream(spark, small_dir), cfg)
        .select(*cols), "restart", spark, out=out).count()
    assert first == 1500 and again == 1500


def test_frozen_stream_equals_batch(spark, small_dir):
    cfg = preset("documented")
    # no cluster column: the model finds the clusters and keeps them for the stream
    small = MLConfig(num_features=1 << 12, kmeans_starts=2)
    a = fusion.audit(tickets(spark, small_dir).drop("cluster"), cfg, small)
    batch = {r["ticket_id"]: (r["inferred_severity"], r["mismatch_label"])
             for r in a.labelled.select("ticket_id", "inferred_severity", "mismatch_label").collect()}
    path = tempfile.mkdtemp(prefix="sevscope-model-") + "/m"
    a.model.save(path)
    m = fusion.SignalModel.load(spark, path)
    got = stream.run_available(
        stream.score_frozen(ticket_stream(spark, small_dir).drop("cluster"), m)
        .select("ticket_id", "inferred_severity", "mismatch_label"), "frozen", spark)
    streamed = {r["ticket_id"]: (r["inferred_severity"], r["mismatch_label"]) for r in got.collect()}
    assert streamed == batch


def test_single_split_stream_is_spread(spark, small_dir):
    # sf0.001 orders is one small row group: one split, fewer than the cores
    assert spark.read.parquet(f"{small_dir}/orders.parquet").rdd.getNumPartitions() < \
        spark.sparkContext.defaultParallelism
    plan = ticket_stream(spark, small_dir)._jdf.queryExecution().logical().toString()
    assert "Repartition" in plan
