"""End-to-end jobs on a CSV written from the derived ticket view."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sevscope.config import MLConfig, preset
from sevscope.operators import fusion, ml
from sevscope.plans import jobs
from sevscope.sources import sinks
from sevscope.sources.tickets import tickets


@pytest.mark.slow
def test_fit_then_score_jobs(spark, small_dir):
    work = tempfile.mkdtemp(prefix="sevscope-job-")
    csv = os.path.join(work, "in")
    raw = tickets(spark, small_dir)
    # raw-style headers: capitals, spaces, the public data set's names
    (raw.withColumnRenamed("ticket_priority", "Priority_Level")
        .withColumnRenamed("ticket_subject", " Ticket Subject ")
        .drop("cluster")
        .write.option("header", True).csv(csv))
    t = jobs.read_tickets(spark, csv, "csv")
    assert "ticket_priority" in t.columns
    assert "cluster" not in t.columns      # the job makes the clusters from the texts
    small = MLConfig(num_features=1 << 12, reg_params=(0.01,), max_iter=20, kmeans_starts=2)
    fit = jobs.fit_job(spark, t, os.path.join(work, "fit"), ml_cfg=small)
    assert spark.read.parquet(fit.labelled).count() == 1500
    rep = {r["class"]: r for r in spark.read.json(fit.report).collect()}
    assert set(rep) == {"Consistent", "Mismatch", "accuracy", "macro avg", "weighted avg"}
    d = json.loads(spark.read.text(fit.dossiers).first()[0])
    assert d["feature_evidence"][0]["signal"] == "keyword"
    paths = jobs.score_job(spark, t, fit, os.path.join(work, "score"))
    preds = sinks.read_predictions(spark, paths["predictions"])
    assert preds.count() == 1500
    # frozen statistics: labels equal those of the fit batch
    lab = spark.read.parquet(fit.labelled).select("ticket_id", "inferred_severity")
    again = preds.selectExpr("ticket_id", "inferred_severity AS s2")
    j = lab.join(again, "ticket_id")
    assert j.count() == 1500 and j.where("inferred_severity <> s2").count() == 0


@pytest.mark.slow
def test_scoring_keeps_text_null_and_repeated_ids(spark, small_dir):
    raw = tickets(spark, small_dir)
    small = MLConfig(num_features=1 << 10, reg_params=(0.01,), max_iter=10)
    a = fusion.audit(raw, preset("documented"), small)
    trained = ml.train(ml.model_rows(a.with_text(), a.model.hours_min, a.model.hours_max, small), small)
    named = raw.orderBy("ticket_id").limit(200).withColumn("ticket_id", F.expr(
        "CASE WHEN ticket_id % 7 = 0 THEN NULL WHEN ticket_id % 2 = 0 THEN 'TKT-1' ELSE 'TKT-' || ticket_id END"))
    scored = jobs.score_tickets(a.model, trained.model, named)
    path = sinks.write_predictions(scored, os.path.join(tempfile.mkdtemp(), "p"))
    back = sinks.read_predictions(spark, path)
    ids = lambda df: sorted(str(r[0]) for r in df.select("ticket_id").collect())
    assert back.count() == 200 and ids(back) == ids(named)
    # a ticket's values do not depend on its batch
    few = named.orderBy("ticket_description", "ticket_subject").limit(5)
    key = lambda r: (r["full_text"], r["ticket_channel"], r["resolution_time_hours"])
    whole = {key(r): (r["resolution_norm"], r["model_confidence"]) for r in scored.collect()}
    for r in jobs.score_tickets(a.model, trained.model, few).collect():
        assert whole[key(r)] == (r["resolution_norm"], r["model_confidence"])
