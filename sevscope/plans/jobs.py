"""Batch jobs: fit (audit + classifier) and score, file in -> files out.

``fit_job``   tickets (CSV or Parquet) -> labelled Parquet (S3), dossiers as
              JSON lines (S5), the test report as JSON (S6), and a committed
              version of the frozen signal model with its cluster model and
              the classifier (S7, ``bundle``).
``score_job`` tickets + saved models -> predictions CSV (S4) and dossiers of
              predicted mismatches (S5), all by frozen statistics.
Tickets need no ``cluster`` column: the fit makes a cluster model from their
vectors (``embedding`` column) or texts, and scoring applies it. Every output
goes to the given folder (on a cluster: shared storage); all work is Spark
jobs, nothing is gathered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bundle
from ..config import AuditConfig, MLConfig, preset
from ..operators import dossier as dz
from ..operators import fusion, logistic, ml, prep
from ..operators import reports as rp
from ..session import stage
from ..sources import sinks


def read_tickets(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    if fmt == "csv":
        return sinks.read_tickets_csv(spark, path, multi_line=multi_line)
    return prep.normalize_columns(spark.read.parquet(path))


@dataclass
class FitOutputs:
    labelled: str
    dossiers: str
    report: str
    models: str
    version: str


def fit_job(spark: SparkSession, tickets: DataFrame, out: str,
            cfg: AuditConfig | None = None, ml_cfg: MLConfig | None = None,
            style: str | None = None) -> FitOutputs:
    cfg = cfg or preset("documented")
    # the records of the fit have no classifier's confidence, which "predict" shows
    style = style or ("notebook" if cfg.dossier_style == "predict" else cfg.dossier_style)
    out = out.rstrip("/")
    ml_cfg = ml_cfg or MLConfig()
    a = fusion.audit(tickets, cfg, ml_cfg, keep={"text_slots": ml.text_slots(ml_cfg)})
    o = FitOutputs(labelled=f"{out}/labelled", dossiers=f"{out}/dossiers",
                   report=f"{out}/report", models=f"{out}/models", version="")
    sinks.write_labelled(a.with_text().drop("hours_parsed", "crisis_mask"), o.labelled)
    flat = dz.dossier_columns(a.labelled.where(F.col("mismatch_label") == 1), a.model.median_hours, style=style,
                              crisis_terms=cfg.crisis_terms)
    sinks.write_dossiers(dz.dossier_json(flat, style), o.dossiers)
    t = ml.train(ml.model_rows(a.labelled, a.model.hours_min, a.model.hours_max, ml_cfg), ml_cfg)
    o.version = bundle.save(spark, o.models, a.model, t.model)
    sinks.write_report(rp.classification_report(t.score_split("test")), o.report)
    return o


def score_tickets(model: fusion.SignalModel, classifier: logistic.TextClassifier, tickets: DataFrame) -> DataFrame:
    """Raw tickets with labels, prediction and confidence: columns are added,
    no row is dropped, repeated or joined."""
    labelled = model.transform(model.prepare(tickets))
    rows = ml.model_rows(labelled, model.hours_min, model.hours_max, MLConfig(num_features=classifier.num_features))
    return ml.score(classifier, rows)


def score_job(spark: SparkSession, tickets: DataFrame, models: FitOutputs, out: str,
              style: str | None = None) -> dict:
    out = out.rstrip("/")
    saved = bundle.load(spark, models.models, models.version or None)
    model = saved.signal_model
    style = style or model.cfg.dossier_style
    scored = score_tickets(model, saved.classifier, tickets)
    narrow = stage(scored.drop("full_text", "ticket_subject", "ticket_description", "embedding"),
                   "scored")
    paths = {"predictions": f"{out}/predictions", "dossiers": f"{out}/dossiers"}
    sinks.write_predictions(narrow, paths["predictions"])
    flat = dz.dossier_columns(narrow.where(F.col("prediction") == 1), model.median_hours, style=style,
                              crisis_terms=model.cfg.crisis_terms)
    sinks.write_dossiers(dz.dossier_json(flat, style), paths["dossiers"])
    return paths
