"""Evidence dossiers.

A dossier is a per-row projection of a flagged ticket; nothing is gathered on
the driver and no text is read, the terms found are bits of ``crisis_mask``.
The median of the interpretation text (A2) is the fitted one: filling missing
hours with the median does not move it. ``dossier_struct`` builds the nested
record with one struct type for the three evidence items; ``dossier_json``
writes each item with its own keys, NULLs included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CRISIS_TERMS, DOSSIER_TEXT
from ..functions import severity as sev
from ..functions import text as tx

FLAT_COLUMNS = ("ticket_id", "assigned_priority", "inferred_severity", "mismatch_type",
                "severity_delta", "keyword_value", "keyword_weight", "resolution_value",
                "resolution_interpretation", "cluster_value", "cluster_weight",
                "constraint_analysis", "confidence")


def label_as_prediction(df: DataFrame) -> DataFrame:
    """Deterministic scorer used where no trained classifier is given:
    prediction = pseudo-label, confidence = 0.5 + |delta| / 6 (4 places)."""
    return df.withColumns({
        "prediction": F.col("mismatch_label"),
        "model_confidence": F.bround(F.lit(0.5) + F.abs(F.col("severity_delta")) / 6.0, 4),
    })


def _pystr(c: Column) -> Column:
    """Python ``str()`` of a value, 'None' for NULL."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def dossier_columns(df: DataFrame, median: float, style: str = "predict",
                    confidence: Column | None = None, crisis_terms=CRISIS_TERMS) -> DataFrame:
    """Flat dossier fields for every row of ``df`` (filter to flagged first)."""
    words = DOSSIER_TEXT[style]
    matched = tx.terms_of_mask(F.col("crisis_mask"), crisis_terms)
    if style == "notebook":
        # unknown priority counts as medium
        delta = F.col("inferred_severity_numeric") - F.coalesce(F.col("priority_numeric"), F.lit(1))
    else:
        delta = F.col("severity_delta")
    hours1 = F.bround(F.col("resolution_hours"), 1).cast("string")
    if confidence is None:
        confidence = (F.abs(delta) / 3.0 if style == "notebook"
                      else F.col("model_confidence"))
    return df.select(
        F.col("ticket_id").cast("string").alias("ticket_id"),
        F.col("ticket_priority").alias("assigned_priority"),
        F.col("inferred_severity"),
        sev.dossier_direction(delta).alias("mismatch_type"),
        delta.cast("string").alias("severity_delta"),
        tx.keyword_value(matched).alias("keyword_value"),
        tx.keyword_weight(matched, len(crisis_terms)).cast("string").alias("keyword_weight"),
        F.concat(hours1, F.lit(" hours")).alias("resolution_value"),
        F.when(F.col("resolution_hours") > F.lit(median), F.lit(words["above"]))
         .otherwise(F.lit(words["below"])).alias("resolution_interpretation"),
        F.concat(F.lit("Cluster "), _pystr(F.col("cluster"))).alias("cluster_value"),
        F.bround(F.col("cluster_severity") / 3.0, 3).cast("string").alias("cluster_weight"),
        F.format_string(words["analysis"], _pystr(F.col("ticket_priority")),
                        _pystr(F.col("inferred_severity")), hours1,
                        _pystr(delta)).alias("constraint_analysis"),
        F.bround(confidence, 3).cast("string").alias("confidence"),
    )


def dossier_struct(flat: DataFrame, style: str = "predict") -> DataFrame:
    """the nested dossier record, one per row."""
    words = DOSSIER_TEXT[style]
    none = F.lit(None).cast("string")

    def item(signal, value, weight, interp):
        return F.struct(F.lit(signal).alias("signal"), value.alias("value"),
                        weight.alias("weight"), interp.alias("interpretation"))

    evidence = F.array(
        item("keyword", F.col("keyword_value"), F.col("keyword_weight"), none),
        item(words["resolution_signal"], F.col("resolution_value"), none,
             F.col("resolution_interpretation")),
        item("embedding_cluster", F.col("cluster_value"), F.col("cluster_weight"), none),
    )
    return flat.select(
        "ticket_id",
        F.struct(
            "ticket_id", "assigned_priority", "inferred_severity", "mismatch_type",
            "severity_delta", evidence.alias("feature_evidence"),
            "constraint_analysis", "confidence").alias("dossier"))


def dossier_json(flat: DataFrame, style: str = "predict") -> DataFrame:
    """(ticket_id, json): one JSON object per flagged ticket."""
    words = DOSSIER_TEXT[style]

    def obj(*columns):
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

    keyword = obj(F.lit("keyword").alias("signal"), F.col("keyword_value").alias("value"),
                  F.col("keyword_weight").alias("weight"))
    resolution = obj(F.lit(words["resolution_signal"]).alias("signal"), F.col("resolution_value").alias("value"),
                     F.col("resolution_interpretation").alias("interpretation"))
    cluster = obj(F.lit("embedding_cluster").alias("signal"), F.col("cluster_value").alias("value"),
                  F.col("cluster_weight").alias("weight"))
    head = obj("ticket_id", "assigned_priority", "inferred_severity", "mismatch_type", "severity_delta")
    tail = obj("constraint_analysis", "confidence")
    return flat.select("ticket_id", F.concat(
        F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"feature_evidence":['),
        F.concat_ws(",", keyword, resolution, cluster), F.lit("],"), F.substr(tail, F.lit(2))).alias("json"))


def flagged(df: DataFrame, flag: str = "prediction") -> DataFrame:
    """P10 + P12: display columns of flagged rows (those present)."""
    cols = ["ticket_id", "ticket_priority", "inferred_severity", "severity_delta",
            "mismatch_type", "model_confidence", "ticket_channel"]
    return df.where(F.col(flag) == 1).select([c for c in cols if c in df.columns])
