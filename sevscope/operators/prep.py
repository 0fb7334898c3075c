"""Ticket preparation.

``normalize_columns`` and ``prepare`` are pure projections; ``fill_hours``
needs one global statistic (the median of parsed hours), computed by an
aggregate that Spark runs partially on every partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions import severity as sev
from ..functions import text as tx

REQUIRED = ("ticket_subject", "ticket_description", "ticket_channel",
            "ticket_priority", "resolution_time_hours")
# raw names of the public ticket data set and the app's short name
RENAMES = {"priority_level": "ticket_priority", "issue_category": "ticket_type",
           "resolution_time": "resolution_time_hours"}


def normalize_name(name: str) -> str:
    """Strip, lower, spaces to underscores."""
    return name.strip().lower().replace(" ", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """P1 + P2: normalised headers, known raw names renamed when present, and
    an early failure naming every missing required column."""
    df = df.toDF(*[normalize_name(c) for c in df.columns])
    present = set(df.columns)
    renames = {src: dst for src, dst in RENAMES.items()
               if src in present and dst not in present}
    if renames:
        df = df.withColumnsRenamed(renames)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"ticket table lacks required columns: {missing}")
    if "ticket_type" not in df.columns:
        df = df.withColumn("ticket_type", F.lit(None).cast("string"))
    if "ticket_id" not in df.columns:
        raise ValueError("ticket table needs a ticket_id column (no positional ids)")
    return df


def prepare(df: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """P3-P6 + F1 (before the median fill): adds ``full_text``,
    ``priority_numeric`` and ``hours_parsed``; keeps every input column."""
    cfg = cfg or AuditConfig()
    df = normalize_columns(df)
    subject = F.coalesce(F.col("ticket_subject"), F.lit(""))
    description = F.coalesce(F.col("ticket_description"), F.lit(""))
    ttype = F.col("ticket_type")
    if cfg.fill_type:
        ttype = F.coalesce(ttype, F.lit("unknown"))
    priority = tx.strip_lower("ticket_priority")
    return df.withColumns({
        "ticket_subject": subject,
        "ticket_description": description,
        "ticket_channel": F.coalesce(F.col("ticket_channel"), F.lit("unknown")),
        "ticket_type": ttype,
        "ticket_priority": priority,
        "full_text": F.concat(subject, F.lit(" "), description),
        "priority_numeric": sev.severity_code(priority),
        "hours_parsed": tx.parse_resolution_hours("resolution_time_hours"),
    })


def median_expr(c: Column | str, cfg: AuditConfig) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if cfg.exact:
        return F.percentile(c, 0.5)
    return F.percentile_approx(c, 0.5, cfg.accuracy)


def hours_median(prepped: DataFrame, cfg: AuditConfig) -> float:
    """A1: median of the parsed hours (NULLs ignored), over the time column
    only (Catalyst prunes every other column); exact without a one-task
    merge of all values (``quantiles.exact_quantiles``)."""
    if cfg.exact:
        from .quantiles import exact_quantile
        m = exact_quantile(prepped, "hours_parsed", 0.5)
    else:
        m = prepped.agg(median_expr("hours_parsed", cfg).alias("m")).first()["m"]
    if m is None:
        raise ValueError("no ticket has a parsable resolution time; "
                         "the median used to fill missing times is undefined")
    return float(m)


def fill_hours(prepped: DataFrame, median: float) -> DataFrame:
    """A1 fill: ``resolution_hours`` = parsed hours, else the batch median."""
    return prepped.withColumn(
        "resolution_hours", F.coalesce(F.col("hours_parsed"), F.lit(float(median))))


def add_rule_terms(df: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """F2-F5 over the whole lowered text."""
    cfg = cfg or AuditConfig()
    low = F.lower(F.col("full_text"))
    found = F.col("__found")
    return (df.withColumn("__found", tx.scan(low, cfg.crisis_terms, cfg.low_terms))
              .withColumns({
                "crisis_mask": found["crisis_mask"],
                "low_hits": found["low_hits"],
                "negations": tx.scanned_negations(found, low)})
              .drop("__found")
              .withColumn("crisis_hits", tx.mask_hits(F.col("crisis_mask"), cfg.crisis_terms))
              .withColumns({
                "rule_tenths": tx.rule_tenths(F.col("crisis_hits"), F.col("low_hits"),
                                              F.col("negations")),
                })
              .withColumn("rule_score", tx.rule_score(F.col("rule_tenths"))))


# The tokens that pandas reads as missing.
_NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def null_tokens_to_null(df: DataFrame, cols=None) -> DataFrame:
    """pandas reads these CSV tokens as missing; map them to NULL."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: F.when(F.col(c).isin(*_NULL_TOKENS), F.lit(None))
                           .otherwise(F.col(c)) for c in cols})

