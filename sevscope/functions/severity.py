"""Severity expressions (P6, P7, F8-F19, F23) as native Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (CONSISTENT, FALSE_ALARM, HIDDEN_CRISIS, SEVERITY_LEVELS,
                      SINGLE_CUTS)


def severity_code(label: Column) -> Column:
    """low=0 ... critical=3; anything else NULL."""
    expr = None
    for i, name in enumerate(SEVERITY_LEVELS):
        expr = F.when(label == name, F.lit(i)) if expr is None else expr.when(label == name, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


def severity_name(code: Column) -> Column:
    """Inverse of ``severity_code``."""
    expr = None
    for i, name in enumerate(SEVERITY_LEVELS):
        expr = F.when(code == i, F.lit(name)) if expr is None else expr.when(code == i, F.lit(name))
    return expr.otherwise(F.lit(None).cast("string"))


def bucket_strict(score: Column, cuts) -> Column:
    """Code 0..3 with strict '<' cuts; NULL score falls to 3."""
    a, b, c = cuts
    return (F.when(score < a, 0).when(score < b, 1).when(score < c, 2)
            .otherwise(3))


def bucket_closed(score: Column, cuts) -> Column:
    """code 0..3 with '<=' percentile cuts; NULL score falls to 3."""
    a, b, c = cuts
    return (F.when(score <= a, 0).when(score <= b, 1).when(score <= c, 2)
            .otherwise(3))


def bucket_single(score: Column) -> Column:
    return bucket_strict(score, SINGLE_CUTS)


def single_cluster_severity(rule_score: Column) -> Column:
    """cluster severity of a lone ticket from its rule score."""
    return (F.when(rule_score >= 2, 3).when(rule_score >= 1, 2)
            .when(rule_score >= 0, 1).otherwise(0))


def mismatch_type(delta: Column) -> Column:
    """by delta only; NULL delta is Consistent."""
    return (F.when(delta >= 2, HIDDEN_CRISIS).when(delta <= -2, FALSE_ALARM)
            .otherwise(CONSISTENT))


def dossier_direction(delta: Column) -> Column:
    """Hidden Crisis when delta > 0, else False Alarm (delta 0 included)."""
    return F.when(delta > 0, HIDDEN_CRISIS).otherwise(FALSE_ALARM)


def rule_agrees(delta: Column, rule_norm: Column) -> Column:
    """F16: the rule signal points the same way as a large delta."""
    return F.coalesce(((delta >= 2) & (rule_norm > 1.5)) |
                      ((delta <= -2) & (rule_norm < 1.0)), F.lit(False))


def equal_width_bin4(x: Column, lo: float, hi: float) -> Column:
    """four right-closed equal-width bins over [lo, hi], low edge widened.

    Edges are lo + i * ((hi - lo) / 4) so the comparison uses the same doubles
    as the edge array of the reference. A constant column lands in bin 1.
    """
    if hi == lo:
        return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(F.lit(1))
    step = (hi - lo) / 4.0
    e1, e2, e3 = lo + step, lo + 2 * step, lo + 3 * step
    return (F.when(x.isNull(), F.lit(None).cast("int"))
            .when(x <= e1, 0).when(x <= e2, 1).when(x <= e3, 2).otherwise(3))


def minmax(x: Column, lo, hi, scale: float = 3.0) -> Column:
    """Min-max scaling to [0, scale]; a zero range maps to 0."""
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    rng = hi - lo
    if rng == 0:
        return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0))
    return (x - F.lit(float(lo))) / F.lit(float(rng)) * F.lit(float(scale))


def zscore(x: Column, mean, std) -> Column:
    """Population z-score; a zero spread gives 0 (documented deviation)."""
    if mean is None:
        return F.lit(None).cast("double")
    if not std:
        return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0))
    return (x - F.lit(float(mean))) / F.lit(float(std))
