"""Oracle SQL (DuckDB dialect) for the registered queries.

These statements restate each query's meaning in plain SQL over the driver
tables, written independently of the Spark code, so that the two engines can
be compared row by row. They favour clarity over speed (window functions over
the whole table, sorted lists for exact percentiles) and are only meant for
the small correctness scale.

Percentiles: Spark's ``percentile`` interpolates as
``(hi - pos) * v_lo + (pos - lo) * v_hi`` (and returns ``v_lo`` when both
neighbours are equal); DuckDB's ``quantile_cont`` uses another formula that can
differ in the last bit, so the oracles spell Spark's formula out.
"""

from __future__ import annotations

from ..config import (CRISIS_TERMS, DEFAULT_WEIGHTS, FIXED_CUTS, LOW_TERMS,
                      NEGATION_WORDS, AuditConfig, preset)
from ..sources.tickets import TICKETS_SQL

D = "CAST(%s AS DOUBLE)"


def dbl(x) -> str:
    return D % repr(float(x))


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits_sql(text: str, terms) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({text}, {sql_str(t)}) THEN 1 ELSE 0 END)"
                            for t in terms) + ")"


def negations_sql(text: str) -> str:
    words = ", ".join(sql_str(w) for w in NEGATION_WORDS)
    return (f"len(list_filter(regexp_split_to_array({text}, '[^\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: w IN ({words})))")


def spark_quantile(lst: str, n: str, p: float) -> str:
    """Spark's percentile over a sorted list ``lst`` of ``n`` values."""
    pos = f"({dbl(p)} * CAST({n} - 1 AS DOUBLE))"
    lo = f"{lst}[CAST(floor({pos}) AS BIGINT) + 1]"
    hi = f"{lst}[CAST(ceil({pos}) AS BIGINT) + 1]"
    return (f"(CASE WHEN {lo} = {hi} THEN {lo} ELSE "
            f"(ceil({pos}) - {pos}) * {lo} + ({pos} - floor({pos})) * {hi} END)")


def matched_terms_sql(text: str) -> str:
    arr = "[" + ", ".join(sql_str(t) for t in CRISIS_TERMS) + "]"
    return f"list_filter({arr}, lambda k: contains({text}, k))"


def severity_name_sql(code: str) -> str:
    return (f"(CASE {code} WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' "
            f"WHEN 3 THEN 'critical' END)")


def severity_code_sql(label: str) -> str:
    return (f"(CASE {label} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 "
            f"WHEN 'critical' THEN 3 ELSE NULL END)")


def mismatch_type_sql(delta: str) -> str:
    return (f"(CASE WHEN {delta} >= 2 THEN 'Hidden Crisis' WHEN {delta} <= -2 "
            f"THEN 'False Alarm' ELSE 'Consistent' END)")


def minmax_sql(x: str, lo: str, hi: str) -> str:
    return (f"(CASE WHEN {hi} = {lo} THEN {dbl(0)} ELSE "
            f"({x} - {lo}) / ({hi} - {lo}) * {dbl(3)} END)")


def zscore_sql(x: str, mean: str, std: str) -> str:
    return f"(CASE WHEN {std} = 0 THEN {dbl(0)} ELSE ({x} - {mean}) / {std} END)"


def prep_ctes(cfg: AuditConfig) -> str:
    """tickets -> prep -> terms -> filled."""
    ttype = "coalesce(ticket_type, 'unknown')" if cfg.fill_type else "ticket_type"
    low = "lower(full_text)"
    return f"""
tickets AS ({TICKETS_SQL}),
prep AS (
  SELECT ticket_id,
         coalesce(ticket_subject, '') AS ticket_subject,
         coalesce(ticket_description, '') AS ticket_description,
         coalesce(ticket_channel, 'unknown') AS ticket_channel,
         {ttype} AS ticket_type,
         lower(regexp_replace(ticket_priority, '^\\s+|\\s+$', '', 'g')) AS ticket_priority,
         coalesce(ticket_subject, '') || ' ' || coalesce(ticket_description, '') AS full_text,
         resolution_time_hours, cluster
  FROM tickets),
terms AS (
  SELECT *, {severity_code_sql('ticket_priority')} AS priority_numeric,
         TRY_CAST(nullif(regexp_extract(lower(resolution_time_hours), '([0-9.]+)', 1), '') AS DOUBLE)
           * (CASE WHEN contains(lower(resolution_time_hours), 'day') THEN {dbl(24)} ELSE {dbl(1)} END)
           AS hours_parsed,
         {hits_sql(low, CRISIS_TERMS)} AS crisis_hits,
         {hits_sql(low, LOW_TERMS)} AS low_hits,
         {negations_sql(low)} AS negations
  FROM prep),
hours_list AS (
  SELECT list_sort(list(hours_parsed) FILTER (WHERE hours_parsed IS NOT NULL)) AS l,
         count(hours_parsed) AS n FROM terms),
filled AS (
  SELECT terms.*,
         10 * crisis_hits - 5 * low_hits - 3 * negations AS rule_tenths,
         CAST(10 * crisis_hits - 5 * low_hits - 3 * negations AS DOUBLE) / {dbl(10)} AS rule_score,
         coalesce(hours_parsed, (SELECT {spark_quantile('l', 'n', 0.5)} FROM hours_list))
           AS resolution_hours
  FROM terms)"""


def signal_ctes(cfg: AuditConfig) -> str:
    """filled -> sig (rule norm, cluster severity, resolution severity, z)."""
    if cfg.rule_norm == "pct_rank":
        norm = (f"{dbl(3)} * (CAST(rank() OVER (ORDER BY rule_tenths) - 1 AS DOUBLE) "
                f"+ CAST(count(*) OVER (PARTITION BY rule_tenths) + 1 AS DOUBLE) / {dbl(2)}) "
                f"/ CAST(count(*) OVER () AS DOUBLE)")
    else:
        norm = minmax_sql("rule_score", "min(rule_score) OVER ()", "max(rule_score) OVER ()")
    return f"""
cmeans AS (
  SELECT cluster, avg(resolution_hours) AS m FROM filled
  WHERE cluster IS NOT NULL GROUP BY cluster),
crank AS (
  SELECT cluster, CAST(row_number() OVER (ORDER BY m, cluster) - 1 AS INTEGER) AS cluster_severity
  FROM cmeans),
s1 AS (
  SELECT f.*, {norm} AS rule_score_norm, cr.cluster_severity,
         {minmax_sql('resolution_hours', 'min(resolution_hours) OVER ()', 'max(resolution_hours) OVER ()')}
           AS resolution_severity
  FROM filled f LEFT JOIN crank cr ON f.cluster = cr.cluster),
sig AS (
  SELECT *,
    {zscore_sql('rule_score_norm', 'avg(rule_score_norm) OVER ()', 'stddev_pop(rule_score_norm) OVER ()')} AS rule_z,
    {zscore_sql('CAST(cluster_severity AS DOUBLE)', 'avg(CAST(cluster_severity AS DOUBLE)) OVER ()', 'stddev_pop(CAST(cluster_severity AS DOUBLE)) OVER ()')} AS cluster_z,
    {zscore_sql('resolution_hours', 'avg(resolution_hours) OVER ()', 'stddev_pop(resolution_hours) OVER ()')} AS resolution_z
  FROM s1)"""


def fused_ctes(cfg: AuditConfig) -> str:
    """sig -> scored -> labelled."""
    w = [dbl(x) for x in cfg.weights]
    if cfg.fuse == "zscore":
        raw = f"{w[0]} * rule_z + {w[1]} * cluster_z + {w[2]} * resolution_z"
    else:
        raw = (f"{w[0]} * rule_score_norm + {w[1]} * CAST(cluster_severity AS DOUBLE) "
               f"+ {w[2]} * resolution_severity")
    if cfg.cuts == "percentile":
        cut_cte = f""",
score_list AS (
  SELECT list_sort(list(inferred_severity_score) FILTER (WHERE inferred_severity_score IS NOT NULL)) AS l,
         count(inferred_severity_score) AS n FROM scored),
cuts AS (
  SELECT {spark_quantile('l', 'n', 0.25)} AS c1, {spark_quantile('l', 'n', 0.5)} AS c2,
         {spark_quantile('l', 'n', 0.75)} AS c3 FROM score_list)"""
        code = ("(CASE WHEN s.inferred_severity_score <= c.c1 THEN 0 "
                "WHEN s.inferred_severity_score <= c.c2 THEN 1 "
                "WHEN s.inferred_severity_score <= c.c3 THEN 2 ELSE 3 END)")
    else:
        a, b, c = (dbl(x) for x in FIXED_CUTS)
        cut_cte = """,
cuts AS (SELECT 0 AS dummy)"""
        code = (f"(CASE WHEN s.inferred_severity_score < {a} THEN 0 "
                f"WHEN s.inferred_severity_score < {b} THEN 1 "
                f"WHEN s.inferred_severity_score < {c} THEN 2 ELSE 3 END)")
    big = "abs(severity_delta) >= 2"
    agrees = ("coalesce((severity_delta >= 2 AND rule_score_norm > 1.5) OR "
              "(severity_delta <= -2 AND rule_score_norm < 1.0), false)")
    if cfg.gate == "rule_agrees":
        flag = f"({big} AND rule_agrees)"
    elif cfg.gate == "consensus":
        flag = f"({big} AND signal_consensus >= 3.0)"
    else:
        flag = f"({big})"
    lo, hi = "min(rule_score_norm) OVER ()", "max(rule_score_norm) OVER ()"
    step = f"(({hi} - {lo}) / {dbl(4)})"
    rule_sev = (f"(CASE WHEN {hi} = {lo} THEN 1 "
                f"WHEN rule_score_norm <= {lo} + {step} THEN 0 "
                f"WHEN rule_score_norm <= {lo} + 2 * {step} THEN 1 "
                f"WHEN rule_score_norm <= {lo} + 3 * {step} THEN 2 ELSE 3 END)")
    return f""",
scored AS (
  SELECT *, round({raw}, {cfg.score_digits}) AS inferred_severity_score FROM sig){cut_cte},
coded AS (
  SELECT s.*, {code} AS inferred_severity_numeric FROM scored s, cuts c),
delta AS (
  SELECT *, {severity_name_sql('inferred_severity_numeric')} AS inferred_severity,
         inferred_severity_numeric - priority_numeric AS severity_delta,
         {rule_sev} AS rule_severity
  FROM coded),
gated AS (
  SELECT *, {agrees} AS rule_agrees,
         CAST(abs(rule_severity - priority_numeric) + abs(cluster_severity - priority_numeric)
              + abs(round_even(resolution_severity, 0) - priority_numeric) AS DOUBLE) AS signal_consensus
  FROM delta),
labelled AS (
  SELECT *, CAST(coalesce({flag}, false) AS INTEGER) AS mismatch_label,
         {mismatch_type_sql('severity_delta')} AS mismatch_type
  FROM gated)"""


def audit_with(cfg: AuditConfig) -> str:
    """WITH clause ending in the ``labelled`` CTE."""
    return "WITH " + prep_ctes(cfg).lstrip().rstrip(",") + "," + signal_ctes(cfg) + "," \
        + fused_ctes(cfg).lstrip(",")


def audit_sql(name: str = "documented", select: str = "SELECT * FROM labelled") -> str:
    return audit_with(preset(name)) + "\n" + select


__all__ = ["audit_sql", "audit_with", "prep_ctes", "spark_quantile", "dbl",
           "DEFAULT_WEIGHTS", "matched_terms_sql", "mismatch_type_sql"]
