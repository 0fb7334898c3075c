"""Oracle SQL per registered query (DuckDB dialect; see ``oracle_sql``)."""

from __future__ import annotations

from ..config import BANNER_CONSISTENT, BANNER_MISMATCH, BANNER_TYPES, CRISIS_TERMS, DOSSIER_TEXT, LOW_TERMS, preset
from .oracle_sql import (audit_sql, audit_with, dbl, hits_sql, matched_terms_sql,
                         negations_sql, prep_ctes, severity_name_sql, spark_quantile,
                         sql_str)

ORACLES: dict[str, str] = {}


def _prep_select(select: str) -> str:
    return "WITH " + prep_ctes(preset("documented")).lstrip() + "\n" + select


ORACLES["scan_tickets"] = _prep_select("SELECT * FROM tickets")

_MISSING = ", ".join(sql_str(t) for t in (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null"))
ORACLES["csv_tickets"] = _prep_select("SELECT 'TKT-' || ticket_id AS ticket_id, " + ", ".join(
    f"CASE WHEN {c} IN ({_MISSING}) THEN NULL ELSE {c} END AS {c}"
    for c in ("ticket_subject", "ticket_description", "ticket_channel", "ticket_type", "ticket_priority",
              "resolution_time_hours")) + " FROM tickets")

_ORDERED = {"hours": "hours_parsed", "priority": "CAST(priority_numeric AS DOUBLE)"}
ORACLES["exact_percentiles"] = _prep_select(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{k}' AS signal, {dbl(p)} AS p, {spark_quantile('l', 'n', p)} AS value FROM ("
        f"SELECT list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)) AS l, count({c}) AS n FROM terms)"
        for k, c in _ORDERED.items() for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)) + ")")

ORACLES["tfidf_check"] = _prep_select(
    "SELECT ticket_id, CAST(len(list_filter(regexp_split_to_array(lower(full_text), '[^\\p{L}\\p{N}_]+'), "
    "lambda w: w <> '')) AS INTEGER) AS n_tokens, regexp_matches(full_text, '[\\p{L}\\p{N}_]') AS unit FROM prep")
ORACLES["audit_by_text_check"] = "SELECT count(*) AS tickets, 4::BIGINT AS clusters, true AS ranked FROM orders"
ORACLES["score_check"] = ("SELECT count(*) AS tickets, count(DISTINCT o_orderkey) AS ids, true AS in_range, "
                          "true AS binary FROM orders")

ORACLES["prep_tickets"] = _prep_select(
    "SELECT ticket_id, ticket_subject, ticket_description, ticket_channel, ticket_type, "
    "ticket_priority, full_text, CAST(priority_numeric AS INTEGER) AS priority_numeric, "
    "resolution_hours FROM filled")

ORACLES["parse_resolution"] = _prep_select(
    "SELECT ticket_id, resolution_time_hours, hours_parsed, resolution_hours FROM filled")

ORACLES["rule_signal"] = _prep_select(
    "SELECT ticket_id, CAST(crisis_hits AS INTEGER) AS crisis_hits, "
    "CAST(low_hits AS INTEGER) AS low_hits, CAST(negations AS INTEGER) AS negations, "
    "CAST(rule_tenths AS INTEGER) AS rule_tenths, rule_score FROM filled")

_DL = "lower(coalesce(text, ''))"
ORACLES["document_rule_signal"] = (
    f"SELECT doc_id, CAST({hits_sql(_DL, CRISIS_TERMS)} AS INTEGER) AS crisis_hits, "
    f"CAST({hits_sql(_DL, LOW_TERMS)} AS INTEGER) AS low_hits, "
    f"CAST({negations_sql(_DL)} AS INTEGER) AS negations, "
    f"CAST(10 * {hits_sql(_DL, CRISIS_TERMS)} - 5 * {hits_sql(_DL, LOW_TERMS)} "
    f"- 3 * {negations_sql(_DL)} AS INTEGER) AS rule_tenths, "
    f"CAST(10 * {hits_sql(_DL, CRISIS_TERMS)} - 5 * {hits_sql(_DL, LOW_TERMS)} "
    f"- 3 * {negations_sql(_DL)} AS DOUBLE) / {dbl(10)} AS rule_score, "
    f"CASE WHEN len({matched_terms_sql(_DL)}) > 0 "
    f"THEN array_to_string({matched_terms_sql(_DL)}[1:5], ', ') ELSE 'none' END AS keyword_value "
    "FROM documents")

ORACLES["rule_percentile"] = audit_sql(
    "documented",
    "SELECT ticket_id, CAST(rule_tenths AS INTEGER) AS rule_tenths, "
    "round(rule_score_norm, 9) AS rule_score_norm FROM labelled")

ORACLES["resolution_signal"] = audit_sql(
    "documented",
    "SELECT ticket_id, resolution_hours, round(resolution_severity, 9) AS resolution_severity, "
    "round(resolution_z, 9) AS resolution_z FROM labelled")

ORACLES["cluster_severity"] = audit_sql(
    "documented",
    "SELECT cluster, cluster_severity, CAST(count(*) AS BIGINT) AS n, "
    "round(avg(resolution_hours), 9) AS mean_hours FROM labelled "
    "WHERE cluster IS NOT NULL GROUP BY cluster, cluster_severity")

_FUSED = ("SELECT ticket_id, round(rule_score_norm, 9) AS rule_score_norm, cluster_severity, "
          "round(resolution_severity, 9) AS resolution_severity, inferred_severity_score, "
          "inferred_severity, CAST(severity_delta AS INTEGER) AS severity_delta, "
          "mismatch_label, mismatch_type FROM labelled")
ORACLES["fuse_documented"] = audit_sql("documented", _FUSED)
ORACLES["fuse_train"] = audit_sql("train", _FUSED)
ORACLES["fuse_notebook"] = audit_sql("notebook", _FUSED)
ORACLES["fuse_app"] = audit_sql("app", _FUSED)

ORACLES["mismatch_label"] = audit_sql(
    "documented",
    "SELECT ticket_id, CAST(severity_delta AS INTEGER) AS severity_delta, rule_agrees, "
    "mismatch_label, mismatch_type FROM labelled")

ORACLES["consensus_label"] = audit_sql(
    "notebook",
    "SELECT ticket_id, CAST(rule_severity AS INTEGER) AS rule_severity, signal_consensus, "
    "CAST(severity_delta AS INTEGER) AS severity_delta, mismatch_label FROM labelled")


# ------------------------------------------------------------------- evidence
_DOC = preset("documented")


def _with(select: str, name: str = "documented") -> str:
    return audit_sql(name, select)


def _matched(text: str) -> str:
    return matched_terms_sql(f"lower({text})")


ORACLES["keyword_evidence"] = _prep_select(
    f"SELECT ticket_id, CAST(len({_matched('full_text')}) AS INTEGER) AS keyword_count, "
    f"CASE WHEN len({_matched('full_text')}) > 0 "
    f"THEN array_to_string({_matched('full_text')}[1:5], ', ') ELSE 'none' END AS keyword_value, "
    f"round_even(least(len({_matched('full_text')}) / {dbl(18)}, {dbl(1)}), 3) AS keyword_weight "
    "FROM prep")


def _fmt(template: str, *args: str) -> str:
    parts = template.split("%s")
    out = [sql_str(parts[0])]
    for a, p in zip(args, parts[1:]):
        out += [a, sql_str(p)]
    return "(" + " || ".join(out) + ")"


def _dossier_select(where_extra: str = "", style: str = "notebook") -> str:
    words = DOSSIER_TEXT[style]
    m = _matched("full_text")
    if style == "notebook":
        delta = "(inferred_severity_numeric - coalesce(priority_numeric, 1))"
        conf = f"abs({delta}) / {dbl(3)}"
    else:
        delta, conf = "severity_delta", f"round_even({dbl(0.5)} + abs(severity_delta) / {dbl(6)}, 4)"
    h1 = "CAST(round_even(resolution_hours, 1) AS VARCHAR)"
    return f"""
, med AS (SELECT list_sort(list(resolution_hours)) AS l, count(resolution_hours) AS n FROM labelled)
SELECT CAST(ticket_id AS VARCHAR) AS ticket_id,
       ticket_priority AS assigned_priority,
       inferred_severity,
       CASE WHEN {delta} > 0 THEN 'Hidden Crisis' ELSE 'False Alarm' END AS mismatch_type,
       CAST({delta} AS VARCHAR) AS severity_delta,
       CASE WHEN len({m}) > 0 THEN array_to_string({m}[1:5], ', ') ELSE 'none' END AS keyword_value,
       CAST(round_even(least(len({m}) / {dbl(18)}, {dbl(1)}), 3) AS VARCHAR) AS keyword_weight,
       {h1} || ' hours' AS resolution_value,
       CASE WHEN resolution_hours > (SELECT {spark_quantile('l', 'n', 0.5)} FROM med)
            THEN {sql_str(words['above'])} ELSE {sql_str(words['below'])} END AS resolution_interpretation,
       'Cluster ' || coalesce(CAST(cluster AS VARCHAR), 'None') AS cluster_value,
       CAST(round_even(cluster_severity / {dbl(3)}, 3) AS VARCHAR) AS cluster_weight,
       {_fmt(words['analysis'], "coalesce(ticket_priority, 'None')",
             "coalesce(inferred_severity, 'None')", h1,
             f"coalesce(CAST({delta} AS VARCHAR), 'None')")} AS constraint_analysis,
       CAST(round_even({conf}, 3) AS VARCHAR) AS confidence
FROM labelled WHERE mismatch_label = 1 {where_extra}"""


_DOSSIER_WITH = audit_with(_DOC)
ORACLES["dossiers"] = _DOSSIER_WITH + _dossier_select()
ORACLES["dossier_preview"] = _DOSSIER_WITH + _dossier_select(
    "AND ticket_id IN (SELECT ticket_id FROM labelled WHERE mismatch_label = 1 "
    "ORDER BY ticket_id LIMIT 3)")

ORACLES["dossiers_predict"] = _DOSSIER_WITH + _dossier_select(style="predict")
ORACLES["dossiers_app"] = audit_with(preset("app")) + _dossier_select(style="app")
_WORDS = DOSSIER_TEXT["notebook"]
ORACLES["dossier_json"] = f"""WITH d AS ({_DOSSIER_WITH}{_dossier_select()})
SELECT ticket_id, CAST(to_json(struct_pack(
  ticket_id := ticket_id, assigned_priority := assigned_priority, inferred_severity := inferred_severity,
  mismatch_type := mismatch_type, severity_delta := severity_delta,
  feature_evidence := json_array(
    to_json(struct_pack(signal := 'keyword', value := keyword_value, weight := keyword_weight)),
    to_json(struct_pack(signal := '{_WORDS["resolution_signal"]}', value := resolution_value,
                        interpretation := resolution_interpretation)),
    to_json(struct_pack(signal := 'embedding_cluster', value := cluster_value, weight := cluster_weight))),
  constraint_analysis := constraint_analysis, confidence := confidence)) AS VARCHAR) AS json
FROM d"""

_CONF = f"round_even({dbl(0.5)} + abs(severity_delta) / {dbl(6)}, 4)"
ORACLES["flagged"] = _with(
    f"SELECT ticket_id, ticket_priority, inferred_severity, "
    f"CAST(severity_delta AS INTEGER) AS severity_delta, mismatch_type, "
    f"{_CONF} AS model_confidence, ticket_channel FROM labelled WHERE mismatch_label = 1")

ORACLES["display_texts"] = _with(
    f"SELECT ticket_id, upper(ticket_priority) AS assigned_priority, upper(inferred_severity) AS inferred_severity, "
    f"CAST(severity_delta AS INTEGER) AS severity_delta, "
    f"CAST(round_even({_CONF} * {dbl(100)}, 1) AS VARCHAR) || '%' AS confidence_text, "
    f"CASE WHEN mismatch_label = 0 THEN {sql_str(BANNER_CONSISTENT)} ELSE replace({sql_str(BANNER_MISMATCH)}, '%s', "
    f"CASE WHEN severity_delta > 0 THEN {sql_str(BANNER_TYPES[0])} ELSE {sql_str(BANNER_TYPES[1])} END) END AS banner "
    f"FROM labelled")

# -------------------------------------------------------------------- reports
ORACLES["priority_counts"] = _with(
    "SELECT ticket_priority AS priority, CAST(count(*) AS BIGINT) AS n FROM labelled "
    "WHERE ticket_priority IS NOT NULL GROUP BY ticket_priority")

ORACLES["cluster_counts"] = _with(
    "SELECT cluster, cluster_severity, CAST(count(*) AS BIGINT) AS n FROM labelled "
    "WHERE cluster IS NOT NULL AND cluster_severity IS NOT NULL GROUP BY cluster, cluster_severity")

ORACLES["dashboard_kpis"] = _with(
    f"""SELECT total, mismatches, hidden_crises,
       round(CAST(mismatches AS DOUBLE) / CAST(total AS DOUBLE), 9) AS mismatch_rate,
       CAST(round_even(CAST(mismatches AS DOUBLE) / CAST(total AS DOUBLE) * {dbl(100)}, 1) AS VARCHAR)
         || '%' AS mismatch_rate_text
FROM (SELECT CAST(count(*) AS BIGINT) AS total,
             CAST(count(*) FILTER (WHERE mismatch_label = 1) AS BIGINT) AS mismatches,
             CAST(count(*) FILTER (WHERE mismatch_label = 1 AND severity_delta > 0) AS BIGINT)
               AS hidden_crises
      FROM labelled)""")

ORACLES["delta_heatmap"] = _with(
    "SELECT ticket_type, ticket_channel, round(avg(severity_delta), 9) AS mean_delta, "
    "CAST(count(*) AS BIGINT) AS n FROM labelled "
    "WHERE ticket_type IS NOT NULL AND ticket_channel IS NOT NULL "
    "GROUP BY ticket_type, ticket_channel")

_HEAT = ("chat", "email", "phone", "social media", "unknown")
ORACLES["delta_heatmap_wide"] = _with(
    "SELECT ticket_type, " + ", ".join(
        f"coalesce(round(avg(CASE WHEN ticket_channel = {sql_str(c)} THEN severity_delta END), 9), "
        f"{dbl(0)}) AS \"{c}\"" for c in _HEAT)
    + " FROM labelled WHERE ticket_type IS NOT NULL GROUP BY ticket_type")

ORACLES["mismatch_type_counts"] = _with(
    "SELECT mismatch_type, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY mismatch_type")

# the 19 inner edges as literals; a bin's number is the count of edges reached
_EDGES = ("0.525", "0.550", "0.575", "0.600", "0.625", "0.650", "0.675", "0.700", "0.725", "0.750",
          "0.775", "0.800", "0.825", "0.850", "0.875", "0.900", "0.925", "0.950", "0.975")


def _histogram(conf: str, source: str) -> str:
    reached = " + ".join(f"CAST(c >= {e}::DECIMAL(6,4) AS INTEGER)" for e in _EDGES)
    return f"""SELECT bin, {dbl(0.5)} + bin * {dbl(0.025)} AS bin_lo,
       {dbl(0.5)} + (bin + 1) * {dbl(0.025)} AS bin_hi, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {reached} AS bin FROM (SELECT CAST({conf} AS DECIMAL(6,4)) AS c FROM {source}) WHERE c IS NOT NULL)
GROUP BY bin"""


ORACLES["confidence_histogram"] = _with(_histogram(_CONF, "labelled WHERE mismatch_label = 1"))
ORACLES["confidence_edges"] = _histogram("0.5 + (o_orderkey % 41) * 0.0125", "orders")

ORACLES["assigned_vs_inferred"] = _with(
    "SELECT ticket_priority AS priority, CAST(count(*) AS BIGINT) AS n, 'Assigned' AS type "
    "FROM labelled WHERE ticket_priority IS NOT NULL GROUP BY ticket_priority "
    "UNION ALL SELECT inferred_severity, CAST(count(*) AS BIGINT), 'Inferred' "
    "FROM labelled WHERE inferred_severity IS NOT NULL GROUP BY inferred_severity")


def _own_cuts(cols: dict) -> str:
    """CTE body: sorted list + count per score, for Spark-formula quartiles."""
    parts = []
    for n, c in cols.items():
        parts.append(f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)) AS {n}_l, "
                     f"count({c}) AS {n}_n")
    return ", ".join(parts)


def _code(x: str, n: str) -> str:
    q = [spark_quantile(f"q.{n}_l", f"q.{n}_n", p) for p in (0.25, 0.5, 0.75)]
    return (f"(CASE WHEN {x} <= {q[0]} THEN 0 WHEN {x} <= {q[1]} THEN 1 "
            f"WHEN {x} <= {q[2]} THEN 2 ELSE 3 END)")


_SIG = {"rule": "rule_score_norm", "cluster": "CAST(cluster_severity AS DOUBLE)",
        "resolution": "resolution_severity"}
_PAIRS = (("rule_vs_fused", "rule_code", "inferred_severity_numeric"),
          ("cluster_vs_fused", "cluster_code", "inferred_severity_numeric"),
          ("resolution_vs_fused", "resolution_code", "inferred_severity_numeric"),
          ("rule_vs_cluster", "rule_code", "cluster_code"),
          ("rule_vs_resolution", "rule_code", "resolution_code"),
          ("cluster_vs_resolution", "cluster_code", "resolution_code"))
ORACLES["signal_agreement"] = audit_with(_DOC) + f""",
q AS (SELECT {_own_cuts(_SIG)} FROM labelled),
sigcoded AS (SELECT l.*, {', '.join(f"{_code(c, n)} AS {n}_code" for n, c in _SIG.items())}
          FROM labelled l, q),
wide AS (SELECT {', '.join(f"avg(CAST(coalesce({a} = {b}, false) AS DOUBLE)) AS {n}" for n, a, b in _PAIRS)}
         FROM sigcoded)
""" + " UNION ALL ".join(f"SELECT '{n}' AS pair, round({n}, 9) AS agreement FROM wide"
                         for n, _, _ in _PAIRS)

_W = [dbl(w) for w in _DOC.weights]
_ABL = {
    "rule_only": f"round({_W[0]} * rule_z, 9)",
    "cluster_only": f"round({_W[1]} * cluster_z, 9)",
    "resolution_only": f"round({_W[2]} * resolution_z, 9)",
    "rule_cluster": f"round({_W[0]} * rule_z + {_W[1]} * cluster_z, 9)",
    "full": f"round({_W[0]} * rule_z + {_W[1]} * cluster_z + {_W[2]} * resolution_z, 9)",
}
ORACLES["ablation"] = audit_with(_DOC) + f""",
sc AS (SELECT *, {', '.join(f"{v} AS {k}_s" for k, v in _ABL.items())} FROM labelled),
q AS (SELECT {_own_cuts({k: f"{k}_s" for k in _ABL})} FROM sc),
fl AS (SELECT mismatch_label, {', '.join(
    f"CAST(coalesce(abs({_code(f'{k}_s', k)} - priority_numeric) >= 2, false) AS INTEGER) AS {k}_f"
    for k in _ABL)} FROM sc, q)
""" + " UNION ALL ".join(
    f"SELECT '{k}' AS configuration, round(avg(CAST({k}_f AS DOUBLE)), 9) AS mismatch_rate, "
    f"round(avg(CAST({k}_f = mismatch_label AS DOUBLE)), 9) AS agreement FROM fl" for k in _ABL)

ORACLES["label_distribution"] = _with(
    f"""SELECT category, n, round(CAST(n AS DOUBLE) * {dbl(100)} / CAST(total AS DOUBLE), 6) AS pct FROM (
  SELECT 'Consistent' AS category, count(*) FILTER (WHERE mismatch_label = 0) AS n, count(*) AS total FROM labelled
  UNION ALL SELECT 'Mismatch', count(*) FILTER (WHERE mismatch_label = 1), count(*) FROM labelled
  UNION ALL SELECT 'Hidden Crisis', count(*) FILTER (WHERE severity_delta >= 2), count(*) FROM labelled
  UNION ALL SELECT 'False Alarm', count(*) FILTER (WHERE severity_delta <= -2), count(*) FROM labelled)""")

_SUM = {"rule_score_norm": "rule_score_norm",
        "cluster_severity": "CAST(cluster_severity AS DOUBLE)",
        "resolution_severity": "resolution_severity",
        "inferred_severity_score": "inferred_severity_score"}
ORACLES["signal_summary"] = audit_with(_DOC) + f""",
q AS (SELECT {_own_cuts({k.split('_')[0] + str(i): v for i, (k, v) in enumerate(_SUM.items())})},
      {', '.join(f"count({v}) AS c{i}, avg({v}) AS a{i}, stddev_samp({v}) AS s{i}, min({v}) AS mi{i}, max({v}) AS ma{i}"
                 for i, v in enumerate(_SUM.values()))} FROM labelled)
""" + " UNION ALL ".join(
    f"SELECT '{k}' AS signal, CAST(c{i} AS BIGINT) AS count, round(a{i}, 9) AS mean, "
    f"round(s{i}, 9) AS std, round(mi{i}, 9) AS min, "
    + ", ".join(f"round({spark_quantile(f'q.{k.split(chr(95))[0]}{i}_l', f'q.{k.split(chr(95))[0]}{i}_n', p)}, 9) AS {nm}"
                for p, nm in ((0.25, 'p25'), (0.5, 'p50'), (0.75, 'p75')))
    + f", round(ma{i}, 9) AS max FROM q" for i, k in enumerate(_SUM))

# ---------------------------------------------------------- model input/split
_MI = audit_with(_DOC) + f""",
mi0 AS (SELECT ticket_id, full_text, ticket_channel, resolution_hours, mismatch_label FROM labelled
        WHERE full_text IS NOT NULL AND ticket_channel IS NOT NULL AND resolution_hours IS NOT NULL
          AND mismatch_label IS NOT NULL),
mi1 AS (SELECT *, CASE WHEN max(resolution_hours) OVER () = min(resolution_hours) OVER () THEN {dbl(0)}
          ELSE (resolution_hours - min(resolution_hours) OVER ())
               / (max(resolution_hours) OVER () - min(resolution_hours) OVER ()) END AS resolution_norm
        FROM mi0),
mi AS (SELECT ticket_id,
         full_text || ' [CHANNEL] ' || ticket_channel || ' [RESTIME] '
           || CAST(round_even(resolution_norm, 2) AS VARCHAR) AS input_text,
         ticket_channel, resolution_norm, mismatch_label AS label FROM mi1),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(ticket_id AS VARCHAR) || '-42'), ticket_id) AS rn,
              count(*) OVER (PARTITION BY label) AS cnt FROM mi),
sz AS (SELECT *, (2 * cnt + 5) // 10 AS k_test FROM rk),
sp AS (SELECT *, CASE WHEN rn <= k_test THEN 'test'
                      WHEN rn <= k_test + (cnt - k_test + 5) // 10 THEN 'val' ELSE 'train' END AS split
       FROM sz)
"""
ORACLES["model_input"] = _MI + (
    "SELECT ticket_id, input_text, ticket_channel, round(resolution_norm, 9) AS resolution_norm, "
    "label FROM mi")
ORACLES["stratified_split"] = _MI + "SELECT ticket_id, label, split FROM sp"
ORACLES["class_weights"] = _MI + (
    "SELECT label, n, CAST(sum(n) OVER () AS DOUBLE) / (CAST(2.0 AS DOUBLE) * n) AS weight FROM ("
    "SELECT label, CAST(count(*) AS BIGINT) AS n FROM sp WHERE split = 'train' GROUP BY label)")
ORACLES["channel_index"] = _with(
    "SELECT ticket_id, ticket_channel, "
    "CAST(dense_rank() OVER (ORDER BY ticket_channel) - 1 AS INTEGER) AS channel_index "
    "FROM labelled")
_TOK = "list_filter(regexp_split_to_array(lower(input_text), '\\s+'), lambda t: t <> '')"
ORACLES["truncate_tokens"] = _MI + (
    f"SELECT ticket_id, CAST(len({_TOK}) AS INTEGER) AS n_tokens, "
    f"CAST(least(len({_TOK}), 256) AS INTEGER) AS n_kept, "
    f"array_to_string({_TOK}[1:256], ' ') AS tokens_text FROM mi")



def _lloyd_step(n: int) -> str:
    """Assignment to centres ``c{n}`` and the next centres ``c{n + 1}``."""
    return f""",
a{n} AS (SELECT vec_id, e, arg_min(k, {{'d': list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'k': k}}) AS k
        FROM v, c{n} GROUP BY vec_id, e),
c{n + 1} AS (SELECT k, list(x ORDER BY i) AS m FROM (
        SELECT k, i, avg(x) AS x FROM (SELECT k, unnest(e) AS x, unnest(range(len(e))) AS i FROM a{n}) GROUP BY k, i) GROUP BY k)"""


ORACLES["kmeans_steps"] = """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, e AS m FROM v QUALIFY k < 4)""" + "".join(
    map(_lloyd_step, range(4))) + """
SELECT r.vec_id, CAST(a3.k AS INTEGER) AS cluster,
    round(list_sum(list_transform(list_zip(a3.e, c3.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance
FROM embeddings r LEFT JOIN a3 ON a3.vec_id = r.vec_id LEFT JOIN c3 ON c3.k = a3.k"""

# ------------------------------------------------------------ classification
_REPORT_WITH = f"""WITH j AS (SELECT l.quality, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
ml AS (SELECT list_sort(list(n_chars)) AS l, count(n_chars) AS n FROM j),
yp AS (SELECT quality AS label,
              CAST(n_chars > (SELECT {spark_quantile('l', 'n', 0.5)} FROM ml) AS INTEGER) AS prediction
       FROM j),
c AS (SELECT CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS DOUBLE) AS c00,
             CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS DOUBLE) AS c01,
             CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS DOUBLE) AS c10,
             CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS c11 FROM yp),
m AS (SELECT coalesce(c00 / nullif(c00 + c10, 0), 0) AS p0, coalesce(c00 / nullif(c00 + c01, 0), 0) AS r0,
             c00 + c01 AS s0,
             coalesce(c11 / nullif(c11 + c01, 0), 0) AS p1, coalesce(c11 / nullif(c11 + c10, 0), 0) AS r1,
             c10 + c11 AS s1,
             coalesce((c00 + c11) / nullif(c00 + c01 + c10 + c11, 0), 0) AS acc FROM c),
m2 AS (SELECT *, coalesce({dbl(2)} * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0,
              coalesce({dbl(2)} * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, s0 + s1 AS tot FROM m),
rep AS (
  SELECT 'Consistent' AS class, p0 AS precision, r0 AS recall, f0 AS f1, CAST(s0 AS BIGINT) AS support FROM m2
  UNION ALL SELECT 'Mismatch', p1, r1, f1, CAST(s1 AS BIGINT) FROM m2
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, CAST(tot AS BIGINT) FROM m2
  UNION ALL SELECT 'macro avg', (p0 + p1) / {dbl(2)}, (r0 + r1) / {dbl(2)}, (f0 + f1) / {dbl(2)},
                   CAST(tot AS BIGINT) FROM m2
  UNION ALL SELECT 'weighted avg', coalesce((p0 * s0 + p1 * s1) / nullif(tot, 0), 0),
                   coalesce((r0 * s0 + r1 * s1) / nullif(tot, 0), 0),
                   coalesce((f0 * s0 + f1 * s1) / nullif(tot, 0), 0), CAST(tot AS BIGINT) FROM m2)
"""


def _attacked_sql() -> str:
    """tickets -> paired -> robust: the fixed rules' prediction of each ticket
    before and after every attack."""
    w = [dbl(x) for x in preset("documented").weights]
    words = "|".join(sorted(CRISIS_TERMS, key=lambda t: (-len(t), t)))
    texts = {"before": ("lower(s)", "lower(t)"),
             "crisis_words_out": tuple(f"regexp_replace(lower({c}), '{words}', '', 'g')" for c in "st"),
             "low_words_in": ("lower(s)", f"coalesce(lower(t), '') || '. {', '.join(LOW_TERMS)}'"),
             "sentences_reversed": tuple(
                 f"array_to_string(list_reverse(string_split(regexp_replace(lower({c}), '([.!?])[ \\t\\n\\r]+', "
                 f"'\\1' || chr(1), 'g'), chr(1))), ' ')" for c in "st")}
    joined = ", ".join(f"coalesce({a}, '') || ' ' || coalesce({b}, '') AS {n}" for n, (a, b) in texts.items())
    tenths = {n: f"(10 * {hits_sql(n, CRISIS_TERMS)} - 5 * {hits_sql(n, LOW_TERMS)} - 3 * {negations_sql(n)})" for n in texts}
    raw = ", ".join(f"{t} AS {n}" for n, t in tenths.items())
    score = {n: (f"({w[0]} * {dbl(1.5)} + {w[1]} * (CAST(CASE WHEN {n} >= 20 THEN 3 WHEN {n} >= 10 THEN 2 "
                 f"WHEN {n} >= 0 THEN 1 ELSE 0 END AS DOUBLE) - {dbl(1.5)}) + {w[2]} * ({dbl(0)} - {dbl(1.5)}))") for n in texts}
    code = {n: (f"(CASE WHEN NOT known THEN 3 WHEN {s} < {dbl(-0.5)} THEN 0 WHEN {s} < {dbl(0.5)} THEN 1 "
                f"WHEN {s} < {dbl(1.5)} THEN 2 ELSE 3 END)") for n, s in score.items()}
    guess = ", ".join(f"coalesce(abs({c} - p) >= 2, false) AS {n}" for n, c in code.items())
    names = list(texts)[1:]
    every = " AND ".join(f"{n} = before" for n in names)
    stable = ", ".join(f"count(*) FILTER ({cond}) AS {n}_stable" for n, cond in
                       [*[(n, f"{n} = before") for n in names], ("all", every)])
    shares = " UNION ALL ".join(f"SELECT '{n}' AS attack, tickets, {n}_stable AS stable FROM counted"
                                for n in [*names, "all"])
    return prep_ctes(preset("documented")).lstrip() + f""",
raw_texts AS (SELECT r.ticket_id, r.ticket_subject AS s, r.ticket_description AS t, f.priority_numeric AS p,
        f.hours_parsed IS NOT NULL AS known FROM tickets r JOIN terms f ON f.ticket_id = r.ticket_id),
attacked AS MATERIALIZED (SELECT p, known, {joined} FROM raw_texts),
scored AS (SELECT p, known, {raw} FROM attacked),
guessed AS (SELECT {guess} FROM scored),
counted AS MATERIALIZED (SELECT count(*) AS tickets, {stable} FROM guessed),
robust AS (SELECT attack, tickets, stable, round(coalesce(CAST(stable AS DOUBLE) / nullif(tickets, 0), 0), 9) AS share
        FROM ({shares}))"""


ORACLES["robustness"] = f"WITH {_attacked_sql()} SELECT * FROM robust"
ORACLES["classification_report"] = _REPORT_WITH + "SELECT * FROM rep"
ORACLES["threshold_check"] = _REPORT_WITH + f""",
{_attacked_sql()},
req AS (SELECT * FROM (VALUES ('accuracy', {dbl(0.83)}), ('macro_f1', {dbl(0.82)}),
                              ('recall_consistent', {dbl(0.78)}), ('recall_mismatch', {dbl(0.78)}),
                              ('adversarial_robustness', {dbl(0.7)}))
        AS t(metric, required)),
val AS (SELECT 'accuracy' AS metric, f1 AS value FROM rep WHERE class = 'accuracy'
        UNION ALL SELECT 'macro_f1', f1 FROM rep WHERE class = 'macro avg'
        UNION ALL SELECT 'recall_consistent', recall FROM rep WHERE class = 'Consistent'
        UNION ALL SELECT 'recall_mismatch', recall FROM rep WHERE class = 'Mismatch'
        UNION ALL SELECT 'adversarial_robustness', share FROM robust WHERE attack = 'all')
SELECT req.metric, req.required, round(val.value, 9) AS value,
       coalesce(val.value >= req.required, false) AS passed
FROM req LEFT JOIN val ON req.metric = val.metric"""

# ------------------------------------------------------------------ streaming
ORACLES["score_fixed"] = "WITH " + prep_ctes(_DOC).lstrip() + f""",
fx AS (SELECT ticket_id, rule_score, priority_numeric,
         CASE WHEN rule_score >= 2 THEN 3 WHEN rule_score >= 1 THEN 2 WHEN rule_score >= 0 THEN 1
              ELSE 0 END AS cluster_severity,
         CASE WHEN hours_parsed IS NULL THEN NULL ELSE {dbl(0)} END AS resolution_severity
       FROM filled),
fs AS (SELECT *, {_W[0]} * ({dbl(3)} - {dbl(1.5)}) + {_W[1]} * (CAST(cluster_severity AS DOUBLE) - {dbl(1.5)})
                 + {_W[2]} * (resolution_severity - {dbl(1.5)}) AS inferred_severity_score FROM fx),
fc AS (SELECT *, CASE WHEN inferred_severity_score < {dbl(-0.5)} THEN 0
                      WHEN inferred_severity_score < {dbl(0.5)} THEN 1
                      WHEN inferred_severity_score < {dbl(1.5)} THEN 2 ELSE 3 END AS code FROM fs)
SELECT ticket_id, rule_score, cluster_severity, inferred_severity_score,
       {severity_name_sql('code')} AS inferred_severity,
       CAST(code - priority_numeric AS INTEGER) AS severity_delta FROM fc"""

ORACLES["score_frozen"] = ORACLES["fuse_documented"]

for _name in ("stream_json", "stream_csv"):
    ORACLES[_name] = ORACLES["fuse_documented"]
ORACLES["stream_quarantine"] = (
    "SELECT 'BROKEN,' || o_orderkey AS record, 'csv' AS format FROM orders WHERE o_orderkey % 100 = 0 "
    "UNION ALL SELECT '{\"Ticket ID\": ' || o_orderkey || ', \"BROKEN', 'json' FROM orders WHERE o_orderkey % 100 = 0")

_NAMED = ("CASE WHEN ticket_id % 41 = 0 THEN NULL ELSE 'TKT-' || "
          "(CASE WHEN ticket_id % 10 = 0 THEN ticket_id - ticket_id % 100 ELSE ticket_id END) END")
ORACLES["predictions_by_rule"] = _with(
    f"SELECT {_NAMED} AS ticket_id, ticket_priority, inferred_severity, "
    f"CAST(severity_delta AS INTEGER) AS severity_delta, mismatch_label AS prediction, "
    f"{_CONF} AS model_confidence, ticket_channel, resolution_hours FROM labelled")
