
import pytest
from pyspark.sql import functions as F

from sevscope.config import FIXED_CUTS, preset
from sevscope.functions import severity as sev
from sevscope.functions import text as tx
from sevscope.operators import fusion, signals
from sevscope.operators import reports as rp
from sevscope.streaming import score as stream


def _one(spark, col, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_parse_resolution_edge_rows(spark):
    vals = ["2 days 4 hours", "Monday 5", "-5 hours", "1,200 hours", "48", "2 Days",
            "1.2.3", ".", "pending", None, "12.5 hours"]
    got = _one(spark, tx.parse_resolution_hours("x"), vals)
    assert got == [48.0, 120.0, 5.0, 1.0, 48.0, 48.0, None, None, None, None, 12.5]


def test_strip_lower_priority(spark):
    values = [" high ", "\tCritical\n", "MEDIUM", None, "\u00a0High\u2003", "\x1clow\x1f", "\u3000low\x85", "a b"]
    assert _one(spark, tx.strip_lower("x"), values) == [v and v.strip().lower() for v in values]


def test_term_mask_equals_search(spark):
    texts = ["Production DOWN, not working", "nothing here", "asap urgent blocked", ""]
    low = F.lower("x")
    mask = tx.term_mask(low)
    got = _one(spark, F.struct(tx.terms_of_mask(mask).alias("a"), tx.matched_crisis_terms(low).alias("b"),
                               F.bit_count(mask).alias("n"), tx.crisis_hits(low).alias("m")), texts)
    assert all(r["a"] == r["b"] and r["n"] == r["m"] == len(r["a"]) for r in got)


def test_ranks_are_sparse_and_place_unseen_scores(spark):
    scores = [10] * 4 + [20] * 2 + [-30_000_000] + [25]
    hist = spark.createDataFrame([(s,) for s in scores], "rule_tenths int").groupBy("rule_tenths").agg(
        F.count(F.lit(1)).alias("n"))
    table = signals.rank_table(hist)
    assert table.count() <= 65 + 4
    model = fusion.SignalModel(preset("documented"), len(scores), *[0.0] * 5, -30_000_000, 25, *[0.0] * 4, {}, 0.0, 0.0,
                               rank=table)
    asked = [10, 20, 25, -30_000_000, 0, -5, 11, 19, 22, 24, 26, 2_000_000_000, -2_000_000_000, 15, 17]
    df = spark.createDataFrame([(s,) for s in asked], "rule_tenths int")
    got = {r["rule_tenths"]: r["rule_score_norm"] for r in model._rule_norm_join(df, False).collect()}
    for s in asked:
        less, eq = sum(x < s for x in scores), scores.count(s)
        want = 3 * (less + (eq + 1) / 2) / len(scores)
        assert abs(got[s] - want) < 1e-12, s


def test_missing_or_null_cluster_is_named(spark):
    import pytest
    rows = [(1, "urgent", "", "email", "t", "low", "5", None)]
    with pytest.raises(ValueError, match="cluster"):
        fusion.audit(_tickets(spark, rows), preset("documented"))


def test_histogram_edges_and_unknown_channels(spark):
    edges = [0.5 + 0.025 * k for k in range(20)]
    rows = [(1, float(f"{e:.4f}")) for e in edges] + [(1, 1.0), (1, 0.9999), (1, 0.5124), (0, 0.6), (1, None)]
    df = spark.createDataFrame(rows, "prediction int, model_confidence double")
    got = {r["bin"]: r["n"] for r in rp.confidence_histogram(df).collect()}
    assert got == {k: 1 + (k == 0) + 2 * (k == 19) for k in range(20)}
    heat = spark.createDataFrame([("t", "email", 1), ("t", "carrier pigeon", 3), ("u", "email", 2)],
                                 "ticket_type string, ticket_channel string, severity_delta int")
    wide = {r["ticket_type"]: r.asDict() for r in rp.delta_heatmap_wide(heat).collect()}
    assert wide["t"]["carrier pigeon"] == 3.0 and wide["u"]["carrier pigeon"] == 0.0


def test_rule_terms_overlaps_and_negations(spark):
    df = spark.createDataFrame([("Production DOWN, not working",), ("download the information",),
                                ("no no never without nothing not-no noël",)], "t string")
    low = F.lower("t")
    rows = df.select(tx.crisis_hits(low).alias("c"), tx.low_hits(low).alias("l"),
                     tx.negations(low).alias("n"),
                     tx.matched_crisis_terms(low).alias("m")).collect()
    c, l, n, m = rows[0]
    assert (c, l, n) == (3, 0, 1) and m == ["down", "not working", "production down"]
    assert 10 * c - 5 * l - 3 * n == 27
    c, l, n, m = rows[1]
    assert (c, l, n) == (1, 1, 0) and 10 * c - 5 * l - 3 * n == 5
    # whole words only; adjacent words each count; letters with accents are word chars
    assert rows[2]["n"] == 6


def test_keyword_value_and_weight(spark):
    df = spark.createDataFrame([("urgent critical outage down breach broken",), ("hello",)], "t string")
    m = tx.matched_crisis_terms(F.lower("t"))
    rows = df.select(tx.keyword_value(m), tx.keyword_weight(m)).collect()
    assert rows[0][0] == "urgent, critical, outage, down, breach" and rows[0][1] == 0.333
    assert rows[1][0] == "none" and rows[1][1] == 0.0


def test_equal_width_bins(spark):
    got = _one(spark, sev.equal_width_bin4(F.col("x"), 0.0, 3.0), [0.0, 0.75, 1.5, 1.51, 3.0],
               "x double")
    assert got == [0, 0, 1, 2, 3]
    assert _one(spark, sev.equal_width_bin4(F.col("x"), 2.0, 2.0), [2.0], "x double") == [1]


def test_null_score_falls_to_critical(spark):
    got = _one(spark, sev.bucket_strict(F.col("x"), FIXED_CUTS), [0.1, 1.0, 2.0, 3.0, None], "x double")
    assert got == [0, 1, 2, 3, 3]
    got = _one(spark, sev.bucket_closed(F.col("x"), (0, 1, 2)), [0.0, 1.0, 2.0, 2.5, None],
               "x double")
    assert got == [0, 1, 2, 3, 3]


def test_mismatch_type_and_direction(spark):
    got = _one(spark, sev.mismatch_type(F.col("x")), [3, 2, 1, 0, -2, None], "x int")
    assert got == ["Hidden Crisis", "Hidden Crisis", "Consistent", "Consistent", "False Alarm",
                   "Consistent"]
    assert _one(spark, sev.dossier_direction(F.col("x")), [0, 1, -1], "x int") == [
        "False Alarm", "Hidden Crisis", "False Alarm"]


def _tickets(spark, rows):
    schema = ("ticket_id long, ticket_subject string, ticket_description string, "
              "ticket_channel string, ticket_type string, ticket_priority string, "
              "resolution_time_hours string, cluster int")
    return spark.createDataFrame(rows, schema)


def test_percentile_rank_with_ties(spark):
    # rule scores 1, 2, 2, 5 -> ranks 1, 2.5, 2.5, 4 -> x 3 / 4
    texts = ["urgent", "urgent critical", "outage breach", "urgent critical outage breach broken"]
    rows = [(i, t, "", "email", "t", "low", "5", i % 2) for i, t in enumerate(texts)]
    a = fusion.audit(_tickets(spark, rows), preset("documented"))
    got = {r["ticket_id"]: r["rule_score_norm"] for r in a.labelled.collect()}
    assert [got[i] for i in range(4)] == [0.75, 1.875, 1.875, 3.0]


def test_unknown_priority_gives_null_delta(spark):
    rows = [(1, "urgent", "", "email", "t", "urgent", "5", 0),
            (2, "urgent", "", "email", "t", None, "6", 1),
            (3, "hello", "", "email", "t", "low", "7", 2),
            (4, "outage down", "", "chat", "t", "critical", "9", 3)]
    a = fusion.audit(_tickets(spark, rows), preset("documented"))
    got = {r["ticket_id"]: r for r in a.labelled.collect()}
    for i in (1, 2):
        assert got[i]["severity_delta"] is None
        assert got[i]["mismatch_label"] == 0
        assert got[i]["mismatch_type"] == "Consistent"


def test_all_times_missing_fails_clearly(spark):
    rows = [(1, "a", "", "email", "t", "low", None, 0), (2, "b", "", "email", "t", "low", "x", 1)]
    import pytest
    with pytest.raises(ValueError, match="resolution time"):
        fusion.audit(_tickets(spark, rows), preset("documented"))


def test_single_ticket_fixed_mode(spark):
    cfg = preset("documented")
    rows = [(1, "hello", "", "email", "t", "low", "5 hours", None),          # score 0.0 -> medium
            (2, "urgent", "", "email", "t", "low", "5 hours", None),         # 1.0 -> high
            (3, "urgent", "no", "email", "t", "low", "5 hours", None),       # 0.7 -> medium
            (4, "urgent critical", "", "email", "t", "low", "2 days", None),  # 2.0 -> high
            (5, "hello", "", "email", "t", "low", "", None),                 # no time -> critical
            (6, "hello", "", "email", "t", "low", None, None)]
    got = {r["ticket_id"]: r["inferred_severity"]
           for r in stream.score_fixed(_tickets(spark, rows), cfg).collect()}
    assert got == {1: "medium", 2: "high", 3: "medium", 4: "high", 5: "critical", 6: "critical"}


def test_lexicons_of_any_length(spark):
    from sevscope.functions import text as tx
    for n in (0, 1, 62, 63, 130):
        terms = tuple(f"w{k}x" for k in range(n))
        said = [t for k, t in enumerate(terms) if k % 7 == 0 or k in (61, 62, n - 1)]
        df = spark.createDataFrame([(" ".join(said),), ("",)], "t string")
        mask = df.select(tx.term_mask(F.col("t"), terms).alias("m"))
        got = mask.select(tx.terms_of_mask(F.col("m"), terms).alias("a"), tx.mask_hits(F.col("m"), terms).alias("n")).collect()
        assert [(list(r.a), r.n) for r in got] == [(said, len(said)), ([], 0)]


@pytest.mark.parametrize("window", [1, 40, 1 << 20])
def test_places_of_terms_in_a_batch(monkeypatch, window):
    import numpy as np
    import pyarrow as pa

    from sevscope.functions import text
    monkeypatch.setattr(text, "_WINDOW", window)
    rows = ["down", "", None, "dow", "n", "a down", "日noé", "system failure", "syste", "m failure", "infoinf", "o" * 99]
    terms = ["down", "no", "é", "system failure", "info", "o" * 50, "", "down"]
    for texts in (pa.array(rows, pa.string()), pa.array(rows, pa.string())[1:-1], pa.array([], pa.string())):
        want = [[r is not None and t in r for t in terms] for r in texts.to_pylist()]
        assert np.array_equal(text._holding(texts, terms), np.array(want, dtype=bool).reshape(len(texts), len(terms)))
