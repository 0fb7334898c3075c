"""Golden classification report (published test metrics) and report shapes."""

import json

import pytest

from sevscope.operators import reports as rp

# Published test report: confusion counts implied by recall x support.
GOLDEN = {
    "Consistent": (0.9275779376498801, 0.6689726738152888, 0.7773311897106109, 2891),
    "Mismatch": (0.5002610966057441, 0.8638412984670875, 0.6335978835978836, 1109),
    "macro avg": (0.7139195171278121, 0.7664069861411882, 0.7054645366542472, 4000),
    "weighted avg": (0.8091043434703934, 0.723, 0.7374811305908572, 4000),
}


def test_golden_report(spark):
    conf = spark.createDataFrame([(1934, 957, 151, 958)], "c00 long, c01 long, c10 long, c11 long")
    rows = {r["class"]: r for r in rp.report_from_confusion(conf).collect()}
    for name, (p, r, f, s) in GOLDEN.items():
        assert rows[name]["precision"] == pytest.approx(p, abs=1e-12)
        assert rows[name]["recall"] == pytest.approx(r, abs=1e-12)
        assert rows[name]["f1"] == pytest.approx(f, abs=1e-12)
        assert rows[name]["support"] == s
    assert rows["accuracy"]["f1"] == pytest.approx(0.723, abs=1e-12)


def test_report_from_rows_and_thresholds(spark):
    data = [(0, 0)] * 1934 + [(0, 1)] * 957 + [(1, 0)] * 151 + [(1, 1)] * 958
    df = spark.createDataFrame(data, "label int, prediction int")
    rep = rp.classification_report(df)
    chk = {r["metric"]: r for r in rp.threshold_check(rep).collect()}
    assert chk["accuracy"]["passed"] is False
    assert chk["macro_f1"]["passed"] is False
    assert chk["recall_consistent"]["passed"] is False
    assert chk["recall_mismatch"]["passed"] is True


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    rows = {r["class"]: r for r in rp.classification_report(df).collect()}
    assert rows["Mismatch"]["precision"] == 0.0 and rows["Mismatch"]["f1"] == 0.0


def test_value_counts_drop_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "x string")
    assert [(r["x"], r["n"]) for r in rp.value_counts(df, "x").collect()] == [("a", 2), ("b", 1)]


def test_dossier_json_shape(spark, small_dir):
    from sevscope.plans.queries import REGISTRY
    rows = REGISTRY["dossier_json"](spark, small_dir).limit(5).collect()
    assert rows
    d = json.loads(rows[0]["json"])
    assert set(d) == {"ticket_id", "assigned_priority", "inferred_severity", "mismatch_type",
                      "severity_delta", "feature_evidence", "constraint_analysis", "confidence"}
    ev = d["feature_evidence"]
    assert [e["signal"] for e in ev] == ["keyword", "resolution_time", "embedding_cluster"]
    assert set(ev[0]) == {"signal", "value", "weight"}
    assert set(ev[1]) == {"signal", "value", "interpretation"}
