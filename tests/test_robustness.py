"""Attacks on a ticket's wording, and ten tickets worked by hand."""

import pytest
from pyspark.sql import functions as F

from sevscope.config import preset
from sevscope.operators import reports, robustness
from sevscope.streaming import score

CFG = preset("documented")
SCHEMA = ("ticket_id long, ticket_subject string, ticket_description string, ticket_channel string, "
          "ticket_priority string, resolution_time_hours string")


def _tickets(spark, rows):
    return spark.createDataFrame([(k, s, d, "email", p, "5 hours") for k, (s, d, p) in enumerate(rows)], SCHEMA)


def test_attacks_rewrite_texts(spark):
    df = spark.createDataFrame([("URGENT: Production Down. Data loss! Why?  Then",), ("",), (None,)], "t string")
    got = df.select(robustness.without_words(F.col("t"), CFG.crisis_terms).alias("a"),
                    robustness.with_words(F.col("t"), ("minor", "how to")).alias("b"),
                    robustness.reordered(F.col("t")).alias("c")).collect()
    assert tuple(got[0]) == (": . ! why?  then", "urgent: production down. data loss! why?  then. minor, how to",
                             "then why? data loss! urgent: production down.")
    assert tuple(got[1]) == ("", ". minor, how to", "")
    assert tuple(got[2]) == (None, ". minor, how to", None)


# With usable hours the fixed rules score 0.6 + 0.4 * (cluster - 1.5) - 0.3:
# rule score >= 2 -> 0.9 (high, 2); >= 1 -> 0.5 (high, 2); >= 0 -> 0.1 (medium,
# 1); below 0 -> -0.3 (medium, 1). All low words together take 5.5 points.
# (subject, description, priority), prediction before, after words out, after
# low words in, after reversing.
TEN = [
    (("urgent outage", "severe breach", "low"), 1, 0, 0, 1),          # high against low: two apart
    (("urgent outage", "severe breach", "medium"), 0, 0, 0, 0),
    (("urgent outage", "severe breach", "critical"), 0, 1, 1, 0),     # medium against critical
    (("hello", "there", "critical"), 1, 1, 1, 1),
    (("hello", "there", "low"), 0, 0, 0, 0),
    (("urgent", "please", "low"), 1, 0, 0, 1),
    (("urgent", "please", "high"), 0, 0, 0, 0),
    (("not urgent", "no", "low"), 0, 0, 0, 0),                        # 1 - 0.6: medium
    (("asap", "now. question", "low"), 0, 0, 0, 0),                   # 1 - 0.5: medium
    ((None, None, "critical"), 1, 1, 1, 1),
]


def test_ten_tickets_by_hand(spark):
    t = _tickets(spark, [r[0] for r in TEN])
    paired = robustness.paired_predictions(t, lambda df: score.predict_fixed(df, CFG), CFG)
    assert set(t.columns) <= set(paired.columns)
    names = list(robustness.attacks(CFG))
    got = {r.ticket_id: (r.before, *[r[n] for n in names], r.ticket_subject) for r in paired.collect()}
    assert got == {k: (*r[1:], r[0][0]) for k, r in enumerate(TEN)}
    table = {r.attack: (r.tickets, r.stable, r.share) for r in robustness.robustness(paired, names).collect()}
    assert table == {"crisis_words_out": (10, 7, 0.7), "low_words_in": (10, 7, 0.7), "sentences_reversed": (10, 10, 1.0),
                     "all": (10, 7, 0.7)}
    report = reports.classification_report(t.select(F.lit(1).alias("label"), F.lit(1).alias("prediction")))
    rows = {r.metric: (r.value, r.passed) for r in reports.threshold_check(
        report, robustness.robustness(paired, names)).collect()}
    assert len(rows) == 5 and rows["adversarial_robustness"] == (0.7, True)
    assert {r.metric: r.passed for r in reports.threshold_check(report).collect()}["adversarial_robustness"] is False


def test_no_tickets(spark):
    got = robustness.check(spark.createDataFrame([], SCHEMA),
                           lambda df: score.predict_fixed(df, CFG), CFG).collect()
    assert {(r.tickets, r.stable, r.share) for r in got} == {(0, 0, 0.0)}


@pytest.mark.slow
def test_a_fitted_classifier_can_be_attacked(spark, small_dir):
    from sevscope.config import MLConfig
    from sevscope.operators import fusion, ml
    from sevscope.plans import jobs
    from sevscope.sources.tickets import tickets
    small = MLConfig(num_features=1 << 10, reg_params=(0.1,), max_iter=10)
    raw = tickets(spark, small_dir)
    a = fusion.audit(raw, CFG, small, keep={"text_slots": ml.text_slots(small)})
    model = ml.train(ml.model_rows(a.labelled, a.model.hours_min, a.model.hours_max, small), small).model
    got = {r.attack: r for r in robustness.check(raw, lambda t: jobs.score_tickets(a.model, model, t), CFG).collect()}
    assert got["all"].tickets == 1500 and got["all"].stable <= min(r.stable for r in got.values())


def test_words_are_taken_out_from_left_to_right(spark):
    texts = ["dodownwn", "production downdown", "urgenturgent asaps", "noédowné日", "down" * 3000, "", None, "dow", "n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    want = df.select("k", F.regexp_replace(F.lower("t"), "|".join(sorted(CFG.crisis_terms, key=lambda t: (-len(t), t))), ""))
    out = df.select("k", robustness.without_words(F.col("t"), CFG.crisis_terms).alias("t"))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}
    assert df.select(robustness.without_words(F.col("t"), ("b", "abc", "ab", "bcd"))).collect()[0][0] == "dodownwn"
    over = spark.createDataFrame([("xabcd abd babcabcd",)], "t string")
    assert over.select(robustness.without_words(F.col("t"), ("b", "abc", "ab", "bcd"))).first()[0] == "xd d d"


def test_no_attack_searches_a_text_in_the_jvm(spark):
    t = _tickets(spark, [TEN[0][0]])
    plan = robustness.paired_predictions(t, lambda df: score.predict_fixed(df, CFG), CFG)._jdf.queryExecution().optimizedPlan().toString()
    assert "production down|" not in plan
