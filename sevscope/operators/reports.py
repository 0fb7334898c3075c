"""Report tables.

Every report is an aggregate with map-side partial aggregation: only a few
rows per partition and group reach the shuffle. Groups are few (severity
levels, channels, configurations), so a hot group never lands whole in one
task: partial aggregates are merged, not rows. Percentile cuts are exact
(``quantiles.exact_quantiles``: bucketed selection, no one-task merge of a
whole column) or ``percentile_approx`` when asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (BANNER_CONSISTENT, BANNER_MISMATCH, BANNER_TYPES, CLASS_NAMES, CONSISTENT, DEFAULT_WEIGHTS, FALSE_ALARM,
                      HIDDEN_CRISIS, REQUIRED_THRESHOLDS)
from ..functions import severity as sev
from .quantiles import exact_quantiles

PROBS = (0.25, 0.5, 0.75)


def _pct(col: Column, exact: bool = True, accuracy: int = 1_000_000) -> Column:
    arr = F.array(*[F.lit(p) for p in PROBS])
    return F.percentile(col, arr) if exact else F.percentile_approx(col, arr, accuracy)


def value_counts(df: DataFrame, col: str, key: str | None = None) -> DataFrame:
    """A8 + T3: counts of one column, NULLs dropped, descending (ties by key)."""
    key = key or col
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(key))
              .agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.col(key)))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two columns."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
              .groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), a, b))


def dashboard_kpis(scored: DataFrame) -> DataFrame:
    """A11 + A12 + P11 + F28: totals, mismatches, rate, hidden crises."""
    flag = F.col("prediction") == 1
    k = scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(flag).alias("mismatches"),
        F.count_if(flag & (F.col("severity_delta") > 0)).alias("hidden_crises"))
    rate = (F.col("mismatches").cast("double") / F.col("total").cast("double"))
    return k.select(
        "total", "mismatches", "hidden_crises",
        F.round(rate, 9).alias("mismatch_rate"),
        F.concat(F.bround(rate * 100.0, 1).cast("string"), F.lit("%")).alias("mismatch_rate_text"))


def display_texts(scored: DataFrame) -> DataFrame:
    """what a scored ticket shows: upper-case names, the confidence as a
    percentage and the banner (a positive delta is a hidden crisis, any other
    one, a missing one too, a false alarm)."""
    kind = F.when(F.col("severity_delta") > 0, BANNER_TYPES[0]).otherwise(BANNER_TYPES[1])
    return scored.select(
        "ticket_id", F.upper("ticket_priority").alias("assigned_priority"),
        F.upper("inferred_severity").alias("inferred_severity"), "severity_delta",
        F.concat(F.bround(F.col("model_confidence") * 100.0, 1).cast("string"), F.lit("%")).alias("confidence_text"),
        F.when(F.col("prediction") == 0, BANNER_CONSISTENT).otherwise(
            F.format_string(BANNER_MISMATCH, kind)).alias("banner"))


def delta_heatmap(df: DataFrame) -> DataFrame:
    """A13 long form: mean delta per (type, channel); NULL keys dropped."""
    return (df.where(F.col("ticket_type").isNotNull() & F.col("ticket_channel").isNotNull())
              .groupBy("ticket_type", "ticket_channel")
              .agg(F.round(F.avg("severity_delta"), 9).alias("mean_delta"),
                   F.count(F.lit(1)).alias("n")))


def delta_heatmap_wide(df: DataFrame, channels=None) -> DataFrame:
    """A13 as the app shows it: types x channels, absent cells 0. Without a
    given list the columns are all channels of the data, in order (one more
    pass over one narrow column)."""
    if channels is None:
        known = df.where(F.col("ticket_channel").isNotNull()).select("ticket_channel").distinct()
        channels = [r[0] for r in known.orderBy("ticket_channel").toLocalIterator()]
    return (df.where(F.col("ticket_type").isNotNull())
              .groupBy("ticket_type").pivot("ticket_channel", list(channels))
              .agg(F.round(F.avg("severity_delta"), 9))
              .na.fill(0.0))


def confidence_histogram(scored: DataFrame, bins: int = 20, lo: float = 0.5,
                         hi: float = 1.0) -> DataFrame:
    """Fixed-edge histogram of the confidence of flagged rows. The
    confidence has four places, so bins are found in whole ten-thousandths: a
    value on an edge opens its bin, whatever the edge's nearest double is."""
    width = (hi - lo) / bins
    first, step = round(lo * 10_000), round(width * 10_000)
    units = F.round(F.col("model_confidence") * 10_000).cast("long") - first
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(units / step).cast("int")))
    return (scored.where((F.col("prediction") == 1) & F.col("model_confidence").isNotNull())
                  .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
                  .select("bin", (F.lit(lo) + F.col("bin") * width).alias("bin_lo"),
                          (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_hi"), "n"))


def assigned_vs_inferred(df: DataFrame) -> DataFrame:
    """Assigned and inferred level counts, tagged."""
    a = value_counts(df, "ticket_priority", "priority").withColumn("type", F.lit("Assigned"))
    i = value_counts(df, "inferred_severity", "priority").withColumn("type", F.lit("Inferred"))
    return a.unionByName(i)


def label_distribution(df: DataFrame) -> DataFrame:
    """Label and type counts with their share of all tickets."""
    k = df.agg(F.count(F.lit(1)).alias("total"),
               F.count_if(F.col("mismatch_label") == 0).alias("c0"),
               F.count_if(F.col("mismatch_label") == 1).alias("c1"),
               F.count_if(F.col("severity_delta") >= 2).alias("hc"),
               F.count_if(F.col("severity_delta") <= -2).alias("fa"))
    rows = k.selectExpr(
        "total",
        f"stack(4, '{CONSISTENT}', c0, 'Mismatch', c1, '{HIDDEN_CRISIS}', hc, "
        f"'{FALSE_ALARM}', fa) AS (category, n)")
    return rows.select("category", "n",
                       F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


def signal_summary(df: DataFrame, cols=("rule_score_norm", "cluster_severity",
                                        "resolution_severity", "inferred_severity_score"),
                   exact: bool = True) -> DataFrame:
    """A10: count, mean, sample std, min, quartiles and max per signal."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
        if not exact:
            aggs.append(_pct(x, exact).alias(f"{c}__q"))
    wide = df.agg(*aggs)
    if exact:
        q = exact_quantiles(df, {c: F.col(c) for c in cols}, PROBS)
        wide = wide.withColumns({
            f"{c}__q": F.array(*[F.lit(v).cast("double") for v in q[c]]) for c in cols})
    items = []
    for c in cols:
        items.append(F.struct(
            F.lit(c).alias("signal"), F.col(f"{c}__n").alias("count"),
            *[F.round(v, 9).alias(n) for n, v in (
                ("mean", F.col(f"{c}__mean")), ("std", F.col(f"{c}__std")),
                ("min", F.col(f"{c}__min")), ("p25", F.col(f"{c}__q")[0]),
                ("p50", F.col(f"{c}__q")[1]), ("p75", F.col(f"{c}__q")[2]),
                ("max", F.col(f"{c}__max")))]))
    return wide.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def _own_cut_codes(df: DataFrame, scores: dict, exact: bool = True) -> tuple[DataFrame, dict]:
    """Bucket each named score column by its own p25/p50/p75 (one aggregate
    for every column), returning the frame with ``<name>_code`` columns."""
    if exact:
        cuts_row = exact_quantiles(df, scores, PROBS)
        cuts_row = {n: (None if v[0] is None else v) for n, v in cuts_row.items()}
    else:
        cuts_row = df.agg(*[_pct(c, exact).alias(n) for n, c in scores.items()]).first()
    out = df
    cuts = {}
    for n, c in scores.items():
        q = cuts_row[n]
        cuts[n] = tuple(q) if q is not None else None
        code = (sev.bucket_closed(c, q) if q is not None else F.lit(None).cast("int"))
        out = out.withColumn(f"{n}_code", code)
    return out, cuts


def signal_agreement(df: DataFrame, exact: bool = True) -> DataFrame:
    """A16 + A17: how often each signal's own quartile bucket agrees with the
    fused level and with each other signal (one wide aggregate, stacked)."""
    scores = {"rule": F.col("rule_score_norm"),
              "cluster": F.col("cluster_severity").cast("double"),
              "resolution": F.col("resolution_severity")}
    coded, _ = _own_cut_codes(df, scores, exact)
    fused = F.col("inferred_severity_numeric")
    pairs = [("rule_vs_fused", F.col("rule_code"), fused),
             ("cluster_vs_fused", F.col("cluster_code"), fused),
             ("resolution_vs_fused", F.col("resolution_code"), fused),
             ("rule_vs_cluster", F.col("rule_code"), F.col("cluster_code")),
             ("rule_vs_resolution", F.col("rule_code"), F.col("resolution_code")),
             ("cluster_vs_resolution", F.col("cluster_code"), F.col("resolution_code"))]
    wide = coded.agg(*[F.avg(F.coalesce((a == b), F.lit(False)).cast("double")).alias(n)
                       for n, a, b in pairs])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("pair"), F.round(F.col(n), 9).alias("agreement"))
        for n, _, _ in pairs])).alias("s")).select("s.*")


ABLATION_CONFIGS = (
    ("rule_only", (1, 0, 0)),
    ("cluster_only", (0, 1, 0)),
    ("resolution_only", (0, 0, 1)),
    ("rule_cluster", (1, 1, 0)),
    ("full", (1, 1, 1)),
)


def ablation(df: DataFrame, weights=DEFAULT_WEIGHTS, digits: int = 9,
             exact: bool = True) -> DataFrame:
    """Rebuild the label from signal subsets. Each configuration fuses
    its z-scores with the published weights, buckets by its own quartiles,
    flags |delta| >= 2 and is compared with the gated ``mismatch_label``.
    Two passes over the data in total (cuts, then rates), whatever the number
    of configurations."""
    z = (F.col("rule_z"), F.col("cluster_z"), F.col("resolution_z"))
    scores = {}
    for name, mask in ABLATION_CONFIGS:
        s = None
        for use, w, zc in zip(mask, weights, z):
            if use:
                term = F.lit(float(w)) * zc
                s = term if s is None else s + term
        scores[name] = F.round(s, digits)
    base = df.withColumns({f"{n}_score": c for n, c in scores.items()})
    coded, _ = _own_cut_codes(base, {n: F.col(f"{n}_score") for n in scores}, exact)
    aggs = []
    for n in scores:
        flag = F.coalesce(F.abs(F.col(f"{n}_code") - F.col("priority_numeric")) >= 2,
                          F.lit(False)).cast("int")
        aggs += [F.avg(flag.cast("double")).alias(f"{n}__rate"),
                 F.avg((flag == F.col("mismatch_label")).cast("double")).alias(f"{n}__agree")]
    wide = coded.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("configuration"),
                 F.round(F.col(f"{n}__rate"), 9).alias("mismatch_rate"),
                 F.round(F.col(f"{n}__agree"), 9).alias("agreement"))
        for n in scores])).alias("s")).select("s.*")


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """A20 + T2: total / (2 * count) per class."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(_whole())
    return (counts.select(label, "n",
                          (total.cast("double") / (F.lit(2.0) * F.col("n"))).alias("weight"))
                  .orderBy(label))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()


def confusion_wide(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Confusion counts of a binary classifier in one partial aggregate."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("c00"),
                  F.count_if((y == 0) & (p == 1)).alias("c01"),
                  F.count_if((y == 1) & (p == 0)).alias("c10"),
                  F.count_if((y == 1) & (p == 1)).alias("c11"))


def report_from_confusion(conf: DataFrame) -> DataFrame:
    """A21 + A22: per-class precision/recall/F1/support, accuracy, macro and
    weighted averages; undefined ratios are 0 (as the reference's library)."""
    c = {k: F.col(k).cast("double") for k in ("c00", "c01", "c10", "c11")}

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    p0, r0 = ratio(c["c00"], c["c00"] + c["c10"]), ratio(c["c00"], c["c00"] + c["c01"])
    p1, r1 = ratio(c["c11"], c["c11"] + c["c01"]), ratio(c["c11"], c["c11"] + c["c10"])
    s0, s1 = c["c00"] + c["c01"], c["c10"] + c["c11"]
    wide = conf.select(
        p0.alias("p0"), r0.alias("r0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), s1.alias("s1"),
        ratio(c["c00"] + c["c11"], s0 + s1).alias("acc"))
    wide = wide.withColumns({
        "f0": ratio(2.0 * F.col("p0") * F.col("r0"), F.col("p0") + F.col("r0")),
        "f1": ratio(2.0 * F.col("p1") * F.col("r1"), F.col("p1") + F.col("r1")),
        "tot": F.col("s0") + F.col("s1")})

    def avg(a, b):
        return (F.col(a) + F.col(b)) / 2.0

    def wavg(a, b):
        return ratio(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), F.col("tot"))

    rows = [
        (CLASS_NAMES[0], F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        (CLASS_NAMES[1], F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"),
         F.col("acc"), F.col("tot")),
        ("macro avg", avg("p0", "p1"), avg("r0", "r1"), avg("f0", "f1"), F.col("tot")),
        ("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), F.col("tot")),
    ]
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("class"), p.alias("precision"), r.alias("recall"),
                 f.alias("f1"), s.cast("long").alias("support"))
        for n, p, r, f, s in rows])).alias("s")).select("s.*")


def classification_report(df: DataFrame, label: str = "label",
                          pred: str = "prediction") -> DataFrame:
    return report_from_confusion(confusion_wide(df, label, pred))


def selection_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy and macro F1 in one row."""
    rep = classification_report(df, label, pred)
    return rep.agg(F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
                   F.max(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("f1_macro"))


def threshold_check(report: DataFrame, robust: DataFrame | None = None) -> DataFrame:
    """Required values against the report and the robustness table
    (without one its metric is undefined), pass/fail per metric."""
    spark = report.sparkSession
    metrics = report.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("metric"),
                 F.when(F.col("class") == "accuracy", F.col("f1")).alias("value")),
        F.struct(F.lit("macro_f1").alias("metric"),
                 F.when(F.col("class") == "macro avg", F.col("f1")).alias("value")),
        F.struct(F.lit("recall_consistent").alias("metric"),
                 F.when(F.col("class") == CLASS_NAMES[0], F.col("recall")).alias("value")),
        F.struct(F.lit("recall_mismatch").alias("metric"),
                 F.when(F.col("class") == CLASS_NAMES[1], F.col("recall")).alias("value")),
    )).alias("m")).select("m.*").where(F.col("value").isNotNull())
    if robust is not None:
        metrics = metrics.unionByName(robust.where("attack = 'all'").select(
            F.lit("adversarial_robustness").alias("metric"), F.col("share").alias("value")))
    req = spark.createDataFrame(list(REQUIRED_THRESHOLDS), "metric string, required double")
    return (req.join(metrics, "metric", "left")
            .select("metric", "required", F.round("value", 9).alias("value"),
                    F.coalesce(F.col("value") >= F.col("required"), F.lit(False)).alias("passed")))
