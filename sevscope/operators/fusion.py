"""Signal fusion and pseudo-labels.

``SignalModel`` separates the batch statistics (``fit``) from their use
(``transform``), in the manner of a Spark ML estimator/model pair:

* ``fit`` runs partial aggregates over the prepared tickets: the median of
  the parsed hours, the hours per cluster, the histogram of the rule score and
  the percentiles of the fused score. Scalars and one row per cluster reach the
  driver; the rule score's ranks stay a table with a row per distinct score.
* ``transform`` is a projection with literals plus equi-joins against the rank
  table, whose strategy the optimizer picks by its size. It has no aggregate,
  so it also runs on a stream and never changes a ticket's label by batch.

``audit`` takes tickets with a ``cluster`` column as they are; otherwise it
fits a cluster model on their vectors or texts, which the signal model keeps.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIXED_CUTS, AuditConfig, MLConfig
from ..functions import severity as sev
from ..session import release, stage
from . import clusters, prep, signals
from .quantiles import exact_quantiles

OUTPUT_COLUMNS = (
    "rule_score_norm", "cluster_severity", "resolution_severity", "rule_z",
    "cluster_z", "resolution_z", "inferred_severity_score", "inferred_severity",
    "inferred_severity_numeric", "severity_delta", "rule_agrees", "rule_severity",
    "signal_consensus", "mismatch_label", "mismatch_type")


@dataclass
class SignalModel:
    cfg: AuditConfig
    n: int
    median_hours: float
    hours_min: float
    hours_max: float
    hours_mean: float
    hours_std: float
    rule_lo: int
    rule_hi: int
    rule_norm_mean: float
    rule_norm_std: float
    rule_norm_min: float
    rule_norm_max: float
    cluster_severity: dict
    cluster_mean: float
    cluster_std: float
    cuts: tuple = FIXED_CUTS
    rank: DataFrame | None = field(default=None, repr=False)
    clusterer: clusters.ClusterModel | None = field(default=None, repr=False)

    # ------------------------------------------------------------------ fit
    @classmethod
    def fit(cls, filled: DataFrame, cfg: AuditConfig, median: float) -> "SignalModel":
        """Fit on prepared tickets that carry ``resolution_hours`` (filled),
        ``cluster`` and the rule terms (``prep.add_rule_terms``)."""
        st = signals.collect_stats(filled)
        hist = stage(signals.rule_histogram(filled), "rule_histogram")
        ends = hist.agg(F.min("rule_tenths").alias("lo"), F.max("rule_tenths").alias("hi")).first()
        lo, hi = ends["lo"], ends["hi"]
        rank = None
        if cfg.rule_norm == "pct_rank":
            rank = stage(signals.rank_table(hist), "rule_rank")
            values = rank.where("n > 0").select(signals.exact_norm(st.n).alias("v"), "n")
        else:
            values = hist.select(sev.minmax(F.col("rule_tenths") / 10.0, lo / 10.0, hi / 10.0).alias("v"), "n")
        norm_mean, norm_std, norm_min, norm_max = signals.moments(values, "v", "n")
        ranks = signals.cluster_ranks(st.clusters)
        cl_pairs = [(float(ranks[c]), cnt) for c, cnt, _ in st.clusters]
        cl_mean, cl_std = signals.weighted_moments(cl_pairs)
        model = cls(cfg=cfg, n=st.n, median_hours=median, hours_min=st.hours_min,
                    hours_max=st.hours_max, hours_mean=st.hours_mean,
                    hours_std=st.hours_std, rule_lo=lo, rule_hi=hi,
                    rule_norm_mean=norm_mean, rule_norm_std=norm_std,
                    rule_norm_min=norm_min, rule_norm_max=norm_max,
                    cluster_severity=ranks, cluster_mean=cl_mean, cluster_std=cl_std, rank=rank)
        if cfg.cuts == "percentile":
            model.cuts = model._percentile_cuts(filled)
        return model

    def _percentile_cuts(self, filled: DataFrame) -> tuple:
        """p25/p50/p75 of the fused score, linear interpolation."""
        score = self._with_signals(filled, True).select("inferred_severity_score")
        if self.cfg.exact:
            cuts = exact_quantiles(score, {"s": F.col("inferred_severity_score")},
                                   [0.25, 0.5, 0.75])["s"]
            cuts = None if cuts[0] is None else cuts
        else:
            probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
            agg = F.percentile_approx("inferred_severity_score", probs, self.cfg.accuracy)
            cuts = score.agg(agg.alias("p")).first()["p"]
        if cuts is None:
            raise ValueError("fused score is undefined for every ticket")
        return tuple(float(c) for c in cuts)

    # ------------------------------------------------------------ transform
    def _rule_norm_join(self, df: DataFrame, seen: bool) -> DataFrame:
        """Attach ``rule_score_norm``. ``seen`` says that every score is
        one of the fitted ones; otherwise an unseen score takes its place
        between its two neighbours (only such rows have a key in that join)."""
        if self.cfg.rule_norm == "minmax":
            return df.withColumn("rule_score_norm", sev.minmax(
                F.col("rule_score"), self.rule_lo / 10.0, self.rule_hi / 10.0))
        exact = self.rank.where("n > 0").select(
            F.col("rule_tenths").cast("int").alias("_rk"), signals.exact_norm(self.n).alias("rule_score_norm"))
        df = df.join(exact, F.col("rule_tenths") == F.col("_rk"), "left").drop("_rk")
        if seen:
            return df
        gaps = self.rank.select(F.col("bucket").alias("_rb"), F.col("rule_tenths").alias("_from"),
                                F.col("until").alias("_until"), signals.gap_norm(self.n).alias("_gap"))
        t = F.col("rule_tenths")
        key = F.when(F.col("rule_score_norm").isNull(), signals.score_bucket(t))
        df = df.withColumn("_key", key).join(
            gaps, (F.col("_key") == F.col("_rb")) & (t >= F.col("_from"))
            & (F.col("_until").isNull() | (t < F.col("_until"))), "left")
        return df.withColumn("rule_score_norm", F.coalesce("rule_score_norm", "_gap")).drop(
            "_key", "_rb", "_from", "_until", "_gap")

    def _cluster_expr(self) -> Column:
        """Cluster -> severity rank (k literal branches)."""
        expr = None
        for c, r in sorted(self.cluster_severity.items()):
            cond = F.col("cluster") == c
            expr = F.when(cond, F.lit(r)) if expr is None else expr.when(cond, F.lit(r))
        if expr is None:
            return F.lit(None).cast("int")
        return expr.otherwise(F.lit(None).cast("int"))

    def _with_signals(self, df: DataFrame, seen: bool) -> DataFrame:
        cfg = self.cfg
        w_rule, w_cluster, w_res = (float(w) for w in cfg.weights)
        df = self._rule_norm_join(df, seen)
        df = df.withColumns({
            "cluster_severity": self._cluster_expr(),
            "resolution_severity": sev.minmax(F.col("resolution_hours"),
                                              self.hours_min, self.hours_max),
        })
        df = df.withColumns({
            "rule_z": sev.zscore(F.col("rule_score_norm"), self.rule_norm_mean,
                                 self.rule_norm_std),
            "cluster_z": sev.zscore(F.col("cluster_severity").cast("double"),
                                    self.cluster_mean, self.cluster_std),
            # z(min-max(h)) = z(h): the resolution z-score needs hours only
            "resolution_z": sev.zscore(F.col("resolution_hours"), self.hours_mean,
                                       self.hours_std),
        })
        if cfg.fuse == "zscore":
            raw = (F.lit(w_rule) * F.col("rule_z") + F.lit(w_cluster) * F.col("cluster_z")
                   + F.lit(w_res) * F.col("resolution_z"))
        else:
            raw = (F.lit(w_rule) * F.col("rule_score_norm")
                   + F.lit(w_cluster) * F.col("cluster_severity")
                   + F.lit(w_res) * F.col("resolution_severity"))
        return df.withColumn("inferred_severity_score", F.round(raw, cfg.score_digits))

    def prepare(self, tickets: DataFrame) -> DataFrame:
        """Raw tickets of a later batch or a stream, with rule terms, the
        fitted median in place of missing hours, and their cluster."""
        prepared = prepare_signals(tickets, self.cfg)
        if "cluster" not in prepared.columns:
            if self.clusterer is None:
                raise ValueError("tickets lack a cluster column and the model has no cluster model")
            prepared = clusters.assign(self.clusterer, prepared)
        return prep.fill_hours(prepared, self.median_hours)

    def transform(self, filled: DataFrame, seen: bool = False) -> DataFrame:
        cfg = self.cfg
        df = self._with_signals(filled, seen)
        score = F.col("inferred_severity_score")
        code = (sev.bucket_closed(score, self.cuts) if cfg.cuts == "percentile"
                else sev.bucket_strict(score, self.cuts))
        df = df.withColumn("inferred_severity_numeric", code)
        delta = F.col("inferred_severity_numeric") - F.col("priority_numeric")
        df = df.withColumns({
            "inferred_severity": sev.severity_name(F.col("inferred_severity_numeric")),
            "severity_delta": delta,
        })
        p = F.col("priority_numeric")
        big = F.abs(F.col("severity_delta")) >= 2
        rule_sev = sev.equal_width_bin4(F.col("rule_score_norm"), self.rule_norm_min,
                                        self.rule_norm_max)
        df = df.withColumns({
            "rule_agrees": sev.rule_agrees(F.col("severity_delta"), F.col("rule_score_norm")),
            "rule_severity": rule_sev,
        })
        df = df.withColumn(
            "signal_consensus",
            (F.abs(F.col("rule_severity") - p) + F.abs(F.col("cluster_severity") - p)
             + F.abs(F.rint(F.col("resolution_severity")) - p)).cast("double"))
        if cfg.gate == "rule_agrees":
            flag = big & F.col("rule_agrees")
        elif cfg.gate == "consensus":
            flag = big & (F.col("signal_consensus") >= 3.0)
        else:
            flag = big
        return df.withColumns({
            "mismatch_label": F.coalesce(flag, F.lit(False)).cast("int"),
            "mismatch_type": sev.mismatch_type(F.col("severity_delta")),
        })

    # -------------------------------------------------------------- persist
    def to_json(self) -> str:
        d = {k: v for k, v in self.__dict__.items() if k not in ("rank", "cfg", "clusterer")}
        d["cfg"] = asdict(self.cfg)
        d["cluster_severity"] = [[int(k), int(v)] for k, v in self.cluster_severity.items()]
        d["cuts"] = list(self.cuts)
        d["has_clusterer"] = self.clusterer is not None
        return json.dumps(d)

    def save(self, path: str) -> None:
        """Metadata as one JSON line, the rank table as Parquet, the cluster
        model beside them."""
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.to_json(),)], "meta string") \
             .coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        if self.rank is not None:
            self.rank.write.mode("overwrite").parquet(f"{path}/rule_rank")
        if self.clusterer is not None:
            self.clusterer.save(spark, f"{path}/clusters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SignalModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        cfg_d = meta.pop("cfg")
        clusterer = clusters.ClusterModel.load(spark, f"{path}/clusters") if meta.pop("has_clusterer") else None
        for k in ("weights", "crisis_terms", "low_terms"):
            cfg_d[k] = tuple(cfg_d[k])
        cfg = AuditConfig(**cfg_d)
        meta["cluster_severity"] = {k: v for k, v in meta["cluster_severity"]}
        meta["cuts"] = tuple(meta["cuts"])
        rank = spark.read.parquet(f"{path}/rule_rank") if cfg.rule_norm == "pct_rank" else None
        return cls(cfg=cfg, rank=rank, clusterer=clusterer, **meta)


#: What the signals and the reports need of a prepared ticket: no text.
NARROW = ("ticket_id", "ticket_channel", "ticket_type", "ticket_priority", "priority_numeric",
          "hours_parsed", "crisis_mask", "crisis_hits", "low_hits", "negations", "rule_tenths",
          "rule_score", "cluster")


@dataclass
class Audit:
    """Result of ``audit``: the fitted model, the labelled tickets without
    their texts (from a staged table), and all prepared columns."""
    model: SignalModel
    labelled: DataFrame
    prepared: DataFrame

    def with_text(self) -> DataFrame:
        """The labelled tickets with every prepared column; reads the source
        again instead of keeping a second copy of the texts."""
        return self.model.transform(prep.fill_hours(self.prepared, self.model.median_hours), seen=True)


def prepare_signals(df: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Prepared tickets with rule terms (no statistics needed yet)."""
    return prep.add_rule_terms(prep.prepare(df, cfg), cfg)


def audit(df: DataFrame, cfg: AuditConfig | None = None, ml_cfg: MLConfig | None = None,
          keep: dict | None = None) -> Audit:
    """Fit + transform on one batch (the reference's behaviour). The texts are
    searched once; the narrow result is staged for the statistics' passes.
    ``keep`` names more columns to make from the prepared tickets in that one
    pass and to keep beside the signals."""
    cfg = cfg or AuditConfig()
    prepared = prepare_signals(df, cfg)
    kept = [c.alias(name) for name, c in (keep or {}).items()]
    clusterer = None
    if "cluster" in prepared.columns:
        narrow = stage(prepared.select(*NARROW, *kept), "signals")
    elif "embedding" in prepared.columns:
        clusterer = clusters.fit(prepared, ml_cfg)
        prepared = clusters.assign(clusterer, prepared)
        narrow = stage(prepared.select(*NARROW, *kept), "signals")
    else:
        ml_cfg = ml_cfg or MLConfig()
        words = clusters.word_slots(F.col("full_text"), ml_cfg.num_features).alias("word_slots")
        found = stage(prepared.select(*[c for c in NARROW if c != "cluster"], words, *kept), "signals_words")
        clusterer, table = clusters.fit_words(found, ml_cfg)
        release(found)
        narrow = stage(clusterer.assign_vectors(table), "signals")
        release(table)
        prepared = clusters.assign(clusterer, prepared)
    median = prep.hours_median(narrow, cfg)
    filled = prep.fill_hours(narrow, median)
    model = SignalModel.fit(filled, cfg, median)
    model.clusterer = clusterer
    return Audit(model=model, labelled=model.transform(filled, seen=True), prepared=prepared)
