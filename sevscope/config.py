"""Fixed values and the audit configuration.

The constants in the first block must equal the published behaviour of the
audited system for results to match; they are stated here once, in their
natural order, and everything else reads them from this module.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay exactly as published for matching results)
# ---------------------------------------------------------------------------

# Crisis lexicon, in order (order matters for the dossier keyword list).
CRISIS_TERMS = (
    "urgent", "critical", "outage", "down", "breach", "broken", "emergency",
    "failure", "not working", "data loss", "cannot access", "system failure",
    "escalate", "immediately", "asap", "severe", "blocked", "production down",
)

# Low-urgency lexicon, in order.
LOW_TERMS = (
    "question", "inquiry", "how to", "tutorial", "info", "wondering",
    "when will", "update me", "minor", "small issue", "curious",
)

# Negation words, counted once per whole-word occurrence.
NEGATION_WORDS = ("not", "no", "never", "without")

# Ordinal severity scale.
SEVERITY_LEVELS = ("low", "medium", "high", "critical")

# Fusion weights: rule, embedding cluster, resolution time.
DEFAULT_WEIGHTS = (0.4, 0.4, 0.2)

# Fixed cut points of the training script (strict "<").
FIXED_CUTS = (0.75, 1.5, 2.25)

# Single-ticket cut points (strict "<") and centring constant.
SINGLE_CUTS = (-0.5, 0.5, 1.5)
SINGLE_CENTRE = 1.5

# Labels of the two classes of the mismatch classifier.
CLASS_NAMES = ("Consistent", "Mismatch")

# Mismatch type names.
HIDDEN_CRISIS = "Hidden Crisis"
FALSE_ALARM = "False Alarm"
CONSISTENT = "Consistent"

# Banner of a scored ticket by its prediction and the sign of its delta.
BANNER_CONSISTENT = "✅ **CONSISTENT** — Priority assignment looks correct."
BANNER_MISMATCH = "❌ **MISMATCH DETECTED** — %s"
BANNER_TYPES = ("Hidden Crisis 🚨", "False Alarm ⚠️")

# Evaluation thresholds of the published evaluation table.
REQUIRED_THRESHOLDS = (
    ("accuracy", 0.83),
    ("macro_f1", 0.82),
    ("recall_consistent", 0.78),
    ("recall_mismatch", 0.78),
    ("adversarial_robustness", 0.7),
)

# Split fractions: 20 % test, then 10 % of the rest for validation.
TEST_FRACTION = 0.2
VAL_FRACTION = 0.1
SPLIT_SEED = 42

# Classifier input markers and token cap.
CHANNEL_MARKER = " [CHANNEL] "
RESTIME_MARKER = " [RESTIME] "
MAX_TOKENS = 256

# Dossier wordings, one set per front end.
DOSSIER_TEXT = {
    "predict": {
        "resolution_signal": "resolution_time_hours",
        "above": "Above median — suggests elevated complexity",
        "below": "Below median — routine resolution",
        "analysis": (
            "The ticket was assigned '%s' but semantic and keyword signals "
            "indicate '%s' severity. Resolution time of %s hours and embedding "
            "cluster membership further support this discrepancy, yielding a "
            "severity delta of %s."
        ),
    },
    "app": {
        "resolution_signal": "resolution_time",
        "above": "Above median — elevated complexity",
        "below": "Below median — routine",
        "analysis": (
            "Ticket assigned '%s' but signals indicate '%s' severity. "
            "Resolution time of %sh and cluster membership support this "
            "discrepancy. Severity delta: %s."
        ),
    },
    "notebook": {
        "resolution_signal": "resolution_time",
        "above": "Above median — suggests elevated complexity",
        "below": "Below median — routine resolution",
        "analysis": (
            "The ticket was assigned '%s' but semantic analysis and keyword "
            "signals indicate '%s' severity. Resolution time of %s hours and "
            "cluster membership further support this discrepancy, resulting in "
            "a severity delta of %s."
        ),
    },
}
DOSSIER_KEYWORD_LIMIT = 5

# ---------------------------------------------------------------------------
# Configuration
# ---------------------------------------------------------------------------

RULE_NORMS = ("pct_rank", "minmax")
FUSE_MODES = ("raw", "zscore")
CUT_MODES = ("fixed", "percentile")
GATES = ("rule_agrees", "consensus", "none")


@dataclass(frozen=True)
class AuditConfig:
    """Settings of the one parameterised labelling operator.

    ``rule_norm``  how the rule score is mapped to [0, 3].
    ``fuse``       fuse raw signals or their z-scores.
    ``cuts``       fixed cut points or batch percentiles.
    ``gate``       extra condition for ``mismatch_label``.
    ``exact``      exact percentiles (memory grows with distinct values) or
                   ``percentile_approx`` with ``accuracy`` for very large data.
    ``score_digits`` the fused score is rounded before bucketing so that
                   ties fall alike in every engine.
    ``dossier_style`` wording of the evidence records that the jobs write.
    """

    rule_norm: str = "pct_rank"
    fuse: str = "zscore"
    cuts: str = "percentile"
    gate: str = "rule_agrees"
    weights: tuple = DEFAULT_WEIGHTS
    # lexicons are data: pass other term lists to audit another vocabulary
    crisis_terms: tuple = CRISIS_TERMS
    low_terms: tuple = LOW_TERMS
    fill_type: bool = True
    dossier_style: str = "predict"
    exact: bool = True
    accuracy: int = 1_000_000
    score_digits: int = 9

    def __post_init__(self):
        if self.rule_norm not in RULE_NORMS:
            raise ValueError(f"rule_norm must be one of {RULE_NORMS}")
        if self.fuse not in FUSE_MODES:
            raise ValueError(f"fuse must be one of {FUSE_MODES}")
        if self.cuts not in CUT_MODES:
            raise ValueError(f"cuts must be one of {CUT_MODES}")
        if self.gate not in GATES:
            raise ValueError(f"gate must be one of {GATES}")
        if len(self.weights) != 3:
            raise ValueError("weights must have three entries")

    def with_(self, **kw) -> "AuditConfig":
        return replace(self, **kw)


PRESETS = {
    # published specification (default)
    "documented": AuditConfig(),
    # training script
    "train": AuditConfig(rule_norm="pct_rank", fuse="raw", cuts="fixed",
                         gate="rule_agrees"),
    # notebook
    "notebook": AuditConfig(rule_norm="minmax", fuse="zscore", cuts="percentile",
                            gate="consensus", dossier_style="notebook"),
    # interactive batch view: no label gate, channel/type not filled
    "app": AuditConfig(rule_norm="pct_rank", fuse="zscore", cuts="percentile",
                       gate="none", fill_type=False, dossier_style="app"),
}


def preset(name: str = "documented", **overrides) -> AuditConfig:
    try:
        cfg = PRESETS[name]
    except KeyError:
        raise ValueError(f"unknown preset {name!r}; choose from {sorted(PRESETS)}")
    return cfg.with_(**overrides) if overrides else cfg


@dataclass
class MLConfig:
    """Spark ML classifier settings (re-aimed transformer fine-tuning)."""

    num_features: int = 1 << 18   # hashed term space; a wider one costs time, a narrower one merges words
    min_doc_freq: int = 1
    max_iter: int = 100            # upper limit; fits stop at ``tol``
    tol: float = 1e-6              # relative gain of the objective at which a fit has converged
    round_iter: int = 10           # iterations between two looks at the validation rows
    patience: int = 3              # rounds without a better validation macro F1 before a fit stops
    reg_params: tuple = (0.0, 0.01, 0.1)
    seed: int = SPLIT_SEED
    clusters: int = 4
    kmeans_starts: int = 10
    kmeans_iter: int = 300         # upper limit; a start stops when its centres stand
