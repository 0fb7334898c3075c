"""Adversarial robustness of a mismatch predictor.

An attack rewrites a ticket's texts so that the wording changes and the case
does not: crisis words are taken out, low-urgency words are put in, or the
sentences change their order. All attacks are expressions (words are taken out
by one Arrow function). A ticket's predictions before and after stand in one row, so nothing is joined or
shuffled but the final counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.text import without_terms

_CUT = "\u0001"     # marks sentence ends while sentences are parted
_TEXTS = ("ticket_subject", "ticket_description")


def without_words(text: Column, terms) -> Column:
    """The lowered text without any of the terms, longer terms first."""
    return without_terms(F.lower(text), terms)


def with_words(text: Column, terms) -> Column:
    """The lowered text followed by the terms."""
    return F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(". " + ", ".join(terms)))


def reordered(text: Column) -> Column:
    """The lowered text with its sentences in reverse order."""
    parts = F.split(F.regexp_replace(F.lower(text), "([.!?])[ \t\n\r]+", "$1" + _CUT), _CUT)
    return F.array_join(F.reverse(parts), " ")


def attacks(cfg: AuditConfig) -> dict[str, Callable[[str], Column]]:
    """Attack name -> new text of a text column."""
    return {
        "crisis_words_out": lambda c: without_words(F.col(c), cfg.crisis_terms),
        "low_words_in": lambda c: with_words(F.col(c), cfg.low_terms) if c.endswith(_TEXTS[1]) else F.lower(c),
        "sentences_reversed": lambda c: reordered(F.col(c)),
    }


def paired_predictions(tickets: DataFrame, predict: Callable[[DataFrame], DataFrame], cfg: AuditConfig) -> DataFrame:
    """``tickets`` with ``before`` and one more prediction per attack.
    ``predict`` adds an integer ``prediction`` to raw tickets and keeps their
    rows."""
    own = {c: f"__own_{c}" for c in _TEXTS}
    frame = tickets.withColumns({kept: F.col(c) for c, kept in own.items()})
    held = [*own.values()]

    def predicted(df: DataFrame, name: str) -> DataFrame:
        held.append(name)
        return predict(df).withColumn(name, F.coalesce(F.col("prediction").cast("int"), F.lit(0))).select(
            *[c for c in tickets.columns if c not in held], *held)

    frame = predicted(frame, "before")
    for name, attack in attacks(cfg).items():
        frame = predicted(frame.withColumns({c: attack(kept) for c, kept in own.items()}), name)
    back = frame.withColumns({c: F.col(kept) for c, kept in own.items()})
    return back.drop(*own.values())


def robustness(paired: DataFrame, names) -> DataFrame:
    """(attack, tickets, stable, share): in how many tickets an attack leaves
    the prediction as it was; ``all``: those that no attack changes."""
    same = {n: F.col(n) == F.col("before") for n in names}
    every = F.lit(True)
    for s in same.values():
        every = every & s
    same["all"] = every
    counted = paired.agg(F.count(F.lit(1)).alias("tickets"), *[F.count_if(s).alias(n) for n, s in same.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("attack"), "tickets", F.col(n).alias("stable")) for n in same]))
    return counted.select(rows.alias("r")).select("r.*").withColumn(
        "share", F.round(F.coalesce(F.try_divide(F.col("stable").cast("double"), F.col("tickets")), F.lit(0.0)), 9))


def check(tickets: DataFrame, predict: Callable[[DataFrame], DataFrame], cfg: AuditConfig) -> DataFrame:
    return robustness(paired_predictions(tickets, predict, cfg), list(attacks(cfg)))
