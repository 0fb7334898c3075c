"""Personal data in whole texts: patterns, checksums, context.

Regular expressions propose spans. Validators confirm them: octet ranges for
addresses, Luhn for payment cards, a digit count for phones, mod-97 for bank
accounts, issue rules for social security numbers. Words near a span raise its
score. E-mail, ip, card and phone spans that pass their validator are always
kept; the further kinds (iban, ssn, key) need a score of ``MIN_SCORE``.

Matches are leftmost and not overlapping within a kind; one that fails its
validator is dropped without a retry. Offsets count code points, the end is
exclusive. Spans are listed by start, then by the order of ``KINDS``.

Defined results: null is empty and has no span; repeated rows are scanned each
for itself; very long texts are scanned whole (the e-mail pattern is found
from its ``@``, so a long run of name characters costs linear time); other
columns are kept (a column that carries a result's name is replaced).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sevscope.llm.common import byte_slices, keeping_columns, sha256_hex, text_bytes

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "key")
MIN_SCORE = 0.6
CONTEXT_CHARS = 60

# The contract's patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), anchored at the start of a digit run, where
#: every match begins, and without give-back, so that long runs cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Further kinds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score of a validated span by itself, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "key": 0.9}
BONUS = 0.3
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "key": ("key", "token", "secret"),
}
_CUES = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v) + ")") for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > end and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at)):
            yield left, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _proposed(text: str):
    """(kind, start, end) of the spans that their validators confirm."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m.group()):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()
    for m in _KEY.finditer(text):
        yield "key", m.start(), m.end()


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the kept spans, in listing order."""
    out = []
    for kind, a, b in _proposed(text):
        near = (text[max(0, a - CONTEXT_CHARS):a] + " " + text[b:b + CONTEXT_CHARS]).lower()
        score = min(1.0, PRIOR[kind] + BONUS * bool(_CUES[kind].search(near)))
        if kind in BASE or score >= MIN_SCORE:
            out.append((kind, a, b, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                      T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("score", pa.float64())]))


def _scan(batches):
    for whole in batches:
        for batch in byte_slices([whole], whole.num_columns - 1, 8 << 20):
            spans = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                text = t.decode("utf-8", "replace") if t else ""
                spans.append([dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(text)])
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(spans, _ARROW_SPANS)],
                                             names=batch.schema.names[:-1] + ["pii"])


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of (kind, start, end, score)."""
    rest = [c for c in docs.columns if c != "pii"]
    ins = docs.select(*rest, text_bytes(text).alias("__pii_text"))
    return ins.mapInArrow(_scan, T.StructType([*ins.schema.fields[:-1],
                                               T.StructField("pii", T.ArrayType(_SPAN))]))


def redact(docs: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """``docs`` (same columns) with every span replaced by its kind's mark;
    of overlapping spans the first listed is replaced."""
    return keeping_columns(docs, ("pii",), lambda d: _redacted(d, text, mark))


def _redacted(docs: DataFrame, text: str, mark: str) -> DataFrame:
    found = find_pii(docs, text)
    state = F.aggregate(
        "pii", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(
            F.concat(a["out"], F.substr(F.col(text), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")),
                     F.replace(F.lit(mark), F.lit("{}"), F.upper(s["kind"]))).alias("out"),
            s["end"].alias("at"))).otherwise(a))
    done = F.concat(state["out"], F.substr(F.col(text), state["at"].cast("int") + 1, F.length(text)))
    return found.select(*[done.alias(c) if c == text else F.col(c) for c in docs.columns])


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of ``find_pii``'s result."""
    def joined(kinds):
        return F.array_join(F.transform(
            F.filter("pii", lambda s: s["kind"].isin(*kinds)),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    best = F.array_max(F.transform("pii", lambda s: s["score"]))
    return found.select(key, *counts, F.sha2(joined(BASE).cast("binary"), 256).alias("base_sha256"),
                        joined(KINDS).alias("spans"), best.alias("top_score"))


def brute_force(text: str | None):
    """Base spans of a text by the contract's patterns alone."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(int(p) for p in m.group().split(".")) <= 255:
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = [c for c in m.group() if c.isdigit()]
        if 14 <= len(digits) <= 19 and luhn("".join(digits)):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], BASE.index(s[0])))
    return out, sha256_hex(",".join(f"{k}:{a}:{b}" for k, a, b in out).encode())
