"""Text functions (F1-F7). Each takes and returns a ``Column``.

All but ``scan`` and ``without_terms`` are native Spark expressions that compile
into generated code. ``scan`` finds all lexicon terms and the negations of a
batch of texts at once in one Arrow function: each native ``contains`` walks a
text byte by byte, and 29 of them were most of an audit's time. Places where a
term may begin are found for all terms together, by a hash of four bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (CRISIS_TERMS, DOSSIER_KEYWORD_LIMIT, LOW_TERMS,
                      NEGATION_WORDS)

# A word character in the sense of Python's Unicode ``\w``: letters, numbers
# and underscore. Lookarounds make a whole-word match without consuming the
# neighbours, so adjacent words ("no no") are each counted. The leading
# zero-width test of the first letters rejects most positions before the
# Unicode lookbehind runs (half the time on whole documents, same matches).
WORD_CLASS = r"[\p{L}\p{N}_]"
NEGATION_PATTERN = (r"(?=[%s])(?<!%s)(?:%s)(?!%s)"
                    % ("".join(sorted({w[0] for w in NEGATION_WORDS})), WORD_CLASS,
                       "|".join(NEGATION_WORDS), WORD_CLASS))
NUMBER_PATTERN = r"([0-9.]+)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What Python's ``str.strip`` takes off: Unicode white space and U+001C-U+001F.
SPACE_CLASS = r"[\s\u001c-\u001f\u0085\p{Z}]"


def strip_lower(c) -> Column:
    """Python-style ``str.strip().lower()``; NULL stays NULL."""
    return F.lower(F.regexp_replace(_col(c), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", ""))


def parse_resolution_hours(c) -> Column:
    """first number of the lowered text, times 24 when it mentions 'day'.

    NULL, text without a number, and unparsable numbers ("1.2.3", ".") give
    NULL (``try_cast``), to be filled by the batch median later.
    """
    low = F.lower(_col(c))
    value = F.nullif(F.regexp_extract(low, NUMBER_PATTERN, 1), F.lit("")).try_cast("double")
    return F.when(low.contains("day"), value * 24.0).otherwise(value)


def term_hits(text: Column, terms) -> Column:
    """Number of lexicon terms that occur as substrings (each counted once)."""
    acc = None
    for t in terms:
        hit = F.when(text.contains(t), 1).otherwise(0)
        acc = hit if acc is None else acc + hit
    return acc


def crisis_hits(lower_text: Column, terms=CRISIS_TERMS) -> Column:
    """F2."""
    return term_hits(lower_text, terms)


def low_hits(lower_text: Column, terms=LOW_TERMS) -> Column:
    """F3."""
    return term_hits(lower_text, terms)


def negations(lower_text: Column) -> Column:
    """whole-word occurrences of the negation words."""
    return F.regexp_count(lower_text, F.lit(NEGATION_PATTERN))


def rule_tenths(crisis: Column, low: Column, neg: Column) -> Column:
    """F5 as an exact integer: 10*crisis - 5*low - 3*neg."""
    return (crisis * 10 - low * 5 - neg * 3).cast("int")


def rule_score(tenths: Column) -> Column:
    """F5 as a double: tenths / 10 (equal decimal scores compare equal)."""
    return tenths / 10.0


#: Terms whose bits share one long.
MASK_BITS = 62


def _mask_of(lower_text: Column, terms) -> Column:
    acc = F.lit(0).cast("long")
    for k, t in enumerate(terms):
        acc = acc + F.when(lower_text.contains(t), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return acc


def term_mask(lower_text: Column, terms=CRISIS_TERMS) -> Column:
    """The terms found, as bits (bit k: the k-th term), so that later steps need
    neither the text nor another search: one long, or an array of longs for a
    lexicon of more than ``MASK_BITS`` terms."""
    parts = [_mask_of(lower_text, terms[k:k + MASK_BITS]) for k in range(0, max(1, len(terms)), MASK_BITS)]
    return parts[0] if len(parts) == 1 else F.array(*parts)


_ANY_NEGATION = "(?:%s)" % "|".join(NEGATION_WORDS)
#: Whole words by ASCII rules, and words whose neighbour is not ASCII.
_ASCII_NEGATION = rf"\b{_ANY_NEGATION}\b"
_OTHER_NEIGHBOUR = rf"[^\x00-\x7F]{_ANY_NEGATION}|{_ANY_NEGATION}[^\x00-\x7F]"

#: Bytes of the texts looked at together, which bounds the working arrays.
_WINDOW = 1 << 20
_SLOTS = 16                        # binary digits of a hash of four bytes
_FACTOR = np.uint32(2654435761)    # FIXED VALUE (multiplicative hashing)


def _windows(texts: pa.Array):
    """(first row, bytes, end of each row in them) of runs of whole texts of
    at most ``_WINDOW`` bytes, or of one longer text. A null text is empty."""
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"") if texts.null_count else texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + _WINDOW, "right")) - 1)
        yield row, data[ends[row]:ends[to]], ends[row + 1:to + 1] - ends[row]
        row = to


def _likely(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places of ``data`` whose four bytes have the hash of one of ``heads``."""
    shift = np.uint32(32 - _SLOTS)
    known = np.zeros(1 << _SLOTS, dtype=bool)
    known[heads * _FACTOR >> shift] = True
    found = []
    for k in range(4):
        four = data[k:k + (len(data) - k) // 4 * 4].copy().view("<u4")
        found.append(4 * np.flatnonzero(known[four * _FACTOR >> shift]) + k)
    return np.concatenate(found)


def _places(data: np.ndarray, ends: np.ndarray, terms: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per term (not empty) the places where it begins, in no order, and their
    rows; a term lies in one row."""
    heads = np.array([int.from_bytes(t[:4], "little") for t in terms], dtype=np.uint32)
    whole = np.array([len(t) >= 4 for t in terms], dtype=bool)
    if whole.any() and len(data) >= 4:
        likely = _likely(data, heads[whole])
        four = data[likely[:, None] + np.arange(4)].view("<u4").ravel()
    out = []
    for term, head, four_bytes in zip(terms, heads, whole):
        if len(term) > len(data):
            at = np.zeros(0, dtype=np.int64)
        elif four_bytes:
            at, done = likely[four == head], 4
        else:
            at, done = np.flatnonzero(data[:len(data) - len(term) + 1] == term[0]), 1
        at = at[at + len(term) <= len(data)]
        for k in range(done if len(at) else len(term), len(term)):
            at = at[data[at + k] == term[k]]
        row = np.searchsorted(ends, at, "right")
        inside = at + len(term) <= ends[row] if len(at) else np.zeros(0, dtype=bool)
        out.append((at[inside], row[inside]))
    return out


def _holding(texts: pa.Array, terms) -> np.ndarray:
    """Which texts (rows) contain which terms (columns); a null text has none."""
    held = np.zeros((len(texts), len(terms)), dtype=bool)
    held[:, [k for k, t in enumerate(terms) if not t]] = True
    named = [(k, t.encode()) for k, t in enumerate(terms) if t]
    for first, data, ends in _windows(texts):
        for (k, _), (_, row) in zip(named, _places(data, ends, [t for _, t in named])):
            held[first + row, k] = True
    if texts.null_count:
        held[~texts.is_valid().to_numpy(zero_copy_only=False)] = False
    return held


def _cut_out(texts: pa.Array, terms: list[bytes]) -> pa.Array:
    """The texts without the terms: from left to right, the longest first."""
    pieces, lengths = [], []
    for _, data, ends in _windows(texts):
        found = _places(data, ends, terms)
        at = np.concatenate([a for a, _ in found])
        size = np.repeat(np.array([len(t) for t in terms], dtype=np.int64), [len(a) for a, _ in found])
        order = np.lexsort((-size, at))
        at, size, row = at[order], size[order], np.concatenate([r for _, r in found])[order]
        if (at[1:] < at[:-1] + size[:-1]).any():
            kept, end = [], 0
            for k, (a, n) in enumerate(zip(at.tolist(), size.tolist())):
                if a >= end:
                    kept.append(k)
                    end = a + n
            at, size, row = at[kept], size[kept], row[kept]
        length = np.diff(ends, prepend=0)
        if len(at):
            left = np.ones(len(data), dtype=bool)
            left[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())] = False
            data = data[left]
            length = length - np.bincount(row, weights=size, minlength=len(length)).astype(np.int64)
        pieces.append(data)
        lengths.append(length)
    if not pieces:
        return texts
    ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    out = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(pieces))])
    return pc.if_else(texts.is_valid(), out, None).cast(pa.string())


def scan(lower_text: Column, crisis_terms=CRISIS_TERMS, low_terms=LOW_TERMS) -> Column:
    """F2-F4 as a struct: ``crisis_mask`` as ``term_mask`` gives it, ``low_hits``
    and ``negations``. The last is null where a negation word stands beside a
    character outside ASCII (and for a null text): see ``scanned_negations``."""
    parts = [crisis_terms[k:k + MASK_BITS] for k in range(0, max(1, len(crisis_terms)), MASK_BITS)]
    kind = "long" if len(parts) == 1 else "array<long>"

    @F.arrow_udf(f"struct<crisis_mask: {kind}, low_hits: int, negations: int>")
    def found(texts: pa.Array) -> pa.Array:
        held = _holding(texts, [*crisis_terms, *low_terms])
        masks = np.zeros((len(texts), len(parts)), dtype=np.int64)
        for k in range(len(crisis_terms)):
            masks[:, k // MASK_BITS] += held[:, k].astype(np.int64) << (k % MASK_BITS)
        low = held[:, len(crisis_terms):].sum(axis=1, dtype=np.int32)
        whole = pc.if_else(pc.match_substring_regex(texts, _OTHER_NEIGHBOUR), pa.scalar(None, pa.int32()),
                           pc.count_substring_regex(texts, _ASCII_NEGATION))
        ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(parts))
        mask = pa.array(masks.ravel()) if len(parts) == 1 else pa.ListArray.from_arrays(ends, pa.array(masks.ravel()))
        return pa.StructArray.from_arrays([mask, pa.array(low), whole.cast(pa.int32())],
                                          names=["crisis_mask", "low_hits", "negations"])

    return found(lower_text)


def without_terms(text: Column, terms) -> Column:
    """The text without any of the terms, from left to right, longer terms
    first; one Arrow function."""
    sought = [t.encode() for t in terms if t]
    if not sought:
        return text

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        return _cut_out(texts, sought)

    return cut(text)


def scanned_negations(found: Column, lower_text: Column) -> Column:
    """F4 from ``scan``; the few texts that ASCII rules do not settle are
    counted by ``negations``."""
    return F.coalesce(found["negations"], negations(lower_text))


def mask_hits(mask: Column, terms=CRISIS_TERMS) -> Column:
    """F2 from the mask: how many terms were found."""
    if len(terms) <= MASK_BITS:
        return F.bit_count(mask)
    return F.aggregate(mask, F.lit(0), lambda a, m: a + F.bit_count(m))


def terms_of_mask(mask: Column, terms=CRISIS_TERMS) -> Column:
    """F6 from the mask: terms found, in lexicon order (array<string>)."""
    def part(k):
        return mask if len(terms) <= MASK_BITS else mask[k // MASK_BITS]

    return F.array_compact(F.array(*[
        F.when(part(k).bitwiseAND(F.lit(1 << (k % MASK_BITS)).cast("long")) != 0, F.lit(t))
        for k, t in enumerate(terms)]))


def matched_crisis_terms(lower_text: Column, terms=CRISIS_TERMS) -> Column:
    """crisis terms found in the text, in lexicon order (array<string>)."""
    return F.array_compact(F.array(*[F.when(lower_text.contains(t), F.lit(t))
                                     for t in terms]))


def keyword_value(matched: Column) -> Column:
    """First five matched terms joined by ', ', or 'none'."""
    return F.when(F.size(matched) > 0,
                  F.array_join(F.slice(matched, 1, DOSSIER_KEYWORD_LIMIT), ", ")
                  ).otherwise(F.lit("none"))


def keyword_weight(matched: Column, n_terms: int = len(CRISIS_TERMS)) -> Column:
    """round(min(n / lexicon size, 1), 3), half-even."""
    return F.bround(F.least(F.size(matched) / float(n_terms), F.lit(1.0)), 3)

