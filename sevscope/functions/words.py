"""Words of a batch of texts and their hashes, in one Arrow function (M1, M4).

A native ``split`` walks a text character by character through a pattern, makes
a string of every word and calls a lambda on it. Here the words of a window of
texts are found by a table of their bytes, and the words of equal length are
hashed together. Which characters are letters or numbers is asked of the JVM,
so words and hashes are those of the native functions, bit by bit.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import WORD_CLASS, _windows

#: What Java's ``\s`` matches.
SPACES = b" \t\n\x0b\f\r"
_POINTS = 0x110000
_SURROGATES = range(0xD800, 0xE000)

# FIXED VALUES of the two hashes (xxHash64; Murmur3, 32 bits), both by Spark's seed.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                  0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_C1, _C2, _M, _F1, _F2 = (np.uint32(p) for p in (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35))
_SEED = 42


@lru_cache(maxsize=1)
def word_table() -> bytes:
    """Which code points are word characters to the JVM, packed."""
    points = [c for c in range(_POINTS) if c not in _SURROGATES]
    pattern = SparkSession.active()._jvm.java.util.regex.Pattern.compile(f"[^{WORD_CLASS[1:]}")
    kept = pattern.matcher("".join(map(chr, points))).replaceAll(" ")
    table = np.zeros(_POINTS, dtype=bool)
    table[points] = [c != " " for c in kept]
    return zlib.compress(np.packbits(table).tobytes())


@lru_cache(maxsize=2)
def _unpacked(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).astype(bool)


def _in_words(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts belong to word characters."""
    held = table[:256][data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        held[high] = False
        first = high[data[high] >= 0xC0]
        size = 2 + (data[first] >= 0xE0) + (data[first] >= 0xF0)
        first, size = first[first + size <= len(data)], size[first + size <= len(data)]
        for n, bits in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            at = first[size == n]
            point = (data[at] & bits).astype(np.int32)
            for k in range(1, n):
                point = point << 6 | (data[at + k] & 0x3F)
            at = at[table[np.minimum(point, _POINTS - 1)]]
            for k in range(n):
                held[at + k] = True
    return held


def _runs(held: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of held bytes, none across the end of a
    row, and the runs of every row."""
    edge = np.zeros(len(held) + 1, dtype=bool)
    edge[0] = True
    edge[ends] = True
    starts = held.copy()
    starts[1:] &= ~held[:-1] | edge[1:-1]
    stops = held.copy()
    stops[:-1] &= ~held[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(stops) + 1 - starts, np.diff(np.searchsorted(starts, ends), prepend=0)


def _by_length(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, kind, hashed) -> np.ndarray:
    """``hashed(at, starts, length)`` of the words of each length; ``at`` reads
    numbers of a given kind at places of the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])

    def at(places, number):
        return np.ndarray(len(padded) - number.itemsize + 1, number, padded, strides=(1,))[places]

    out = np.empty(len(starts), dtype=kind)
    order = np.argsort(np.minimum(lens, 0xFFFF).astype(np.uint16), kind="stable")
    long = order[lens[order] >= 0xFFFF]
    order = order[:len(order) - len(long)]
    cuts = np.flatnonzero(np.diff(lens[order])) + 1
    for some in (*np.split(order, cuts), *long.reshape(-1, 1)):
        if len(some):
            out[some] = hashed(at, starts[some], int(lens[some[0]]))
    return out


def _turned(x, bits: int):
    size = x.dtype.itemsize * 8
    return x << x.dtype.type(bits) | x >> x.dtype.type(size - bits)


def _xx(at, p, n: int):
    u8, u4, u1 = np.dtype("<u8"), np.dtype("<u4"), np.dtype("u1")
    k = 0
    if n >= 32:
        seed = np.full(len(p), _SEED, np.uint64)
        v = [seed + _P1 + _P2, seed + _P2, seed, seed - _P1]
        while k <= n - 32:
            v = [_turned(x + at(p + k + 8 * i, u8) * _P2, 31) * _P1 for i, x in enumerate(v)]
            k += 32
        h = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
        for x in v:
            h = (h ^ _turned(x * _P2, 31) * _P1) * _P1 + _P4
    else:
        h = np.full(len(p), _SEED, np.uint64) + _P5
    h = h + np.uint64(n)
    for k in range(k, n - 7, 8):
        h = _turned(h ^ _turned(at(p + k, u8) * _P2, 31) * _P1, 27) * _P1 + _P4
    k = n & ~7
    if n & 4:
        h = _turned(h ^ at(p + k, u4).astype(np.uint64) * _P1, 23) * _P2 + _P3
        k += 4
    for k in range(k, n):
        h = _turned(h ^ at(p + k, u1).astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _murmur(at, p, n: int):
    u4, u1 = np.dtype("<u4"), np.dtype("u1")
    h = np.full(len(p), _SEED, np.uint32)
    for k in range(0, n - 3, 4):
        h = _turned(h ^ _turned(at(p + k, u4) * _C1, 15) * _C2, 13) * np.uint32(5) + _M
    k = np.zeros(len(p), np.uint32)
    for i in range(n & 3):
        k |= at(p + (n & ~3) + i, u1).astype(np.uint32) << np.uint32(8 * i)
    h = h ^ _turned(k * _C1, 15) * _C2 ^ np.uint32(n)
    h = (h ^ h >> np.uint32(16)) * _F1
    h = (h ^ h >> np.uint32(13)) * _F2
    return h ^ h >> np.uint32(16)


def xxhash64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of byte strings."""
    return _by_length(data, starts, lens, np.uint64, _xx).view(np.int64)


def murmur3(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The hash of Spark ML's ``HashingTF``."""
    return _by_length(data, starts, lens, np.uint32, _murmur).view(np.int32)


def slots_of_texts(texts: pa.Array, num_features: int, table: bytes | None = None, cap: int | None = None,
                   hashed=xxhash64) -> tuple[np.ndarray, np.ndarray]:
    """(slots, words a row) of texts: words by ``table``, or what stands
    between white space; of a row the first ``cap``."""
    held_by = _unpacked(table) if table else None
    space = np.ones(256, dtype=bool)
    space[list(SPACES)] = False
    slots, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, data, ends in _windows(texts):
        starts, lens, count = _runs(space[data] if held_by is None else _in_words(data, held_by), ends)
        if cap is not None:
            kept = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count) < cap
            starts, lens, count = starts[kept], lens[kept], np.minimum(count, cap)
        slots.append((hashed(data, starts, lens) % num_features).astype(np.int32))
        counts.append(count)
    return np.concatenate(slots), np.concatenate(counts)


def hashed_slots(lower_text: Column, num_features: int, cap: int | None = None, by_space: bool = False) -> Column:
    """Hashed slots of the words of a lowered text, in order (of its first
    ``cap``): runs of letters, numbers and underscore, or with ``by_space`` of
    anything but white space. Null for a null text."""
    table = None if by_space else word_table()

    @F.arrow_udf("array<int>")
    def slots(texts: pa.Array) -> pa.Array:
        flat, counts = slots_of_texts(texts, num_features, table, cap)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        missing = None if not texts.null_count else texts.is_null()
        return pa.ListArray.from_arrays(ends, pa.array(flat), mask=missing)

    return slots(lower_text)
