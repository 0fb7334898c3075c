"""Word and shingle fingerprints of whole texts, vectorised over Arrow batches.

A batch of texts is handled as one byte buffer: every byte and position adds a
64-bit term to a running sum, so the fingerprint of any word is a difference of
two sums, scaled to be position-free. No Python object is made per word.

Words follow ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. They are found on
the UTF-8 bytes, which is the same: every separator is a single ASCII byte and
no byte of a longer code point equals one.
"""

from __future__ import annotations

import numpy as np

SPACES = bytes([0x20, *range(0x09, 0x0E)])
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_STEP = 0x9E3779B97F4A7C15 | 1        # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_STEP, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the step and of its inverse, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            up = np.full(size, _STEP, dtype=np.uint64)
            down = np.full(size, _INVERSE, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_bounds(data: np.ndarray):
    """Start and end offsets of the words of a byte array whose texts are
    parted by separators."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if not space[-1]:
        edge = np.concatenate([edge, [len(data)]])
    return edge[0::2], edge[1::2]


def span_coder(data: np.ndarray):
    """Function (start, end) -> 64-bit codes of byte spans of an array."""
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])

    def codes(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _BYTE[7])

    return codes


def word_spans(texts: list[bytes], prefixes: tuple[int, ...] = ()):
    """(codes, first, start, end): the 64-bit code of every word of the texts,
    in order; the number of each text's first word (one more entry than
    texts); the words' byte offsets in the texts joined by line feeds. For
    each length in ``prefixes`` one more array follows: the codes of the words
    cut to so many bytes."""
    data = np.frombuffer(b"\n".join(texts).translate(_FOLD), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=begin[1:])
    start, end = word_bounds(data)
    codes = span_coder(data)
    return (codes(start, end), np.searchsorted(start, begin), start, end,
            *(codes(start, np.minimum(end, start + p)) for p in prefixes))


def word_codes(texts: list[bytes]):
    """(codes, first) of ``word_spans``."""
    return word_spans(texts)[:2]


def window_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Code of the n words that begin at each place (places whose window
    leaves the array are left out)."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out += codes[k:k + size] * _SLOT[k]
    return mix(out)


def sequence_code(codes: np.ndarray) -> int:
    """Code of a whole word sequence shorter than a window."""
    return int(mix((codes * _SLOT[:len(codes)]).sum(dtype=np.uint64, keepdims=True)
                   + np.uint64(len(codes)) * _BYTE[11])[0])


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct codes of the n-word shingles of each text. A text of
    fewer words, but not none, has its whole sequence as one shingle."""
    codes, first = word_codes(texts)
    windows = window_codes(codes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(windows[a:b - n + 1]))
        elif b > a:
            out.append(np.array([sequence_code(codes[a:b])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
