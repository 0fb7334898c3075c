"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut into pieces by the tokenizer's pattern; a piece's bytes are
encoded by halves: both halves recursively, then joined. A join re-encodes a
window of tokens around the seam and grows it until its outermost pairs are
stable: two neighbouring tokens are stable when encoding their joined bytes
gives the two tokens again. A token sequence whose neighbours are all stable
is the encoding of its bytes, so tokens outside the window need no second
look. Encodings thus form a monoid under ``join``; across piece borders the
join is plain concatenation. Decoding concatenates the tokens' bytes up the
same tree.

Words repeat, so a task keeps the results of up to ``HELD_PIECES`` short pieces,
the ones in use longest; memory is bounded whatever the texts.

Each task reads the public rank file named by ``path`` on its own machine;
nothing is collected and texts are never shuffled. A very long piece of n bytes
costs about n log n.

Defined results: null and empty texts have no tokens (digests of the empty
string); bytes that are not UTF-8 are replaced, as in the text column's own
reading; repeated rows are encoded each for itself; other columns are kept
(a column that carries a result's name is replaced).
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sevscope.llm.common import byte_slices, text_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = 1 << 60             # rank of a pair that is no token
LEAF = 24                 # bytes up to which a span is merged directly
HELD_PIECES = 400_000     # short pieces whose results a task keeps
HELD_PAIRS = 1_000_000    # neighbours whose token a task keeps
SHORT = 64                # characters up to which a piece is kept


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes and decodes by the ranks of a file and a pattern of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.single = [ranks.get(bytes([b]), NONE) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    def pair(self, key: int) -> int:
        """The token that two neighbours make (``left << 20 | right``), which
        is also its rank."""
        if len(self.pairs) > HELD_PAIRS:
            self.pairs.clear()
        made = self.pairs[key] = self.ranks.get(self.tokens[key >> 20] + self.tokens[key & 0xFFFFF], NONE)
        return made

    def merge(self, data: bytes) -> list[int]:
        """Encoding of a short span: the neighbouring pair of least rank is
        merged, the leftmost of equals first, until none is known. Spans are
        ids from the start, pairs are looked up by two ids."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        known, pair, single = self.pairs.get, self.pair, self.single
        parts = [single[b] for b in data]
        made = []
        for k in range(len(parts) - 1):
            key = parts[k] << 20 | parts[k + 1]
            got = known(key)
            made.append(pair(key) if got is None else got)
        while made:
            least = min(made)
            if least == NONE:
                break
            k = made.index(least)
            parts[k:k + 2] = [least]
            del made[k]
            if k:
                key = parts[k - 1] << 20 | least
                got = known(key)
                made[k - 1] = pair(key) if got is None else got
            if k < len(made):
                key = least << 20 | parts[k + 1]
                got = known(key)
                made[k] = pair(key) if got is None else got
        return parts

    def is_stable(self, a: int, b: int) -> bool:
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) > 500_000:
                self.stable.clear()
            known = self.stable[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings put together."""
        if not left or not right:
            return left or right
        if self.is_stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merge(b"".join(self.tokens[i] for i in left[-a:] + right[:b]))
            left_ok = a == len(left) or self.is_stable(left[-a - 1], window[0])
            right_ok = b == len(right) or self.is_stable(window[-1], right[b])
            if left_ok and right_ok:
                return left[:-a] + window + right[b:]
            a, b = a if left_ok else 2 * a, b if right_ok else 2 * b

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def encode(self, text: str) -> list[int]:
        """Token ids of any text; piece by piece, so the join is concatenation."""
        out: list[int] = []
        for piece in self.pieces.findall(text):
            out += self.encode_piece(piece.encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of an id sequence, concatenated up a tree of halves."""
        if len(ids) <= 64:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class PieceCache:
    """``make(encoder, piece)`` for the pieces of texts, computed once for
    pieces that repeat. Two generations: when the new one is full it becomes
    the old one, so pieces in use are never forgotten all at once."""

    def __init__(self, encoder: Encoder, make):
        self.encoder, self.make, self.known, self.old = encoder, make, {}, {}

    def _missed(self, piece: str):
        got = self.old.get(piece)
        if got is None:
            got = self.make(self.encoder, piece)
        if len(piece) <= SHORT:
            if len(self.known) >= HELD_PIECES // 2:
                self.old, self.known = self.known, {}
            self.known[piece] = got
        return got

    def of(self, text: str) -> list:
        """Results of the text's pieces, in order."""
        pieces = self.encoder.pieces.findall(text)
        out = list(map(self.known.get, pieces))
        if None in out:
            missed = self._missed
            for k, got in enumerate(out):
                if got is None:
                    out[k] = missed(pieces[k])
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(path: str, pattern: str) -> Encoder:
    """The task process's encoder for a rank file, loaded once."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def piece_digest(encoder: Encoder, piece: str):
    """(number of ids, ids as text with a leading space each, decoded bytes)."""
    ids = encoder.encode_piece(piece.encode())
    return len(ids), "".join([f" {i}" for i in ids]).encode(), encoder.decode(ids)


def piece_ids(encoder: Encoder, piece: str):
    return encoder.encode_piece(piece.encode())


def _digests(path: str, pattern: str):
    def run(batches):
        cache = PieceCache(encoder_of(path, pattern), piece_digest)
        for whole in batches:
            for batch in byte_slices([whole], whole.num_columns - 1, 8 << 20):
                counts, ids, decoded = [], [], []
                for t in batch.column(batch.num_columns - 1).to_pylist():
                    parts = cache.of(t.decode("utf-8", "replace") if t else "")
                    counts.append(sum([p[0] for p in parts]))
                    ids.append(hashlib.sha256(b"".join([p[1] for p in parts])[1:]).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=batch.schema.names[:-1] + ["n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _ids(path: str, pattern: str):
    def run(batches):
        cache = PieceCache(encoder_of(path, pattern), piece_ids)
        for whole in batches:
            for batch in byte_slices([whole], whole.num_columns - 1, 8 << 20):
                rows = []
                for t in batch.column(batch.num_columns - 1).to_pylist():
                    row: list[int] = []
                    for part in cache.of(t.decode("utf-8", "replace") if t else ""):
                        row += part
                    rows.append(row)
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(rows, pa.list_(pa.int32()))],
                                                 names=batch.schema.names[:-1] + ["token_ids"])
    return run


def _texts(path: str, pattern: str):
    def run(batches):
        encoder = encoder_of(path, pattern)
        for batch in batches:
            at = batch.num_columns - 1
            texts = [None if ids is None else encoder.decode(ids).decode("utf-8", "replace")
                     for ids in batch.column(at).to_pylist()]
            cols = [batch.column(i) for i in range(at)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())],
                                             names=batch.schema.names[:-1] + ["text"])
    return run


def _with_text(docs: DataFrame, text: str, made: tuple[str, ...]):
    rest = [c for c in docs.columns if c not in made]
    ins = docs.select(*rest, text_bytes(text).alias("__bpe_text"))
    return ins, ins.schema.fields[:-1]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``."""
    ins, fields = _with_text(docs, text, ("token_ids",))
    return ins.mapInArrow(_ids(path, pattern), T.StructType(
        [*fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``encoded`` with its id lists replaced by ``text`` (null ids: null)."""
    rest = [c for c in encoded.columns if c not in (ids, "text")]
    ins = encoded.select(*rest, ids)
    return ins.mapInArrow(_texts(path, pattern), T.StructType(
        [*ins.schema.fields[:-1], T.StructField("text", T.StringType())]))


def digest_texts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    ins, fields = _with_text(docs, text, made)
    return ins.mapInArrow(_digests(path, pattern), T.StructType(
        [*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
         T.StructField("decoded_sha256", T.StringType())]))
