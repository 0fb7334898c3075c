"""Cross-tokenizer alignment by lockstep vectorised merging.

Two tokenizers A and B cut the bytes of one text (with a leading space) into
tokens. Byte offsets where tokens of both end cut the text into groups; every
A token of a group is linked with every B token of it.

* A batch of texts is split at safe boundaries into *lanes* of about ``LANE``
  characters (``vocab.safe_parts``; both tokenizers end a token there, so no
  group spans two lanes) and encoded by the libraries.
* One NumPy state vector holds, for every lane, the pointers to its current A
  and B token and to the tokens that began its open group. Each step compares
  the ends of the two tokens of all lanes, advances the pointer that is behind
  (both when equal), and emits a cut and the group that it closes, which is
  the product of a run of A and a run of B tokens. Finished lanes are taken
  out of the vector.
* Corpus counts: a *chunk* of documents has a sorted list of its distinct id
  pairs with the number of its documents that hold each. These lists, not the
  documents' links, are dealt by pair and summed; the sums go back per chunk,
  where a document's sums are products with its sparse row. So the shuffled
  rows are distinct pairs per chunk, a pair that every document holds is one
  row a chunk, and nothing is collected or broadcast unchecked.

Memory of a task: the texts and distinct pairs of one chunk (``CHUNK`` bytes of
text, or a single text); tokens are held for ``STEP`` bytes at a time, links
are expanded ``SLICE`` at a time, and a group with more links than that by its
distinct ids.

Defined results: texts that are null, empty or not given back byte by byte by
the tokens of both have no tokens (zeros, empty digest); bytes that are not
UTF-8 are replaced first. Every row counts as a document, repeated rows too.
Ties for an A id's highest count are all best. Other columns are kept (a column
that carries a result's name is replaced). An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sevscope.llm.common import broadcast_if_small, byte_slices
from sevscope.llm.vocab import ByteLevel, Pieces, once, safe_parts
from sevscope.session import stage

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
LANE = 400               # characters after which a lane may end
CHUNK = 8 << 20          # bytes of text of a chunk
STEP = 1 << 19           # bytes of text aligned at a time
SLICE = 1 << 19          # links expanded at a time
PAIR = 1 << 16           # B ids lie below it; a pair is A id * PAIR + B id
_CODE = (1 << 33) - 1    # a pair's bits in a (document, pair) key

ALIGNED = ("a_ids", "b_ids", "a_cuts", "b_cuts")
DIGEST = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def lockstep(a_end, b_end, a_first, a_stop, b_first):
    """Groups of all lanes: for each, in order, its number of A and of B tokens.

    ``a_end`` and ``b_end`` are end offsets of all tokens, lane after lane on
    one axis; lane k owns the A tokens ``a_first[k]:a_stop[k]`` and the B
    tokens from ``b_first[k]`` on, both with the same last end."""
    runs_a = np.zeros(len(a_end), dtype=np.int32)
    runs_b = np.zeros(len(a_end), dtype=np.int32)
    i, j, stop = a_first.copy(), b_first.copy(), a_stop
    open_a, open_b = i.copy(), j.copy()
    while len(i):
        x, y = a_end[i], b_end[j]
        cut = np.flatnonzero(x == y)
        i += x <= y
        j += y <= x
        began = open_a[cut]
        runs_a[began] = i[cut] - began
        runs_b[began] = j[cut] - open_b[cut]
        open_a[cut], open_b[cut] = i[cut], j[cut]
        live = i < stop
        if not live.all():
            i, j, stop, open_a, open_b = (v[live] for v in (i, j, stop, open_a, open_b))
    starts = np.flatnonzero(runs_a)
    return runs_a[starts].astype(np.int64), runs_b[starts].astype(np.int64)


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


class Alignment:
    """Tokens and groups of a batch of texts, flat and in order: ids ``a``,
    ``b``; tokens per group ``na``, ``nb``; ``a_at``, ``b_at`` and ``g_at``
    are where each text's tokens and groups begin (one more entry)."""

    def __init__(self, a, b, na, nb, a_at, b_at, g_at):
        self.a, self.b, self.na, self.nb = a, b, na, nb
        self.a_at, self.b_at, self.g_at = a_at, b_at, g_at


class Aligner:
    """The two tokenizers of a task and the alignment of its batches."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.a, self.b = once(ByteLevel, a_path, pattern), once(Pieces, b_path)
        self.a_bytes = np.array(self.a.bytes + [b""], dtype=object)[:-1]
        self.b_bytes = np.array(self.b.bytes + [b""], dtype=object)[:-1]
        self.a_len = np.fromiter(map(len, self.a.bytes), dtype=np.int64)
        self.b_len = np.fromiter(map(len, self.b.bytes), dtype=np.int64)
        ids = [str(i).encode() for i in range(max(len(self.a_len), len(self.b_len)))]
        self.comma, self.bar, self.semicolon = (
            np.array([t + end for t in ids], dtype=object) for end in (b",", b"|", b";"))

    def align(self, texts: list[str]) -> Alignment:
        lanes: list[str] = []
        owner: list[int] = []
        for k, text in enumerate(texts):
            if text:
                parts = safe_parts(text, LANE) if self.b.splits else [text]
                lanes += parts
                owner += [k] * len(parts)
        spaced = [" " + lane for lane in lanes]
        a_parts, b_parts = self.a.encode(spaced), self.b.encode(lanes)
        a, b = _flat(a_parts), _flat(b_parts)
        want = [s.encode() for s in spaced]
        whole = b"".join(want)
        if not (b"".join(self.a_bytes[a].tolist()) == whole and b"".join(self.b_bytes[b].tolist()) == whole):
            bad = {k for k, w, x, y in zip(owner, want, a_parts, b_parts)
                   if b"".join(self.a_bytes[x].tolist()) != w or b"".join(self.b_bytes[y].tolist()) != w}
            keep = [n for n, k in enumerate(owner) if k not in bad]
            a_parts, b_parts = [a_parts[n] for n in keep], [b_parts[n] for n in keep]
            owner = [owner[n] for n in keep]
            a, b = _flat(a_parts), _flat(b_parts)
        count_a = np.fromiter(map(len, a_parts), dtype=np.int64, count=len(a_parts))
        count_b = np.fromiter(map(len, b_parts), dtype=np.int64, count=len(b_parts))
        lane_a, lane_b = _starts(count_a), _starts(count_b)
        na, nb = lockstep(np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]), lane_a[:-1], lane_a[1:], lane_b[:-1])
        text_lane = np.searchsorted(np.array(owner, dtype=np.int64), np.arange(len(texts) + 1))
        a_at, b_at = lane_a[text_lane], lane_b[text_lane]
        return Alignment(a, b, na, nb, a_at, b_at, np.searchsorted(_starts(na), a_at))

    def group_digests(self, got: Alignment) -> list[str]:
        """Hex digest of each text's groups written as ``a1,a2|b1;a3|b2``."""
        first_a, first_b = _starts(got.na), _starts(got.nb)
        out = np.empty(len(got.a) + len(got.b), dtype=object)
        place = np.arange(len(got.a)) + np.repeat(first_b[:-1], got.na)
        out[place] = self.comma[got.a]
        out[first_a[1:] + first_b[:-1] - 1] = self.bar[got.a[first_a[1:] - 1]]
        place = np.arange(len(got.b)) + np.repeat(first_a[1:], got.nb)
        out[place] = self.comma[got.b]
        out[first_a[1:] + first_b[1:] - 1] = self.semicolon[got.b[first_b[1:] - 1]]
        words, ends = out.tolist(), (got.a_at + got.b_at).tolist()
        return [hashlib.sha256(b"".join(words[s:e])[:-1]).hexdigest() if e > s else ""
                for s, e in zip(ends[:-1], ends[1:])]


def _merged(keys: np.ndarray, times: np.ndarray):
    """Distinct keys, sorted, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(times, first) if len(first) else times)


def _outer(a, b, text, size):
    """(text, pair) keys and times of one group, ``size`` at a time."""
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    step = max(1, size // len(ub))
    for k in range(0, len(ua), step):
        pairs = ua[k:k + step, None] * PAIR + ub[None, :]
        yield (text << 33) + pairs.ravel(), (ca[k:k + step, None] * cb[None, :]).ravel()


def text_pairs(got: Alignment):
    """Distinct linked (text, pair) keys of a batch, sorted, and how often each
    is linked."""
    links = got.na * got.nb
    first_a, first_b, total = _starts(got.na), _starts(got.nb), _starts(links)
    text = np.repeat(np.arange(len(got.g_at) - 1), np.diff(got.g_at))
    found, at = [], 0
    while at < len(links):
        to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE, "right")) - 1)
        if to == at + 1 and links[at] > SLICE:
            parts = _outer(got.a[first_a[at]:first_a[to]], got.b[first_b[at]:first_b[to]], int(text[at]), SLICE)
            found.extend(parts)
        else:
            n = links[at:to]
            g = np.repeat(np.arange(at, to), n)
            r = np.arange(int(n.sum())) - np.repeat(total[at:to] - total[at], n)
            a, b = got.a[first_a[g] + r // got.nb[g]], got.b[first_b[g] + r % got.nb[g]]
            found.append(_merged((text[g] << 33) + a * PAIR + b, np.ones(len(g), dtype=np.int64)))
        at = to
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return _merged(np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found]))


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative whole numbers in the fewest bytes each."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _texts(batch, at: int) -> list[str]:
    return [t.decode("utf-8", "replace") if t else "" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), pa.int64())


def _rows(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _align(paths, at: int, kept: list[int]):
    def run(batches):
        aligner = once(Aligner, *paths)
        for batch in byte_slices(batches, at, STEP):
            got = aligner.align(_texts(batch, at))
            text = np.repeat(np.arange(batch.num_rows), np.diff(got.g_at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept]
                + [_rows(got.a_at, got.a), _rows(got.b_at, got.b),
                   _rows(got.g_at, _starts(got.na)[1:] - got.a_at[text]),
                   _rows(got.g_at, _starts(got.nb)[1:] - got.b_at[text])],
                names=[batch.schema.names[i] for i in kept] + list(ALIGNED))
    return run


def align_texts(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text",
                keep_text: bool = True) -> DataFrame:
    """``docs`` with the token ids ``a_ids``, ``b_ids`` and the cuts: group k
    ends after ``a_cuts[k]`` A tokens and ``b_cuts[k]`` B tokens."""
    ins, at, kept, fields = _inputs(docs, text, ALIGNED, keep_text)
    ints = T.ArrayType(T.IntegerType())
    return ins.mapInArrow(_align((a_path, b_path, pattern), at, kept),
                          T.StructType(fields + [T.StructField(c, ints) for c in ALIGNED]))


def _inputs(docs: DataFrame, text: str, made, keep_text: bool):
    ins = docs.select(*[c for c in docs.columns if c not in made])
    at = ins.columns.index(text)
    kept = [i for i in range(len(ins.columns)) if keep_text or i != at]
    return ins, at, kept, [ins.schema.fields[i] for i in kept]


#: Columns of a document's row while corpus counts are missing: its chunk, its
#: sparse row (places in the chunk's pair list, as differences, and times),
#: and on a chunk's first row the list itself with documents per pair.
_PARTIAL = ("__chunk", "__n", "__at", "__times", "__pairs", "__docs")


def _partial(paths, at: int, kept: list[int]):
    def run(batches):
        from pyspark import TaskContext

        aligner = once(Aligner, *paths)
        part = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(byte_slices(batches, at, CHUNK)):
            n, done = batch.num_rows, 0
            keys, times, digests, sizes = [], [], [], []
            for some in byte_slices([batch], at, STEP):
                got = aligner.align(_texts(some, at))
                k, t = text_pairs(got)
                keys.append(k + (done << 33))
                times.append(t)
                digests += aligner.group_digests(got)
                links = _starts(got.na * got.nb)[got.g_at]
                sizes.append([np.diff(v) for v in (got.a_at, got.b_at, got.g_at, links)])
                done += some.num_rows
            keys, times = np.concatenate(keys), np.concatenate(times)
            pairs, place, docs = np.unique(keys & _CODE, return_inverse=True, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(n + 1) << 33)
            row_at, row_times = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                row_at.append(_narrow(np.diff(place[s:e], prepend=0)))
                row_times.append(_narrow(times[s:e]))
            only_first = np.concatenate([[0], np.full(n, len(pairs))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept]
                + [_long(np.concatenate(v)) for v in zip(*sizes)]
                + [pa.array(digests, pa.string()), _long(np.full(n, part + number)),
                   _long(np.diff(cuts)), pa.array(row_at, pa.binary()), pa.array(row_times, pa.binary()),
                   pa.ListArray.from_arrays(pa.array(only_first.astype(np.int32)), pa.array(pairs, pa.int64())),
                   _rows(only_first, docs)],
                names=[batch.schema.names[i] for i in kept] + [*DIGEST[:5], *_PARTIAL])
    return run


def _with_counts(names: list[str]):
    """Rows of one chunk (left) with the sums over its pair list (right)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        docs, best = np.zeros((2, len(place)), dtype=np.int64)
        docs[place], best[place] = right.column("docs").to_numpy(), right.column("best").to_numpy()
        sums = []
        for n, at, times in zip(*(left.column(c).to_pylist() for c in ("__n", "__at", "__times"))):
            k, t = np.cumsum(_wide(at, n)), _wide(times, n)
            sums.append((int((best[k] * t).sum()), int((docs[k] * t).sum())))
        out = left.select(names)
        return (out.append_column("n_best", pa.array([s[0] for s in sums], pa.int64()))
                .append_column("count_sum", pa.array([s[1] for s in sums], pa.int64())))
    return run


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, docs, best) over the corpus from the chunks' lists."""
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("docs"))
    top = F.max("docs").over(Window.partitionBy(F.expr(f"pair div {PAIR}")))
    return counts.withColumn("best", (F.col("docs") == top).cast("long"))


def _staged_partial(docs, a_path, b_path, pattern, text, keep_text):
    ins, at, kept, fields = _inputs(docs, text, DIGEST + _PARTIAL, keep_text)
    longs = [T.StructField(c, T.LongType()) for c in DIGEST[:4]]
    partial = ins.mapInArrow(_partial((a_path, b_path, pattern), at, kept), T.StructType(
        fields + longs + [
            T.StructField("groups_sha256", T.StringType()), T.StructField("__chunk", T.LongType()),
            T.StructField("__n", T.LongType()), T.StructField("__at", T.BinaryType()),
            T.StructField("__times", T.BinaryType()), T.StructField("__pairs", T.ArrayType(T.LongType())),
            T.StructField("__docs", T.ArrayType(T.IntegerType()))]))
    partial = stage(partial, "align_partial")
    listed = (partial.where(F.size("__pairs") > 0)
              .select(F.col("__chunk").alias("chunk"), F.posexplode(F.arrays_zip("__pairs", "__docs")).alias("place", "x"))
              .select("chunk", "place", F.col("x.__pairs").alias("pair"), F.col("x.__docs").cast("long").alias("docs")))
    return partial, listed, [f.name for f in fields]


def link_digests(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text",
                 keep_text: bool = True) -> DataFrame:
    """``docs`` with token, group and link numbers, the groups' digest, and
    the sums over the corpus counts of the linked id pairs (``DIGEST``)."""
    partial, listed, names = _staged_partial(docs, a_path, b_path, pattern, text, keep_text)
    counts = broadcast_if_small(stage(pair_counts(listed), "align_counts"))
    back = listed.drop("docs").join(counts, "pair").select("chunk", "place", "docs", "best")
    names = [*names, *DIGEST[:5]]
    rows = partial.drop("__pairs", "__docs")
    fields = [f for f in rows.schema.fields if f.name in names]
    both = rows.groupBy("__chunk").cogroup(back.groupBy("chunk"))
    return both.applyInArrow(_with_counts(names), T.StructType(
        fields + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))


def link_table(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text") -> DataFrame:
    """(a_id, b_id, docs, best): the linked id pairs of the corpus, in how many
    documents each is linked, and whether that is its A id's highest."""
    listed = _staged_partial(docs, a_path, b_path, pattern, text, False)[1]
    return pair_counts(listed).select(
        F.expr(f"CAST(pair div {PAIR} AS INT)").alias("a_id"), F.expr(f"CAST(pair % {PAIR} AS INT)").alias("b_id"),
        "docs", (F.col("best") == 1).alias("best"))
