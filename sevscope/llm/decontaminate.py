"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Every run of ten words of a benchmark item is a window (an item of fewer
words, but not none, is one window). The windows' 64-bit codes are broadcast
as a sorted array; tasks slide over the words of whole documents, look every
window up and verify each hit word for word before it counts.

The broadcast is bounded: items are dealt into blocks of at most
``BLOCK_WORDS`` words (plus one item; about 0.5 KB a word in each Python
worker), documents are scanned once for each block, and a block's result is a
staged table before the next block is broadcast, so a worker holds one block's
windows. Only blocks reach the driver, one at a time, and only benchmark text.

Defined results: null or wordless texts have no words and are clean; null or
wordless items match nothing; a null item id is left out of the lists, though
its windows still count as hits; items that repeat under one id count once;
repeated documents are scanned each for itself; a document whose words are all
hit is removed or becomes empty, as the mode says. Columns of the documents
are returned unchanged (a column that carries a result's name is replaced).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sevscope.llm.common import byte_slices, keeping_columns, sha256_hex, text_bytes
from sevscope.llm.shingles import _FOLD, window_codes, word_spans
from sevscope.session import release, stage

N = 10
BLOCK_WORDS = 400_000

_KEPT = np.zeros(256, dtype=bool)
_KEPT[ord("0"):ord("9") + 1] = _KEPT[ord("a"):ord("z") + 1] = True
_KEPT[0x80:] = True
_SPACED = bytes(b if _KEPT[b] else 0x20 for b in _FOLD)   # folds, then spaces what is no word byte


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


class Windows:
    """Windows of a block of items, by length and code."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            size = min(n, len(words))
            codes, _, _, _ = word_spans([b" ".join(words)])
            for k, code in enumerate(window_codes(codes, size).tolist()):
                gram = b" ".join(words[k:k + size])
                held = found[size][code]
                for entry in held:
                    if entry[0] == gram:
                        entry[1].add(item)
                        break
                else:
                    held.append((gram, {item}))
        self.grams = {s: dict(x) for s, x in found.items()}
        self.codes = {s: np.array(sorted(x), dtype=np.uint64) for s, x in found.items()}


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int):
    """Lists of (id, text bytes), each of at most ``block_words`` words plus
    one item; the driver holds one list at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), text_bytes(text).alias("t"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((r["item"], bytes(r["t"])))
        held += len(words_of(block[-1][1]))
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def _scan(windows, text_at: int):
    """Arrow pass: adds the hit word runs and the items of one block."""
    def run(batches):
        w = windows.value
        for batch in byte_slices(batches, text_at):
            texts = [x or b"" for x in batch.column(text_at).to_pylist()]
            spaced = [t.translate(_SPACED) for t in texts]
            codes, first, start, end = word_spans(spaced)
            joined = b"\n".join(spaced)
            hits: dict[int, list] = defaultdict(list)
            for size, wanted in w.codes.items():
                here = window_codes(codes, size)
                at = np.searchsorted(wanted, here)
                at[at == len(wanted)] = 0
                for k in np.flatnonzero(wanted[at] == here).tolist():
                    doc = int(np.searchsorted(first, k, "right")) - 1
                    if k + size > first[doc + 1]:
                        continue
                    gram = b" ".join(joined[start[j]:end[j]] for j in range(k, k + size))
                    for known, items in w.grams[size][int(here[k])]:
                        if known == gram:
                            hits[doc].append((k - int(first[doc]), size, items))
            runs, items = [], []
            for d in range(len(texts)):
                merged, names = [], set()
                for k, size, ids in sorted(hits.get(d, ()), key=lambda x: x[:2]):
                    names |= ids
                    if merged and k <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], k + size)
                    else:
                        merged.append({"start": k, "end": k + size})
                runs.append(merged)
                items.append(sorted(x for x in names if x is not None))
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(np.diff(first), pa.int64()), pa.array(runs, _ARROW_RUNS),
                        pa.array(items, pa.list_(pa.string()))],
                names=batch.schema.names + ["__dc_words", "__dc_runs", "__dc_items"])
    return run


_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _merge(a, b):
    """Sorted, disjoint runs of two such arrays (DataFrame functions)."""
    def add(acc, r):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (r["start"] <= F.when(F.size(acc) > 0, last["end"])),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1),
                               F.array(F.struct(last["start"].alias("start"),
                                                F.greatest(last["end"], r["end"]).alias("end"))))) \
            .otherwise(F.concat(acc, F.array(r)))
    return F.aggregate(F.array_sort(F.concat(a, b)), F.array().cast(_RUNS), add)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_runs`` (runs of hit word numbers, end
    exclusive), ``n_hit`` and ``hit_items`` (sorted item ids)."""
    spark = docs.sparkSession
    made = ("n_words", "hit_runs", "n_hit", "hit_items")
    rest = [c for c in docs.columns if c not in made]
    out = docs.select(*rest, text_bytes(text).alias("__dc_text"))
    schema = T.StructType([*out.schema.fields, T.StructField("__dc_words", T.LongType()),
                           T.StructField("__dc_runs", _RUNS),
                           T.StructField("__dc_items", T.ArrayType(T.StringType()))])
    done = held = before = None
    for block in _blocks(benchmark, item, item_text, block_words):
        if done is not None:      # the block before is written out, then its windows go
            done = stage(done, "dc_block")
            release(before)
            held.unpersist()
            before = done
        held = spark.sparkContext.broadcast(Windows(block, n))
        if done is None:
            done = out.mapInArrow(_scan(held, len(rest)), schema)
        else:
            prior = done.select(*rest, F.col("__dc_runs").alias("__dc_runs0"),
                                F.col("__dc_items").alias("__dc_items0"), "__dc_text")
            wide = T.StructType([*prior.schema.fields, *schema.fields[-3:]])
            done = (prior.mapInArrow(_scan(held, len(rest) + 2), wide)
                    .withColumn("__dc_runs", _merge(F.col("__dc_runs0"), F.col("__dc_runs")))
                    .withColumn("__dc_items", F.array_sort(F.array_union("__dc_items0", "__dc_items"))))
    if done is None:
        done = out.mapInArrow(_scan(spark.sparkContext.broadcast(Windows([], n)), len(rest)), schema)
    n_hit = F.aggregate("__dc_runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return done.select(*rest, F.col("__dc_words").alias("n_words"), F.col("__dc_runs").alias("hit_runs"),
                       n_hit.alias("n_hit"), F.col("__dc_items").alias("hit_items"))


def _slices_before_last(batches):
    for batch in batches:
        yield from byte_slices([batch], batch.num_columns - 2)


def _cut(batches):
    """Arrow pass: texts without the characters from the first to the last
    word of each hit run."""
    for batch in _slices_before_last(batches):
        texts = [x or b"" for x in batch.column(batch.num_columns - 2).to_pylist()]
        runs = batch.column(batch.num_columns - 1).to_pylist()
        _, first, start, end = word_spans([t.translate(_SPACED) for t in texts])
        out, base = [], 0
        for d, t in enumerate(texts):
            parts, at = [], 0
            for r in runs[d] or ():
                a = int(start[first[d] + r["start"]]) - base
                b = int(end[first[d] + r["end"] - 1]) - base
                parts.append(t[at:a])
                at = b
            out.append(b"".join([*parts, t[at:]]).decode("utf-8", "replace"))
            base += len(t) + 1
        cols = [batch.column(i) for i in range(batch.num_columns - 2)]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(out, pa.string())],
                                         names=batch.schema.names[:-2] + ["__dc_cut"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text",
                  **options) -> DataFrame:
    """``docs`` (same columns) without contamination: mode ``documents`` drops
    every document with a hit, mode ``spans`` cuts the hit runs out of the
    text and keeps all rows (a null text then stays null)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    made = ("n_words", "n_hit", "hit_runs", "hit_items")
    return keeping_columns(docs, made, lambda d: _cleaned(d, benchmark, mode, text, options))


def _cleaned(docs: DataFrame, benchmark: DataFrame, mode: str, text: str, options: dict) -> DataFrame:
    found = find_contamination(docs, benchmark, text=text, **options)
    names = docs.columns
    if mode == "documents":
        return found.where("n_hit = 0")
    ins = found.select(*names, text_bytes(text).alias("__dc_text"), "hit_runs")
    schema = T.StructType([*ins.schema.fields[:-2], T.StructField("__dc_cut", T.StringType())])
    cut = ins.mapInArrow(_cut, schema)
    return cut.select(*[(F.when(F.col(c).isNull(), F.col(c)).otherwise(F.col("__dc_cut")).alias(c)
                         if c == text else F.col(c)) for c in names])


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of ``find_contamination``'s result."""
    return found.select(
        key, "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(text: bytes | None, items: list[tuple], n: int = N):
    """Reference answer for one document: (n_words, n_hit, item ids)."""
    words, hit, ids = words_of(text or b""), set(), set()
    for item, other in items:
        gram = words_of(other or b"")
        size = min(n, len(gram))
        for k in range(len(gram) - size + 1 if gram else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == gram[k:k + size]:
                    hit |= set(range(j, j + size))
                    ids.add(item)
    ids = sorted(str(x) for x in ids if x is not None)
    return len(words), len(hit), len(ids), sha256_hex(",".join(ids).encode())
