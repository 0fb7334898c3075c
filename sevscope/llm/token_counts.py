"""Token counts of whole texts, by a public tokenizer's own library.

One Arrow pass: texts are cut at safe boundaries (``vocab.safe_parts``) into
parts of about ``PART`` characters, parts are packed in order into batches of
at most ``PACK`` characters, each batch is encoded by one library call, and only
the lengths are kept and summed per text. A batch's cost thus follows its
size, whether it holds one long text or a thousand short ones, and a task's
memory does not depend on the texts. A text without safe boundaries is one
part. Tokenizers whose boundaries are not known to be safe get whole texts.

Defined results: null and empty texts have 0 bytes and 0 tokens; bytes that
are not UTF-8 are replaced before encoding and counted as they are; repeated
rows are counted each for itself; a text is over the limit when it has more
than ``limit`` tokens; other columns are kept (a column that carries a
result's name is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sevscope.llm.common import byte_slices
from sevscope.llm.vocab import counter_of, safe_parts

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
PART = 4_096             # characters after which a long text is split
PACK = 1 << 20           # characters of a batch given to the library at once
MADE = ("n_bytes", "n_tokens", "over_limit")


def count_batch(counter, texts: list[str]) -> np.ndarray:
    """Token counts of texts, encoded in batches of about equal size."""
    total = np.zeros(len(texts), dtype=np.int64)
    parts: list[str] = []
    owner: list[int] = []
    held = 0

    def flush():
        nonlocal held
        if parts:
            np.add.at(total, owner, counter.lengths(parts))
            parts.clear()
            owner.clear()
            held = 0

    for k, text in enumerate(texts):
        if not text:
            continue
        for number, part in enumerate(safe_parts(text, PART) if counter.splits else [text]):
            if held + len(part) > PACK:
                flush()
            parts.append(counter.lead + part if number else part)
            owner.append(k)
            held += len(part)
    flush()
    return total


def _counts(path: str, limit: int, at: int, kept: list[int]):
    def run(batches):
        counter = counter_of(path)
        for batch in byte_slices(batches, at, 4 << 20):
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            counts = count_batch(counter, [t.decode("utf-8", "replace") if t else "" for t in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept]
                + [pa.array([len(t or b"") for t in raw], pa.int64()), pa.array(counts, pa.int64()),
                   pa.array(counts > limit, pa.bool_())],
                names=[batch.schema.names[i] for i in kept] + list(MADE))
    return run


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT,
                 keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    ins = docs.select(*[c for c in docs.columns if c not in MADE])
    at = ins.columns.index(text)
    kept = [i for i in range(len(ins.columns)) if keep_text or i != at]
    fields = [ins.schema.fields[i] for i in kept]
    return ins.mapInArrow(_counts(path, limit, at, kept), T.StructType(
        [*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
         T.StructField("over_limit", T.BooleanType())]))
