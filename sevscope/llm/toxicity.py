"""Toxic passages by maximum-scoring segment search.

Every word gets a token score: the log-odds of its occurrence in toxic against
clean training texts under a Dirichlet prior (a flat part plus the corpus
frequency), less a margin of its standard error, less a constant cost that
makes the expected score of clean text negative. A word is known by itself
and by its first bytes (``PREFIXES``), so inflected forms share evidence; the
best of these counts. A linear-time search then finds every maximal-scoring
segment of the text.

Segment scores follow an extreme-value law: of n clean words, the expected
number of segments of score S or more is K n exp(-lambda S), with lambda from
the clean token scores. A passage whose expected number is under
``SIGNIFICANT`` is reported. A logistic curve over the best passage's
log expectation and the number of significant passages gives the probability;
it is fitted on at most ``FIT_ROWS`` labelled rows (taken by a hash of the
id). Counts, token scores and passages cover all rows and whole texts.

The token table holds every significant entry. It is broadcast in blocks of
``CAPACITY`` entries; a word's score is the best over all blocks.

Defined results: null and empty texts have no words and get the curve's value
at no evidence; a document without label is scored but not learned from;
several labels of one id count as the largest; a null label is no label;
without any label, or with labels of one value only, every score is the
smoothed share of toxic labels (0.5 / (n + 1) for none toxic).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sevscope.llm.common import broadcast_if_small, byte_slices, row_number_of_fold, text_bytes
from sevscope.llm.decontaminate import _SPACED
from sevscope.llm.shingles import word_spans
from sevscope.session import stage

FOLDS, HELD_OUT = 5, 0
PREFIXES = (4, 5, 6)
PRIOR_FLAT, PRIOR_MASS = 0.5, 1000.0
MIN_Z, MARGIN, COST = 3.0, 1.0, 1.0
CAPACITY = 200_000
FIT_ROWS = 100_000
K, SIGNIFICANT = 0.1, 0.5
FLUSH = 250_000   # words whose counts a task holds before it passes them on


def _word_families(texts: list[bytes]):
    """Codes of words and of their prefixes, one row per family, and the
    number of each text's first word. Words no longer than a prefix have the
    word's own code in that family (marked by family, so never mixed up)."""
    spans = word_spans([t.translate(_SPACED) for t in texts], PREFIXES)
    return np.stack([spans[0], *(c ^ np.uint64(0x5851F42D4C957F2D * (k + 1) % (1 << 64))
                                 for k, c in enumerate(spans[4:]))]), spans[1]


def _count(batches):
    """Arrow pass over (toxic, text): (code, n_toxic, n_clean) partial counts;
    code 0 is the number of words."""
    held, size = [], 0

    def flush():
        codes = np.concatenate([c for c, _ in held])
        toxic = np.concatenate([t for _, t in held])
        known, at = np.unique(codes, return_inverse=True)
        n = np.bincount(at, minlength=len(known))
        n_toxic = np.bincount(at, weights=toxic, minlength=len(known)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(known.view(np.int64)), pa.array(n_toxic), pa.array(n - n_toxic)],
            names=["code", "n_toxic", "n_clean"])

    for batch in byte_slices(batches, 1):
        families, first = _word_families([t or b"" for t in batch.column(1).to_pylist()])
        labels = np.array(batch.column(0).to_pylist(), dtype=np.int8)
        toxic = np.repeat(labels, np.diff(first))
        held.append((np.concatenate([families.ravel(), np.zeros(len(toxic), np.uint64)]),
                     np.tile(toxic, len(families) + 1)))
        size += families.size
        if size >= FLUSH * len(families):
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def segments(scores: np.ndarray, places: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence in which
    the words at ``places`` have the given scores and every other word has
    -COST. Linear in the number of places with a positive score."""
    stack: list[list[float]] = []   # [first, end, sum before, sum after]
    total, last = 0.0, 0
    for at, s in zip(places.tolist(), scores.tolist()):
        total -= COST * (at - last)
        last = at + 1
        left, right = total, total + s
        total = right
        if s <= 0:
            continue
        item = [at, at + 1, left, right]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = int(stack[j][4])
            if j < 0 or stack[j][3] >= item[3]:
                stack.append([*item, j])
                break
            item[0], item[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(int(a), int(b), r - l) for a, b, l, r, _ in stack]


def _passages(blocks):
    """Arrow pass over (key columns..., text): words, segments of positive score."""
    def run(batches):
        for whole in batches:
            for batch in byte_slices([whole], whole.num_columns - 1):
                families, first = _word_families([t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()])
                best = np.full(families.shape[1], -COST)
                for codes, scores in (b.value for b in blocks):
                    for row in families:
                        at = np.searchsorted(codes, row)
                        at[at == len(codes)] = 0
                        best = np.maximum(best, np.where(codes[at] == row, scores[at], -COST))
                hot = np.flatnonzero(best > 0)
                cut = np.searchsorted(hot, first)
                found = [[dict(zip(("start", "end", "score"), s)) for s in
                          segments(best[hot[a:b]], hot[a:b] - f)] if b > a else []
                         for a, b, f in zip(cut[:-1], cut[1:], first[:-1])]
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(np.diff(first), pa.int64()), pa.array(found, _ARROW_SEGMENTS)],
                    names=batch.schema.names[:-1] + ["n_words", "segments"])
    return run


_ARROW_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_SEGMENTS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                      T.StructField("score", T.DoubleType())]))


def token_scores(train: DataFrame):
    """(codes, scores, clean shares) of the significant tokens of a frame
    (toxic, text bytes): sorted codes, score of each, its share of clean words."""
    counts = stage(train.mapInArrow(_count, "code long, n_toxic long, n_clean long").groupBy("code")
                   .agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")), "tox_counts")
    total = counts.where("code = 0").first()
    nt, nc = (float(total["t"]), float(total["c"])) if total else (0.0, 0.0)
    if not nt or not nc:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    prior = F.lit(PRIOR_FLAT) + F.lit(PRIOR_MASS) * (F.col("t") + F.col("c")) / F.lit(nt + nc)
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = (F.log(t / (F.lit(nt + PRIOR_MASS) - t)) - F.log(c / (F.lit(nc + PRIOR_MASS) - c)))
    err = F.sqrt(1 / t + 1 / c)
    kept = stage(counts.where(f"code != 0 AND t > 1 AND t < {nt}").select("code", odds.alias("odds"), err.alias("err"), "c")
                 .where(F.col("odds") >= MIN_Z * F.col("err")), "tox_tokens")
    parts = max(1, math.ceil(kept.count() / CAPACITY))
    kept = pd.concat([kept.where(F.pmod("code", F.lit(parts)) == k).toPandas() for k in range(parts)])
    codes = kept["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    scores = (kept["odds"] - MARGIN * kept["err"]).to_numpy(float) - COST
    shares = (kept["c"].to_numpy(float) + PRIOR_FLAT) / (nc + 1)
    keep = scores[order] > 0
    return codes[order][keep], scores[order][keep], shares[order][keep]


def decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root lambda of sum(share * exp(lambda * score)) = 1 over
    clean words, those without a score having -COST."""
    rest = max(1e-9, 1 - shares.sum())

    def over(x):
        return float((shares * np.exp(np.minimum(x * scores, 700))).sum() + rest * math.exp(-x * COST)) > 1
    low, high = 0.0, 1.0
    while not over(high) and high < 64:
        high *= 2
    low = 1e-6
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return max(low, 0.05)


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge-penalised logistic curve, Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.full(len(w), penalty)
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, n_words, n_passages, passages) of
    every document; passages are the significant segments (start and end word
    number, score). Labels of the held-out fold are never read."""
    spark = docs.sparkSession
    fold = row_number_of_fold(F.col("__tx_key"), FOLDS)
    truth = stage(labels.select(F.col(key).alias("__tx_key"), F.col("toxic").cast("int").alias("toxic"))
                  .where(F.col("toxic").isNotNull() & F.col("__tx_key").isNotNull() & (fold != HELD_OUT))
                  .groupBy("__tx_key").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "tox_labels")
    texts = docs.select(F.col(key).alias("__tx_key"), text_bytes(text).alias("t"))
    truth_side = broadcast_if_small(truth)
    codes, scores, shares = token_scores(texts.join(truth_side, "__tx_key").select("toxic", "t"))
    blocks = [spark.sparkContext.broadcast((codes[a:a + CAPACITY], scores[a:a + CAPACITY]))
              for a in range(0, len(codes), CAPACITY)]
    found = stage(texts.mapInArrow(_passages(blocks), T.StructType([
        T.StructField("__tx_key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("segments", _SEGMENTS)])), "tox_passages")

    lam = decay(scores, shares) if len(scores) else 1.0
    space = F.log(F.lit(K) * F.greatest(F.col("n_words"), F.lit(1)))
    bits = F.transform("segments", lambda s: F.lit(lam) * s["score"])
    best = F.coalesce(F.array_max(bits) - space, -space - 1.0)
    significant = F.filter("segments", lambda s: F.lit(lam) * s["score"] - space > -math.log(SIGNIFICANT))
    found = found.withColumns({"x1": F.least(F.greatest(best, F.lit(-10.0)), F.lit(30.0)),
                               "passages": significant}).withColumn(
        "x2", F.log1p(F.size("passages").cast("double")))
    fit = (found.join(truth_side, "__tx_key").select("__tx_key", "x1", "x2", "toxic")
           .orderBy(F.xxhash64("__tx_key"), "x1", "x2").limit(FIT_ROWS).toPandas())
    y = fit["toxic"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        w = fit_curve(fit[["x1", "x2"]].to_numpy(float), y)
        z = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("x1") + F.lit(float(w[2])) * F.col("x2")
        p = 1 / (1 + F.exp(-z))
    else:
        p = F.lit((float(y.sum()) + 0.5) / (len(y) + 1) if len(y) else 0.5 / 1.5)
    held = row_number_of_fold(F.col("__tx_key"), FOLDS) == HELD_OUT
    return found.withColumn("score", p).select(
        F.col("__tx_key").alias(key), held.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words",
        F.size("passages").cast("long").alias("n_passages"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that the score rejects (their ids; a
    null id is judged by its largest score)."""
    bad = stage(score_toxicity(docs, labels, key, text).where("predicted = 1")
                .select(F.col(key).alias("__tx_key")).distinct(), "tox_rejected")
    return docs.join(broadcast_if_small(bad), F.col(key).eqNullSafe(F.col("__tx_key")), "left_anti")
