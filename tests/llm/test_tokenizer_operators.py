"""Token counts and cross-tokenizer alignment against the libraries on whole
texts and a plain alignment by sets of offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sevscope.llm import align, queries, token_counts, vocab

A_PATH, B_PATH = (public_tokenizers.path(p) for p in (align.A_VOCABULARY, align.B_VOCABULARY))
PIECES = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
BYTES = Tokenizer.from_file(A_PATH)
BYTES.encode_special_tokens = True
HARD = ["", " ", "  ", "a", " a", "a ", "a  b   c", "x\ty\nz \n", "don't <|endoftext|> </s> <s> <0x41>", "Ünïcode 漢字 😀🏽 é",
        "a\x00b", "ﬁ ① Ａ", "x▁y", "▁", "a ▁ b", "z" * 3000, "漢" * 2000, " " * 3000, "𞤀𞤁 a", "a b 　 c \x1c d",
        "word " * 4000, "1234567890 " * 500, "'s 't's", "a​b ﻿"]


def _token_bytes():
    letters = vocab._byte_letters()
    a = {i: bytes(letters[c] for c in t) for t, i in BYTES.get_vocab().items() if all(c in letters for c in t)}
    b = {i: bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i)
         else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in range(PIECES.vocab_size())}
    return a, b


def brute_alignment(texts):
    """One tuple per text: n_a, n_b, n_groups, n_links, digest, n_best, count_sum."""
    a_bytes, b_bytes = _token_bytes()
    held, counts = [], Counter()
    for text in texts:
        a = BYTES.encode(" " + text, add_special_tokens=False).ids if text else []
        b = PIECES.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            held.append(([], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(a_bytes[i]) for i in a]), np.cumsum([len(b_bytes[i]) for i in b])
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            to_i, to_j = int(np.searchsorted(ends_a, cut, "right")), int(np.searchsorted(ends_b, cut, "right"))
            groups.append((a[i:to_i], b[j:to_j]))
            i, j = to_i, to_j
        held.append((a, b, groups))
        counts.update({(x, y) for ga, gb in groups for x in set(ga) for y in set(gb)})
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for a, b, groups in held:
        times = Counter()
        for ga, gb in groups:
            for x, n in Counter(ga).items():
                for y, m in Counter(gb).items():
                    times[x, y] += n * m
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((len(a), len(b), len(groups), sum(times.values()),
                    hashlib.sha256(shown.encode()).hexdigest() if a else "",
                    sum(t for p, t in times.items() if counts[p] == top[p[0]]),
                    sum(t * counts[p] for p, t in times.items())))
    return out


def _documents(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def test_count_query_equals_the_library(spark, small_dir):
    texts = _documents(spark, small_dir)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.REGISTRY["op12_token_counts"](spark, small_dir).collect()}
    want = {k: len(PIECES.encode(t or "")) for k, t in texts.items()}
    assert got == {k: (len((texts[k] or "").encode()), n, n > 4096) for k, n in want.items()}


def test_alignment_query_equals_brute_force(spark, small_dir):
    texts = _documents(spark, small_dir)
    ids = sorted(texts)
    got = {r.doc_id: tuple(r[c] for c in align.DIGEST)
           for r in queries.REGISTRY["op13_tokenizer_alignment"](spark, small_dir).collect()}
    assert got == dict(zip(ids, brute_alignment([texts[k] for k in ids])))


def _random_texts(n):
    rng = random.Random(5)
    bits = HARD + ["the ", "of the", " unbelievable", "\n\n", "über", "日本", "?!", " 12", "́"]
    return ["".join(rng.choice(bits)[:40] for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_counts_of_hard_texts():
    texts = HARD + _random_texts(300)
    assert token_counts.count_batch(vocab.Pieces(B_PATH), texts).tolist() == [len(PIECES.encode(t)) for t in texts]
    plain = Tokenizer.from_file(A_PATH)
    assert token_counts.count_batch(vocab.Plain(A_PATH), texts).tolist() == [
        len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.count_batch(vocab.Plain(public_tokenizers.path("word_bpe_49k.json")), texts).tolist() == [
        len(words.encode(t, add_special_tokens=False).ids) for t in texts]


def test_byte_level_ids_equal_the_files_own_library():
    texts = HARD[1:] + [t for t in _random_texts(300) if t] + ["\U0001e4d0\U0001e4d1 x", "Ᲊa"]
    got = vocab.ByteLevel(A_PATH, public_tokenizers.PATTERN).encode(texts)
    assert [g.tolist() for g in got] == [BYTES.encode(t, add_special_tokens=False).ids for t in texts]


def test_parts_join_to_the_text():
    for text in HARD + _random_texts(100):
        for size in (1, 7, 400):
            assert " ".join(vocab.safe_parts(text, size)) == text


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_hard_texts(spark, monkeypatch, small):
    texts = HARD + _random_texts(120) + [None, "a b", "a b"]
    rows = [(k, t, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string, n_a string").repartition(3)
    if small:  # every group by its distinct ids, a slice per group
        monkeypatch.setattr(align, "SLICE", 1)
        aligner = align.Aligner(A_PATH, B_PATH, public_tokenizers.PATTERN)
        got = aligner.align([t or "" for t in texts])
        keys, times = align.text_pairs(got)
        monkeypatch.undo()
        again = align.text_pairs(got)
        assert (keys == again[0]).all() and (times == again[1]).all()
        return
    out = align.link_digests(docs, A_PATH, B_PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "own", *align.DIGEST[:5], "n_best", "count_sum"]
    rows = {r.doc_id: tuple(r[c] for c in align.DIGEST) for r in out.collect()}
    assert rows == dict(enumerate(brute_alignment(texts)))


def test_alignment_cuts_and_link_table(spark):
    texts = ["the unbelievable 漢字", "", None, "x▁y", "the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    a_bytes, b_bytes = _token_bytes()
    args = (A_PATH, B_PATH, public_tokenizers.PATTERN)
    for r in align.align_texts(docs, *args).collect():
        if r.text and "▁" not in r.text:
            joined = [b"".join(table[i] for i in ids) for table, ids in ((a_bytes, r.a_ids), (b_bytes, r.b_ids))]
            assert joined == [(" " + r.text).encode()] * 2
            assert (r.a_cuts[-1], r.b_cuts[-1]) == (len(r.a_ids), len(r.b_ids))
        else:
            assert not r.a_ids and not r.b_ids and not r.a_cuts and not r.b_cuts
    table = {(r.a_id, r.b_id): (r.docs, r.best) for r in align.link_table(docs, *args).collect()}
    the = (BYTES.encode(" the", add_special_tokens=False).ids[0], PIECES.encode("the")[0])
    assert table[the] == (2, True)


def test_hazards_of_counts_and_alignment(hard_docs, no_docs, hard_rows):
    args = (A_PATH, B_PATH, public_tokenizers.PATTERN)
    clash = hard_docs.withColumn("n_tokens", F.lit("x")).withColumn("__chunk", F.lit(1)).withColumn("chunk", F.lit("y"))
    counted = token_counts.count_tokens(clash, B_PATH)
    assert counted.count() == len(hard_rows) and dict(counted.dtypes)["n_tokens"] == "bigint"
    assert {r.n_tokens for r in counted.where("text IS NULL OR text = ''").collect()} == {0}
    aligned = align.link_digests(clash, *args)
    assert aligned.count() == len(hard_rows) and "chunk" in aligned.columns
    assert {tuple(r[c] for c in align.DIGEST) for r in aligned.where("text IS NULL OR text = ''").collect()} == {
        (0, 0, 0, 0, "", 0, 0)}
    for df in (token_counts.count_tokens(no_docs, B_PATH), align.link_digests(no_docs, *args),
               align.align_texts(no_docs, *args), align.link_table(no_docs, *args)):
        assert df.count() == 0
