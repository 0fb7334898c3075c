"""Line dedup, licences, decontamination, personal data, BPE on hazards."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sevscope.llm import bpe, decontaminate, licenses, line_dedup, pii

PATH, PATTERN = public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN


# ------------------------------------------------------------------ lines
def test_line_dedup_hazards(hard_docs, hard_rows, no_docs):
    out = line_dedup.line_dedup(hard_docs, ratio=0.1, min_pages=3)
    assert out.columns == [*hard_docs.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == len(hard_rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id in (4, 5, 11, 12, 13)}
    assert by_id[4].text is None and by_id[4].n_lines == 0
    assert by_id[5].text == "" and by_id[5].n_lines == 1
    assert by_id[11].text == "a\n\nb\n a " and by_id[11].n_dropped == 1
    assert by_id[12].text == "z" and by_id[12].score == 1.5
    assert line_dedup.line_dedup(no_docs).collect() == []


def test_line_counted_once_per_page_and_by_site(spark):
    rows = [(k, "x\nx\nx", "a") for k in range(2)] + [(k, "x", "b") for k in range(2, 5)] + [
        (k, f"u{k}", "b") for k in range(5, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, ratio=0.1).collect()}
    assert out[0] == "x\nx\nx"            # two pages only on its site
    assert out[2] == "" and out[7] == "u7"


# ---------------------------------------------------------------- licences
def test_every_known_sentence_has_a_cue_and_is_normal():
    for s in licenses.SENTENCES.values():
        assert any(c in s for c in licenses.CUES)
        assert s == " ".join("".join(c if c.isalnum() else " " for c in s).split()) == s.lower()
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    known = set(licenses.SENTENCES)
    assert all(set(run) <= known for _, _, run in licenses.RULES)


def test_license_rules_are_ordered(spark, hard_docs, no_docs, hard_rows):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction. The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        "Released under the MIT License.\nReleased under the MIT License.",
        "He said: released under the MIT license", "not a license", None, "",
        "You may obtain a copy of the License at\nLicensed under CC BY-NC 4.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert out[0].sentence_ids == "mit-grant,mit-notice" and out[0].n_matches == 1
    assert out[1].licenses == "MIT" and out[1].n_matches == 2
    assert out[2].licenses == "MIT" and out[3].licenses == "" and out[4].sentence_ids == ""
    assert out[6].licenses == "CC-BY-NC-4.0" and out[6].n_loose == 1
    wide = licenses.scan_licenses(hard_docs)
    assert wide.count() == len(hard_rows) and "score" in wide.columns
    assert [r.licenses for r in wide.where("doc_id = 14").collect()] == ["Apache-2.0"]
    assert licenses.scan_licenses(no_docs).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0
(the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_full_licence_texts_are_known(spark):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3.format("the copyright holder"), "GPL-3.0-or-later": GPL,
             "Apache-2.0": APACHE, "BSD-3-Clause ": BSD_3.format("the University of Nowhere"),
             "GPL-2.0-or-later": GPL.replace("version 3", "version 2")}
    rows = []
    for name, text in texts.items():
        for lead in ("", "# ", " * ", "// "):
            rows.append((name.strip(), "Copyright (c) 2020 A. Holder\n" + "".join(lead + x + "\n" for x in text.split("\n"))))
        rows.append((name.strip(), " ".join(text.split())))
        rows.append((name.strip(), text.replace("\n", "\r\n") + "import os\n"))
    out = licenses.scan_licenses(spark.createDataFrame(rows, "name string, text string")).collect()
    assert all((r.licenses, r.n_matches, r.n_loose) == (r.name, 1, 0) for r in out), [
        (r.name, r.licenses, r.sentence_ids, r.n_loose) for r in out if r.licenses != r.name or r.n_loose]


# ---------------------------------------------------------- decontamination
BENCH = [(1, " ".join(f"word{k}" for k in range(10, 25))), (2, "Two... WORDS!"), (2, "two words"), (3, None),
         (4, "?!"), (None, "footer"), (5, "two words three")]


@pytest.mark.parametrize("block", [10 ** 6, 3])
def test_decontamination_equals_brute_force(spark, hard_docs, hard_rows, block):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontaminate.find_contamination(hard_docs, bench, block_words=block)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                 for r in decontaminate.report(found).collect())
    items = [(i, t.encode() if t else None) for i, t in BENCH]
    want = []
    for r in hard_rows:
        n, hit, k, digest = decontaminate.brute_force((r[1] or "").encode(), items)
        want.append((str(r[0]), n, hit, k, digest, hit > 0))
    assert got == sorted(want)


def test_decontamination_modes(spark, hard_docs, hard_rows, no_docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    kept = decontaminate.decontaminate(hard_docs, bench)
    assert kept.columns == hard_docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {None, 4, 5, 6, 9, 10}
    cut = decontaminate.decontaminate(hard_docs, bench, mode="spans")
    assert cut.columns == hard_docs.columns and cut.count() == len(hard_rows)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[4] is None and texts[7] == "" and texts[13] == ""
    assert texts[1] == " ".join(f"word{k}" for k in range(10)) + "  " + " ".join(f"word{k}" for k in range(25, 40))
    assert decontaminate.decontaminate(no_docs, bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(hard_docs, none).count() == len(hard_rows)


# ------------------------------------------------------------ personal data
def _noisy(rng):
    parts = ["a.b@c.de", "x@y", "@", "a@b.c@d.e", "..@..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4",
             "4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "+12", "++49 30 1234567 8", " - ", "12",
             "é", "漢", "-", ".", "+", " ", "\n", "3782 822463 10005", "%_+-@Q-q.z1"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [_noisy(rng) for _ in range(3000)] + [None, "", "9" * 20_000, "a" * 50_000 + "@b.c", "1." * 10_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(pii.find_pii(docs)).collect():
        spans, digest = pii.brute_force(texts[r.doc_id])
        assert r.base_sha256 == digest, texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.BASE)


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88 3704 0044 0532 0130 00")
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("iban DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("number 219-09-9999") == [] and kinds("social security 219-09-9999") == ["ssn"]
    assert kinds("ssn 000-12-3456") == []
    low = pii.find_spans("x 70.23.22.57")[0][3]
    assert pii.find_spans("server 70.23.22.57")[0][3] > low


def test_pii_hazards_and_redaction(spark, hard_docs, hard_rows, no_docs):
    assert pii.report(pii.find_pii(hard_docs)).count() == len(hard_rows)
    assert pii.find_pii(no_docs).collect() == []
    docs = spark.createDataFrame([(1, "ä a@b.co, 1.2.3.4!", "p"), (2, None, "p"), (3, "none", "p")],
                                 "doc_id long, text string, pii string")
    out = {r.doc_id: r.text for r in pii.redact(docs.drop("pii")).collect()}
    assert out == {1: "ä [EMAIL], [IP]!", 2: None, 3: "none"}


# --------------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def coders():
    ranks = bpe.load_ranks(PATH)
    return bpe.Encoder(ranks, PATTERN), tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_library(coders):
    own, lib = coders
    rng = random.Random(4)
    bits = ["a", "b", "e", " ", "  ", "\n", "\t", "é", "ß", "漢", "1", "22", "'s", "'ll", "!", "--", "\xa0", "\x85", "\x1c",
            " ", "th", "ing", "<|", "x" * 40, "ab" * 70, "0" * 33, " " * 50, "\U0001f600", "aaaa", "=" * 7]
    cache = bpe.PieceCache(own, bpe.piece_ids)
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        ids = lib.encode_ordinary(text)
        assert own.encode(text) == ids and own.decode(ids) == text.encode()
        assert [i for part in cache.of(text) for i in part] == ids


def test_join_is_associative_and_exact(coders):
    own, lib = coders
    rng = random.Random(9)
    for n in range(400):
        text = "".join(rng.choice("abcdehinorst" if n % 2 else "ab=") for _ in range(rng.randint(3, 300)))
        a, b, c = (own.encode_piece(p) if p else [] for p in (text[:50].encode(), text[50:51].encode(), text[51:].encode()))
        left, right = own.join(own.join(a, b), c), own.join(a, own.join(b, c))
        assert left == right == own.encode_piece(text.encode())
        if text.isalpha():
            assert left == lib.encode_ordinary(text)


def test_bpe_hazards(coders, hard_docs, hard_rows, no_docs):
    own, lib = coders
    docs = hard_docs.withColumnRenamed("code", "n_tokens").withColumnRenamed("part", "ids_sha256")
    rows = bpe.digest_texts(docs, PATH, PATTERN).collect()
    assert len(rows) == len(hard_rows)
    want = {}
    for r in hard_rows:
        ids = lib.encode_ordinary(r[1] or "")
        want.setdefault(r[1], (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                               hashlib.sha256((r[1] or "").encode()).hexdigest()))
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.text]
    back = bpe.decode_ids(bpe.encode_texts(hard_docs, PATH, PATTERN).withColumnRenamed("text", "was"), PATH, PATTERN)
    assert all((r.was or "") == r.text for r in back.collect())
    assert bpe.digest_texts(no_docs, PATH, PATTERN).collect() == []


def test_cache_restarts(coders):
    own, lib = coders
    cache = bpe.PieceCache(own, bpe.piece_ids)
    old, bpe.HELD_PIECES = bpe.HELD_PIECES, 50
    try:
        text = " ".join(f"some{k} words{k}" for k in range(100))
        for _ in range(3):
            assert [i for p in cache.of(text) for i in p] == lib.encode_ordinary(text)
        assert len(cache.known) <= 50
    finally:
        bpe.HELD_PIECES = old
