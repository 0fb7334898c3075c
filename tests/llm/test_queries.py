"""The registered queries on the smallest tables: columns, whole tables, and
their brute-force or library answers."""

import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken

from sevscope.llm import bpe, decontaminate, pii, queries
from test_joins_and_models import _brute

COLUMNS = {
    "op1_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op2_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint",
                          "items_sha256": "string", "contaminated": "boolean"},
    "op3_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_lm_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
                      "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_embedding_neardup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
                "base_sha256": "string", "spans": "string"},
    "op7_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint",
                        "loss_sha256": "string", "formatted_chars": "bigint"},
    "op8_line_dedup": {"doc_id": "bigint", "text": "string"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_license_scan": {"doc_id": "bigint", "licenses": "string"},
    "op11_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint",
                                 "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string",
                                 "repaired_sha256": "string"},
    "op12_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op13_tokenizer_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint",
                                 "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint",
                                 "groups_sha256": "string"},
}


@pytest.fixture(scope="module")
def documents(spark, small_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark, small_dir):
    held = {}

    def get(name):
        if name not in held:
            df = queries.REGISTRY[name](spark, small_dir)
            assert COLUMNS[name].items() <= dict(df.dtypes).items()
            held[name] = df.collect()
        return held[name]
    return get


def test_every_query_has_its_contract():
    assert set(COLUMNS) == set(queries.REGISTRY)


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - {"op5_embedding_neardup", "op7_chat_format",
                                                            "op11_conversation_repair"}))
def test_documents_come_back_whole(rows, documents, name):
    assert sorted(r.doc_id for r in rows(name)) == sorted(documents)


def test_join_leaks_spans_and_tokens(spark, small_dir, rows, documents):
    docs = sorted(documents.items())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows("op1_ngram_join")) == sorted(_brute(docs))
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    short = {k for k, t in docs if len(t or "") < 4000}
    for r in rows("op2_decontaminate"):
        if r.doc_id in short:
            want = decontaminate.brute_force((documents[r.doc_id] or "").encode(), items)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == want
    for r in rows("op6_pii"):
        assert r.base_sha256 == pii.brute_force(documents[r.doc_id])[1]
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows("op3_byte_bpe"):
        text = documents[r.doc_id] or ""
        ids = lib.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def test_folds(rows):
    for name, fold in (("op4_lm_scores", 1), ("op9_toxicity", 0)):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == fold) for r in rows(name))
