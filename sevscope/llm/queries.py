"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from sevscope.llm import (align, bpe, chat, decontaminate, licenses, line_dedup, lm, ngram_join, pii, repair,
                          rp_forest, token_counts, toxicity)
from sevscope.llm.common import table
from sevscope.session import scoped

REGISTRY = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = scoped(f)
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add


@query("op7_chat_format", chat.ORACLE)
def chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(chat.injected(spark))))


@query("op8_line_dedup", line_dedup.ORACLE)
def lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.line_dedup(docs)


@query("op10_license_scan", licenses.ORACLE)
def license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


@query("op2_decontaminate")
def decontamination(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                             table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


@query("op6_pii")
def personal_data(spark, sf_dir):
    return pii.report(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op9_toxicity")
def toxic(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   table(spark, sf_dir, "labels")).drop("passages")


@query("op3_byte_bpe")
def byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_texts(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN).drop("text")


@query("op5_embedding_neardup")
def embedding_neardup(spark, sf_dir):
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op1_ngram_join")
def ngram(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_lm_scores")
def lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_texts(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, 50_256)


@query("op12_token_counts")
def token_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(token_counts.VOCABULARY), keep_text=False)


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.link_digests(docs, public_tokenizers.path(align.A_VOCABULARY),
                              public_tokenizers.path(align.B_VOCABULARY), public_tokenizers.PATTERN, keep_text=False)


@query("op11_conversation_repair", repair.ORACLE)
def conversation_repair(spark, sf_dir):
    return repair.digests(table(spark, sf_dir, "conversations"))
