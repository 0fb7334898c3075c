"""Corpus pipeline: from raw ``documents`` to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of ``documents``; ``n_chars``
follows the text. ``run`` writes every stage as Parquet in the shared folder
and reads it back, so a lost executor costs at most one stage's files.

1. toxicity: documents that the passage search rejects go. Labels are read
   from ``sf_dir``, without the held-out fold.
2. line_dedup: boilerplate lines of each source go; the rest of the text stays.
3. ngram_join: of every group of near-duplicates the smallest doc_id stays.
4. decontamination: documents with a benchmark passage go.
5. byte_bpe: token counts and digests of the ids and of the decoded bytes.

Rows without a doc_id are kept until their text itself is rejected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sevscope.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from sevscope.llm.common import table
from sevscope.session import stage


def drop_toxic(spark, docs, sf_dir):
    """Columns of ``docs``; null and empty texts stay, repeated rows go or stay
    together; without labels nothing is known to be toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark, docs, sf_dir):
    """Columns of ``docs``; every row stays, null texts stay null, repeated rows
    lose the same lines, and ``n_chars`` (where there is one) follows the text."""
    done = line_dedup.drop_boilerplate(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def drop_near_duplicates(spark, docs, sf_dir):
    """Columns of ``docs``; of tied ids the smallest stays, with all its rows;
    rows without an id or without words stay."""
    return ngram_join.keep_one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Columns of ``docs``; null and empty texts stay; an empty benchmark drops
    nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def encode(spark, docs, sf_dir):
    """Columns of ``docs`` but for the text, with token counts and digests
    (columns of these names are replaced); null texts count as empty."""
    return bpe.digest_texts(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: A learned score and byte-pair merges have no SQL form; the tests hold the
#: pipeline against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
