"""The pipeline's stages against brute force on a small corpus."""

import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from sevscope.llm import bpe, decontaminate

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(2000)]
    item = " ".join(rng.choices(words, k=14))
    docs, labels = [], []
    for k in range(200):
        text = rng.choices(words, k=rng.randint(30, 80))
        if k % 10 == 3:
            text.insert(4, "horridness")
            text.insert(20, "horridness")
        if k % 20 == 5:
            text[10:10] = item.split()
        body = " ".join(text)
        docs.append((k, f"menu line here\n{body}", "en", "s", None))
        labels.append((k, 1, int(k % 10 == 3)))
    docs += [(200 + k, docs[k][1].replace("w1 ", "w1  "), "en", "s", None) for k in range(0, 40, 2)]
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0)]
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, TABLE).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, {d[0]: d[1] for d in docs}, item


def test_stages(spark, tables):
    place, texts, item = tables
    docs, seen = spark.read.parquet(f"{place}/documents.parquet"), []
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(apply(spark, docs, place).collect(), TABLE)
        assert docs.columns == columns, name
        seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic = {k for k in texts if "horridness" in (texts[k] or "")}
    assert set(seen[0]) == set(texts) - toxic
    bare = {k: t and t.replace("menu line here\n", "") for k, t in texts.items() if k not in toxic}
    assert seen[1] == bare
    copies = {k for k in bare if 200 <= k < 300 and k - 200 in bare}
    assert set(seen[2]) == set(bare) - copies
    leaked = {k for k in seen[2] if decontaminate.brute_force((bare[k] or "").encode(), [(1, item.encode())])[1]}
    assert leaked and set(seen[3]) == set(seen[2]) - leaked
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, place).collect()}
    assert out == {k: len(lib.encode_ordinary(t or "")) for k, t in seen[3].items()}


def test_stages_on_an_empty_table(spark, tables):
    place = tables[0]
    docs = spark.createDataFrame([], TABLE)
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, docs, place).collect() == []


@pytest.mark.parametrize("stage", range(4))
def test_a_stage_keeps_columns_named_like_results(spark, tables, stage):
    place, texts, _ = tables
    names = ["n_lines", "n_dropped", "n_words", "n_hit", "hit_runs", "hit_items", "pii", "score", "predicted", "held_out",
             "passages", "n_shingles", "component_id", "code", "token", "line", "word", "site", "part", "n"]
    rows = [(k, texts[k], "en", None if k % 3 else "s", None, *range(k, k + len(names))) for k in sorted(texts)[:60:3]]
    rows += [rows[0], (None, None, None, None, None, *range(len(names)))]
    docs = spark.createDataFrame(rows, TABLE + "".join(f", {n} long" for n in names))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, place)
    assert out.columns == docs.columns
    kept = {r[0]: tuple(r[5:]) for r in out.collect()}
    assert kept and all(kept[r[0]] == tuple(r[5:]) for r in rows if r[0] in kept)
    assert None in kept or not stage      # the first stage judges any text by its score


def test_redaction_and_span_cuts_keep_columns_named_like_results(spark):
    from sevscope.llm import pii
    docs = spark.createDataFrame([(1, "mail a@b.org now", 7, 8)], "doc_id long, text string, pii long, n_words long")
    assert tuple(pii.redact(docs).first())[2:] == (7, 8)
    bench = spark.createDataFrame([(1, "mail a")], "item_id long, text string")
    assert tuple(decontaminate.decontaminate(docs, bench, mode="spans").first()) [2:] == (7, 8)


def test_components_over_exchanges_equal_one_task(spark, monkeypatch):
    from sevscope.llm import common
    edges = spark.createDataFrame([(k, k * 7 % 50) for k in range(60)] + [(3, 3), (None, 1)], "a long, b long")
    one = sorted(map(tuple, common.connected_components(edges, "a", "b").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, common.connected_components(edges, "a", "b").collect())) == one
