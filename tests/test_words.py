"""Words found and hashed by the batch, against the native functions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sevscope.config import MLConfig
from sevscope.functions import words
from sevscope.operators import clusters, fusion, kmeans
from sevscope.session import is_staged, release, stage, staged_tables

N = 1 << 18


def _texts():
    rng = random.Random(3)
    kinds = ((32, 127), (0xA0, 0x800), (0x800, 0xD800), (0xE000, 0x110000), (32, 33), (32, 33))
    odd = ["", None, " ", "a", "__ a_b É٣x y ½ ² Ⅷ 中文字 \U0001F600x\U0001D7D8 éa", "x" * 31, "y" * 32, "z" * 33 + " " + "w" * 100,
           "q" * 70_000 + " r", "a\tb\nc\x0bd\x0ce\rf\u0085g h i", "  lead and trail  ", "İstanbul ẞ ǅ", "w " * 300, "ΑΣ\u0301Σ' ΟΔΟΣ.ΑΣ ΣΣ ΑΣ"]
    return odd + ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(400))) for _ in range(300)]


def test_slots_are_those_of_the_native_functions(spark):
    low = F.lower("t")

    def slots(pattern):
        found = F.filter(F.split(low, pattern), lambda w: w != "")
        return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(N)).cast("int"))

    rows = spark.createDataFrame([(t,) for t in _texts()], "t string").repartition(3).select(
        "t", slots(clusters.WORD_GAP).alias("a"), words.hashed_slots(low, N).alias("a1"), clusters.word_slots(F.col("t"), N).alias("a2"),
        F.slice(slots(r"\s+"), 1, 256).alias("b"), words.hashed_slots(low, N, 256, by_space=True).alias("b1")).collect()
    assert len(rows) == len(_texts())
    for r in rows:
        assert r.a == r.a1 == r.a2 and r.b == r.b1, r.t


@pytest.mark.parametrize("window", [1, 50])
def test_slots_do_not_depend_on_the_batch(spark, window, monkeypatch):
    from sevscope.functions import text
    texts = pa.array([t if t is None or len(t) < 1_000 else t[:40] for t in _texts()])
    whole = words.slots_of_texts(texts, N, words.word_table())
    monkeypatch.setattr(text, "_WINDOW", window)
    apart = words.slots_of_texts(texts.slice(2), N, words.word_table())
    skip = whole[1][:2].sum()
    assert (whole[0][skip:] == apart[0]).all() and (whole[1][2:] == apart[1]).all()
    assert [len(a) for a in words.slots_of_texts(texts[:0], N)] == [0, 0]


def test_staged_vectors_are_small_records_and_nothing_is_cached(spark):
    before = staged_tables(spark)
    vectors = spark.range(5_000).selectExpr("array(cast(id % 7 as double), cast(id % 11 as double)) v")
    data = kmeans.blocks(vectors, 2)
    assert is_staged(data) and not data.storageLevel.useMemory and not data.storageLevel.useDisk
    rows, longest = data.selectExpr("sum(rows)", "max(length(data))").first()
    assert rows == 5_000 and longest <= 2_048
    release(data)
    starts = kmeans.fit(vectors, 2, 3, 2, 20, 1)
    assert len(starts) == 2 and staged_tables(spark) == before


def test_text_vectors_give_the_clusters_of_the_model(spark):
    cfg = MLConfig(num_features=1 << 10, kmeans_starts=2, clusters=3)
    rows = [(k % 40, f"{('red blue', 'one two three', 'été hiver')[k % 3]} w{k % 5}") for k in range(200)] + [(None, "")]
    texts = spark.createDataFrame(rows, "ticket_id long, full_text string")
    found = stage(texts.withColumn("word_slots", clusters.word_slots(F.col("full_text"), cfg.num_features)), "words")
    model, table = clusters.fit_words(found, cfg)
    got = model.assign_vectors(table)
    assert got.columns == ["ticket_id", "full_text", "cluster"] and table.columns == ["ticket_id", "full_text", "h", "data"]
    assert sorted(map(str, got.collect())) == sorted(map(str, clusters.assign(model, texts).collect()))
    release(found, table)


def test_an_audit_of_texts_keeps_no_slots_or_vectors(spark, small_dir):
    from sevscope.sources.tickets import tickets
    before = set(staged_tables(spark))
    fusion.audit(tickets(spark, small_dir).drop("cluster"), ml_cfg=MLConfig(num_features=1 << 12, kmeans_starts=2))
    left = {p.rsplit("/", 2)[-2] for p in set(staged_tables(spark)) - before}
    assert left == {"signals", "rule_histogram", "rule_rank"}


def test_term_frequencies_are_those_of_the_ml_stages(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from sevscope.operators import ml
    texts = [t for t in _texts() if t is not None] + ["no " * 700 + "yes"]
    df = spark.createDataFrame(list(enumerate(texts)), "ticket_id long, t string").repartition(3)
    stages = [RegexTokenizer(inputCol="t", outputCol="w", pattern=clusters.WORD_GAP, toLowercase=True),
              HashingTF(inputCol="w", outputCol="tf", numFeatures=N)]
    want = {r.ticket_id: (r.n, r.tf) for r in PipelineModel(stages).transform(df).select("ticket_id", F.size("w").alias("n"), "tf").collect()}
    made = ml.term_frequencies(df, "t", N)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "MapInArrow" not in plan       # staged
    assert {r.ticket_id: (r.n_tokens, r["__tf"]) for r in made.collect()} == want
    release(made)
