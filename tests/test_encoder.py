"""The encoder hook runs a user model per Arrow batch and feeds k-means."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from sevscope.config import MLConfig
from sevscope.functions.encoder import encoder_udf
from sevscope.operators import clusters, ml


def test_encoder_udf_and_kmeans(spark):
    # defined inside the test so cloudpickle ships it by value to the workers
    def _load():
        import numpy as np

        def encode(texts):
            return np.array([[len(t), t.count("a"), t.count(" ")] for t in texts], dtype=float)
        return encode

    df = spark.createDataFrame([(i, "a" * (i % 7) + " x" * (i % 3)) for i in range(200)],
                               "ticket_id long, full_text string")
    enc = df.withColumn("embedding", encoder_udf(_load, batch_size=16)("full_text"))
    rows = enc.collect()
    assert all(len(r["embedding"]) == 3 for r in rows)
    assert rows[5]["embedding"][1] == 5.0
    enc = enc.withColumn("embedding", F.when(F.col("ticket_id") != 3, F.col("embedding")))
    model = clusters.fit(enc, MLConfig(kmeans_starts=2))
    got = clusters.assign(model, enc).collect()
    assert len(got) == 200 and {r["cluster"] for r in got} == {0, 1, 2, 3, None}
    # every ticket is in the cluster of its nearest centre
    centres = model.centres
    for r in got:
        if r["embedding"] is not None:
            assert r["cluster"] == int(((centres - np.array(r["embedding"])) ** 2).sum(axis=1).argmin())


def test_clusters_of_words_in_any_script(spark):
    texts = ["größe über naïve", "größe über naïve", "проверка связи", "проверка связи", "システム 障害", "システム 障害",
             "urgent outage", "urgent outage"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "ticket_id long, full_text string")
    vectors = ml.tfidf_vectors(df, cfg=MLConfig(num_features=1 << 12)).collect()
    assert sorted({r["n_tokens"] for r in vectors}) == [2, 3]
    model = clusters.fit(df, MLConfig(num_features=1 << 12))
    path = tempfile.mkdtemp() + "/m"
    model.save(spark, path)
    got = clusters.assign(clusters.ClusterModel.load(spark, path), df).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r["full_text"], set()).add(r["cluster"])
    assert all(len(c) == 1 for c in by_text.values())
    assert len({c for s in by_text.values() for c in s}) == 4
