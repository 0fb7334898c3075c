"""What keeps the audit's work in proportion to its input: each case holds the
results against the plainer form, and the form of the plan where that counts."""

import re

from pyspark.sql import functions as F

from sevscope.functions import text as tx
from sevscope.operators import prep
from sevscope.sources.tickets import tickets


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scan_finds_what_the_single_searches_find(spark):
    texts = ["urgent: production down, no, no reply", "not-never_not éno noé —no— nó", "snow knows nothing",
             "how to? info... a+b (c) a.b", "", None, "no", "中no without\nnot\tnever", "asap\x00urgent no1 1no no_", "nono no no"]
    low = F.lower("x")
    for crisis, small in ((("urgent", "down", "production down", "asap"), ("how to", "info", "a+b (c)", "a.b", "a.c")),
                          (tuple(f"t{k}" for k in range(70)) + ("urgent", "中"), ())):
        found = tx.scan(low, crisis, small)
        rows = spark.createDataFrame([(t,) for t in texts], "x string").select(
            found["crisis_mask"].alias("mask"), tx.term_mask(low, crisis).alias("mask0"),
            found["low_hits"].alias("low"), (tx.low_hits(low, small) if small else F.lit(0)).alias("low0"),
            tx.scanned_negations(found, low).alias("neg"), tx.negations(low).alias("neg0")).collect()
        assert len(rows) == len(texts)
        assert all((r.mask, r.low, r.neg) == (r.mask0, r.low0, r.neg0) for r in rows), rows


def test_rule_terms_come_from_one_search_of_the_text(spark, small_dir):
    plan = _plan(prep.add_rule_terms(prep.prepare(tickets(spark, small_dir))).select("ticket_id", "rule_score", "crisis_mask"))
    assert "Contains(" not in plan and plan.count("ArrowEvalPython") == 1


def test_texts_join_the_tickets_last(spark, small_dir):
    plan = _plan(tickets(spark, small_dir))
    above = plan[:plan.index("Join LeftOuter", plan.index("Join LeftOuter") + 1)]
    assert "doc_id" in re.findall(r"Join LeftOuter, \(([^\n]*)", above)[0]


def test_vector_length_reads_the_stored_entries_only(spark):
    from pyspark.ml.linalg import Vectors
    from sevscope.operators import ml
    rows = [(0, Vectors.sparse(1 << 30, [3, 1 << 29], [3.0, -4.0])), (1, Vectors.dense([1.0, 2.0, 2.0])), (2, None),
            (3, Vectors.sparse(7, [], []))]
    got = {r.k: r.n for r in spark.createDataFrame(rows, ["k", "v"])
           .select("k", ml.vector_length("v").alias("n")).collect()}
    assert got == {0: 5.0, 1: 3.0, 2: None, 3: 0.0}


def test_files_of_one_task_have_few_rows_and_raw_files_go(spark, small_dir, monkeypatch):
    import __spark_entry__ as E
    from sevscope.plans import queries
    from sevscope.sources import sinks
    made = []
    monkeypatch.setattr(sinks, "MULTI_LINE_ROWS", 100)
    monkeypatch.setitem(queries._PACKED, "maxRecordsPerFile", 100)
    fresh = queries.shared_path
    monkeypatch.setattr(queries, "shared_path", lambda *a: made.append(fresh(*a)) or made[-1])
    df = E.queries()["csv_tickets"](spark, small_dir)
    n = spark.read.parquet(f"{small_dir}/orders.parquet").count()
    assert df.count() == n and len(df.inputFiles()) >= n // 100
    bad = E.queries()["stream_quarantine"](spark, small_dir)
    assert bad.count() == 2 * spark.read.parquet(f"{small_dir}/orders.parquet").where("o_orderkey % 100 = 0").count()
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in made if "/raw/" in p]
    assert len(paths) == 2 and not any(p.getFileSystem(conf).exists(p) for p in paths)


def test_written_tickets_are_packed(spark, small_dir):
    import __spark_entry__ as E
    df = E.queries()["csv_tickets"](spark, small_dir)
    lengths = spark.read.format("binaryFile").load(df.inputFiles()).select("length").collect()
    texts = df.selectExpr("sum(octet_length(ticket_description)) n").first().n
    assert all(f.endswith(".gz") for f in df.inputFiles()) and sum(r.length for r in lengths) < texts / 2


def test_long_rows_are_taken_in_parts():
    import numpy as np
    from sevscope.operators import clusters, partials
    rng = np.random.default_rng(1)
    lens = np.array([0, 3, 500, 0, 1, 40, 0])
    flat = rng.integers(0, 50, lens.sum())
    got = list(partials.parts(flat, lens, 42))
    assert all(len(f) == n.sum() and (len(f) <= 42 or len(n) == 1) for f, n in got)
    assert (np.concatenate([f for f, _ in got]) == flat).all() and (np.concatenate([n for _, n in got]) == lens).all()
    assert not list(partials.parts(flat[:0], lens[:0]))
    weight, table = rng.random(50), clusters.projection(50, 3)
    whole = clusters._projected(flat, lens, weight, table)
    assert np.allclose(clusters.project(flat, lens, weight, table), whole) and clusters.project(flat[:0], lens[:0], weight, table).shape == (0, 256)


def test_lloyd_of_all_starts_equals_each_start_alone(spark):
    import numpy as np
    from sevscope.operators import kmeans
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    vectors = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<float>").repartition(3)
    data = kmeans.blocks(vectors, 5)
    assert data.selectExpr("sum(length(data)) n").first()[0] == x.size * 4      # single precision is kept
    firsts = [x[3 * s:3 * s + 3].astype(np.float64) for s in range(4)]
    together = kmeans.lloyd(data, firsts, 7)
    for first, got in zip(firsts, together):
        c = first
        for _ in range(got.steps):
            at = kmeans.nearest(x.astype(np.float64), c)[0]
            c = np.array([x[at == k].astype(np.float64).mean(axis=0) if (at == k).any() else c[k] for k in range(3)])
        assert np.allclose(got.centres, c) and np.isclose(got.cost, kmeans.nearest(x.astype(np.float64), c)[1].sum())
    data.unpersist()


def test_a_text_is_split_once_for_its_count_and_its_head(spark, small_dir):
    import __spark_entry__ as E
    plan = _plan(E.queries()["truncate_tokens"](spark, small_dir))
    assert len(re.findall(r"\bsplit\(", plan)) == 1
