"""Staging a frame in the shared folder: same rows, lineage cut to a scan."""

from pyspark.sql import functions as F

from sevscope.session import Scope, release, stage, staged_tables


def test_stage_keeps_rows_and_cuts_lineage(spark, small_dir):
    orders = spark.read.parquet(f"{small_dir}/orders.parquet")
    df = (orders.groupBy((F.col("o_orderkey") % 7).alias("k"))
                .agg(F.count(F.lit(1)).alias("n")))
    staged = stage(df, "test")
    assert sorted(staged.collect()) == sorted(df.collect())
    plan = staged._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Relation" in plan
    root = spark.sparkContext.getCheckpointDir()
    assert staged.inputFiles() and all(root.rstrip("/").split(":")[-1] in f
                                        for f in staged.inputFiles())


def test_a_scope_keeps_what_its_result_reads(spark, small_dir):
    before = set(staged_tables(spark))
    with Scope(spark) as own:
        a, b = (stage(spark.range(k), name) for k, name in ((5, "a"), (7, "b")))
        with Scope(spark) as inner:
            c, d = stage(spark.range(3), "c"), stage(spark.range(4), "d")
            kept = inner.result(c.union(a))
        assert len(set(staged_tables(spark)) - before) == 3      # d is gone, c belongs to the outer scope
        out = own.result(kept.join(a, "id"))
    left = set(staged_tables(spark)) - before
    assert len(left) == 2 and all("/b/" not in path and "/d/" not in path for path in left)
    assert out.count() == 8
    release(a, b, None, spark.range(1))
    assert all("/c/" in path for path in set(staged_tables(spark)) - before)
    release(c, d)
    assert set(staged_tables(spark)) == before


def test_a_failed_scope_leaves_nothing(spark):
    before = staged_tables(spark)
    try:
        with Scope(spark):
            stage(spark.range(3), "x")
            raise KeyError
    except KeyError:
        pass
    assert staged_tables(spark) == before


def test_queries_leave_only_what_their_results_read(spark, small_dir):
    from sevscope.plans.queries import REGISTRY
    for name in ("fuse_documented", "stratified_split", "signal_summary"):
        before = set(staged_tables(spark))
        df = REGISTRY[name](spark, small_dir)
        read = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        left = {path.rsplit("/", 1)[-1] for path in set(staged_tables(spark)) - before}
        assert left <= read, name
        assert df.count() > 0
