"""Bucketed exact quantiles equal Spark's percentile, also under heavy ties."""

import pytest
from pyspark.sql import functions as F

from sevscope.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("bucket_rows", [7, 100, 1000])
def test_bucketed_equals_percentile(spark, bucket_rows):
    df = spark.range(0, 5000).select(
        # a third of the rows share one value; the rest spread with ties
        F.when(F.col("id") % 3 == 0, F.lit(7.0))
         .otherwise(F.round(F.sin(F.col("id")) * 50, 2)).alias("x"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 17).alias("y"),
        F.lit(None).cast("double").alias("z"))
    cols = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z")}
    fast = exact_quantiles(df, cols, PROBS)
    slow = exact_quantiles(df, cols, PROBS, small_rows=1, bucket_rows=bucket_rows)
    assert fast == slow
    assert slow["z"] == [None] * len(PROBS)
