"""The derived ticket view reads whole tables and whole texts."""

from pyspark.sql import functions as F

from sevscope.sources.tickets import side_counts, tickets


def test_descriptions_are_whole_documents_and_all_are_used(spark, small_dir):
    n_docs, n_vecs = side_counts(spark, small_dir)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    orders = spark.read.parquet(f"{small_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("ticket_id"), "o_custkey")
    t = tickets(spark, small_dir).join(orders, "ticket_id")
    keyed = t.withColumn("doc_id", F.col("ticket_id") % n_docs)
    # unprefixed descriptions (custkey % 6 in 4, 5) are the document text itself
    plain = (keyed.where((F.col("o_custkey") % 6 >= 4) & (F.col("o_custkey") % 19 != 0))
                  .join(docs, "doc_id"))
    assert plain.count() > 0
    assert plain.where(F.col("ticket_description") != F.col("text")).count() == 0
    # the longest description is the longest used document, uncut
    longest = keyed.agg(F.max(F.length("ticket_description"))).first()[0]
    used = docs.join(keyed.select("doc_id").distinct(), "doc_id")
    assert longest >= used.agg(F.max(F.length("text"))).first()[0]
    # orders reach every document and every embedding row
    assert keyed.select("doc_id").distinct().count() == n_docs
    assert t.select(F.col("ticket_id") % n_vecs).distinct().count() == n_vecs
