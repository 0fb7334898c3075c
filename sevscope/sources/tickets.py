"""The ``tickets`` view derived from the driver tables.

The driver tables carry no support-ticket text, so the ticket columns are
derived from ``orders`` by key (see FIXTURES.md §6). One ticket per order; the
work grows with ``orders``. Every document and every embedding row is used:
an order takes the whole text of document ``o_orderkey % (document count)``
and the label of embedding ``o_orderkey % (embedding count)``, so the side
tables are read whole. They grow with the data, so no broadcast is forced:
AQE broadcasts a side only when its runtime size is under the threshold and
otherwise joins by shuffle (uniform keys, no hot key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES of the derived view (FIXTURES.md §6).
SUBJECTS = (
    "URGENT: system failure",
    "Question about info page",
    "Production down, escalate ASAP",
    "Minor, no rush",
    "Cannot access account",
    "How to export without login",
    "Data loss after outage",
)
DESCRIPTION_PREFIXES = (
    "Login is broken and not working. ",
    "Just wondering, curious. ",
    "It has never, never worked; no reply. ",
    "Severe breach, blocked immediately. ",
)
CHANNELS = ("email", "chat", "phone", "social media")
PRIORITY_BY_ORDER = {"1-URGENT": "Critical", "2-HIGH": " high ",
                     "3-MEDIUM": "MEDIUM", "5-LOW": "low"}
CLUSTERS = 4

TICKET_COLUMNS = ("ticket_id", "ticket_subject", "ticket_description",
                  "ticket_channel", "ticket_type", "ticket_priority",
                  "resolution_time_hours", "cluster")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cores only when the scan yields fewer
    splits than cores (a small single-row-group file). A large input is
    already split by the file reader, so there this adds no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def _by_mod(key: Column, mod: int, values, default: Column) -> Column:
    """CASE key % mod WHEN i THEN values[i] ... ELSE default."""
    m = key % mod
    expr = None
    for i, v in enumerate(values):
        cond = m == i
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(default)


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderpriority")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ticket table: one row per order, the columns of FIXTURES.md §6."""
    o = spread(read_table(spark, sf_dir, "orders").select(*ORDER_COLUMNS))
    return derive_tickets(spark, sf_dir, o)


def ticket_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The same tickets as a stream: ``orders`` read by the file stream source,
    the side tables joined as static data (stream-static joins)."""
    base = sf_dir.rstrip("/")
    batch = spark.read.parquet(f"{base}/orders.parquet")
    # the file source watches a directory; the glob keeps it to the orders files
    reader = spark.readStream.schema(batch.schema).option("pathGlobFilter", "orders*.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    o = reader.parquet(base).select(*ORDER_COLUMNS)
    # Same rule as ``spread``: planning the batch scan of the files present
    # lists them and computes their splits without reading data. Few splits
    # (a small single-row-group file) would leave a micro-batch on one core,
    # so only then the stream is spread round-robin; many or large files are
    # split by the reader and get no extra shuffle.
    cores = spark.sparkContext.defaultParallelism
    if batch.rdd.getNumPartitions() < cores:
        o = o.repartition(cores)
    return derive_tickets(spark, sf_dir, o)


def _key_mod(key: Column, n: int) -> Column:
    """``key % n``; NULL (no match) for an empty side table."""
    return key % F.lit(n) if n > 0 else F.lit(None).cast("long")


def side_counts(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Row counts of ``documents`` and ``embeddings`` (answered from the
    Parquet footers; no column is read)."""
    return (read_table(spark, sf_dir, "documents").count(),
            read_table(spark, sf_dir, "embeddings").count())


def derive_tickets(spark: SparkSession, sf_dir: str, o: DataFrame) -> DataFrame:
    """Ticket columns derived from an orders frame (batch or stream)."""
    n_docs, n_vecs = side_counts(spark, sf_dir)
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey"), F.col("c_mktsegment"))
    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.col("text").alias("doc_text"))
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")

    # the texts come last, so that no later shuffle carries a text per ticket
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(e, _key_mod(o.o_orderkey, n_vecs) == e.vec_id, "left")
          .join(d, _key_mod(o.o_orderkey, n_docs) == d.doc_id, "left"))

    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    subject = F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(
        _by_mod(k, 8, [F.lit(s) for s in SUBJECTS],
                F.concat(F.lit("Order "), k.cast("string"))))
    head = F.col("doc_text")
    description = F.when(ck % 19 == 0, F.lit(None).cast("string")).otherwise(
        _by_mod(ck, 6, [F.concat(F.lit(p), head) for p in DESCRIPTION_PREFIXES], head))
    channel = F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(
        _by_mod(k, 4, [F.lit(ch) for ch in CHANNELS], F.lit(None)))
    prio = F.col("o_orderpriority")
    priority = None
    for raw, mapped in PRIORITY_BY_ORDER.items():
        priority = (F.when(prio == raw, mapped) if priority is None
                    else priority.when(prio == raw, mapped))
    resolution = (
        F.when(k % 29 == 0, F.lit(None).cast("string"))
        .when(k % 31 == 0, F.lit("pending"))
        .when(ck % 3 == 0, F.concat((F.lit(1) + ck % 9).cast("string"), F.lit(" days")))
        .when(ck % 3 == 1, F.concat((k % 97).cast("string"), F.lit(".5 Hours")))
        .otherwise((k % 97).cast("string")))

    return j.select(
        k.alias("ticket_id"),
        subject.alias("ticket_subject"),
        description.alias("ticket_description"),
        channel.alias("ticket_channel"),
        F.col("c_mktsegment").alias("ticket_type"),
        priority.alias("ticket_priority"),
        resolution.alias("resolution_time_hours"),
        (F.col("label") % CLUSTERS).alias("cluster"),
    )


def with_vectors(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Attach each ticket's text vector (``embedding``, 64 floats) with the
    same key rule as the ``cluster`` column. The whole vector table is read;
    AQE picks a broadcast or a shuffle join by its runtime size."""
    _, n_vecs = side_counts(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return (df.join(e, _key_mod(F.col("ticket_id"), n_vecs) == e.vec_id, "left")
              .drop("vec_id"))


# The same view as SQL text, runnable unchanged in Spark and DuckDB; used as the
# first CTE of every oracle query.
TICKETS_SQL = """
SELECT o.o_orderkey AS ticket_id,
 CASE WHEN o.o_orderkey % 17 = 0 THEN NULL
      WHEN o.o_orderkey % 8 = 0 THEN 'URGENT: system failure'
      WHEN o.o_orderkey % 8 = 1 THEN 'Question about info page'
      WHEN o.o_orderkey % 8 = 2 THEN 'Production down, escalate ASAP'
      WHEN o.o_orderkey % 8 = 3 THEN 'Minor, no rush'
      WHEN o.o_orderkey % 8 = 4 THEN 'Cannot access account'
      WHEN o.o_orderkey % 8 = 5 THEN 'How to export without login'
      WHEN o.o_orderkey % 8 = 6 THEN 'Data loss after outage'
      ELSE 'Order ' || CAST(o.o_orderkey AS VARCHAR(20)) END AS ticket_subject,
 CASE WHEN o.o_custkey % 19 = 0 THEN NULL
      WHEN o.o_custkey % 6 = 0 THEN 'Login is broken and not working. ' || d.text
      WHEN o.o_custkey % 6 = 1 THEN 'Just wondering, curious. ' || d.text
      WHEN o.o_custkey % 6 = 2 THEN 'It has never, never worked; no reply. ' || d.text
      WHEN o.o_custkey % 6 = 3 THEN 'Severe breach, blocked immediately. ' || d.text
      ELSE d.text END AS ticket_description,
 CASE WHEN o.o_orderkey % 23 = 0 THEN NULL
      WHEN o.o_orderkey % 4 = 0 THEN 'email' WHEN o.o_orderkey % 4 = 1 THEN 'chat'
      WHEN o.o_orderkey % 4 = 2 THEN 'phone' ELSE 'social media' END AS ticket_channel,
 c.c_mktsegment AS ticket_type,
 CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN ' high '
      WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'low' ELSE NULL END AS ticket_priority,
 CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
      WHEN o.o_orderkey % 31 = 0 THEN 'pending'
      WHEN o.o_custkey % 3 = 0 THEN CAST(1 + o.o_custkey % 9 AS VARCHAR(20)) || ' days'
      WHEN o.o_custkey % 3 = 1 THEN CAST(o.o_orderkey % 97 AS VARCHAR(20)) || '.5 Hours'
      ELSE CAST(o.o_orderkey % 97 AS VARCHAR(20)) END AS resolution_time_hours,
 e.label % 4 AS cluster
FROM orders o
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
LEFT JOIN embeddings e ON e.vec_id = o.o_orderkey % (SELECT count(*) FROM embeddings)
"""
