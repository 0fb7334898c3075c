"""Line dedup by site-relative frequency (DataFrame functions only).

A line is boilerplate on a site when the pages of the site that hold it, over
all pages of the site, exceed a ratio. Pages are counted once per line however
often they repeat it. Lines are compared without leading and trailing spaces;
blank lines are neither counted nor dropped.

Only 64-bit line keys are shuffled for the counts (pre-aggregated before the
exchange, so a line that a third of all pages hold is one row per task). The
text moves once, to meet its own list of boilerplate keys by document id.

Defined results: a null text stays null with 0 lines; an empty text has one
blank line; a null site is a site of its own; rows that repeat count as pages
of their own; a page left without lines has the empty text. All other columns
are returned unchanged, working columns carry a ``__ld_`` prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevscope.llm.common import broadcast_if_small, keeping_columns
from sevscope.session import stage

RATIO = 0.1
MIN_PAGES = 3


def _site(host: str) -> Column:
    return F.xxhash64(F.col(host).cast("string"), F.col(host).isNull())


def _line_key(host: str, line: Column) -> Column:
    return F.xxhash64(F.col(host).cast("string"), F.col(host).isNull(), F.trim(line))


def _page_lines(docs: DataFrame, text: str, host: str, *keep: Column) -> DataFrame:
    """One row for each distinct non-blank line key of each page."""
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != "")
    keys = F.array_distinct(F.transform(lines, lambda x: _line_key(host, x)))
    return docs.select(*keep, _site(host).alias("__ld_site"), F.explode(keys).alias("__ld_line"))


def boilerplate_lines(docs: DataFrame, text: str = "text", host: str = "source",
                      ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line, pages, site_pages) of every line key over the ratio."""
    pages = stage(docs.groupBy(_site(host).alias("site")).agg(F.count("*").alias("site_pages")),
                  "ld_sites")
    counts = (_page_lines(docs, text, host).groupBy("__ld_site", "__ld_line")
              .agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
              .select(F.col("__ld_site").alias("site"), F.col("__ld_line").alias("line"), "pages"))
    return counts.join(broadcast_if_small(pages), "site").where(
        F.col("pages") > F.lit(float(ratio)) * F.col("site_pages"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
               ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and the columns
    ``n_lines`` (lines before) and ``n_dropped`` (existing columns of these
    two names are replaced)."""
    boiler = stage(boilerplate_lines(docs, text, host, ratio, min_pages).select(
        F.col("line").alias("__ld_line")), "ld_boiler")
    drops = (_page_lines(docs, text, host, F.col(key).alias("__ld_key"))
             .join(broadcast_if_small(boiler), "__ld_line", "left_semi")
             .groupBy("__ld_key", "__ld_site").agg(F.collect_set("__ld_line").alias("__ld_drop")))
    drops = drops.withColumnRenamed("__ld_site", "__ld_at")
    held = docs.withColumn("__ld_site", _site(host)).join(
        drops, F.col(key).eqNullSafe(F.col("__ld_key")) & (F.col("__ld_site") == F.col("__ld_at")),
        "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x: (F.trim(x) == "")
                    | ~F.array_contains("__ld_drop", _line_key(host, x)))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_dropped = F.when(F.col("__ld_drop").isNull() | F.col(text).isNull(), 0).otherwise(
        F.size(lines) - F.size(kept)).cast("long")
    new_text = F.when(F.col("__ld_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return held.select(*[new_text.alias(c) if c == text else F.col(c) for c in rest],
                       n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def drop_boilerplate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (same columns, also where they are named like results) without
    the boilerplate lines of their hosts; every row stays."""
    return keeping_columns(docs, ("n_lines", "n_dropped"), lambda d: line_dedup(d, **options))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
boiler AS (
  SELECT source, trim(line) AS line FROM l WHERE trim(line) <> ''
  GROUP BY 1, 2
  HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) >
    {RATIO} * (SELECT count(*) FROM documents d WHERE d.source IS NOT DISTINCT FROM l.source)),
marked AS (
  SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN boiler b
  ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.line),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS new_text,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM marked GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.new_text, '') END AS text,
       d.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
