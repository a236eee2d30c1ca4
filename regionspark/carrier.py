"""Annotated and predicted regions derived from `documents` by rules that Spark and SQL share, for the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import split_at

GT_SQL = r"""
parts AS (
  SELECT doc_id, i, trim(string_split_regex(text, '[.\n]')[i]) AS raw
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split_regex(text, '[.\n]')) + 1)) AS i)
), gt AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ix, raw, regexp_replace(lower(raw), '\s+', '', 'g') AS norm
  FROM parts WHERE raw <> ''
)"""

PRED_SQL = GT_SQL + r""", planned AS (
  SELECT doc_id, ix, raw, doc_id * 31 + ix AS k, lead(raw) OVER (PARTITION BY doc_id ORDER BY ix) AS nxt FROM gt
), ops AS (
  SELECT *, CASE WHEN k % 13 = 3 THEN 'drop' WHEN k % 7 = 2 THEN 'sub' WHEN k % 11 = 5 THEN 'split' WHEN k % 17 = 1 AND nxt IS NOT NULL THEN 'merge' ELSE 'copy' END AS op FROM planned
), kept AS (
  SELECT * FROM (SELECT *, lag(op) OVER (PARTITION BY doc_id ORDER BY ix) AS before FROM ops) WHERE coalesce(before, '') <> 'merge' AND op <> 'drop'
), emitted AS (
  SELECT doc_id, ix * 2 AS o, CASE op WHEN 'sub' THEN replace(raw, 'th', 't') WHEN 'split' THEN left(raw, length(raw) // 2) WHEN 'merge' THEN raw || ' ' || nxt ELSE raw END AS raw FROM kept
  UNION ALL SELECT doc_id, ix * 2 + 1, substr(raw, length(raw) // 2 + 1) FROM kept WHERE op = 'split'
), pred AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS ix, trim(raw) AS raw, regexp_replace(lower(raw), '\s+', '', 'g') AS norm FROM emitted WHERE doc_id % 9 <> 4
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _norm(c: F.Column) -> F.Column:
    return F.regexp_replace(F.lower(c), r"\s+", "")


def _sentences() -> F.Column:
    """The sentences of a text, of any length. Arrays number themselves, so nothing is shuffled."""
    return F.filter(F.transform(split_at(F.col("text"), "\n."), lambda x: F.trim(x)), lambda x: x != "")


def _numbered(lists: DataFrame, elements: F.Column) -> DataFrame:
    """(source_file, ix, raw, norm) of the elements of a list.

    `elements` is an expression over the columns of `lists`, not one of them: of a column that is exploded Spark asks first
    whether it has elements, which puts its whole expression, and with it all that its lambdas read, into a filter.
    """
    rows = lists.select("source_file", F.posexplode(elements).alias("ix", "raw"))
    return rows.select("source_file", F.col("ix").cast("long").alias("ix"), "raw", _norm(F.col("raw")).alias("norm"))


def gt_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, ix, raw, norm): the sentences of all documents, of any length."""
    return _numbered(documents(spark, sf_dir).select(F.col("doc_id").alias("source_file"), "text"), _sentences())


def pred_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions made from the same sentences by dropping, changing, splitting and merging; every ninth file has none."""
    file, all_ = F.col("source_file"), F.col("regions")

    def pieces(raw: F.Column, i: F.Column) -> F.Column:
        """What a region becomes; a region after a merged one has gone into it."""
        k, following = file * 31 + i, F.get(all_, i + 1)
        plain = lambda n: (n % 13 != 3) & (n % 7 != 2) & (n % 11 != 5)
        gone = (k % 13 == 3) | ((i > 0) & plain(k - 1) & ((k - 1) % 17 == 1))
        half = F.floor(F.length(raw) / 2).cast("int")
        halves = F.array(F.substring(raw, F.lit(1), half), F.substring(raw, half + 1, F.length(raw)))
        merge = (k % 17 == 1) & following.isNotNull()
        kept = F.when(k % 7 == 2, F.array(F.replace(raw, F.lit("th"), F.lit("t")))).when(k % 11 == 5, halves)
        kept = kept.when(merge, F.array(F.concat_ws(" ", raw, following))).otherwise(F.array(raw))
        return F.when(gone, F.array().cast("array<string>")).otherwise(kept)

    made = F.transform(F.flatten(F.transform("regions", pieces)), lambda x: F.trim(x))
    docs = documents(spark, sf_dir).where("doc_id % 9 <> 4")
    return _numbered(docs.select(F.col("doc_id").alias("source_file"), _sentences().alias("regions")), made)
