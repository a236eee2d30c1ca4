"""Evaluate predicted regions against annotated ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import normalize
from ..operators import align, metrics
from ..stages import write_stage


@dataclass
class Evaluation:
    matches: DataFrame
    items: DataFrame
    summary: DataFrame
    coverage: DataFrame


def exploded(records: DataFrame, settings: Settings) -> DataFrame:
    """(source_file, ix, raw, norm) of records (source_file, regions)."""
    rows = records.select("source_file", F.posexplode("regions").alias("ix", "raw"))
    return rows.select("source_file", F.col("ix").cast("long").alias("ix"), "raw", normalize(F.col("raw"), settings.normalize).alias("norm"))


def coverage(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """gt_files, scored_files and unpredicted_files: files are keys, one row each."""
    marked = gt.select("source_file").join(pred.select(F.col("source_file").alias("_p")), F.col("source_file") == F.col("_p"), "left")
    one = lambda c: F.count_if(c)
    return marked.agg(F.count(F.lit(1)).alias("gt_files"), one(F.col("_p").isNotNull()).alias("scored_files"), one(F.col("_p").isNull()).alias("unpredicted_files"))


def evaluate(gt: DataFrame, pred: DataFrame, settings: Settings = Settings(), judged: DataFrame | None = None) -> Evaluation:
    """gt and pred are records (source_file, regions), one for each file. Files without prediction are not scored."""
    rules, joint = settings.align, "" if settings.normalize.ignore_whitespace else " "
    files = gt.select("source_file").join(pred.select("source_file"), "source_file", "left_semi")
    left = exploded(gt.join(files, "source_file", "left_semi"), settings)
    right = exploded(pred.join(files, "source_file", "left_semi"), settings)
    # Rates read the matches several times; they are made once.
    found = write_stage(align.matches(left, right, rules, settings.normalize.ignore_whitespace, judged, settings.judge.on_failure), "matches")
    items = metrics.per_file(found, left, right, files, rules, joint)
    return Evaluation(found, items, metrics.corpus(items), coverage(gt, pred))
