"""Writers: reports, claims, statistics, manifests and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_report(summary: DataFrame, items: DataFrame, folder: str) -> None:
    """Summary and items as JSON folders; items stay distributed."""
    summary.write.mode("overwrite").json(f"{folder}/summary")
    items.write.mode("overwrite").json(f"{folder}/items")


def write_claims(claims: DataFrame, folder: str) -> None:
    """{source_file, claim_text} records."""
    claims.select("source_file", "claim_text").write.mode("overwrite").json(folder)


def append_stats(stats: DataFrame, folder: str) -> None:
    stats.write.mode("append").json(folder)


def write_manifests(split: DataFrame, folder: str) -> None:
    split.write.mode("overwrite").partitionBy("split").json(folder)


def markdown_row(ground_truth: Column, prediction: Column) -> Column:
    """A two-cell table row; line breaks become `<br>`."""
    cell = lambda c: F.replace(c, F.lit("\n"), F.lit("<br>"))
    return F.format_string("| %s | %s |", cell(ground_truth), cell(prediction))


def write_markdown(rows: DataFrame, folder: str) -> None:
    """A header and a table for each sample: columns image, ground_truth, prediction, duration."""
    text = F.concat(F.format_string("### %s (%.2f s)\n\n| ground truth | prediction |\n| --- | --- |\n", F.col("image"), F.col("duration")), markdown_row(F.col("ground_truth"), F.col("prediction")), F.lit("\n"))
    rows.orderBy("image").select(text.alias("value")).write.mode("overwrite").text(folder)


def first_records(frame: DataFrame, order: str, n: int, folder: str) -> None:
    frame.orderBy(order).limit(n).write.mode("overwrite").json(folder)


def write_stage_lines(stage: DataFrame, folder: str) -> None:
    """Stage-1 or stage-2 records as JSON lines, with whatever columns the stage has; nulls stay as keys."""
    stage.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_simplified(simplified: DataFrame, folder: str) -> None:
    """{file_name, lines, status} records by file name; each file of the folder holds a range of names."""
    simplified.repartitionByRange("file_name").sortWithinPartitions("file_name").write.mode("overwrite").json(folder)
