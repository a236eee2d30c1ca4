"""Two-stage extraction with a user's models: read the lines of each picture, then merge them without losing one.

Engines are hooks (operators.hooks). A second call is made only for the rows that need it: stage 1 where the first reply has
more than `most_blank` blank lines, stage 2 where it leaves lines out. What is still left out is appended line by line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename
from ..operators.hooks import call_rows
from ..operators.lines import LINES, MERGED, cover, missing_ids, needs_retry, number_lines, parsed_replies, reply_lines, reply_merged
from ..stages import drop_stage, write_stage

READ_AGAIN = "The last reading had several empty text fields. Read the whole picture again, without empty fields or blank lines.\n\n"
MERGE_AGAIN = "The last reply left out these line ids: {ids}. Use every line from 1 to {last}.\n\n"


def _called(rows: DataFrame, name: str, make: Callable, columns: list[str], **calls) -> DataFrame:
    """The rows with the parsed `reply` of the engine (a variant) and `error`, as a written table of the reply's text."""
    return write_stage(call_rows(rows, name, make, columns, "reply", "string", **calls), "replies")


def read_pictures(images: DataFrame, make: Callable[[], Callable[[str, str], str]], prompt: str, most_blank: int = 3, name: str = "stage-1", **calls) -> DataFrame:
    """(file_name, img_path, lines, total_lines, error) of images (path); engine(path, prompt) gives a reply.

    A picture whose engine fails, or whose reply is no JSON, is an error row without lines.
    """
    rows = images.select("path", F.lit(prompt).alias("prompt"))
    first = _called(rows, name, make, ["path", "prompt"], **calls)
    texts = parsed_replies(first.select("path", "reply", "error")).withColumn("texts", reply_lines(F.col("v")))
    again = F.col("error").isNull() & F.col("v").isNotNull() & needs_retry(F.col("texts"), most_blank)
    flagged = texts.where(again).select("path", F.lit(READ_AGAIN + prompt).alias("prompt"))
    second = _called(flagged, name, make, ["path", "prompt"], **calls)
    both = texts.where(~F.coalesce(again, F.lit(False))).select("path", "v", "error", "texts")
    redone = parsed_replies(second.select("path", "reply", "error")).withColumn("texts", reply_lines(F.col("v")))
    both = both.unionByName(redone.select("path", "v", "error", "texts"))
    error = F.coalesce("error", F.when(F.col("v").isNull(), F.lit("reply is no JSON")))
    lines = F.when(error.isNull(), number_lines(F.col("texts"))).otherwise(F.array().cast(LINES))
    out = both.select(basename(F.col("path")).alias("file_name"), F.col("path").alias("img_path"), lines.alias("lines"), error.alias("error"))
    out = write_stage(out.withColumn("total_lines", F.size("lines")), "stage-1")
    drop_stage(first, second)
    return out


def merge_lines(stage1: DataFrame, make: Callable[[], Callable[[str, str, str], str]], prompt: str, name: str = "stage-2", **calls) -> DataFrame:
    """(file_name, merged_lines, total_merged_lines, fallback_ids, error) of stage-1 rows; engine(path, prompt, lines as JSON)
    gives a reply. Rows whose engine fails are error rows without merged lines."""
    rows = stage1.select("file_name", F.col("img_path").alias("path"), "lines", F.to_json("lines").alias("data"), F.lit(prompt).alias("prompt"))
    first = _called(rows, name, make, ["path", "prompt", "data"], **calls)
    merged = parsed_replies(first.drop("prompt")).withColumn("merged", reply_merged(F.col("v")))
    ids = missing_ids(F.col("lines"), F.col("merged"))
    again = F.col("error").isNull() & (F.size(ids) > 0)
    last = F.coalesce(F.array_max(F.transform("lines", lambda x: x["line_id"])), F.lit(0)).cast("string")
    text = F.replace(F.replace(F.lit(MERGE_AGAIN + prompt), F.lit("{ids}"), F.array_join(ids, ", ")), F.lit("{last}"), last)
    flagged = merged.where(again).select("file_name", "path", "lines", "data", text.alias("prompt"))
    second = _called(flagged, name, make, ["path", "prompt", "data"], **calls)
    redone = parsed_replies(second.drop("prompt")).withColumn("merged", reply_merged(F.col("v")))
    keep = ["file_name", "lines", "merged", "error"]
    both = merged.where(~F.coalesce(again, F.lit(False))).select(*keep).unionByName(redone.select(*keep))
    ok = F.col("error").isNull()
    whole = F.when(ok, cover(F.col("lines"), F.col("merged"))).otherwise(F.array().cast(MERGED))
    fallback = F.when(ok, missing_ids(F.col("lines"), F.col("merged"))).otherwise(F.array().cast("array<int>"))
    out = both.select("file_name", whole.alias("merged_lines"), F.size(whole).alias("total_merged_lines"), fallback.alias("fallback_ids"), "error")
    out = write_stage(out, "stage-2")
    drop_stage(first, second)
    return out
