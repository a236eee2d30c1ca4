"""Two-stage extraction: reply repair, renumbering, coverage, fallback and simplification."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

SUFFIX, STATUS = " (Manual Revision Needed)", "Manual Revision Needed"
LINES = "array<struct<line_id:int,text:string>>"
MERGED = "array<struct<merged_id:int,original_line_ids:array<int>,merged_text:string>>"


def json_body(reply: Column) -> Column:
    """A reply without fences, from its first opening to its last closing bracket."""
    bare = strip(F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    body = F.regexp_extract(bare, r"(\{[\s\S]*\}|\[[\s\S]*\])", 1)
    return F.when(body != "", body).otherwise(bare)


def repair(text: str) -> str | None:
    """JSON from nearly-JSON: control characters, trailing commas, unclosed strings and brackets; None if hopeless."""
    text = re.sub(r"[\x00-\x1f\x7f]", " ", text)
    text = text[min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=0) :]
    closing, inside, escaped = [], False, False
    for c in text:
        if escaped:
            escaped = False
        elif c == "\\" and inside:
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "{[":
            closing.append("}" if c == "{" else "]")
        elif not inside and c in "}]" and closing:
            closing.pop()
    whole = re.sub(r",\s*$", "", text + '"' * inside) + "".join(reversed(closing))
    for attempt in (text, re.sub(r",(\s*[}\]])", r"\1", whole)):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repaired(body: pd.Series) -> pd.Series:
    return body.map(repair, na_action="ignore")


def parse_reply(reply: Column) -> Column:
    """A variant, null if the reply is beyond repair. Only texts that do not parse as they are are sent to Python."""
    body = json_body(reply)
    good = F.try_parse_json(body)
    return F.coalesce(good, F.try_parse_json(repaired(F.when(good.isNull(), body))))


def parsed_replies(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """The rows with `v`, the reply as a variant, in place of the reply."""
    return rows.withColumn("v", parse_reply(F.col(reply))).drop(reply)


def reply_merged(v: Column) -> Column:
    """Merged lines of {"merged_lines": [...]} or a bare list; ids that are no numbers are left out."""
    items = F.coalesce(F.try_variant_get(v, "$.merged_lines", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    ids = lambda x: F.coalesce(F.try_variant_get(x, "$.original_line_ids", "array<variant>"), F.array().cast("array<variant>"))
    numbers = lambda x: F.filter(F.transform(ids(x), lambda i: F.try_variant_get(i, "$", "int")), lambda i: i.isNotNull())
    kept = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    text = lambda x: F.coalesce(F.try_variant_get(x, "$.merged_text", "string"), F.lit(""))
    return F.transform(kept, lambda x, i: F.struct((i + 1).cast("int").alias("merged_id"), numbers(x).alias("original_line_ids"), text(x).alias("merged_text"))).cast(MERGED)


def reply_lines(v: Column) -> Column:
    """Texts of {"lines": [...]} or a bare list, of strings or of {"text": ...} objects."""
    items = F.coalesce(F.try_variant_get(v, "$.lines", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit("")))


def number_lines(texts: Column) -> Column:
    """Stripped texts without blanks, numbered from 1."""
    kept = F.filter(F.transform(texts, strip), lambda x: x != "")
    return F.transform(kept, lambda x, i: F.struct((i + 1).cast("int").alias("line_id"), x.alias("text"))).cast(LINES)


def blank_count(texts: Column) -> Column:
    return F.size(F.filter(texts, lambda x: strip(x) == ""))


def needs_retry(texts: Column, most: int = 3) -> Column:
    return blank_count(texts) > most


def payloads(stage1: DataFrame, folder: str = "") -> DataFrame:
    """What stage 2 needs: file_name, img_path (carried, else below `folder`) and lines; rows without a name go."""
    path = F.coalesce(F.when(F.col("img_path") != "", F.col("img_path")), F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), F.col("file_name")))
    return stage1.where(F.coalesce("file_name", F.lit("")) != "").select("file_name", path.alias("img_path"), F.transform("lines", lambda x: F.struct(x["line_id"], x["text"])).cast(LINES).alias("lines"))


def missing_ids(lines: Column, merged: Column) -> Column:
    """Line ids that no merged line covers, in order."""
    ids = F.transform(lines, lambda x: x["line_id"])
    covered = F.flatten(F.transform(merged, lambda m: m["original_line_ids"]))
    return F.array_sort(F.array_except(ids, covered))


def cover(lines: Column, merged: Column) -> Column:
    """Merged lines with every uncovered line appended on its own, numbered from 1."""
    by_id = F.map_from_entries(F.transform(lines, lambda x: F.struct(x["line_id"], x["text"])))
    single = F.transform(missing_ids(lines, merged), lambda i: F.struct(F.lit(0).alias("merged_id"), F.array(i).alias("original_line_ids"), F.element_at(by_id, i).alias("merged_text")))
    whole = F.concat(merged, single.cast(MERGED))
    return F.transform(whole, lambda m, i: F.struct((i + 1).cast("int").alias("merged_id"), m["original_line_ids"].alias("original_line_ids"), m["merged_text"].alias("merged_text"))).cast(MERGED)


def consolidate(stage1: DataFrame, replies: DataFrame) -> DataFrame:
    """Stage 2 from recorded replies (file_name, merged_lines): zero omission, and which ids fell back.

    A file without a reply is an error row with no merged lines.
    """
    own = replies.select(F.col("file_name").alias("_f"), F.col("merged_lines").cast(MERGED).alias("_m"))
    both = stage1.join(own, F.col("file_name") == F.col("_f"), "left")
    ok = F.col("_m").isNotNull()
    merged = F.when(ok, cover(F.col("lines"), F.col("_m"))).otherwise(F.array().cast(MERGED))
    fallback = F.when(ok, missing_ids(F.col("lines"), F.col("_m"))).otherwise(F.array().cast("array<int>"))
    return both.select("file_name", merged.alias("merged_lines"), F.size(merged).alias("total_merged_lines"), fallback.alias("fallback_ids"), F.when(~ok, "no reply").alias("error"))


def simplify(stage2: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """(file_name, lines, status), by name: files that fell back are marked in name and status."""
    clean = strip(F.replace(F.col("file_name"), F.lit(SUFFIX), F.lit("")))
    own = stage2.withColumn("_clean", clean)
    mark = F.coalesce(F.col("status") == STATUS, F.lit(False)) if "status" in stage2.columns else F.lit(False)
    if "fallback_ids" in stage2.columns:
        mark = mark | (F.size("fallback_ids") > 0)
    if flagged is not None:
        own = own.join(flagged.select(F.col("file_name").alias("_flag")).distinct(), F.col("_clean") == F.col("_flag"), "left")
        mark = mark | F.col("_flag").isNotNull()
    lines = F.filter(F.transform("merged_lines", lambda m: strip(m["merged_text"])), lambda t: t.isNotNull() & (t != ""))
    out = own.select(F.when(mark, F.concat("_clean", F.lit(SUFFIX))).otherwise(F.col("_clean")).alias("file_name"), lines.alias("lines"), F.when(mark, STATUS).alias("status"))
    return out.orderBy("file_name")


def coverage_share(rows: DataFrame) -> DataFrame:
    """Distinct covered ids over all ids, by variant (columns variant, line_ids, covered_ids)."""
    return rows.groupBy("variant").agg((F.sum(F.size(F.array_intersect("line_ids", "covered_ids"))) / F.sum(F.size("line_ids"))).alias("coverage"))
