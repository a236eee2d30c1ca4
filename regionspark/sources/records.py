"""Records in loosely structured JSON: four key dialects, regions, reports, listings and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Input
from ..functions.text import LINE_ENDS, basename, split_at, strip
from ..stages import is_folder

# Suffixes of image inputs.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tiff", "bmp", "pdf")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_ix, record VARIANT) of JSON arrays, single objects, {"items": [...]} and tolerant JSON lines.

    Lines may end in commas; blank lines and lone brackets are skipped; another line that is no JSON raises with its
    file and line number, as does a file without records.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # The parser stops after a first value, so a text whose first line is a value of its own is taken line by line.
    full = F.filter(F.transform(F.split("value", r"\r?\n"), strip), lambda x: x != "")
    by_lines = (F.size(full) > 1) & F.try_parse_json(F.regexp_replace(F.get(full, 0), ",+$", "")).isNotNull()
    parsed = whole.select("path", "value", F.when(~F.coalesce(by_lines, F.lit(False)), F.try_parse_json("value")).alias("v"))
    kind = F.schema_of_variant("v")
    items = F.when(kind.startswith("ARRAY"), F.col("v").cast("array<variant>"))
    items = items.when(F.try_variant_get("v", "$.items", "array<variant>").isNotNull(), F.try_variant_get("v", "$.items", "array<variant>"))
    items = items.when(F.col("v").isNotNull(), F.array("v"))
    numbered = F.transform(F.split("value", r"\r?\n"), lambda x, i: F.struct((i + 1).alias("n"), F.regexp_replace(strip(x), ",+$", "").alias("t")))
    lines = F.filter(numbered, lambda x: ~x["t"].isin("", "[", "]"))
    fail = lambda n: F.raise_error(F.concat(F.col("path"), F.lit(" is neither JSON nor JSON lines: line "), n.cast("string"))).cast("variant")
    by_line = F.transform(lines, lambda x: F.when(F.try_parse_json(x["t"]).isNull(), fail(x["n"])).otherwise(F.try_parse_json(x["t"])))
    none = F.raise_error(F.concat(F.col("path"), F.lit(" has no records"))).cast("array<variant>")
    by_line = F.when(F.size(lines) == 0, none).otherwise(by_line)
    return parsed.select("path", F.posexplode(F.coalesce(items, by_line)).alias("record_ix", "record")).withColumn("record_ix", F.col("record_ix").cast("long"))


def _json_line(line: Column) -> Column:
    return F.regexp_replace(strip(line), ",+$", "")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, record_ix, record VARIANT) of tolerant JSON lines, as read_records takes them, in splits of a file.

    `line` is the number in the whole file, from 1, `record_ix` that of the line before it. A file's lines are counted split
    by split in a scan of their own; only the counts of splits are shuffled, not the lines. Lines end in a line feed, with or
    without a carriage return. A line that is no JSON raises with its file and number, as does a file without records; files
    of no bytes are not seen by Spark's readers.
    """
    nth = F.monotonically_increasing_id()  # rows of a partition in order; a partition may hold several splits
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), _json_line(F.col("value")).alias("t"), nth.alias("nth")
    )
    skipped = F.col("t").isin("", "[", "]")
    splits = lines.groupBy("path", "split").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(~skipped).alias("records"))
    file = Window.partitionBy("path")
    before = F.coalesce(F.sum("n").over(file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("path").alias("_p"), F.col("split").alias("_s"), "first", before.alias("before"), F.sum("records").over(file).alias("records"))
    none = F.when(F.col("records") == 0, F.raise_error(F.concat(F.col("_p"), F.lit(" has no records"))).cast("long")).otherwise(F.col("before"))
    splits = splits.withColumn("before", none)
    met = lines.join(splits, (F.col("path") == F.col("_p")) & (F.col("split") == F.col("_s"))).withColumn("line", F.col("nth") - F.col("first") + F.col("before") + 1)
    fail = F.raise_error(F.concat(F.col("path"), F.lit(" is neither JSON nor JSON lines: line "), F.col("line").cast("string"))).cast("variant")
    kept = met.where(~skipped | (F.col("before") < 0))  # the second never holds; it keeps a file without records from being dropped unseen
    record = F.try_parse_json("t")
    return kept.select("path", "line", (F.col("line") - 1).alias("record_ix"), F.when(record.isNull(), fail).otherwise(record).alias("record"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_ix, record VARIANT): files whose name ends in .jsonl line by line, others as one JSON list, not empty."""
    if path.lower().endswith(".jsonl"):
        return read_json_lines(spark, path).select("path", "record_ix", "record")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    items = F.try_variant_get("v", "$", "array<variant>")
    fail = F.raise_error(F.concat(F.col("path"), F.lit(" is no JSON list with records"))).cast("array<variant>")
    items = F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(fail)
    rows = whole.select("path", F.posexplode(items).alias("record_ix", "record"))
    return rows.withColumn("record_ix", F.col("record_ix").cast("long"))


def present(record: Column, key: str) -> Column:
    return F.try_variant_get(record, f"$.{key}", "variant").isNotNull()


def first_present(record: Column, keys: tuple[str, ...]) -> Column:
    """The variant under the first key that the record has; a JSON null counts as present."""
    found = F.try_variant_get(record, f"$.{keys[-1]}", "variant")
    for key in reversed(keys[:-1]):
        found = F.when(present(record, key), F.try_variant_get(record, f"$.{key}", "variant")).otherwise(found)
    return found


def first_truthy(record: Column, keys: tuple[str, ...]) -> Column:
    """The string under the first key that holds one that is not empty."""
    return F.coalesce(*[F.when(F.try_variant_get(record, f"$.{k}", "string") != "", F.try_variant_get(record, f"$.{k}", "string")) for k in keys])


def clean_regions(lines: Column, empty_token: str) -> Column:
    return F.filter(F.transform(lines, strip), lambda x: (x != "") & (x != F.lit(empty_token)))


def regions_of_text(text: Column, empty_token: str = "<EMPTY>") -> Column:
    """Lines of a string without blanks and the empty token."""
    return F.when(text.isNull() | (text == empty_token), F.array().cast("array<string>")).otherwise(clean_regions(split_at(text, LINE_ENDS), empty_token))


def regions(value: Column, empty_token: str = "<EMPTY>") -> Column:
    """Regions of a variant: a list's elements, a string's lines, nothing for null, else the value itself."""
    items = F.try_variant_get(value, "$", "array<string>")
    text = F.try_variant_get(value, "$", "string")
    listed = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(value.isNull() | F.is_variant_null(value), F.array().cast("array<string>")).when(listed, clean_regions(F.coalesce(items, F.array().cast("array<string>")), empty_token)).otherwise(regions_of_text(text, empty_token))


def last_wins(records: DataFrame, key: str = "source_file", order: str = "record_ix") -> DataFrame:
    """One row for each key: the one with the greatest order. A struct's maximum needs no sort and combines map-side."""
    rest = [c for c in records.columns if c not in (key, order)]
    best = records.groupBy(key).agg(F.max_by(F.struct(order, *rest), F.struct(F.col(order))).alias("_r"))
    return best.select(key, "_r.*")


def load_regions(spark: SparkSession, path: str, rules: Input = Input()) -> DataFrame:
    """(source_file, record_ix, regions): files by basename, the last record of a file wins.

    A record without a file or text key, or with null under its text key, raises.
    """
    records = read_records(spark, path)
    file = F.try_variant_get(first_present(F.col("record"), rules.file_keys), "$", "string")
    text = first_present(F.col("record"), rules.text_keys)
    file = F.when(F.coalesce(file, F.lit("")) == "", F.raise_error(F.lit("record without a file key"))).otherwise(file)
    text_ok = F.when(text.isNull() | F.is_variant_null(text), F.raise_error(F.lit("record without text"))).otherwise(regions(text, rules.empty_token))
    return last_wins(records.select(basename(file).alias("source_file"), "record_ix", text_ok.alias("regions")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, lines) of a JSON list or JSON lines, as the splitter reads them: records without a file are skipped."""
    records = read_records(spark, path)
    file = first_truthy(F.col("record"), ("source_file", "file_name", "image", "filename", "image_path"))
    lines = first_present(F.col("record"), ("claim_text", "lines", "text"))
    return records.select("record_ix", file.alias("file_name"), regions(lines).alias("lines")).where("file_name is not null")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Summary and items of an evaluation report."""
    whole = spark.read.json(path, multiLine=True)
    return whole.select("summary.*"), whole.select(F.inline("items"))


def read_markdown_report(spark: SparkSession, path: str) -> DataFrame:
    """(row_ix, ground_truth, prediction) of two-cell table rows; `<br>` separates lines.

    A row with further cells keeps them in its prediction.
    """
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("rows"))
    follow = F.transform("rows", lambda x, i: F.struct(x.alias("row"), F.coalesce(F.get("rows", i + 1), F.lit("")).alias("next")))
    whole = whole.select(F.posexplode(follow).alias("row_ix", "r")).select("row_ix", "r.row", "r.next")
    rule = r"^\|[\s:|-]*\|\s*$"  # what stands above it is a header
    rows = whole.where(F.col("row").startswith("| ") & ~F.col("row").rlike(rule) & ~F.col("next").rlike(rule))
    cells = F.split(F.regexp_replace("row", r"^\|\s?|\s?\|\s*$", ""), r" \| ", 2)
    lines = lambda c: F.filter(F.transform(F.split(c, r"<br>"), strip), lambda x: x != "")
    rows = rows.select(F.col("row_ix").cast("long").alias("row_ix"), cells.alias("c")).where("size(c) = 2")
    return rows.select("row_ix", lines(F.get("c", 0)).alias("ground_truth"), lines(F.get("c", 1)).alias("prediction"))


def is_image(path: Column) -> Column:
    """Whether a path ends in one of the suffixes, in either case."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def list_images(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(path, file_name) of the image files below a folder, by path and without reading them; `glob` narrows their names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder).select("path")
    return found.where(is_image(F.col("path"))).select("path", basename(F.col("path")).alias("file_name")).orderBy("path")


def resolve_paths(records: DataFrame, listings: list[DataFrame], name: str = "file_name") -> DataFrame:
    """Records with the path of the first listing that has their file; null if none has."""
    paths = []
    for i, listing in enumerate(listings):
        one = listing.groupBy("file_name").agg(F.min("path").alias(f"_p{i}")).withColumnRenamed("file_name", f"_f{i}")
        records = records.join(one, F.col(name) == F.col(f"_f{i}"), "left").drop(f"_f{i}")
        paths.append(f"_p{i}")
    return records.withColumn("path", F.coalesce(*paths)).drop(*paths)


def flagged_files(spark: SparkSession, log: str, marker: str) -> DataFrame:
    """(file_name): what stands in the first brackets of log lines with the marker."""
    lines = spark.read.text(log).where(F.col("value").contains(marker))
    return lines.select(F.regexp_extract("value", r"\[(.*?)\]", 1).alias("file_name")).where("file_name != ''").distinct()


def input_items(inputs: Column) -> Column:
    """The items of an image input: a JSON array's strings, else the input itself."""
    text = strip(inputs)
    listed = F.when(text.startswith("[") & text.endswith("]"), F.try_variant_get(F.try_parse_json(text), "$", "array<string>"))
    return F.coalesce(listed, F.array(inputs))


def images_of(spark: SparkSession, inputs: str | list[str]) -> DataFrame:
    """(item_ix, path, file_name) of one input or several, in order. A string may be a JSON array of inputs.

    Folders give the image files below them at any depth, by suffix; every other item of a list is taken as it is, whatever
    its suffix. A single string is taken if it is a file or an address.
    """
    if isinstance(inputs, str):
        items = spark.createDataFrame([(inputs,)], "input string").select(input_items(F.col("input"))).first()[0]
        alone = items == [inputs]
    else:
        items, alone = inputs, False
    found = spark.createDataFrame([], "item_ix long, path string")
    single = []
    for k, item in enumerate(items):
        kind = None if item.startswith("http") else is_folder(spark, item)
        if kind:
            found = found.unionByName(list_images(spark, item).select(F.lit(k).cast("long").alias("item_ix"), "path"))
        elif not alone or kind is False or item.startswith("http"):
            single.append((k, item))
    found = found.unionByName(spark.createDataFrame(single, "item_ix long, path string"))
    name = basename(F.regexp_replace("path", r"\?.*$", ""))
    return found.select("item_ix", "path", name.alias("file_name")).orderBy("item_ix", "path")


def box_rows_by_line(pages: DataFrame, lines: str = "lines") -> DataFrame:
    """The rows of box_rows from the layout of one entry a line: [polygon, [text, confidence]] as variants, page by page.

    `lines` is a variant: a page's list of entries, or a list of such lists.
    """
    entry = F.try_variant_get(lines, "$", "array<variant>")
    nested = F.try_variant_get(lines, "$", "array<array<variant>>")
    one = F.try_variant_get(lines, "$[0][1][0]", "string").isNotNull()  # the first entry is a line itself
    flat = F.when(one, entry).otherwise(F.flatten(F.filter(nested, lambda x: x.isNotNull())))
    rows = pages.select("page", F.posexplode(flat).alias("box_ix", "l"))
    polygon = F.try_variant_get("l", "$[0]", "array<array<double>>")
    xs, ys = F.transform(polygon, lambda q: q[0]), F.transform(polygon, lambda q: q[1])
    text, score = F.try_variant_get("l", "$[1][0]", "string"), F.try_variant_get("l", "$[1][1]", "double")
    edges = [F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max")]
    return rows.select("page", "box_ix", strip(text).alias("text"), score.alias("confidence"), *edges)


def box_rows(pages: DataFrame, polygons: str = "rec_polys", texts: str = "rec_texts", scores: str = "rec_scores") -> DataFrame:
    """(page, box_ix, text, confidence, x_min, y_min, x_max, y_max) of parallel arrays; the shortest array decides."""
    zipped = F.arrays_zip(F.col(polygons).alias("p"), F.col(texts).alias("t"), F.col(scores).alias("s"))
    n = F.least(F.size(polygons), F.size(texts), F.size(scores))
    boxes = pages.select("page", F.posexplode(F.slice(zipped, F.lit(1), n)).alias("box_ix", "b"))
    xs, ys = F.transform("b.p", lambda q: q[0].cast("double")), F.transform("b.p", lambda q: q[1].cast("double"))
    return boxes.select("page", "box_ix", strip(F.col("b.t")).alias("text"), F.col("b.s").cast("double").alias("confidence"), F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max"))
