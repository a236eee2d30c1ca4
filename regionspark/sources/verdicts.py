"""A store of verdicts by key: every append is a new part, the last writer of a key wins.

A store is a folder of JSON lines, `part=N/` an append, each line {"key": ..., "same": ...}. Caches of other writers are read
too, as a file or a folder: one object {key: verdict}, over as many lines as it likes, or one such object a line. What is no
such JSON counts as empty, as does a store that does not exist.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import drop_stage, write_stage

SCHEMA = "key string, same boolean"
_PART = r"/part=(\d+)/[^/]*$"


def _texts(spark: SparkSession, path: str, whole: bool) -> DataFrame | None:
    """(value, part) of the lines of a store's parts, or the whole texts of other files; None if nothing is there."""
    try:
        found = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=whole)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    file = F.col("_metadata.file_path")
    found = found.where(~file.rlike(_PART) if whole else file.rlike(_PART))
    return found.select("value", F.regexp_extract(file, _PART, 1).cast("long").alias("part"))


def _pairs(text: DataFrame) -> DataFrame:
    """(key, same, part) of texts that are one object {key: verdict}."""
    v = F.try_variant_get(F.try_parse_json("value"), "$", "map<string, boolean>")
    return text.select(F.explode(v).alias("key", "same"), "part")


def load_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(key, same): of each key the verdict that was written last."""
    parts, other = _texts(spark, path, False), _texts(spark, path, True)
    if parts is None or other is None:
        return spark.createDataFrame([], SCHEMA)
    v = F.try_parse_json("value")
    own = parts.select(F.try_variant_get(v, "$.key", "string").alias("key"), F.try_variant_get(v, "$.same", "boolean").alias("same"), "part")
    # A text that is no object as a whole is taken line by line; of what has no part, any could be the last.
    other = other.select("value", F.lit(-1).cast("long").alias("part"))
    lines = other.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)) | F.col("value").rlike(r"\}\s*\n\s*\{"))
    lines = lines.select(F.explode(F.split("value", r"\r?\n")).alias("value"), "part")
    whole = other.where(~F.col("value").rlike(r"\}\s*\n\s*\{"))
    rows = own.unionByName(_pairs(whole)).unionByName(_pairs(lines)).where("key is not null and same is not null")
    return rows.groupBy("key").agg(F.max(F.struct("part", "same")).alias("last")).select("key", "last.same")


def next_part(spark: SparkSession, path: str) -> int:
    """The number after the last part's; files are listed, not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    last = files.agg(F.max(F.regexp_extract("path", _PART, 1).cast("long"))).first()[0]
    return 0 if last is None else last + 1


def append_verdicts(verdicts: DataFrame, path: str) -> int:
    """Add a part with these verdicts (key, same); returns its number. One writer at a time; a part that was not finished is
    overwritten by whoever appends next."""
    number = next_part(verdicts.sparkSession, path)
    verdicts.select("key", "same").write.mode("overwrite").json(f"{path.rstrip('/')}/part={number}")
    return number


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """Replace the store by these verdicts, one of each key. They may come from the store itself: that compacts it."""
    rows = verdicts.where("key is not null and same is not null").groupBy("key").agg(F.max("same").alias("same"))
    rows = write_stage(rows, "verdicts")  # read from the store before it goes
    rows.withColumn("part", F.lit(0)).write.mode("overwrite").partitionBy("part").json(path)
    drop_stage(rows)


def compact_verdicts(spark: SparkSession, path: str) -> None:
    write_verdicts(load_verdicts(spark, path), path)
