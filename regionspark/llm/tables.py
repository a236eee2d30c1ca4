"""Arrow passes and exact ranks: map_arrow and distributed prefix sums. Written stages are those of regionspark.stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..stages import drop_stage, fresh, release, shared_dir, write_stage

__all__ = ["drop_stage", "fresh", "give_back", "key_of", "kept_schema", "map_arrow", "prefix_sums", "release", "shared_dir", "write_stage"]


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and, where the C library can, its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """df.mapInArrow(work, schema); workers outlive their tasks, so each task gives its freed memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return df.mapInArrow(run, schema)


def kept_schema(df: DataFrame, names: list[str]) -> str:
    """DDL of these columns of `df`."""
    fields = {f.name: f for f in df.schema}
    return ", ".join(f"`{n.replace('`', '``')}` {fields[n].dataType.simpleString()}" for n in names)


def key_of(column: str | Column) -> Column:
    """A never-null string key that tells null from every value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def prefix_sums(df: DataFrame, group: str, order: list[str], weight: str, out: str, rows: int, bucket_rows: int = 512) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows before this one in its group, in a hashed order.

    `rows` is the number of rows of `df`. Groups are dealt over hash buckets of about `bucket_rows` rows, so a group
    that holds most rows is still spread; bucket totals are summed in two levels. `group` must not be null. The order
    is (hash of `order`, `order`): the same for every run. Rows equal in `order` get their places in either order.
    Column names that begin with `_p` or `_t` are taken.
    """
    buckets = max(1, -(-rows // bucket_rows))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    d = df.withColumn("_pb", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("long"))
    totals = d.groupBy(F.col(group).alias("_pg"), F.col("_pb").alias("_pk")).agg(F.sum(weight).alias("_pw"))
    totals = totals.withColumn("_ph", (F.col("_pk") / 256).cast("long"))
    tops = totals.groupBy("_pg", "_ph").agg(F.sum("_pw").alias("_pt"))
    tops = tops.select(
        F.col("_pg").alias("_tg"), F.col("_ph").alias("_th"), running("_pt", Window.partitionBy("_pg").orderBy("_ph")).alias("_tb")
    )
    inner = totals.withColumn("_pi", running("_pw", Window.partitionBy("_pg", "_ph").orderBy("_pk")))
    base = inner.join(tops, (F.col("_pg") == F.col("_tg")) & (F.col("_ph") == F.col("_th")))
    base = base.select("_pg", "_pk", (F.col("_pi") + F.col("_tb")).alias("_p0"))
    own = d.withColumn("_pr", running(weight, Window.partitionBy(group, "_pb").orderBy(*order)))
    joined = own.join(base, (F.col(group) == F.col("_pg")) & (F.col("_pb") == F.col("_pk")))
    return joined.withColumn(out, (F.col("_pr") + F.col("_p0")).cast("long")).drop("_pb", "_pg", "_pk", "_p0", "_pr")
