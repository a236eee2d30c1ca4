"""Tables written once into the folder that all executors share: lineage ends there and every reader sees the same rows."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

RELEASE_AFTER = 2.0  # seconds of written steps
_ran = 0.0


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a local session without either gets one of its own.

    On a cluster without such a folder this raises: no folder of one machine is seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="regionspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool | None:
    """Whether a path is a folder; None if there is nothing."""
    where, fs = _file_system(spark, path)
    return fs.getFileStatus(where).isDirectory() if fs.exists(where) else None


def write_stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once and return it as a scan. The folder goes with drop_stage, or when the driver's JVM ends.

    What steps took, their shuffle files and broadcasts on the executors and their plans on the driver, is released once
    they have run for `RELEASE_AFTER` seconds, and not only when Python and the driver's JVM happen to collect their
    garbage: frames in reference cycles here keep their plans there. Steps that ran for less have little to release.
    """
    global _ran
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    begun = time.monotonic()
    df.write.parquet(path)
    _ran += time.monotonic() - begun
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    del df
    if _ran > RELEASE_AFTER:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Release what nothing refers to any more, shuffle files above all.

    The driver's threads may hold the last job until another has run: after a small job this releases what was before it.
    """
    global _ran
    _ran = 0.0
    gc.collect()
    spark._jvm.java.lang.System.gc()


def drop_stage(*tables: DataFrame | None) -> None:
    """Delete written stages that nothing will read again; other tables and None are left alone."""
    for table in tables:
        path = None if table is None else table.__dict__.get("_written_at")
        if path:
            where, fs = _file_system(table.sparkSession, path)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it (Spark does not tell case apart)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
