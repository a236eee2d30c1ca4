"""Evaluate prediction files as they arrive: files are independent and counts add up, so each micro-batch is a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..plans.evaluate import evaluate
from ..sources.records import last_wins


def evaluate_stream(predictions: DataFrame, gt: DataFrame, out: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Appends per-file items of each micro-batch of `predictions` (source_file, regions) below `out`.

    A batch that is run again after a failure overwrites its own folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        evaluate(gt, batch, settings).items.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return predictions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_items(spark: SparkSession, out: str) -> DataFrame:
    """The items below `out`, one for each file: a file that came in several micro-batches counts as its last one says."""
    return last_wins(spark.read.parquet(out), "source_file", "batch").drop("batch")
