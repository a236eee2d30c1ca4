"""Scores of predictions as they arrive: new prediction files are evaluated against the annotated documents.

    python -m jobs.score_predictions --annotations documents.parquet --predictions folder --out folder --checkpoint folder \\
        --config jobs/score_predictions.json

Annotations are a table (doc_id, text, lang, source): a document's lines, stripped, without blanks and the empty token, are
its regions. Predictions are a folder of Parquet files (source_file, record_ix, regions) to which files are added. A run
takes the files that the checkpoint does not know, in micro-batches, and ends.

Below the output folder: `items/batch=N`, Parquet by language, one row a file of the batch: counts and rates; `summary`,
Parquet by language: the rates of each language and source over all files so far, from summed counts.

Of several records of a file within a batch the one with the greatest record_ix counts (of equal ones the greater), over
batches the last batch. Predictions without a document are dropped; documents without a prediction are not scored, but
counted in the log. A batch that is run again after a failure overwrites its own folder, and the summary is always made
anew from all items, so a rerun gives the same; a run without new files changes nothing.

`passes` is "exact" (equal texts, by built-in expressions only) or "all" (merges, splits and similar texts too);
`normalize` is "ascii" (white space and case) or "unicode" (NFKC and case folding as well).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from regionspark.config import Settings
from regionspark.functions.text import normalize, normalize_ascii
from regionspark.operators import metrics
from regionspark.plans.evaluate import evaluate
from regionspark.sources.records import last_wins, regions_of_text
from regionspark.stages import drop_stage, write_stage

PREDICTIONS = "source_file long, record_ix long, regions array<string>"
ITEMS = ("gt", "pred", "matched_gt", "matched_pred", "char_errors", "char_length", "token_errors", "token_length", "cer", "wer", "precision", "recall", "f1")


@dataclass(frozen=True)
class Scoring:
    passes: str = "exact"
    normalize: str = "ascii"
    files_per_batch: int = 1000


def score(records: DataFrame, documents: DataFrame, config: Scoring) -> tuple[DataFrame, list[DataFrame]]:
    """Items of one batch: (source_file, lang, source) and the counts and rates of each file that is annotated; and the
    tables that they are read from."""
    newest = records.where("source_file is not null").groupBy("source_file").agg(F.max(F.struct("record_ix", "regions")).alias("row"))
    newest = write_stage(newest.select("source_file", F.coalesce("row.regions", F.array().cast("array<string>")).alias("regions")), "records")
    keys = newest.select(F.col("source_file").alias("_k"))
    own = documents.join(keys, F.col("doc_id") == F.col("_k"), "left_semi")
    own = own.groupBy(F.col("doc_id").alias("source_file")).agg(F.max(F.struct("text", "lang", "source")).alias("row")).select("source_file", "row.*")
    own = own.withColumn("regions", regions_of_text(F.col("text"))).drop("text")
    if config.passes == "exact":
        both = own.withColumnRenamed("regions", "gt").join(newest.withColumnRenamed("regions", "pred"), "source_file")
        items = metrics.exact_per_file(both, normalize_ascii if config.normalize == "ascii" else normalize, "lang", "source")
        return items.select("source_file", "lang", "source", *ITEMS), [newest]
    own = write_stage(own, "annotated")
    known = newest.join(own.select(F.col("source_file").alias("_k")), F.col("source_file") == F.col("_k"), "left_semi")
    result = evaluate(own.select("source_file", "regions"), known, Settings())
    return own.select("source_file", "lang", "source").join(result.items.select("source_file", *ITEMS), "source_file"), [newest, own, result.matches]


def run(spark: SparkSession, annotations: str, predictions: str, out: str, checkpoint: str, config: Scoring = Scoring()) -> dict[str, int]:
    """Score what is new below `predictions`; returns the numbers that are logged."""
    if config.passes not in ("exact", "all") or config.normalize not in ("ascii", "unicode"):
        raise ValueError(f"unknown passes or normalize: {config}")
    documents = spark.read.parquet(annotations).select("doc_id", "text", "lang", "source").where("doc_id is not null")
    counts = {"batches": 0, "records": 0}

    def batch(rows: DataFrame, number: int) -> None:
        counts["batches"] += 1
        counts["records"] += rows.count()
        scored, tables = score(rows, documents, config)
        scored.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/items/batch={number}")
        drop_stage(*tables)

    source = spark.readStream.schema(PREDICTIONS).option("maxFilesPerTrigger", config.files_per_batch).parquet(predictions)
    stream = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    if counts["batches"]:
        summarise(items(spark, out)).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/summary")
    scored = items(spark, out).count()
    counts |= {"scored": scored, "without_prediction": documents.select("doc_id").distinct().count() - scored}
    log.info("read %(records)s new records in %(batches)s batches; %(scored)s files are scored, %(without_prediction)s documents are not", counts)
    return counts


SCHEMA = "source_file long, source string, " + ", ".join(f"{c} {'double' if c in ITEMS[8:] else 'long'}" for c in ITEMS) + ", batch long, lang string"


def items(spark: SparkSession, out: str) -> DataFrame:
    """The items below `out`, one for each file; none before the first batch."""
    try:
        found = spark.read.schema(SCHEMA).parquet(f"{out}/items")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], SCHEMA)
    return last_wins(found, "source_file", "batch").drop("batch")


def summarise(rows: DataFrame) -> DataFrame:
    """(lang, source, n_files) and the rates over all files of a language and source."""
    whole = rows
    for name in metrics.COUNTS:
        if name not in rows.columns:
            whole = whole.withColumn(name, F.lit(0).cast("long"))
    out = metrics.corpus(whole, "lang", "source")
    return out.select("lang", "source", F.col("count").alias("n_files"), *ITEMS)


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """Items and summary in one table; `level` is "file" or "source"."""
    files = items(spark, out).withColumns({"level": F.lit("file"), "n_files": F.lit(1).cast("long")})
    total = spark.read.parquet(f"{out}/summary").withColumns({"level": F.lit("source"), "source_file": F.lit(None).cast("long")})
    return files.unionByName(total)


if __name__ == "__main__":
    command_line(
        "scores of new predictions", Scoring,
        {"annotations": "Parquet: doc_id, text, lang, source", "predictions": f"folder of Parquet files: {PREDICTIONS}", "out": "output folder", "checkpoint": "the stream's checkpoint"},
        run,
    )
