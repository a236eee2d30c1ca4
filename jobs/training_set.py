"""Training set: documents and their labels become chat records, split into exact shares of test, eval and train.

    python -m jobs.training_set --documents documents.parquet --labels labels.parquet --out folder --config jobs/training_set.json

Below the output folder: `records`, Parquet by split and language, one row a document (doc_id, source, n_lines, images,
messages); `rejected`, Parquet by reason (doc_id, source); `report`, JSON rows (split, lang, n, n_lines).

A document without an id is rejected ("no key"), as is one whose label says so ("quality", "toxic"); of rows with one id the
greatest stays, so the result does not depend on the order of files. Lines are stripped and blank ones dropped; a document
without lines has the empty token as its answer, as an empty picture has. Sizes of the split are exact; its order is a
hash of the id by the seed, so membership is the same for every run, partitioning and cluster.

The texts are shuffled once, by id, and cleaned once into a table in the shared folder; the split counts ranges of the
order there and ranks only the rows at its two borders. Every run replaces the whole output, so a rerun gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from regionspark.functions.text import LINE_ENDS, split_at
from regionspark.operators.dataset import chat_records, clean_lines, exact_split
from regionspark.stages import drop_stage, write_stage

MODULUS = 1_000_003


@dataclass(frozen=True)
class TrainingSet:
    val_ratio: float = 0.1
    test_ratio: float = 0.1
    seed: int = 7919
    reject_quality: tuple[int, ...] = (0,)
    reject_toxic: tuple[int, ...] = (1,)
    root: str = "images"
    suffix: str = ".png"
    prompt: str = "Read all text of the picture, line by line."


def checked(documents: DataFrame, labels: DataFrame, config: TrainingSet) -> DataFrame:
    """(doc_id, lang, source, lines, reason): one row an id, and what rules it out; rows without an id all stay, ruled out."""
    said = labels.groupBy("doc_id").agg(F.collect_set("quality").alias("q"), F.collect_set("toxic").alias("t"))
    docs = documents.select("doc_id", "lang", "source", "text")
    one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("text", "lang", "source")).alias("row"))
    one = one.select("doc_id", "row.*").join(said.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"), "left")
    among = lambda c, values: F.coalesce(F.exists(c, lambda x: x.isin(*values)), F.lit(False)) if values else F.lit(False)
    reason = F.when(among("q", config.reject_quality), "quality").when(among("t", config.reject_toxic), "toxic")
    lines = clean_lines(split_at(F.coalesce("text", F.lit("")), LINE_ENDS))
    kept = one.select("doc_id", "lang", "source", lines.alias("lines"), reason.alias("reason"))
    none = F.array().cast("array<string>")
    return kept.unionByName(docs.where("doc_id is null").select("doc_id", "lang", "source", none.alias("lines"), F.lit("no key").alias("reason")))


def build(spark: SparkSession, documents: str, labels: str, out: str, config: TrainingSet = TrainingSet()) -> dict[str, int]:
    """Write the training set below `out`; returns the numbers that are logged."""
    rows = write_stage(checked(spark.read.parquet(documents), spark.read.parquet(labels), config), "checked")
    kept = rows.where("reason is null").drop("reason")
    order = F.pmod(F.col("doc_id") * config.seed, F.lit(MODULUS))
    split = exact_split(kept, "doc_id", config.val_ratio, config.test_ratio, order=order)
    named = split.withColumns({"file_name": F.concat(F.col("doc_id").cast("string"), F.lit(config.suffix)), "n_lines": F.size("lines").cast("long")})
    records = chat_records(named, config.root, config.prompt, keep=("doc_id", "source", "n_lines", "split", "lang"))
    records.hint("rebalance", "split", "lang").write.mode("overwrite").partitionBy("split", "lang").parquet(f"{out}/records")
    rows.where("reason is not null").select("doc_id", "source", "reason").write.mode("overwrite").partitionBy("reason").parquet(f"{out}/rejected")
    written = spark.read.schema("n_lines long, split string, lang string").parquet(f"{out}/records")
    report = written.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("n_lines"))
    report.orderBy("split", "lang").coalesce(1).write.mode("overwrite").json(f"{out}/report")
    read, ruled_out = rows.agg(F.count(F.lit(1)), F.count("reason")).first()
    drop_stage(rows)
    counts = {"read": read, "rejected": ruled_out, "train": 0, "eval": 0, "test": 0}
    counts |= {r["split"]: r["n"] for r in spark.read.schema("split string, n long").json(f"{out}/report").groupBy("split").agg(F.sum("n").alias("n")).collect()}
    log.info("read %s documents of %s; wrote %s", read, documents, ", ".join(f"{n} {name}" for name, n in counts.items() if name != "read"))
    return counts


def read_back(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/records")


if __name__ == "__main__":
    command_line(
        "training set", TrainingSet,
        {"documents": "Parquet: doc_id, text, lang, source", "labels": "Parquet: doc_id, quality, toxic", "out": "output folder"}, build,
    )
