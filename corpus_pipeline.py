"""A training corpus from raw documents: toxic documents go, repeated lines go, one document of each class of near
copies stays, sources are mixed to their weights, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, extra ones included. After mixing, a document taken twice has two rows. `run` writes what each stage keeps
once and reads it again for the next one, so no stage is computed twice; a stage's table goes when the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regionspark.llm import line_windows, mixing, near_dedup, packing, toxicity
from regionspark.stages import drop_stage, write_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_windows.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # token ids and trained scores have no SQL; tests/llm holds each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = write_stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_stage(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
