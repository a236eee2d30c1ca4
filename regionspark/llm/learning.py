"""What the trained operators share: bounded labelled samples and sums of fixed-size arrays over all tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import expand_signed, squeeze_signed
from .tables import map_arrow, write_stage

#: Labelled rows that a model is fitted on, at most: the rows of least hash.
SAMPLE_ROWS = 12_000
PIECE = 1 << 20  # numbers of an array that are packed at a time


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % modulus


def labelled_ids(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(_id, label) of at most `rows` labelled documents outside the held-out fold: a table to broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(4) != 2))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fold, as a written table.

    The sampled ids are broadcast; the documents are read once and not moved. Of rows that share a doc_id the text of
    least hash counts.
    """
    picked = labelled_ids(labels, label, rows)
    own = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    one = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r"))
    return write_stage(one.select("doc_id", "r.text", "r.label"), "sample")


def task_sums(
    docs: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], shape: tuple[int, ...],
    finish: Callable[[np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """The sum over all tasks of a 64-bit integer array of fixed shape that `add` fills batch by batch.

    Tasks' arrays are added on the executors, one at a time, in levels of ever fewer tasks; `finish` turns the sum into
    what the driver gets, so one array of fixed size reaches it, whatever the input.
    """
    schema = "part int, sums array<binary>"
    size = math.prod(shape)

    def send(total: np.ndarray) -> pa.RecordBatch:
        from pyspark import TaskContext

        context = TaskContext.get()
        flat = total.reshape(-1)
        blobs = [squeeze_signed(flat[lo : lo + PIECE]) for lo in range(0, size, PIECE)]
        columns = [pa.array([context.partitionId() if context else 0], pa.int32()), pa.array([blobs], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "sums"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if total is None:
                total = np.zeros(shape, np.int64)
            add(total, batch)
        if total is not None:
            yield send(total)

    def added(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for blobs in batch.column("sums"):
                if total is None:
                    total = np.zeros(size, np.int64)
                for k, blob in enumerate(blobs.values):
                    total[k * PIECE : (k + 1) * PIECE] += expand_signed(blob.as_py())
        return total

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = added(batches)
        if total is not None:
            yield send(total)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = added(batches)
        if total is not None:
            total = total.reshape(shape)
            out = total if finish is None else finish(total)
            named = pa.array([f"{out.dtype.str} {' '.join(map(str, out.shape))}"])
            yield pa.RecordBatch.from_arrays([named, pa.array([out.tobytes()], pa.binary())], names=["kind", "sums"])

    parts = map_arrow(docs, fill, schema)
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8
    while groups > 1:
        parts = map_arrow(parts.repartition(groups, "part"), merge, schema)
        groups = math.isqrt(groups) if groups > 8 else 1
    got = map_arrow(parts.repartition(1), end, "kind string, sums binary").collect()
    if not got:
        total = np.zeros(shape, np.int64)
        return total if finish is None else finish(total)
    dtype, *sizes = got[0]["kind"].split()
    return np.frombuffer(got[0]["sums"], dtype).reshape([int(x) for x in sizes])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ones:
    """A sparse matrix of zeros and ones: rows and columns of the ones; with products by vectors."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.shape = rows.astype(np.int32), columns.astype(np.int32), shape

    @property
    def T(self) -> Ones:
        return Ones(self.columns, self.rows, self.shape[::-1])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=v[self.columns], minlength=self.shape[0])


def fit_logistic(x: Ones, y: np.ndarray, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps on the penalised log loss."""
    n, d = x.shape
    xt = x.T
    u = np.ones(d)
    for _ in range(30):  # the largest eigenvalue of x'x by power steps
        u = xt @ (x @ u)
        top = float(np.linalg.norm(u))
        u /= max(top, 1e-9)
    step = 4 / (1.1 * top + n + 4 * penalty)
    w, b = np.zeros(d), 0.0
    v, c = w, b
    for k in range(rounds):
        g = sigmoid(x @ v + c) - y
        new, new_b = v - step * (xt @ g + penalty * v), c - step * float(g.sum())
        v, c = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new, new_b
    return w, b
