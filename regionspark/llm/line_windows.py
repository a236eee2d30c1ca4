"""Line dedup by overlapping three-line windows.

Every run of `lines` consecutive lines of a document is hashed; a window that occurs more than once in the corpus stays
at its first place, by (doc_id, hash of the text, line), and its later occurrences cover their lines. Covered lines are
merged and removed. Every window with a word counts; windows of blank lines say nothing.

Windows are written once, as rows of hashes; they are counted with partial sums, and the join that finds later
occurrences has one row per repeated window on its other side and is split by the engine where one window holds many rows.

Defined cases: null and empty texts and texts of fewer than `lines` lines stay as they are; null doc_ids come last;
rows equal in doc_id and text are one occurrence, so all of them keep or lose the same lines, and there are no other ties;
an empty table gives an empty table; extra columns, whatever their names, pass through; a long text takes about 10 times
its bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import fresh, kept_schema, map_arrow, write_stage
from .words import blocks, hash_spans, line_spans, windows, word_spans

LINES = 3


def _windows(lines: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                spans = line_spans(b)
                key, at = windows(hash_spans(b.data, spans.starts, spans.ends), spans, lines)
                if not len(at):
                    continue
                heads = word_spans(b).starts
                says = np.searchsorted(heads, spans.ends)[at + lines - 1] > np.searchsorted(heads, spans.starts)[at]
                key, at = key[says], at[says]
                doc = spans.doc[at]
                rows = pa.array(doc + b.lo)
                line = pa.array((at - spans.first[doc]).astype(np.int32))
                columns = [pa.array(key.view(np.int64)), batch.column("doc_id").take(rows), batch.column("hash").take(rows), line]
                yield pa.RecordBatch.from_arrays(columns, names=["window", "doc_id", "hash", "line"])

    return make


def window_table(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(window, doc_id, hash, line) of every window with a word."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return map_arrow(keyed, _windows(lines), f"window long, {kept_schema(docs, ['doc_id'])}, hash long, line int")


def later_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, hash, covered): first lines of the windows of each document that occur earlier."""
    table = write_stage(window_table(docs, lines), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "line")
    first = table.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first != final")
    first = write_stage(first.select(F.col("window").alias("w"), "first"), "first")  # written, so a hot window's rows can be split
    later = table.join(first.hint("merge"), F.col("window") == F.col("w")).where(place != F.col("first"))
    return later.groupBy("doc_id", "hash").agg(F.collect_set("line").alias("covered"))


def _remove(names: list[str], lines: int, covered_name: str, total_name: str | None, lost_name: str | None):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, covered = batch.column("text"), batch.column(covered_name)
            lost, total = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            changed: dict[int, str] = {}
            for b in blocks(column):
                spans = line_spans(b)
                total[b.lo : b.hi] = spans.counts
                gone = np.zeros(len(spans.starts), bool)
                for i in np.flatnonzero(np.asarray(pc.is_valid(covered.slice(b.lo, b.docs)))):
                    at = np.asarray(covered[b.lo + i].values) + spans.first[i]
                    for k in range(lines):
                        gone[at + k] = True
                    own = slice(spans.first[i], spans.first[i + 1])
                    lost[b.lo + i] = gone[own].sum()
                    kept = zip(spans.starts[own][~gone[own]], spans.ends[own][~gone[own]])
                    changed[b.lo + i] = b"\n".join(b.data[a:z].tobytes() for a, z in kept).decode()
            if changed:
                mask = np.zeros(len(column), bool)
                mask[list(changed)] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], column.type))
            made = {total_name: pa.array(total), lost_name: pa.array(lost), "text": column}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return remove


def dedup_lines(docs: DataFrame, lines: int = LINES, counts: tuple[str, str] | None = None) -> DataFrame:
    """The documents without later occurrences; n_chars follows the text.

    `counts` names two more columns, which `docs` does not have: lines before, and lines removed.
    """
    hash_, d, h, covered = fresh([*docs.columns, *(counts or ())], "hash", "d", "h", "covered")
    later = later_lines(docs.select("doc_id", "text"), lines)
    later = later.select(F.col("doc_id").alias(d), F.col("hash").alias(h), F.col("covered").alias(covered))
    joined = docs.withColumn(hash_, F.xxhash64("text"))
    joined = joined.join(later.hint("merge"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(hash_) == F.col(h)), "left")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, T.LongType()) for name in counts or ()]])
    names = schema.names
    out = map_arrow(joined.select(*docs.columns, covered), _remove(names, lines, covered, *(counts or (None, None))), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
