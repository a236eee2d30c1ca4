"""Substring dedup over a De Bruijn graph of words.

Nodes are runs of `size` - 1 words, edges are windows of `size` words. A window that occurs more than once in the corpus
stays at its first place, by (doc_id, hash of the text, word); words that a later occurrence covers are removed.

1. Candidates. Each window is keyed by its least `anchor`-word part (by hash, leftmost), so equal windows have equal keys
   and neighbours mostly share one: a row per run of windows with one key, about a sixth of the windows. Keys met once go.
2. Edges. A key that is always met in the very same run gives one edge for the whole run: the sources show that this path
   is never entered or left midway. Other runs are opened into their windows. An edge is known by its own hash and that
   of its first node, 128 bits; repeated ones keep their first place.
3. Compaction. A node with one repeated edge in and one out links them. Linked edges that also follow each other at their
   first places are one segment, found by a window over a document; segments linked across documents are joined by pointer
   doubling, log2(segments) joins of the few that are left, and a cycle is cut at its least segment.
4. Spans. Edges of a document that advance in step with their path and with its first source are one span, so every span
   is verified against the coordinates of the text it repeats; later spans are merged and their words removed.

Every step is a join or a partial aggregate by hash, so a text or a passage held by a third of the corpus is spread over
as many rows as it has, and the engine splits skewed joins. Nothing is broadcast or collected.

Defined cases: null and empty texts and texts of fewer than `size` words lose nothing (a null text stays null); null
doc_ids come last (2**63 - 1 stands for them); rows equal in doc_id and text are one occurrence, so all keep or lose the
same words, and there are no other ties; an empty table gives an empty table; extra columns, whatever their names, pass
through; a long text takes about 60 times its bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import drop_stage, fresh, map_arrow, write_stage
from .words import _P, _P_INV, _Q, Block, Words, _powers, blocks, hash_spans, mix, word_spans

SIZE = 20
ANCHOR = 8
NO_ID = (1 << 63) - 1


class Runs:
    """Hashes of runs of words of a block, from sums over a prefix."""

    def __init__(self, block: Block, words: Words):
        terms = hash_spans(block.data, words.starts, words.ends)
        terms *= _powers(_P, len(terms))
        self.sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers(_P_INV, len(self.sums))[start] + (end - start).astype(np.uint64) * _Q)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values the index of its first least one."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        reach += step
    return at


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _run_rows(size: int, anchor: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                words = word_spans(b)
                n = len(words.starts) - size + 1
                if n <= 0:
                    continue
                runs, doc = Runs(b, words), words.doc
                part = np.arange(n + size - anchor)
                keys = runs.hash(part, part + anchor)
                own = leftmost_least(keys, size - anchor + 1)
                at = np.flatnonzero(doc[:n] == doc[size - 1 :])
                if not len(at):
                    continue
                head = np.ones(len(at), bool)
                head[1:] = (own[at[1:]] != own[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
                begin = np.flatnonzero(head)
                count = np.diff(np.append(begin, len(at)))
                at = at[begin]
                rows = pa.array(doc[at] + b.lo)
                columns = [_longs(keys[own[at]]), _longs(runs.hash(at, at + count + size - 1))]
                columns += [batch.column("doc").take(rows), batch.column("hash").take(rows)]
                columns += [pa.array((at - words.first[doc[at]]).astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "run", "doc", "hash", "at", "n"])

    return make


def _edge_rows(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                words, marks = word_spans(b), batch.column("marks").slice(b.lo, b.docs)
                runs, flat = Runs(b, words), marks.flatten()
                doc = np.repeat(np.arange(b.docs), np.asarray(marks.value_lengths()))
                at, n, whole = (np.asarray(flat.field(k).to_numpy(zero_copy_only=False)) for k in range(3))
                at = at.astype(np.int64) + words.first[doc]
                rows = np.where(whole, 1, n)
                doc, n = np.repeat(doc, rows), np.repeat(np.where(whole, n, 1), rows)
                at = np.repeat(at, rows) + np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
                end = at + n + size - 1
                where = pa.array(doc + b.lo)
                columns = [_longs(runs.hash(at, end)), _longs(runs.hash(at, at + size - 1)), _longs(runs.hash(end - size + 1, end))]
                columns += [batch.column("doc").take(where), batch.column("hash").take(where)]
                columns += [pa.array((at - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["edge", "tail", "head", "doc", "hash", "at", "n"])

    return make


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("hash"), "text")


def edge_table(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """Occurrences of all edges that may repeat, as a written table: (edge, tail, head, doc, hash, at, n); n windows each."""
    keyed = _keyed(docs)
    runs = write_stage(map_arrow(keyed, _run_rows(size, anchor), "key long, run long, doc long, hash long, at int, n int"), "runs")
    met = runs.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("times"), (F.min("run") == F.max("run")).alias("whole"))
    met = write_stage(met.where("times > 1").select("k", "whole"), "keys")
    marks = runs.join(met.hint("merge"), F.col("key") == F.col("k"))
    marks = marks.groupBy(F.col("doc").alias("d"), F.col("hash").alias("h")).agg(F.collect_set(F.struct("at", "n", "whole")).alias("marks"))
    marks = write_stage(marks, "marks")
    drop_stage(runs, met)
    joined = keyed.join(marks.hint("merge"), (F.col("doc") == F.col("d")) & (F.col("hash") == F.col("h")))
    schema = "edge long, tail long, head long, doc long, hash long, at int, n int"
    edges = write_stage(map_arrow(joined.select("doc", "hash", "text", "marks"), _edge_rows(size), schema), "edges")
    drop_stage(marks)
    return edges


def repeated_edges(edges: DataFrame) -> DataFrame:
    """(edge, tail, head, n, doc, hash, at): edges with more than one place, at their first one."""
    place = F.struct("doc", "hash", "at")
    many = edges.groupBy("edge", "tail").agg(
        F.min(place).alias("first"), F.max(place).alias("final"), F.max("head").alias("head"), F.max("n").alias("n")
    )
    return many.where("first != final").select("edge", "tail", "head", "n", "first.*")


def _same(a: str, b: str) -> Column:
    """Equality of two (doc, hash, at) structs, field by field."""
    return (F.col(f"{a}.doc") == F.col(f"{b}.doc")) & (F.col(f"{a}.hash") == F.col(f"{b}.hash")) & (F.col(f"{a}.at") == F.col(f"{b}.at"))


def chains(links: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """(seg, top, dist) of every segment with a predecessor: the first of its chain and the windows before it there; None if
    no segment has one. Also the written tables that it is read from.

    `links` is a written table (seg, ptr, dist): each segment's predecessor, at most one on either side, and how many
    windows that one has. Each round joins the pointers with themselves and so doubles their reach. What is still open
    when the reach exceeds all links lies on cycles: each is cut before its least segment and walked again.
    """
    rows = links.count()
    if not rows:
        return None, []
    state = links.withColumns({"low": F.col("ptr"), "open": F.lit(True)})
    for _ in range(rows.bit_length() + 1):
        t = state.select(F.col("seg").alias("s"), F.col("ptr").alias("p"), F.col("dist").alias("d"), F.col("low").alias("l"))
        reach = state.join(t.hint("merge"), _same("ptr", "s"), "left")
        reach = reach.select(
            "seg", F.coalesce("p", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("d", F.lit(0))).alias("dist"),
            F.when(F.col("l") < F.col("low"), F.col("l")).otherwise(F.col("low")).alias("low"), F.col("s").isNotNull().alias("open"),
        )
        reach = write_stage(reach, "chains")
        drop_stage(state)
        state = reach
        if not state.where("open").limit(1).count():
            return state.select("seg", F.col("ptr").alias("top"), "dist"), [state]
    done = state.where("not open").select("seg", F.col("ptr").alias("top"), "dist")
    ring = state.where("open").select(F.col("seg").alias("s"), "low")
    cut = write_stage(links.join(ring.hint("merge"), _same("seg", "s")).where("seg != low").select("seg", "ptr", "dist"), "links")
    again, walked = chains(cut)
    return done if again is None else done.unionByName(again), [state, cut, *walked]


def compact(edges: DataFrame) -> tuple[DataFrame, list[DataFrame | None]]:
    """Paths of the repeated edges (a written table): its columns, with path (a hash of the first place of its first edge) and
    offset; and the written tables that this is read from."""
    spot = F.struct("doc", "hash", "at")
    none = F.lit(None).cast("struct<doc:bigint,hash:bigint,at:int,n:int>")
    ways = F.struct("doc", "hash", "at", "n")
    nodes = edges.select(F.col("head").alias("node"), ways.alias("into"), none.alias("out"))
    nodes = nodes.unionByName(edges.select(F.col("tail").alias("node"), none.alias("into"), ways.alias("out")))
    nodes = nodes.groupBy("node").agg(F.count("into").alias("ins"), F.count("out").alias("outs"), F.max("into").alias("prev"), F.max("out").alias("next"))
    nodes = nodes.where("ins = 1 and outs = 1").withColumn(
        "near", F.expr("prev.doc = next.doc and prev.hash = next.hash and prev.at + prev.n = next.at")
    )
    links = write_stage(nodes.select("prev", "next", "near"), "links")
    near = links.where("near").select(F.col("next.doc").alias("d"), F.col("next.hash").alias("h"), F.col("next.at").alias("a"))
    at = (F.col("doc") == F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("at") == F.col("a"))
    begin = F.last(F.when(F.col("d").isNull(), F.col("at")), True).over(Window.partitionBy("doc", "hash").orderBy("at"))
    parts = edges.join(near.hint("merge"), at, "left").withColumn("begin", begin).drop("d", "h", "a")
    parts = segments = write_stage(parts, "segments")
    far = links.where("not near").select("prev", F.struct("next.doc", "next.hash", "next.at").alias("seg"))
    ends = parts.select(spot.alias("last"), F.struct("doc", "hash", F.col("begin").alias("at")).alias("ptr"))
    far = far.join(ends.hint("merge"), _same("prev", "last")).where("seg != ptr")
    far = far.select("seg", "ptr", (F.col("prev.at") + F.col("prev.n") - F.col("ptr.at")).cast("long").alias("dist"))
    far = write_stage(far, "far")
    found, walked = chains(far)
    parts = parts.withColumn("own", F.struct("doc", "hash", F.col("begin").alias("at")))
    if found is None:
        parts = parts.withColumns({"path": F.col("own"), "offset": (F.col("at") - F.col("begin")).cast("long")})
    else:
        parts = parts.join(found.hint("merge"), _same("own", "seg"), "left").withColumns(
            {"path": F.coalesce("top", "own"), "offset": F.coalesce("dist", F.lit(0)) + F.col("at") - F.col("begin")}
        )
    number = F.xxhash64("path.doc", "path.hash", "path.at").alias("path")
    return parts.select(*edges.columns, number, "offset"), [links, segments, far, *walked]


def repeated_spans(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, later_only: bool = False) -> DataFrame:
    """Every repeated span of every document, as a written table: doc, hash, start, n_words, path, path_offset, the place whose
    words it repeats (first_doc, first_hash, first_start), and later (False where it is that place itself; `later_only`
    leaves those out). doc is doc_id, hash that of the text."""
    occurrences = edge_table(docs, size, anchor)
    edges = write_stage(repeated_edges(occurrences), "repeated")
    paths, inner = compact(edges)
    first = [F.col(c).alias(f"f_{c}") for c in ("doc", "hash", "at")]
    paths = write_stage(paths.select(F.col("edge").alias("e"), F.col("tail").alias("t"), *first, "path", "offset"), "paths")
    drop_stage(edges, *inner)
    met = occurrences.join(paths.hint("merge"), (F.col("edge") == F.col("e")) & (F.col("tail") == F.col("t")))
    later = (F.col("f_doc") != F.col("doc")) | (F.col("f_hash") != F.col("hash")) | (F.col("f_at") != F.col("at"))
    if later_only:
        met = met.where(later)
    met = met.select("doc", "hash", "at", "n", "f_doc", "f_hash", "f_at", "path", "offset")
    order = Window.partitionBy("doc", "hash").orderBy("at")
    before = lambda c: F.lag(c).over(order)
    met = met.withColumn("twice", before("at") == F.col("at")).where("twice is null or not twice").drop("twice")  # rows equal in doc_id and text
    in_step = lambda c: before(F.col(c) - F.col("at")) == F.col(c) - F.col("at")
    same = lambda c: before(c) == F.col(c)
    goes_on = (before(F.col("at") + F.col("n")) == F.col("at")) & same("path") & in_step("offset") & same("f_doc") & same("f_hash") & in_step("f_at")
    met = met.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("new").over(order))
    spans = met.groupBy("doc", "hash", "part").agg(
        F.min("at").alias("start"), (F.sum("n") + size - 1).alias("n_words"), F.min("path").alias("path"), F.min("offset").alias("path_offset"),
        F.min("f_doc").alias("first_doc"), F.min("f_hash").alias("first_hash"), F.min("f_at").alias("first_start"),
    ).drop("part")
    itself = (F.col("first_doc") == F.col("doc")) & (F.col("first_hash") == F.col("hash")) & (F.col("first_start") == F.col("start"))
    spans = write_stage(spans.withColumn("later", ~itself), "spans")
    drop_stage(occurrences, paths)
    return spans


def _remove(names: list[str], marks_name: str, total_name: str | None, lost_name: str | None):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, marks = batch.column("text"), batch.column(marks_name)
            total, lost, kept = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64), []
            for b in blocks(column):
                words, own = word_spans(b), marks.slice(b.lo, b.docs)
                total[b.lo : b.hi] = words.counts
                edge = np.zeros(len(words.starts) + 1, np.int64)
                flat, sizes = own.flatten(), np.asarray(pc.fill_null(own.value_lengths(), 0))
                start = np.asarray(flat.field(0)).astype(np.int64) + np.repeat(words.first[:-1], sizes)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + np.asarray(flat.field(1)).astype(np.int64), -1)
                gone = np.cumsum(edge[:-1]) > 0
                doc = words.doc
                lost[b.lo : b.hi] = np.bincount(doc[gone], minlength=b.docs)
                kept.append(_joined(b, words, doc, ~gone))
            text = pa.concat_arrays(kept) if kept else pa.array([], pa.string())
            made = {total_name: pa.array(total), lost_name: pa.array(lost)}
            made["text"] = pc.if_else(pc.is_valid(column), text, pa.scalar(None, pa.string())).cast(column.type)
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return remove


def _joined(b: Block, words: Words, doc: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each document joined by one space."""
    starts, ends, doc = words.starts[keep], words.ends[keep], doc[keep]
    size = ends - starts
    follows = np.zeros(len(doc), np.int64)
    follows[1:] = doc[1:] == doc[:-1]
    at = np.cumsum(size + follows) - size
    n = int(at[-1] + size[-1]) if len(at) else 0
    out = np.full(n, 32, np.uint8)
    move = np.repeat(starts - at, size)
    to = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
    out[to] = b.data[to + move]
    per_doc = np.bincount(doc, size + follows, b.docs).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
    return pa.StringArray.from_buffers(b.docs, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def dedup_substrings(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, counts: tuple[str, str] | None = None) -> DataFrame:
    """The documents' kept words, joined by one space, as text; n_chars follows the text.

    `counts` names two more columns, which `docs` does not have: words before, and words removed.
    """
    doc, hash_, d, h, marks = fresh([*docs.columns, *(counts or ())], "doc", "hash", "d", "h", "marks")
    spans = repeated_spans(docs.select("doc_id", "text"), size, anchor, later_only=True)
    spans = spans.groupBy(F.col("doc").alias(d), F.col("hash").alias(h)).agg(F.collect_list(F.struct("start", "n_words")).alias(marks))
    joined = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), hash_: F.xxhash64("text")})
    joined = joined.join(spans.hint("merge"), (F.col(doc) == F.col(d)) & (F.col(hash_) == F.col(h)), "left")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, T.LongType()) for name in counts or ()]])
    out = map_arrow(joined.select(*docs.columns, marks), _remove(schema.names, marks, *(counts or (None, None))), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
