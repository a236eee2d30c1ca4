"""Mixing sources to target weights.

Per source, documents stand in a fixed pseudorandom order and their words form blocks of `block_words`. Targets are
shares of the words wanted, held to `most` times a source's size, with what that leaves shared out again by weight.
Output shards of `shard_blocks` slots draw how many blocks they take from each source multinomially, each draw from
what the sources still owe, so that totals meet the targets; slot j of a source maps through the source's
pseudorandom permutation of block indices (a keyed Feistel network walked until it stays in range; another key for each
pass over the source), and slots meet blocks in a join on (source, index).

Shards' counts are not made one after another: a range of shards splits what it owes between its two halves by one
multinomial draw, seeded by the range, and so on down to single shards. Every task walks down to its own shards, so
neither the driver nor a task holds a table of all shards. What reaches the driver, and what every task is told, is one
row per source; sources are meant to be a catalogue, not keys of documents.

Defined cases: null and empty texts have size 0 and are never taken; null sources are a source, last in order; rows equal
in all columns are separate rows, and such ties may change places; an empty table gives an empty table; extra columns,
whatever their names, pass through `mix_documents`; a text of any length is cut into blocks like others, and takes about
6 times its bytes of memory where its words are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh, key_of, map_arrow, prefix_sums, write_stage
from .words import blocks, mix, word_spans


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: float = 2.0
    block_words: int = 128
    shard_blocks: int = 4096
    seed: int = 20240607


def word_count(column: str = "text") -> F.Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], settings: Mix = Mix()) -> list[float]:
    """Words wanted of each source, in the sources' order."""
    total = settings.share * sum(sizes)
    weights = [settings.weights[i % len(settings.weights)] for i in range(len(sizes))]
    found = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n]
    while open_:
        unit = (total - sum(found[i] for i in range(len(sizes)) if i not in set(open_))) / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > settings.most * sizes[i]]
        if not over:
            for i in open_:
                found[i] = weights[i] * unit
            break
        for i in over:
            found[i] = settings.most * sizes[i]
        open_ = [i for i in open_ if i not in set(over)]
    return found


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), applied to `index`."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, 7, dtype=np.uint64) + np.uint64(key & (1 << 64) - 1))

    def walk(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return left << np.uint64(half) | right

    out = walk(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = walk(out[outside])
    return out.astype(np.int64)


def draw(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n of the slots that are owed: multinomial draws, drawn again as far as a source would give more than it owes."""
    got = np.zeros_like(quotas)
    while (want := n - int(got.sum())) > 0:
        rest = quotas - got
        got += np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
    return got


def shard_counts(quotas: np.ndarray, first: int, last: int, settings: Mix = Mix()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots it takes from each source, slots that the shards before it take) of the shards first..last-1."""
    size = settings.shard_blocks

    def walk(lo: int, hi: int, owed: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, owed, before
            return
        middle = (lo + hi) // 2
        left = draw(owed, (middle - lo) * size, np.random.Generator(np.random.PCG64([settings.seed, lo, hi])))
        yield from walk(lo, middle, left, before)
        yield from walk(middle, hi, owed - left, before + left)

    shards = -(-int(quotas.sum()) // size)
    if shards:
        yield from walk(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64))


SLOTS = "shard long, slot long, source_id int, pass int, block long"


def _slots(quotas: np.ndarray, n_blocks: list[int], settings: Mix):
    """A function for map_arrow from runs of shard numbers to their slots."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(0).to_pylist()
            for shard, counts, before in shard_counts(quotas, numbers[0], numbers[-1] + 1, settings):
                slot = 0
                for s in np.flatnonzero(counts):
                    n, m = n_blocks[s], int(counts[s])
                    j = np.arange(before[s], before[s] + m)
                    turn, block = j // n, np.zeros(m, np.int64)
                    for e in np.unique(turn):
                        own = turn == e
                        block[own] = permute(j[own] % n, n, settings.seed * 1_000_003 + int(s) * 1009 + int(e))
                    columns = [pa.array(np.full(m, shard)), pa.array(np.arange(slot, slot + m)), pa.array(np.full(m, s, np.int32))]
                    columns += [pa.array(turn.astype(np.int32)), pa.array(block)]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "slot", "source_id", "pass", "block"])
                    slot += m

    return make


@dataclass
class Mixture:
    """documents: the rows as given with columns for row number, size, source size and target, whose names `added` has in
    that order; spans: which words of them each slot takes (shard, slot, pass, row, word, n_words)."""

    documents: DataFrame
    spans: DataFrame
    added: list[str]


def mixture(docs: DataFrame, settings: Mix = Mix(), keep_text: bool = True) -> Mixture:
    """The mixture of `docs` (doc_id, source, text). Without keep_text the written table holds no texts."""
    spark = docs.sparkSession
    row, size, hash_, source, number, source_size, target = added = fresh(
        docs.columns, "row", "size", "hash", "source_key", "source_id", "source_size", "target"
    )
    numbered = docs.withColumns(
        {size: word_count(), hash_: F.xxhash64("text"), source: key_of("source"), row: F.monotonically_increasing_id()}
    )
    table = write_stage(numbered if keep_text else numbered.drop("text"), "mix")
    totals = table.groupBy(F.col("source").alias("name"), F.col(source).alias("key"))
    totals = totals.agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    totals = sorted(totals, key=lambda r: (r["name"] is None, r["name"] or ""))
    sizes = [int(r["n"]) for r in totals]
    wanted = targets(sizes, settings)
    width = settings.block_words
    n_blocks = [-(-n // width) for n in sizes]
    quotas = np.array([min(round(t / width), int(settings.most) * n) for t, n in zip(wanted, n_blocks)], np.int64)
    ids = spark.createDataFrame(
        [(r["key"], i, sizes[i], float(wanted[i])) for i, r in enumerate(totals)],
        f"{source} string, {number} int, {source_size} long, {target} double",
    )
    marked = table.join(ids, source)  # one row per source; the engine broadcasts it if it is small
    own = marked.where(F.col(size) > 0).select(
        F.col(row).alias("row"), "doc_id", F.col(hash_).alias("hash"), F.col(number).alias("source_id"), F.col(size).alias("size")
    )
    ordered = prefix_sums(own, "source_id", ["hash", "doc_id"], "size", "at", sum(r["rows"] for r in totals))
    lo, end = F.col("at"), F.col("at") + F.col("size")
    block = F.explode(F.sequence((lo / width).cast("long"), ((end - 1) / width).cast("long")))
    placed = ordered.select("row", "source_id", "at", "size", block.alias("block"))
    begin = F.greatest(lo, F.col("block") * width)
    stop = F.least(end, (F.col("block") + 1) * width)
    placed = placed.select("row", "source_id", "block", (begin - lo).alias("word"), (stop - begin).alias("n_words"))
    n_shards = -(-int(quotas.sum()) // settings.shard_blocks)
    tasks = max(1, -(-n_shards // 256), min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slots = map_arrow(spark.range(0, n_shards, 1, tasks), _slots(quotas, n_blocks, settings), SLOTS)
    spans = slots.hint("merge").join(placed, ["source_id", "block"]).select("shard", "slot", "pass", "row", "word", "n_words")
    return Mixture(marked, spans, [added[i] for i in (0, 1, 5, 6)])


def taken_words(docs: DataFrame, settings: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    made = mixture(docs.select("doc_id", "source", "text"), settings, keep_text=False)
    row, size, source_size, target = made.added
    taken = made.spans.groupBy(F.col("row").alias("taker")).agg(F.sum("n_words").alias("taken"))
    joined = made.documents.join(taken, F.col(row) == F.col("taker"), "left")
    return joined.select(
        "doc_id", F.col(size).alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def _cut(names: list[str], spans_name: str):
    """Texts of the word ranges (word, n_words) in the column `spans_name`, in order, joined where they do not touch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            spans = batch.column(spans_name)
            for b in blocks(batch.column("text")):
                w = word_spans(b)
                for i in range(b.docs):
                    merged: list[list[int]] = []
                    for s in sorted((x["word"], x["word"] + x["n_words"]) for x in spans[b.lo + i].as_py() or []):
                        if merged and merged[-1][1] == s[0]:
                            merged[-1][1] = s[1]
                        else:
                            merged.append(list(s))
                    first, n, end = int(w.first[i]), int(w.counts[i]), int(b.offsets[i + 1])
                    parts = []
                    for lo, hi in merged:
                        a = int(b.offsets[i]) if lo == 0 else int(w.starts[first + lo])
                        z = end if hi == n else int(w.ends[first + hi - 1])
                        parts.append(b.data[a:z].tobytes())
                    texts.append(b"\n".join(parts).decode())
            cut_text = pa.array(texts, pa.string())
            out = {n: cut_text if n == "text" else batch.column(n) for n in names}
            if "n_chars" in out:
                out["n_chars"] = pc.utf8_length(cut_text).cast(out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=names)

    return cut


def mix_documents(docs: DataFrame, settings: Mix = Mix()) -> DataFrame:
    """The mixture as documents: for each pass over its source, a row with the words taken of a document.

    Documents of which nothing is taken are left out; columns are those of `docs`, n_chars follows the text.
    """
    made = mixture(docs, settings)
    taker, spans_name = fresh(made.documents.columns, "taker", "spans")
    spans = made.spans.groupBy(F.col("row").alias(taker), "pass").agg(F.collect_list(F.struct("word", "n_words")).alias(spans_name))
    spans = spans.select(taker, spans_name)
    joined = made.documents.join(spans, F.col(made.added[0]) == F.col(taker)).select(*docs.columns, spans_name)
    return map_arrow(joined, _cut(docs.columns, spans_name), docs.schema)
