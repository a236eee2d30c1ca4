"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its `words`-word shingles. Weights are term frequency times 1 + ln((N + 1) / (df + 1)) /
ln(N + 2), with document frequencies counted over all documents in hashed slots of fixed number: a bounded table. Improved
consistent weighted sampling draws `bands * rows` samples of (shingle, level) per text; texts equal in all samples of a
band share a bucket. Candidates are verified by exact weighted Jaccard similarity of their whole shingle sets, and
linked texts form classes (connected components).

A bucket is not turned into all its pairs. First every member is held against the bucket's least member; this links most
copies. In buckets of more than two members that are not all of one class then, a member goes on only if it shares one of
its rarest shingles with a text of another class: the rarest that leave less than 0.8 of its weight, one of which any two
linked texts have in common. So texts that share a template, however many, go no further. Members that go on meet in
blocks of two chunks: those of a bucket of one block by bucket, those of a larger one by rare shingle. A block compares
marks (four bits of each sample) and, by the triangle inequality of the Jaccard distance, the distances to the first
pivot, to find who may still have a link to another class; those members' shingles then meet in blocks, where the exact
similarities of all of them are one matrix product, and a block gives out a spanning forest of new links. Chunks have a
fixed size, so no bucket, however large, is held by one task. Two texts meet only if enough samples agree: fewer agree for
linked texts with a probability below `lost` a pair, far below what banding loses.

Equal texts (known by a 64-bit hash) are one text throughout. Texts of fewer words than a shingle are one shingle.
Defined cases: null and empty texts are equal texts; rows equal in all columns are members of one class; a class of null
doc_ids only keeps one row, whatever other classes have no doc_id or the same one; ties of sampled values go to the least
shingle hash, and of a class' rows with its least doc_id the one of the least text hash stays; an empty table gives an
empty table; extra columns, whatever their names, pass through `drop_near_duplicates`; a long text takes about 25 times
its bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import task_sums
from .packed import expand, squeeze
from .tables import drop_stage, fresh, kept_schema, map_arrow, write_stage
from .words import Block, blocks, hash_spans, mix, windows, word_spans


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 10
    rows: int = 3
    slots: int = 1 << 20
    chunk: int = 1024
    lost: float = 5e-4

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreeing(self) -> int:
        """The most samples of which linked texts agree in fewer with a probability of at most `lost`."""
        total, m = 0.0, 0
        while True:
            total += comb(self.samples, m) * self.similarity**m * (1 - self.similarity) ** (self.samples - m)
            if total > self.lost:
                return m
            m += 1


_DRAWS = 1 << 16


def _draws(seed: int = 5) -> tuple[np.ndarray, ...]:
    """A table of (r, 1 / r, beta, ln c) with r and c from Gamma(2, 1) and beta uniform; a hash of shingle and sample
    number says which entry a shingle has for a sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    r, c = rng.gamma(2, 1, _DRAWS), rng.gamma(2, 1, _DRAWS)
    return tuple(x.astype(np.float32) for x in (r, 1 / r, rng.random(_DRAWS), np.log(c)))


def shingles(b: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, times) of the distinct shingles of a block, by document and key."""
    w = word_spans(b)
    h = hash_spans(b.data, w.starts, w.ends)
    key, at = windows(h, w, size)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = [mix(np.bitwise_xor.reduce(mix(h[w.first[i] : w.first[i + 1]] + np.arange(w.counts[i], dtype=np.uint64)), keepdims=True))[0] for i in short]
        key, doc = np.concatenate([key, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    if b.docs < 1 << 16:
        order = np.argsort(doc.astype(np.uint64) << np.uint64(48) | key >> np.uint64(16))
    else:
        order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
    return doc[new], key[new], np.diff(np.append(new, len(key)))


def document_frequencies(docs: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, int]:
    """Distinct shingles of all documents, counted by slot, and the number of documents."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total[settings.slots] += batch.num_rows
        for b in blocks(batch.column("text")):
            total[: settings.slots] += np.bincount(
                (shingles(b, settings.words)[1] % np.uint64(settings.slots)).astype(np.int64), minlength=settings.slots
            )

    counts = task_sums(docs.select("text"), add, (settings.slots + 1,))
    return counts[: settings.slots], int(counts[settings.slots])


def slot_weights(frequencies: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log((n + 1) / (np.minimum(frequencies, n) + 1)) / np.log(n + 2)).astype(np.float32)


MARKS = 15  # samples in one number, four bits of each


def band_keys(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A key for each document and band, and four bits of each sample; of documents without shingles neither matters."""
    out = np.zeros((n_docs, settings.bands), np.uint64)
    marks = np.zeros((n_docs, -(-settings.samples // MARKS)), np.uint64)
    if not len(doc):
        return out, marks
    r, inverse, beta, ln_c = _draws()
    begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    owner = doc[begins]
    sizes = np.diff(np.append(begins, len(doc)))
    ln_w = np.log(weight).astype(np.float32)
    for band in range(settings.bands):
        joint = np.full(len(begins), band + 1, np.uint64)
        for row in range(settings.rows):
            k = band * settings.rows + row
            odd = mix(np.array([k + 1], np.uint64))[0] | np.uint64(1)
            entry = ((key * odd) >> np.uint64(48)).astype(np.int32)
            rr, bb = r[entry], beta[entry]
            level = np.floor(ln_w * inverse[entry] + bb)
            ln_a = ln_c[entry] - rr * (level - bb + 1)
            least = np.flatnonzero(ln_a == np.repeat(np.minimum.reduceat(ln_a, begins), sizes))
            of = np.searchsorted(begins, least, "right") - 1
            first = np.concatenate([[True], of[1:] != of[:-1]])  # of ties the least key: keys are in order
            chosen = least[first]
            sample = mix(key[chosen] + (level[chosen].astype(np.int64).view(np.uint64) << np.uint64(1)))
            joint = mix(joint * np.uint64(0xD6E8FEB86659FD93) + sample)
            marks[owner, k // MARKS] |= (sample & np.uint64(15)) << np.uint64(4 * (k % MARKS))
        out[owner, band] = joint
    return out, marks


def agree(a: str, b: str, settings: Settings) -> Column:
    """Whether enough samples agree, by the marks in columns `a` and `b`."""
    apart = F.lit(0)
    for i in range(-(-settings.samples // MARKS)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x0111111111111111))
        apart = apart + F.bit_count(x)
    return apart <= settings.samples - settings.least_agreeing


def text_id(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def _lists(rows: np.ndarray, kept: np.ndarray | None = None) -> pa.ListArray:
    """The rows of a matrix of 64-bit numbers as lists, empty where not `kept`."""
    sizes = np.full(len(rows), rows.shape[1]) if kept is None else kept * rows.shape[1]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = rows if kept is None else rows[kept]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1).view(np.int64)))


def sketch_table(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, tid, bands, marks): bands of texts without words are empty."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                doc, key, times = shingles(b, settings.words)
                weight = times * weights[(key % np.uint64(settings.slots)).astype(np.int64)]
                bands, marks = band_keys(doc, key, weight, b.docs, settings)
                some = np.bincount(doc, minlength=b.docs) > 0
                own = [batch.column(c).slice(b.lo, b.docs) for c in ("doc_id", "tid")]
                yield pa.RecordBatch.from_arrays([*own, _lists(bands, some), _lists(marks)], names=["doc_id", "tid", "bands", "marks"])

    own = docs.select("doc_id", text_id().alias("tid"), "text")
    return map_arrow(own, sketch, f"{kept_schema(docs, ['doc_id'])}, tid long, bands array<long>, marks array<long>")


def vector_table(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(tid, keys, times) of the texts in `wanted` (tid, doc_id: one row that has the text)."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                doc, key, times = shingles(b, settings.words)
                cuts = np.searchsorted(doc, np.arange(b.docs + 1))
                keys = pa.array([squeeze(key[a:z], True) for a, z in zip(cuts, cuts[1:])], pa.binary())
                counts = pa.array([squeeze(times[a:z].astype("<u4")) for a, z in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("tid").slice(b.lo, b.docs), keys, counts], names=["tid", "keys", "times"])

    own = docs.select("doc_id", text_id().alias("tid"), "text")
    one = wanted.select(F.col("tid").alias("_t"), F.col("doc_id").alias("_d"))
    found = own.join(one.hint("merge"), (F.col("tid") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("tid", "text")
    return map_arrow(found, vectors, "tid long, keys binary, times binary").dropDuplicates(["tid"])


def unpacked(keys: pa.Scalar, times: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return expand(keys.as_py(), "u8", True), expand(times.as_py(), "u4")


def elements(vector: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A weighted multiset as a set: a shingle that is there n times is n elements, the first with its key; and weights."""
    keys, times = vector[0], vector[1].astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    each = np.repeat(keys, times)
    weight = weights[(each % np.uint64(len(weights))).astype(np.int64)].astype(float)
    return np.where(nth > 0, mix(each + nth.astype(np.uint64)), each), weight


def rarest(element: np.ndarray, weight: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements, by weight from the greatest and then by number, that leave less than `similarity` of the weight.

    Two sets of at least that weighted Jaccard similarity have in common that part of either one's weight, so the first
    of their common elements is among these for both.
    """
    order = np.lexsort((element, -weight))
    left = weight.sum() - np.cumsum(weight[order])
    return element[order[: int((left >= (similarity - 1e-6) * weight.sum()).sum()) + 1]]


def rare_table(texts: DataFrame, vectors: DataFrame, weights: np.ndarray, settings: Settings) -> DataFrame:
    """(element, tid, label) of the rarest elements of the texts (tid, label)."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                rarest(*elements(unpacked(k, n), weights), settings.similarity) for k, n in zip(batch.column("keys"), batch.column("times"))
            ]
            if found:
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                columns = [pa.array(np.concatenate(found).view(np.int64)), batch.column("tid").take(at), batch.column("label").take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["element", "tid", "label"])

    v = vectors.select(F.col("tid").alias("_v"), "keys", "times")
    own = texts.join(v.hint("merge"), F.col("tid") == F.col("_v")).select("tid", "label", "keys", "times")
    return map_arrow(own, rare, "element long, tid long, label long")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> float:
    """Of two (sorted keys, times): sum of least over sum of greatest weights."""
    slot = lambda k: (k % np.uint64(len(weights))).astype(np.int64)
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float((np.minimum(a[1][i], b[1][j]) * weights[slot(common)]).sum())
    total = float((a[1] * weights[slot(a[0])]).sum() + (b[1] * weights[slot(b[0])]).sum()) - least
    return least / total if total else 1.0


def verify(pairs: DataFrame, vectors: DataFrame, weights: np.ndarray, block: int = 256) -> DataFrame:
    """(pivot, tid, similarity) of the pairs. A pivot with many partners is copied to one block for every `block` of
    them, so its partners are dealt over tasks; a partner's vector moves once for each of its pivots."""
    pairs = write_stage(pairs, "pairs")
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    counts = write_stage(counts, "parts")  # a written side lets the engine split the partition of a pivot with most pairs
    own = pairs.join(counts.withColumnRenamed("pivot", "_p").hint("merge"), F.col("pivot") == F.col("_p"))
    own = own.select("pivot", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int").alias("part"), "tid")
    v = vectors.select(F.col("tid").alias("_v"), "keys", "times")
    members = own.join(v.hint("merge"), F.col("tid") == F.col("_v")).select("pivot", "part", F.lit(1).alias("member"), "tid", "keys", "times")
    pivots = counts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pivots = pivots.join(v.hint("merge"), F.col("pivot") == F.col("_v")).select("pivot", "part", F.lit(0).alias("member"), F.col("pivot").alias("tid"), "keys", "times")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, None
        for batch in batches:
            out: list[list] = [[], [], []]
            for p, member, tid, keys, times in zip(batch.column("pivot").to_pylist(), batch.column("member").to_pylist(), batch.column("tid").to_pylist(), batch.column("keys"), batch.column("times")):
                vector = unpacked(keys, times)
                if not member:
                    pivot, held = p, vector
                elif p == pivot:
                    for column, x in zip(out, (p, tid, weighted_jaccard(held, vector, weights))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["pivot", "tid", "similarity"])

    together = pivots.unionByName(members).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")
    checked = write_stage(map_arrow(together, check, "pivot long, tid long, similarity double"), "checked")
    drop_stage(pairs, counts)
    return checked


def components(links: DataFrame) -> DataFrame:
    """(tid, label): the least text id of each linked text's component, by label spreading with jumps."""
    both = links.select(F.col("pivot").alias("a"), F.col("tid").alias("b"))
    edges = write_stage(both.union(both.select("b", "a")).where("a != b").distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("tid")).agg(F.min("b").alias("b"))
    labels = write_stage(labels.select("tid", F.least("tid", "b").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        near = labels.select(F.col("tid").alias("_n"), F.col("label").alias("near"))
        near = edges.join(near.hint("merge"), F.col("b") == F.col("_n")).groupBy("a").agg(F.min("near").alias("near"))
        now = labels.join(near.hint("merge"), F.col("tid") == F.col("a"))
        now = now.select("tid", F.least("label", "near").alias("now"), (F.col("near") < F.col("label")).alias("moved"))
        jump = labels.select(F.col("tid").alias("_j"), F.col("label").alias("far"))
        now = now.join(jump.hint("merge"), F.col("now") == F.col("_j"))
        new = write_stage(now.select("tid", F.least("now", "far").alias("label"), "moved"), "labels")
        drop_stage(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            drop_stage(edges)
            return labels


def linked_texts(sketch: DataFrame, docs: DataFrame, weights: np.ndarray, settings: Settings) -> DataFrame | None:
    """(tid, label) of the texts that have a link; None if there are no candidates."""
    texts = sketch.where(F.size("bands") > 0).groupBy("tid")
    texts = write_stage(texts.agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("marks").alias("marks")), "texts")
    placed = texts.select("tid", "doc_id", "marks", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min(F.struct("tid", "marks")).alias("_m"), F.max("tid").alias("_other")).where("_m.tid != _other")
    shared = write_stage(shared.select(F.col("bucket").alias("_b"), F.col("_m.tid").alias("pivot"), F.col("_m.marks").alias("_marks")), "shared")
    near = agree("marks", "_marks", settings).alias("near")
    members = placed.join(shared.hint("merge"), F.col("bucket") == F.col("_b"))
    members = write_stage(members.select("bucket", "pivot", "tid", "doc_id", "marks", near), "members")
    drop_stage(texts, shared)
    if not members.limit(1).count():
        return None
    wanted = members.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    vectors = write_stage(vector_table(docs, wanted, settings), "vectors")
    checked = verify(members.where("tid != pivot and near").select("pivot", "tid").distinct(), vectors, weights)
    links = write_stage(checked.where(F.col("similarity") >= settings.similarity).select("pivot", "tid"), "links")
    labels = components(links)
    drop_stage(links)
    # Each member with its distance to its bucket's first pivot, where they met, and the label of what it is linked to.
    first = checked.select(F.col("pivot").alias("_p"), F.col("tid").alias("_t"), "similarity")
    of = labels.select(F.col("tid").alias("_l"), "label")
    named = members.join(first.hint("merge"), (F.col("pivot") == F.col("_p")) & (F.col("tid") == F.col("_t")), "left")
    named = named.join(of.hint("merge"), F.col("tid") == F.col("_l"), "left")
    far = F.when(F.col("tid") == F.col("pivot"), 0.0).otherwise(1 - F.col("similarity")).alias("far")
    named = write_stage(named.select("bucket", "tid", "marks", far, F.coalesce("label", "tid").alias("label")), "named")
    drop_stage(members, checked)
    added = open_links(named, vectors, weights, settings)
    drop_stage(named, vectors)
    if added is None:
        return labels
    joined = components(added)
    drop_stage(added)
    # A text that had no link so far is named after itself, as the least text of each class already is.
    every = labels.select("tid", "label").union(joined.select("tid", F.col("tid").alias("label"))).groupBy("tid").agg(F.min("label").alias("label"))
    over = joined.select(F.col("tid").alias("_l"), F.col("label").alias("over"))
    every = every.join(over.hint("merge"), F.col("label") == F.col("_l"), "left").select("tid", F.coalesce("over", "label").alias("label"))
    every = write_stage(every, "labels")
    drop_stage(labels, joined)
    return every


def open_links(named: DataFrame, vectors: DataFrame, weights: np.ndarray, settings: Settings) -> DataFrame | None:
    """(pivot, tid): labels of linked classes, from buckets whose members are not yet all of one class; None without any.

    A member goes on if one of its rarest elements is one of a member of another class, as those of linked texts are. In
    a bucket of one block those members meet; the members of a larger one meet in groups by rare element.
    """
    several = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_a"), F.max("label").alias("_z"))
    several = write_stage(several.where("_n > 2 and _a != _z").select(F.col("bucket").alias("_b")), "several")
    left = named.join(several.hint("merge"), F.col("bucket") == F.col("_b")).select("bucket", "tid", "far", "marks", "label")
    left = write_stage(left, "left")
    if not left.limit(1).count():
        drop_stage(several, left)
        return None
    rare = write_stage(rare_table(left.select("tid", "label").distinct(), vectors, weights, settings), "rare")
    common = rare.groupBy("element").agg(F.min("label").alias("_a"), F.max("label").alias("_z")).where("_a != _z")
    common = write_stage(common.select(F.col("element").alias("_e")), "common")
    met = write_stage(rare.join(common.hint("merge"), F.col("element") == F.col("_e")).select("element", "tid"), "met")
    some = met.select(F.col("tid").alias("_t")).distinct()
    left2 = write_stage(left.join(some.hint("merge"), F.col("tid") == F.col("_t")).drop("_t"), "left")
    drop_stage(several, left, rare, common)
    size = settings.chunk * 2
    large = left2.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    large = write_stage(large.select(F.col("bucket").alias("_b")), "large")
    in_large = left2.join(large.hint("merge"), F.col("bucket") == F.col("_b"))
    small = left2.join(large.hint("merge"), F.col("bucket") == F.col("_b"), "left_anti")
    one = in_large.groupBy("tid").agg(F.first("marks").alias("marks"), F.first("label").alias("label")).withColumnRenamed("tid", "_t")
    by_element = met.join(one.hint("merge"), F.col("tid") == F.col("_t"))
    by_element = by_element.select(F.col("element").alias("bucket"), "tid", F.lit(None).cast("double").alias("far"), "marks", "label")
    groups = write_stage(small.unionByName(by_element), "groups")
    drop_stage(met, left2, large)
    found = _in_blocks(groups, size, ["tid", "far", "marks", "label"], _may_link(settings), "bucket long, tid long, label long")
    maybe = write_stage(found.distinct(), "maybe")
    v = vectors.select(F.col("tid").alias("_v"), "keys", "times")
    added = _in_blocks(maybe, settings.chunk, ["tid", "label", "keys", "times"], _links(settings, weights), "pivot long, tid long", v)
    added = write_stage(added.distinct(), "added")
    drop_stage(groups, maybe)
    if added.limit(1).count():
        return added
    drop_stage(added)
    return None


def _in_blocks(members: DataFrame, chunk: int, columns: list[str], work, schema: str, vectors: DataFrame | None = None) -> DataFrame:
    """`work` on every two chunks of each bucket: rows (bucket, lo, hi, side) in order, side 0 for chunk lo, 1 for hi.

    `members` is a written table.
    """
    parts = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts")).withColumnRenamed("bucket", "_b")
    parts = write_stage(parts, "parts")
    dealt = members.join(parts.hint("merge"), F.col("bucket") == F.col("_b"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("tid", F.lit(1)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns(
        {"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}
    )
    if vectors is not None:
        dealt = dealt.join(vectors.hint("merge"), F.col("tid") == F.col("_v"))
    dealt = dealt.select("bucket", "lo", "hi", "side", *columns)
    return map_arrow(dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"), _groups(work), schema)


def _groups(work):
    """A function for map_arrow that gives `work` the rows of one (bucket, lo, hi) after another as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(key[:, lo])
                if held and now != last:
                    yield from work(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = now
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


def _may_link(settings: Settings):
    """Members of two chunks with a pair of other classes whose marks and distances to the pivot allow a link."""
    most = settings.samples - settings.least_agreeing

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, tid, label = (np.asarray(t[c]) for c in ("side", "tid", "label"))
        far = np.asarray(t["far"].combine_chunks().fill_null(np.nan) if t["far"].null_count else t["far"], float)
        marks = np.asarray(t["marks"].combine_chunks().flatten()).view(np.uint64).reshape(len(tid), -1)
        same = t["lo"][0] == t["hi"][0]
        rows = np.flatnonzero(side == 0)
        others = rows if same else np.flatnonzero(side == 1)
        some = np.zeros(len(tid), bool)
        for lo in range(0, len(rows), 256):
            own = rows[lo : lo + 256]
            apart = np.zeros((len(own), len(others)), np.uint8)
            for k in range(marks.shape[1]):
                x = marks[own, k][:, None] ^ marks[others, k][None]
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                apart += np.bitwise_count(x & np.uint64(0x0111111111111111))
            with np.errstate(invalid="ignore"):
                out = np.abs(far[own][:, None] - far[others][None]) > 1 - settings.similarity + 1e-9
            met = (far[own] == 0)[:, None] | (far[others] == 0)[None]  # the pivot has met all
            ok = (apart <= most) & ~out & ~met & (label[own][:, None] != label[others][None])
            some[own] |= ok.any(1)
            some[others] |= ok.any(0)
        hit = np.flatnonzero(some)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), t["bucket"][0].as_py())), pa.array(tid[hit]), pa.array(label[hit])], names=["bucket", "tid", "label"])

    return work


def _links(settings: Settings, weights: np.ndarray):
    """A spanning forest, as pairs of labels, of the links between classes among the members of two chunks."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, label = (np.asarray(t[c]) for c in ("side", "label"))
        if len(np.unique(label)) < 2:
            return
        doc, key = [], []
        for i, (k, n) in enumerate(zip(t["keys"], t["times"])):
            element, own = elements(unpacked(k, n), weights)
            key.append(element)
            doc.append((np.full(len(element), i), own))
        owner, weight = np.concatenate([d[0] for d in doc]), np.concatenate([d[1] for d in doc]).astype(float)
        total = np.bincount(owner, weights=weight, minlength=len(label))
        _, element, count = np.unique(np.concatenate(key), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        keep = count[element] > 1
        owner, column, root = owner[keep], number[element[keep]], np.sqrt(weight[keep])
        rows = np.flatnonzero(side == 0)
        others = rows if t["lo"][0] == t["hi"][0] else np.flatnonzero(side == 1)
        place = np.zeros(len(label), np.int64)
        place[rows] = np.arange(len(rows))
        place2 = np.zeros(len(label), np.int64)
        place2[others] = np.arange(len(others))
        is_row, is_other = np.zeros(len(label), bool), np.zeros(len(label), bool)
        is_row[rows], is_other[others] = True, True
        common = np.zeros((len(rows), len(others)), np.float32)
        by = np.argsort(column, kind="stable")
        owner, column, root = owner[by], column[by], root[by]
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            part = slice(*np.searchsorted(column, [lo, lo + 4096]))
            a, z = np.zeros((len(rows), 4096), np.float32), np.zeros((len(others), 4096), np.float32)
            o, c, r = owner[part], column[part] - lo, root[part]
            a[place[o[is_row[o]]], c[is_row[o]]] = r[is_row[o]]
            z[place2[o[is_other[o]]], c[is_other[o]]] = r[is_other[o]]
            common += a @ z.T
        similarity = common / np.maximum(total[rows][:, None] + total[others][None] - common, 1e-9)
        ok = (similarity >= settings.similarity - 1e-6) & (label[rows][:, None] != label[others][None])
        parent: dict[int, int] = {}

        def root_of(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(ok)):
            p, q = root_of(int(label[rows[i]])), root_of(int(label[others[j]]))
            if p != q:
                parent[p] = q
                out.append((int(label[rows[i]]), int(label[others[j]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], names=["pivot", "tid"])

    return work


CLASSES = ["doc_id", "tid", "label", "class_id", "class_size"]


def near_duplicate_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, tid, label, class_id, class_size) of every document: label, the least text id of its class, is the class'
    identity; class_id is its least doc_id, which classes without doc_ids or with equal ones share."""
    frequencies, n = document_frequencies(docs, settings)
    weights = slot_weights(frequencies, n)
    del frequencies
    sketch = write_stage(sketch_table(docs, weights, settings), "sketch")
    labels = linked_texts(sketch, docs, weights, settings)
    own = write_stage(sketch.select("doc_id", "tid"), "own")
    drop_stage(sketch)
    texts = own.groupBy("tid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    if labels is None:
        classes = texts.select(F.col("tid").alias("_t"), F.col("tid").alias("label"), F.col("least").alias("class_id"), F.col("n").alias("class_size"))
    else:
        of = texts.join(labels.select(F.col("tid").alias("_l"), "label").hint("merge"), F.col("tid") == F.col("_l"), "left")
        of = write_stage(of.select("tid", "least", "n", F.coalesce("label", "tid").alias("label")), "of")
        sums = of.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size")).withColumnRenamed("label", "_c")
        classes = of.join(sums.hint("merge"), F.col("label") == F.col("_c"))
        classes = classes.select(F.col("tid").alias("_t"), "label", "class_id", "class_size")
    classes = write_stage(classes, "classes")
    if labels is not None:
        drop_stage(labels, of)
    return own.join(classes.hint("merge"), F.col("tid") == F.col("_t")).select(*CLASSES)


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each class: a row of its least doc_id, or of a null one if it has no other."""
    found = near_duplicate_classes(docs.select("doc_id", "text"), settings).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # Of a class' rows with the least doc_id, the one with the least text id, once.
    rows = found.groupBy("label", "tid", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.groupBy("label").agg(F.min(F.struct("tid", "doc_id", "n")).alias("k"))
    tid, d, t = fresh(docs.columns, "tid", "d", "t")
    kept = write_stage(kept.select(F.col("k.tid").alias(t), F.col("k.doc_id").alias(d), F.col("k.n").alias("n")), "kept")
    one = kept.select(t, d).hint("merge")
    marked = docs.withColumn(tid, text_id()).join(one, (F.col(tid) == F.col(t)) & F.col("doc_id").eqNullSafe(F.col(d)))
    if kept.where("n > 1").limit(1).count():  # rows equal in doc_id and text
        marked = marked.dropDuplicates(["doc_id", tid])
    return marked.select(*docs.columns)
