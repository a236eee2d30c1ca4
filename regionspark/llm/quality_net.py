"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word, lower-cased and without what is no letter at its ends, has a sparse ternary index vector drawn from its
64-bit hash; each word also has a shape (case, length, marks, repetition of the words before) with an index vector of its
own. A word's context vector is the sum, over all its places in all documents, of the index vectors of the two words on
either side and of its shape. Context vectors of all words are kept in a count sketch: a table of `SLOTS` rows of fixed
number, to whose row for the word's hash a sum is added with the word's sign, and from which it is read with that sign;
other words in the row add noise of either sign. A table of one row for each word would move several times the corpus;
the sketch moves one table for each task. A document is the mean vector of its words, of its
shapes, and a few lengths. A two-layer network is fitted in numpy on a bounded sample of labelled rows, and a temperature
fitted on a part of them that the network has not seen calibrates its probabilities.

Texts are read twice: for the context vectors, and to pool every document's features, which are written once; training
and scoring read those.

Defined cases: null and empty texts get the score of a document without words; with fewer than two labels known every
score is the known label's (0 without any); equal texts get equal scores, so ties stay ties; repeated rows are scored one
by one, and of labelled rows that share a doc_id the text of least hash is learned from; an empty table gives an empty
table; extra columns are ignored, whatever their names; a long text takes about 25 times its bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import SAMPLE_ROWS, fold, labelled_ids, sigmoid, task_sums
from .tables import kept_schema, map_arrow, write_stage
from .words import LOWER, Block, blocks, hash_spans, mix, word_spans

SLOTS, SHAPES, DIM, NONZERO = 1 << 18, 512, 64, 8
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
WORDS, DOCS = 1 << 16, 2048  # pooled at a time
UNIT = 1024  # vectors of length one are integers of this length, so sums do not depend on their order
FEATURES = 2 * DIM + 3


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """A ternary vector for every 64-bit key: in each of NONZERO equal parts one place is 1 or -1; then a 1, to count."""
    part = DIM // NONZERO
    h = mix(keys)
    out = np.zeros((len(keys), DIM + 1), np.int8)
    out[:, DIM] = 1
    rows = np.arange(len(keys))
    for k in range(NONZERO):
        bits = h >> np.uint64(8 * k)
        place = (bits & np.uint64(127)).astype(np.int64) % part + k * part
        out[rows, place] = 1 - 2 * ((bits >> np.uint64(7)) & np.uint64(1)).astype(np.int8)
    return out


def shape_vectors() -> np.ndarray:
    """The shapes' index vectors, which do not count."""
    out = index_vectors(np.arange(1, SHAPES + 1, dtype=np.uint64) << np.uint64(40))
    out[:, DIM] = 0
    return out


def slots_and_signs(keys: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """The sketch's row and sign of words by their hashes."""
    h = mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return ((h >> np.uint64(1)) % np.uint64(slots)).astype(np.int64), 1 - 2 * (h & np.uint64(1)).astype(np.int8)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def words_and_shapes(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, shape) of every word of a block."""
    w = word_spans(b)
    n = len(w.starts)
    doc = w.doc
    if not n:
        return doc, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letters = np.flatnonzero(_LETTER[b.data])
    lo, hi = np.searchsorted(letters, w.starts), np.searchsorted(letters, w.ends)
    starts, ends = w.starts.copy(), w.ends.copy()
    own = hi > lo
    starts[own], ends[own] = letters[lo[own]], letters[hi[own] - 1] + 1
    key = hash_spans(LOWER[b.data], starts, ends)
    whole = hash_spans(LOWER[b.data], w.starts, w.ends)
    uppers = np.concatenate([[0], np.cumsum(_UPPER[b.data])])
    n_upper, n_letter = uppers[w.ends] - uppers[w.starts], hi - lo
    case = np.where(n_letter == 0, 3, np.where((n_upper == n_letter) & (n_letter > 1), 2, np.minimum(n_upper, 1)))
    tail = w.ends - ends
    last = b.data[w.ends - 1]
    mark = np.where(tail == 0, 0, np.where(np.isin(last, np.frombuffer(b".,;:?", np.uint8)), np.where(tail == 1, 1, 2), 3))
    size = np.minimum((w.ends - w.starts) // 6, 3)
    same = np.zeros(n, np.int64)
    for back in (2, 1):
        again = np.zeros(n, bool)
        again[back:] = (whole[back:] == whole[:-back]) & (doc[back:] == doc[:-back])
        same[again] = back
    return doc, key, ((case * 4 + mark) * 4 + size) * 4 + same


def row_sums(rows: np.ndarray, place: np.ndarray, groups: int, often: int = 48) -> np.ndarray:
    """The sums of the rows of each group: place says which group a row is in, and every group has one."""
    order = np.argsort(place, kind="stable")
    sizes = np.bincount(place, minlength=groups)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = np.zeros((groups, rows.shape[1]), np.int32)
    for g in np.flatnonzero(sizes > often):
        out[g] = rows[order[begins[g] : ends[g]]].sum(0, dtype=np.int32)
    left = np.flatnonzero(sizes <= often)
    for k in range(often):  # the k-th rows of all groups at once
        left = left[sizes[left] > k]
        if not len(left):
            break
        out[left] += rows[order[begins[left] + k]]
    return out


def contexts(doc: np.ndarray, key: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, place of each word among them, their index vectors, their summed context vectors)."""
    distinct, place = np.unique(key, return_inverse=True)
    own = index_vectors(distinct)
    each = own[place]
    around = shape_vectors()[shape]
    for back in (1, 2):
        apart = np.flatnonzero(doc[back:] != doc[:-back])
        for near, at in ((each[:-back], slice(back, None)), (each[back:], slice(None, -back))):
            around[at] += near
            around[at][apart] -= near[apart]
    return distinct, place, own, row_sums(around, place, len(distinct))


def add_contexts(total: np.ndarray, batch: pa.RecordBatch) -> None:
    """Add a batch's context vectors to the sketch's rows, and to each shape's row the index vectors of its words."""
    slots = len(total) - SHAPES
    for b in blocks(batch.column("text")):
        doc, key, shape = words_and_shapes(b)
        if not len(key):
            continue
        distinct, place, own, sums = contexts(doc, key, shape)
        slot, sign = slots_and_signs(distinct, slots)
        rows, group = np.unique(slot, return_inverse=True)
        total[rows] += row_sums(sums * sign[:, None], group, len(rows))
        times, n = np.unique(shape * len(distinct) + place, return_counts=True)
        rows, group = np.unique(times // len(distinct), return_inverse=True)
        total[slots + rows] += row_sums(own[times % len(distinct)] * n[:, None], group, len(rows))


def unit_vectors(total: np.ndarray) -> np.ndarray:
    """Of each row what it has beyond as many words of the corpus taken at random, at length UNIT, in whole numbers."""
    everything = total[-SHAPES:].sum(0)
    mean = everything[:DIM] / max(int(everything[DIM]), 1)
    out = np.zeros((len(total), DIM), np.int16)
    for lo in range(0, len(total), 1 << 14):
        c = total[lo : lo + (1 << 14)].astype(np.float64)
        c = c[:, :DIM] - c[:, DIM:] * mean
        out[lo : lo + len(c)] = np.rint(c * (UNIT / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)))
    return out


def pooled(b: Block, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each document of a block: mean word vector, mean shape vector, lengths, repeats and marks."""
    doc, key, shape = words_and_shapes(b)
    counts = np.bincount(doc, minlength=b.docs)
    ends = np.cumsum(counts)
    slots = len(vectors) - SHAPES
    sums = np.zeros((b.docs, 2 * DIM), np.int64)
    for lo in range(0, len(key), WORDS):
        slot, sign = slots_and_signs(key[lo : lo + WORDS], slots)
        own = vectors[slot] * sign[:, None]
        for i in np.unique(doc[lo : lo + WORDS]):
            a, z = max(ends[i] - counts[i] - lo, 0), ends[i] - lo
            sums[i, :DIM] += own[a:z].sum(0, dtype=np.int32)
    for lo in range(0, b.docs, DOCS):
        n = min(DOCS, b.docs - lo)
        part = slice(*np.searchsorted(doc, [lo, lo + n]))
        seen = np.bincount((doc[part] - lo) * SHAPES + shape[part], minlength=n * SHAPES).reshape(n, SHAPES)
        sums[lo : lo + n, DIM:] = np.rint(seen.astype(np.float64) @ vectors[slots:].astype(np.float64))
    repeats = np.bincount(doc, weights=shape % 4 > 0, minlength=b.docs)
    marks = np.bincount(doc, weights=shape // 16 % 4 == 3, minlength=b.docs)
    one = np.maximum(counts, 1)[:, None]
    return np.hstack([sums / (one * UNIT), np.log1p(counts)[:, None] / 5, np.stack([repeats, marks], 1) / one])


@dataclass(frozen=True)
class Network:
    """Two layers over standardised features; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else sigmoid(self.logits(x) / self.temperature)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Adam on the log loss over four fifths of the rows, then the temperature of least log loss on the last fifth."""
    n, d = x.shape
    if len(np.unique(y)) < 2:
        zero = np.zeros(d)
        return Network(zero, zero + 1, np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0, float(y[0]) if n else 0.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(n)
    held, own = order[: n // 5], order[n // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z = (x[own] - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t = 0
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(len(own))
        for lo in range(0, len(own), BATCH):
            i = shuffled[lo : lo + BATCH]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            g = (sigmoid(h @ p[2] + p[3][0]) - y[own[i]]) / len(i)
            gh = np.outer(g, p[2]) * (h > 0)
            grads = [z[i].T @ gh + DECAY * p[0], gh.sum(0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(held):
        logits = net.logits(x[held])
        loss = lambda s: -np.mean(np.log(np.where(y[held] == 1, s, 1 - s) + 1e-12))
        grid = np.exp(np.linspace(-4, 2.5, 131))
        best = min(grid, key=lambda k: loss(sigmoid(logits / k)))
        net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(best))
    return net


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    network: Network


def word_vectors(docs: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """The sketch of all words' context vectors, then the shapes' rows."""
    return task_sums(docs.select("text"), add_contexts, (slots + SHAPES, DIM + 1), unit_vectors)


def features(docs: DataFrame, vectors: np.ndarray, names: list[str], out: str = "x") -> DataFrame:
    """Columns `names` of every document and its features. The vectors are a table of fixed size, sent once."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                flat = pa.array(pooled(b, shared.value).astype(np.float32).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.docs + 1, dtype=np.int32) * FEATURES), flat)
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(b.lo, b.docs) for n in names], lists], names=[*names, out])

    own = docs.select(*dict.fromkeys([*names, "text"]))
    return map_arrow(own, run, f"{kept_schema(docs, names)}, `{out}` array<float>")


def train_network(table: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """The network from the features (doc_id, x) of at most `rows` labelled documents."""
    picked = labelled_ids(labels, "quality", rows)
    own = table.select("doc_id", "x").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    one = own.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.x", "r.label")
    got = one.toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), FEATURES)
    return fit(x, got["label"].to_numpy(float))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Word vectors from all documents, the network from at most `rows` labelled ones."""
    vectors = word_vectors(docs)
    return Model(vectors, train_network(features(docs, vectors, ["doc_id"]), labels, rows))


def network_scores(table: DataFrame, network: Network, names: list[str], x: str = "x", out: str = "score") -> DataFrame:
    """Columns `names` of a table of features and the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.asarray(batch.column(x).flatten()).reshape(-1, FEATURES)
            made = pa.array(network.scores(held.astype(float)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], names=[*names, out])

    return map_arrow(table, run, f"{kept_schema(table, names)}, `{out}` double")


def score(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """Columns `names` of every document and its score."""
    return network_scores(features(docs, model.vectors, names), model.network, names)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    table = write_stage(features(docs, word_vectors(docs), ["doc_id"]), "pooled")
    scored = network_scores(table, train_network(table, labels), ["doc_id"])
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
