"""Language-model scoring by deleted interpolation.

The probability of a token after a context mixes three estimates, with weights that depend on how often the context was
seen: the bigram's and the unigram's maximum-likelihood estimates and the uniform 1 / (V + 1). Weights are learned by
expectation-maximisation on the bigrams of held-out training documents (`DEV_FOLD`) under counts of the others; final
counts are those of all training documents.

How counts are made: texts become chunks of about `chunk_tokens` tokens with a vocabulary of their own. A chunk sends
each distinct n-gram once, as a hash, to the bucket that owns its hash range; the bucket adds up and sends totals back
(`exchange`, which goes through relays where there are many chunks). So no word, however frequent, is sent more than
once by a chunk, no row is made per token, and no table of all n-grams meets in one place. For the weights, buckets
reduce held-out bigrams to cells of (context bucket, log2 of both estimates in halves), of which there is a fixed number;
a cell keeps its mean estimates, so within a cell EM sees the mean. Words and bigrams are known by 64-bit hashes.

Tokens: words with A-Z lower-cased, then one end token; the end token of one text is the context of the next one's first
word. Defined cases: null and empty texts are the end token alone; null doc_ids are training rows; equal rows get equal
scores; without training tokens every estimate is uniform; an empty table gives an empty table; extra columns, whatever
their names, are ignored; a text longer than a chunk is a chunk of its own, which takes about 15 times its bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import fold
from .packed import expand, squeeze
from .tables import drop_stage, map_arrow, release, write_stage
from .words import _Q, LOWER, blocks, hash_spans, mix, word_spans

FOLDS, HELD_OUT_FOLD, DEV_FOLD = 7, 2, 3
FIT, DEV, HELD_OUT = 0, 1, 2
CONTEXT_BUCKETS = 16
END_HASH = np.uint64(0x5851F42D4C957F2D)
BINS = 64  # of log2 of an estimate, from 0 (never) and 1 (about 2**-31) upwards in halves
DIRECT = 4096  # chunks up to which every chunk sends to every bucket itself

CHUNK = (
    "chunk long, doc_ids array<long>, roles binary, lengths binary, vocabulary binary, tokens binary, n_tokens long, "
    "n_fit long, n_dev long"
)


def _chunks(chunk_tokens: int):
    names = [f.split()[0] for f in CHUNK.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = [i for h in held for i in h[0]]
            roles, lengths, tokens = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            vocabulary, local = np.unique(tokens, return_inverse=True)
            role_of = np.repeat(roles, lengths)
            packed = [squeeze(roles), squeeze(lengths), squeeze(vocabulary, True), squeeze(local.astype(np.uint32))]
            counts = [len(tokens), int((role_of == FIT).sum()), int((role_of == DEV).sum())]
            columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64()))]
            columns += [pa.array([x], pa.binary()) for x in packed] + [pa.array([n]) for n in counts]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            role = np.asarray(batch.column("role")).astype(np.uint8)
            for b in blocks(batch.column("text")):
                w = word_spans(b)
                h = hash_spans(LOWER[b.data], w.starts, w.ends)
                lengths = (w.counts + 1).astype(np.int32)
                tokens = np.full(len(h) + b.docs, END_HASH, np.uint64)
                tokens[np.arange(len(h)) + w.doc] = h
                held.append((batch.column("doc_id").slice(b.lo, b.docs).to_pylist(), role[b.lo : b.hi], lengths, tokens))
                size += len(tokens)
                if size >= chunk_tokens:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return make


def chunk_table(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """Tokens of all documents, in chunks: columns as in CHUNK."""
    remainder = fold(FOLDS)
    role = F.when(remainder == HELD_OUT_FOLD, HELD_OUT).when(remainder == DEV_FOLD, DEV).otherwise(FIT)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", role.alias("role"))
    return map_arrow(own, _chunks(chunk_tokens), CHUNK)


@dataclass
class Chunk:
    """A chunk as arrays; contexts are local ids, the end token's before a text's first word."""

    roles: np.ndarray
    lengths: np.ndarray
    vocabulary: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        return cls(
            expand(row["roles"], "u1"), expand(row["lengths"], "i4"), expand(row["vocabulary"], "u8", True), expand(row["tokens"], "u4")
        )

    @property
    def role_of(self) -> np.ndarray:
        return np.repeat(self.roles, self.lengths)

    @property
    def contexts(self) -> np.ndarray:
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[0] = np.searchsorted(self.vocabulary, END_HASH)
        return before

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes of the distinct bigrams, the place among them of each token's)."""
        h = mix(self.vocabulary[self.contexts] * _Q + self.vocabulary[self.tokens])
        return np.unique(h, return_inverse=True)

    def sums(self, place: np.ndarray, n: int, role: int) -> np.ndarray:
        return np.bincount(place[self.role_of == role], minlength=n).astype(np.uint64)


@lru_cache(64)
def _cuts(lo: int, hi: int, step: int, buckets: int) -> tuple[list[int], np.ndarray]:
    """Every `step`-th bucket of lo..hi-1, and the least hashes of all but the first of them."""
    begins = list(range(lo, hi, step))
    return begins, np.array([(b << 64) // buckets for b in begins[1:]], np.uint64)


def _parts(keys: np.ndarray, lo: int, hi: int, buckets: int, step: int = 1) -> Iterator[tuple[int, slice]]:
    """(first bucket, slice of the sorted keys) of every `step` buckets of lo..hi-1 that have keys."""
    begins, least = _cuts(lo, hi, step, buckets)
    cuts = [0, *np.searchsorted(keys, least).tolist(), len(keys)]
    for bucket, a, z in zip(begins, cuts, cuts[1:]):
        if z > a:
            yield bucket, slice(a, z)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


MESSAGE = "unit long, bucket int, keys binary, fit binary, dev binary, extra binary"
_MESSAGE_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


@dataclass
class Counts:
    """Distinct sorted keys with counts under both roles and, of keys with held-out counts, those of context and word."""

    keys: np.ndarray
    fit: np.ndarray
    dev: np.ndarray
    context: np.ndarray
    word: np.ndarray

    def message(self, unit: int, bucket: int, part: slice) -> tuple:
        some = np.flatnonzero(self.dev[part]) + part.start
        extra = squeeze(np.concatenate([self.context[some], self.word[some]]))
        return unit, bucket, squeeze(self.keys[part], True), squeeze(self.fit[part]), squeeze(self.dev[part]), extra

    @classmethod
    def of(cls, messages: pd.DataFrame) -> tuple[Counts, list[np.ndarray]]:
        """The messages' sum, and the place of each message's keys in it."""
        keys = [expand(k, "u8", True) for k in messages["keys"]]
        fit, dev = ([expand(x, "u8") for x in messages[c]] for c in ("fit", "dev"))
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        places = [place[e - len(k) : e] for k, e in zip(keys, ends)]
        out = cls(distinct, *(np.zeros(len(distinct), np.uint64) for _ in range(4)))
        for at, f, d, extra in zip(places, fit, dev, messages["extra"]):
            out.fit[at] += f
            out.dev[at] += d
            both, some = expand(extra, "u8"), at[d > 0]
            out.context[some], out.word[some] = both[: len(some)], both[len(some) :]
        return out, places


def _batch(messages: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*messages), _MESSAGE_TYPES)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in MESSAGE.split(", ")])


def _send_words(buckets: int, step: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk.of(row)
            n = len(c.vocabulary)
            none = np.zeros(n, np.uint64)
            counts = Counts(c.vocabulary, c.sums(c.tokens, n, FIT), c.sums(c.tokens, n, DEV), none, none)
            yield _batch([counts.message(row["chunk"], b, part) for b, part in _parts(counts.keys, 0, buckets, buckets, step)])

    return send


def _returned(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    ordered = sorted(parts, key=lambda r: r["bucket"])
    return tuple(np.concatenate([expand(r[k], "u8") for r in ordered]) for k in ("fit", "dev"))


def _send_bigrams(buckets: int, step: int):
    """Distinct bigrams with their counts; where held-out counts are among them, also what their weights need."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk.of(row)
            word_fit, _ = _returned(row["words"])
            keys, place = c.bigrams()
            n = len(keys)
            counts = Counts(keys, c.sums(place, n, FIT), c.sums(place, n, DEV), np.zeros(n, np.uint64), np.zeros(n, np.uint64))
            counts.context[place], counts.word[place] = word_fit[c.contexts], word_fit[c.tokens]
            yield _batch([counts.message(row["chunk"], b, part) for b, part in _parts(keys, 0, buckets, buckets, step)])

    return send


def _bins(f: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        halves = np.floor(2 * np.log2(np.where(f > 0, f, 1))) + BINS - 1
    return np.where(f > 0, np.clip(halves, 1, BINS - 1), 0).astype(np.int64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the floor of log2, as far as the last bucket."""
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(int) + 1, CONTEXT_BUCKETS - 1), 0)


def cells_of(context: np.ndarray, fit: np.ndarray, word: np.ndarray, weight: np.ndarray, n_fit: int) -> list[tuple]:
    """(cell, weight, sum of bigram estimates, sum of unigram estimates) of held-out bigrams."""
    f2, f1 = fit / np.maximum(context, 1), word / max(n_fit, 1)
    cell = (context_bucket(context) * BINS + _bins(f2)) * BINS + _bins(f1)
    cells, which = np.unique(cell, return_inverse=True)
    sums = [np.bincount(which, weights=weight * x) for x in (np.ones(len(cell)), f2, f1)]
    return [(int(k), *map(float, s)) for k, s in zip(cells, zip(*sums))]


ANSWER = "kind int, bucket int, unit long, fit binary, dev binary, cell int, weight double, sum2 double, sum1 double, distinct long"
_COUNTS, _CELL, _DISTINCT = 0, 1, 2


def _merge(n_fit: int, with_cells: bool):
    """A bucket's answer: totals for each unit's keys, the number of distinct training keys and, if wanted, cells."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(key[0])
        total, places = Counts.of(group)
        made = [
            (_COUNTS, bucket, int(unit), squeeze(total.fit[at]), squeeze(total.dev[at]), 0, 0.0, 0.0, 0.0, 0)
            for unit, at in zip(group["unit"], places)
        ]
        made.append((_DISTINCT, bucket, -1, None, None, 0, 0.0, 0.0, 0.0, int((total.fit + total.dev > 0).sum())))
        if with_cells:
            seen = np.flatnonzero(total.dev)
            found = cells_of(total.context[seen], total.fit[seen], total.word[seen], total.dev[seen].astype(float), n_fit)
            made += [(_CELL, bucket, -1, None, None, *cell, 0) for cell in found]
        return pd.DataFrame(made, columns=[f.split()[0] for f in ANSWER.split(", ")])

    return merge


def _relay(buckets: int, step: int):
    """What many units send to `step` buckets as one unit's messages to each of them."""

    def relay(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lo = int(group["bucket"].iloc[0])
        total, _ = Counts.of(group)
        parts = _parts(total.keys, lo, min(lo + step, buckets), buckets)
        made = [total.message(int(key[0]), bucket, part) for bucket, part in parts]
        return pd.DataFrame(made, columns=[f.split()[0] for f in MESSAGE.split(", ")])

    return relay


def _hand_back(key: tuple, sent: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A relay's answers for each of its units."""
    fit, dev = _returned(answers.to_dict("records"))
    _, places = Counts.of(sent)
    made = [(int(b), int(unit), squeeze(fit[at]), squeeze(dev[at])) for b, unit, at in zip(sent["bucket"], sent["unit"], places)]
    return pd.DataFrame(made, columns=["bucket", "unit", "fit", "dev"])


@dataclass
class Exchanged:
    """counts: (unit, bucket, fit, dev) for each message; said: the rows of the other kinds of ANSWER; sent: what relays
    were sent, which nothing reads again."""

    counts: DataFrame
    said: DataFrame
    sent: DataFrame | None = None


def exchange(source: DataFrame, send, buckets: int, units: int, n_fit: int, cells: bool, name: str, direct: int) -> Exchanged:
    """Totals for all keys that `send` makes of the rows of `source`.

    Up to `direct` units, each sends to all buckets: units times buckets messages. Beyond, a unit sends one message for
    `step` buckets, relays add up what a group of about `step` units sends them, and send that on: with step the root of
    the number of buckets, messages grow with units times that root, and a relay holds about as much as a bucket.
    """
    answer = lambda messages: messages.groupBy("bucket").applyInPandas(_merge(n_fit, cells), ANSWER)
    if units <= direct:
        found = write_stage(answer(map_arrow(source, send(buckets, 1), MESSAGE)), name)
        counts = found.where(F.col("kind") == _COUNTS).select("unit", "bucket", "fit", "dev")
        return Exchanged(counts, found.where(F.col("kind") != _COUNTS))
    step = max(2, int(buckets**0.5))
    groups = -(-units // step)
    to = F.pmod(F.xxhash64("unit"), F.lit(groups)) * buckets + F.col("bucket")
    sent = write_stage(map_arrow(source, send(buckets, step), MESSAGE).withColumn("relay", to), f"{name}-sent")
    passed = sent.groupBy("relay").applyInPandas(_relay(buckets, step), MESSAGE)
    found = write_stage(answer(passed), name)
    answers = found.where(F.col("kind") == _COUNTS).select(F.col("unit").alias("to"), "bucket", "fit", "dev")
    back = sent.groupBy("relay").cogroup(answers.groupBy("to")).applyInPandas(_hand_back, "bucket int, unit long, fit binary, dev binary")
    counts = write_stage(back, f"{name}-back")
    return Exchanged(counts, found.where(F.col("kind") != _COUNTS), sent)


def fit_weights(cells: np.ndarray, vocabulary: int, rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per context bucket from rows (cell, weight, sum of f2, sum of f1).

    A bucket without held-out bigrams takes the weights of the nearest bucket below it that has some.
    """
    out = np.zeros((CONTEXT_BUCKETS, 3))
    last = np.array([0.0, 0.5, 0.5])
    for b in range(CONTEXT_BUCKETS):
        own = cells[cells[:, 0] // BINS**2 == b] if len(cells) else cells
        if len(own):
            n = own[:, 1]
            last = expectation_maximisation(own[:, 2] / n, own[:, 3] / n, n, vocabulary, rounds)
        out[b] = last
        if b == 0:  # a context never seen has no bigram estimate
            out[0, 0] = 0
            out[0] /= out[0].sum()
    return out


def expectation_maximisation(f2: np.ndarray, f1: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = 200) -> np.ndarray:
    """The mixture weights of the three estimates that make held-out counts `n` likeliest."""
    p = np.stack([f2, f1, np.full(len(n), 1 / (vocabulary + 1))], 1)
    w = np.array([0.4, 0.4, 0.2])
    for _ in range(rounds):
        part = p * w
        part /= part.sum(1, keepdims=True)
        w = (part * n[:, None]).sum(0) / n.sum()
    w = np.maximum(w, [0, 1e-6, 1e-6])
    return w / w.sum()


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(weights: np.ndarray, train_tokens: int, vocabulary: int):
    names = [f.split()[0] for f in SCORED.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk.of(row)
            word = sum(_returned(row["words"])).astype(float)
            bigram = sum(_returned(row["bigrams"])).astype(float)
            _, place = c.bigrams()
            context, own = word[c.contexts], word[c.tokens]
            w = weights[context_bucket(context)]
            p = w[:, 0] * bigram[place] / np.maximum(context, 1) + w[:, 1] * own / max(train_tokens, 1) + w[:, 2] / (vocabulary + 1)
            begins = np.cumsum(c.lengths) - c.lengths
            add = lambda x: np.add.reduceat(x, begins)
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(c.roles == HELD_OUT), pa.array(c.lengths.astype(np.int64))]
            columns += [pa.array(add((own > 0).astype(np.int64))), pa.array(np.full(len(begins), train_tokens, np.int64))]
            columns += [pa.array(add(np.log10((own + 1) / (train_tokens + vocabulary + 1)))), pa.array(add(np.log10(p)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return score


def score_documents(docs: DataFrame, chunk_tokens: int = 1 << 20, bucket_tokens: int = 4 << 20, direct: int = DIRECT) -> DataFrame:
    """Every document's base score and its score under the model learned from the training documents."""
    spark = docs.sparkSession
    chunks = write_stage(chunk_table(docs, chunk_tokens), "chunks")
    sums = [F.sum(f"n_{c}").alias(c) for c in ("tokens", "fit", "dev")]
    n = chunks.agg(F.count(F.lit(1)).alias("units"), *sums).first()
    if not n["tokens"]:
        return spark.createDataFrame([], SCORED)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n["tokens"] // bucket_tokens))

    def exchanged(source: DataFrame, send, cells: bool, name: str) -> Exchanged:
        return exchange(source, send, buckets, n["units"], n["fit"], cells, name, direct)

    def returned(found: Exchanged, name: str) -> DataFrame:
        parts = found.counts.select(F.col("unit").alias(f"_{name}"), F.struct("bucket", "fit", "dev").alias("part"))
        return parts.groupBy(f"_{name}").agg(F.collect_list("part").alias(name))

    words = exchanged(chunks, _send_words, False, "words")
    vocabulary = words.said.where(F.col("kind") == _DISTINCT).agg(F.sum("distinct").alias("n")).first()["n"]
    with_words = chunks.join(returned(words, "words"), F.col("chunk") == F.col("_words")).drop("_words")
    bigrams = exchanged(with_words, _send_bigrams, True, "bigrams")
    cells = bigrams.said.where(F.col("kind") == _CELL).groupBy("cell")
    cells = cells.agg(F.sum("weight").alias("n"), F.sum("sum2").alias("a"), F.sum("sum1").alias("b")).orderBy("cell").collect()
    drop_stage(words.sent, bigrams.sent)
    release(spark)  # the messages' shuffle files, before the last join writes its own
    weights = fit_weights(np.array([[r["cell"], r["n"], r["a"], r["b"]] for r in cells], float).reshape(-1, 4), vocabulary)
    whole = with_words.join(returned(bigrams, "bigrams"), F.col("chunk") == F.col("_bigrams")).drop("_bigrams")
    return map_arrow(whole, _score(weights, n["fit"] + n["dev"], vocabulary), SCORED)
