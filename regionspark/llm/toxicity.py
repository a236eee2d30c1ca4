"""Toxicity by noisy-channel deobfuscation.

A character language model (trigrams over letters and word ends, counted over all documents) is the source; leetspeak,
spacing and repetition are the channel. Words that show one of the three, and runs of words of one character, become a
lattice of readings, in which a separator may be a word end; Viterbi decoding finds the likeliest, and documents are
scored on their restored words by a logistic model over all words that tell labelled toxic documents of a bounded sample
from clean ones; its design matrix is sparse. A word tells if at least `LEAST_DOCS` toxic documents of the sample hold it
and it is likelier in them; words of fewer documents make held-out results worse (README has the figures).

Defined cases: null and empty texts get the model's score of a document without words; with no labelled rows every score
is 0; equal texts get equal scores, so ties stay ties; repeated rows are scored one by one, and of labelled rows that
share a doc_id the text of least hash is learned from; an empty table gives an empty table; extra columns, whatever their
names, are ignored by the scores and kept by drop_toxic; a run of characters of any length is decoded as one word, by
the exact likeliest path: what all paths share is spelled and let go every `SHARED` characters; a long text takes about
20 times its bytes of memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import SAMPLE_ROWS, Ones, fit_logistic, fold, labelled_sample, sigmoid, task_sums
from .tables import drop_stage, fresh, kept_schema, map_arrow, write_stage
from .words import LOWER, SPACE, Block, Words, blocks, group_sizes, hash_spans, word_spans

END, OTHER, LETTERS = 0, 27, 28
# Readings of characters that stand for letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e"}
SEPARATORS = " .-_*~'"
STEP_COSTS = {"letter": 0.0, "leet": 0.7, "dropped repeat": 0.3, "dropped separator": 0.2, "kept mark": 12.0}
LEAST_DOCS = 4
LONGEST, SHARED = 48, 1024  # characters of what is kept once decoded; after which paths are searched for what they share


def _codes() -> np.ndarray:
    table = np.full(256, END, np.uint8)
    table[65:91] = np.arange(1, 27)
    table[97:123] = np.arange(1, 27)
    table[0xC3:] = OTHER
    return table


_CODE = _codes()
_IS_LETTER = (_CODE > 0) | (np.arange(256) >= 0x80)
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[ord(c) for c in LEET if ord(c) < 128]] = True
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[ord(c) for c in SEPARATORS if c != " "]] = True
_KEEP = np.ones(256, bool)
_KEEP[0x80:0xC0] = False


def count_characters(total: np.ndarray, batch: pa.RecordBatch) -> None:
    """Add the letter trigrams of a batch's words to a (LETTERS,)*3 array."""
    for b in blocks(batch.column("text")):
        codes = np.where(b.data >= 0x80, np.where(_KEEP[b.data], OTHER, 255), _CODE[b.data]).astype(np.int32)
        codes = np.concatenate([[END], codes[codes != 255], [END]])
        if len(codes) > 2:
            key = (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]
            key = key[(codes[2:] > 0) | (codes[1:-1] > 0)]
            total += np.bincount(key, minlength=LETTERS**3).reshape(total.shape)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) from trigram counts, interpolated with the bigrams and letters below them.

    After a word end nothing of the word before counts.
    """
    counts = counts.astype(float).copy()
    counts[:, END] = counts[:, END].sum(0)
    two, one = counts.sum(0), counts.sum((0, 1))
    p1 = (one + 1) / (one.sum() + LETTERS)
    p2 = (two + 50 * p1) / (two.sum(-1, keepdims=True) + 50)
    p3 = (counts + 20 * p2[None]) / (counts.sum(-1, keepdims=True) + 20)
    return np.log(p3)


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else END


class Decoder:
    """Viterbi decoding of one obfuscated word, or of a run of words of one character, at a time."""

    def __init__(self, log_p: np.ndarray):
        self.log_p = log_p.tolist()
        self.known: dict[tuple[str, bool], str] = {}

    def readings(self, raw: str) -> set[str]:
        """The words behind `raw`: with and without the marks at its ends, as one word and, at separators, as several."""
        found: set[str] = set()
        for text in {raw.strip(".,;:?\"()[]{}<>#%&*"), _ENDS.sub("", raw)}:
            found.update(_WORD.findall(self.restore(text)))
            if any(c in SEPARATORS for c in text):
                found.update(_WORD.findall(self.restore(text, True)))
        return found

    def restore(self, word: str, apart: bool = False) -> str:
        """The likeliest letters behind `word`; with `apart` separators may be word ends, which become spaces."""
        if len(word) > LONGEST:
            return self._viterbi(word.lower(), apart)
        found = self.known.get((word, apart))
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[word, apart] = self._viterbi(word.lower(), apart)
        return found

    def _viterbi(self, word: str, apart: bool) -> str:
        log_p, cost = self.log_p, STEP_COSTS
        done: list[str] = []
        # A path is [the path before, its last characters, how many it has]; paths share their beginnings.
        best: dict[tuple[int, int, str], tuple[float, list]] = {(END, END, ""): (0.0, [None, "", 0])}
        for at, c in enumerate(word):
            if at and at % SHARED == 0:
                done.append(_let_go([text for _, text in best.values()]))
            run = at and word[at - 1] == c
            readings = [(r, cost["leet"]) for r in LEET.get(c, "")]
            if c.isalpha():
                readings.append((c, cost["letter"]))
            new: dict[tuple[int, int, str], tuple[float, list]] = {}
            for (a, b, last), (score, text) in best.items():
                options = [((b, _code(r), r), score + log_p[a][b][_code(r)] - k, [text, r, text[2] + 1]) for r, k in readings]
                if run:
                    options.append(((a, b, last), score - cost["dropped repeat"], text))
                if c in SEPARATORS:
                    options.append(((a, b, last), score - cost["dropped separator"], text))
                    if apart and b != END:
                        options.append(((END, END, ""), score + log_p[a][b][END] - cost["dropped separator"], [text, " ", text[2] + 1]))
                elif not c.isalpha():
                    options.append(((a, b, last), score - cost["kept mark"], text))
                for state, s, t in options:
                    if state not in new or s > new[state][0]:
                        new[state] = (s, t)
            best = new
        _, text = max(((score + (log_p[a][b][END] if b != END else 0.0), text) for (a, b, _), (score, text) in best.items()), key=lambda x: x[0])
        return "".join([*done, _spelled(text)])


def _spelled(path: list | None) -> str:
    out = []
    while path is not None:
        out.append(path[1])
        path = path[0]
    return "".join(reversed(out))


def _let_go(paths: list[list]) -> str:
    """What all these paths begin with, which is cut off them."""
    ends = {id(p): p for p in paths}
    while len(ends) > 1:  # the longest goes a step back until all meet
        longest = max(ends.values(), key=lambda p: p[2])
        del ends[id(longest)]
        ends[id(longest[0])] = longest[0]
    (shared,) = ends.values()
    text = _spelled(shared)
    shared[0], shared[1] = None, ""
    return text


def suspects(b: Block, w: Words) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(first word, last word) of the words that look obfuscated and of the runs of words of one character.

    Words with a letter and with marks beside letters, repeated letters or separators between single characters; runs
    with a letter of three words or more that are a letter, with punctuation or without, or a mark.
    """
    none = np.zeros(0, np.int64)
    if not len(w.starts):
        return (none, none), (none, none)
    d, starts, ends = b.data, w.starts, w.ends
    letter, low, mark = _IS_LETTER[d], LOWER[d], _IS_MARK[d]
    digit = (d >= 48) & (d < 58)
    found = []

    def add(hit: np.ndarray, size: int) -> None:
        """Words that hold `size` bytes from a hit on."""
        at = np.flatnonzero(hit)
        word = np.searchsorted(starts, at, "right") - 1
        found.append(word[(word >= 0) & (at + size <= ends[word])])

    add(mark[:-1] & letter[1:], 2)
    add(letter[:-1] & (mark | digit)[1:], 2)
    add((low[1:] == low[:-1]) & letter[1:] & (d[1:] < 0x80), 2)
    split = _IS_SEPARATOR[d[1:-1]] & (letter | mark)[:-2] & (letter | mark)[2:]
    add(split[:-2] & split[2:], 5)
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.stack([starts, ends])], axis=0)[0]
    letters, digits, size = count(letter & _KEEP[d]), count(digit), ends - starts
    words = np.unique(np.concatenate(found))
    words = words[letters[words] > 0]
    single = ((letters == 1) & (digits == 0) & (size <= 4)) | ((size == 1) & mark[starts])
    doc = w.doc
    joined = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
    first, last = edges[::2], edges[1::2]
    so_far = np.concatenate([[0], np.cumsum(letters)])
    keep = (last - first >= 2) & (so_far[last + 1] > so_far[first])
    return (words, words), (first[keep], last[keep])


def _strip(b: Block, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words without what is no letter at their ends, and which words have one."""
    letters = np.flatnonzero(_IS_LETTER[b.data])
    lo, hi = np.searchsorted(letters, w.starts), np.searchsorted(letters, w.ends)
    own = np.flatnonzero(hi > lo)
    return letters[lo[own]], letters[hi[own] - 1] + 1, own


_WORD = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"\A[\W\d_]+|[\W\d_]+\Z")


def restored_words(b: Block, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the lower-cased words of a block, with those that the decoder restored."""
    w = word_spans(b)
    starts, ends, own = _strip(b, w)
    doc, key = w.doc[own], hash_spans(LOWER[b.data], starts, ends)
    docs, keys, word_doc = [doc], [key], w.doc
    for first, last in suspects(b, w):
        # What a block holds several times is decoded once.
        _, one, which = np.unique(hash_spans(b.data, w.starts[first], w.ends[last]), return_index=True, return_inverse=True)
        made = [sorted(decoder.readings(b.data[w.starts[first[k]] : w.ends[last[k]]].tobytes().decode("utf-8", "replace"))) for k in one]
        flat = [x.encode() for found in made for x in found]
        if flat:
            sizes = np.array([len(x) for x in flat])
            begin = np.cumsum(sizes + 1) - sizes - 1
            hashes = hash_spans(np.frombuffer(b" ".join(flat), np.uint8), begin, begin + sizes)
            n = np.array([len(found) for found in made])
            times = n[which]
            place = np.arange(times.sum()) + np.repeat((np.cumsum(n) - n)[which] - (np.cumsum(times) - times), times)
            docs.append(np.repeat(word_doc[first], times))
            keys.append(hashes[place])
    return np.concatenate(docs), np.concatenate(keys)


@dataclass(frozen=True)
class Model:
    log_p: np.ndarray
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float
    trained: bool = True

    def scores(self, column: pa.Array, decoder: Decoder) -> np.ndarray:
        out = np.zeros(len(column))
        if not self.trained:
            return out
        for b in blocks(column):
            z = np.full(b.docs, self.intercept)
            doc, slot = _hits(b, decoder, self.words)
            np.add.at(z, doc, self.weights[slot])
            out[b.lo : b.hi] = sigmoid(z)
        return out


def _hits(b: Block, decoder: Decoder, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, index in `words`) of a block."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, key = restored_words(b, decoder)
    slot = np.minimum(np.searchsorted(words, key), len(words) - 1)
    own = words[slot] == key
    both = np.unique(doc[own] * len(words) + slot[own])
    return both // len(words), both % len(words)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The character model from all documents, the word weights from at most `rows` labelled ones, which are written once."""
    log_p = language_model(task_sums(docs.select("text"), count_characters, (LETTERS,) * 3))
    sample = labelled_sample(docs, labels, "toxic", rows)
    sizes = sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["label"]: r["n"] for r in sizes}
    if not n.get(1) or not n.get(0):
        drop_stage(sample)
        return Model(log_p, np.zeros(0, np.uint64), np.zeros(0), 0.0, False)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(log_p)
        for batch in batches:
            for b in blocks(batch.column("text")):
                doc, key = restored_words(b, decoder)
                order, begins, _ = group_sizes(doc, key)
                one = order[begins]
                one = one[np.argsort(doc[one], kind="stable")]
                cuts = np.searchsorted(doc[one], np.arange(b.docs + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(key[one].view(np.int64)))
                columns = [batch.column("doc_id").slice(b.lo, b.docs).cast(pa.int64()), batch.column("label").slice(b.lo, b.docs), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "words"])

    # The distinct restored words of the sample's documents: as bounded as the sample.
    held = write_stage(map_arrow(sample, restored, "doc_id long, label int, words array<long>"), "words")
    drop_stage(sample)
    counts = held.select("label", F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("all"))
    bad, good = F.col("bad"), F.col("all") - F.col("bad")
    odds = F.log((bad + 0.5) / (good + 0.5) * F.lit(n[0] / n[1]))
    told = counts.where((bad >= LEAST_DOCS) & (odds > 0)).select("word")
    words = np.sort(np.array([r["word"] for r in told.collect()], np.int64).view(np.uint64))
    if not len(words):
        drop_stage(held)
        return Model(log_p, words, np.zeros(0), float(np.log(n[1] / n[0])))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_slots(x.values, words).tobytes() for x in batch.column("words")]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "slots"])

    gathered = map_arrow(held, rows_of, "doc_id long, label int, slots binary").toPandas().sort_values("doc_id", kind="stable")
    drop_stage(held)
    slots = [np.frombuffer(x, "<i4") for x in gathered["slots"]]
    x = Ones(np.repeat(np.arange(len(slots)), [len(k) for k in slots]), np.concatenate(slots), (len(slots), len(words)))
    weights, intercept = fit_logistic(x, gathered["label"].to_numpy(float), penalty=0.2, rounds=600)
    return Model(log_p, words, weights, intercept)


def _slots(held: pa.Array, words: np.ndarray) -> np.ndarray:
    """Places in `words` of those of a document's words that are among them."""
    key = np.asarray(held).view(np.uint64)
    slot = np.minimum(np.searchsorted(words, key), len(words) - 1)
    return np.sort(slot[words[slot] == key]).astype("<i4")


def score(docs: DataFrame, model: Model, names: list[str], out: str = "score") -> DataFrame:
    """Columns `names` of every document and its score as column `out`, which is none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.log_p)
        for batch in batches:
            made = pa.array(model.scores(batch.column("text"), decoder))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], names=[*names, out])

    return map_arrow(docs.select(*dict.fromkeys([*names, "text"])), run, f"{kept_schema(docs, names)}, `{out}` double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    (out,) = fresh(docs.columns, "toxicity")
    return score(docs, train(docs, labels), docs.columns, out).where(F.col(out) < threshold).select(*docs.columns)
