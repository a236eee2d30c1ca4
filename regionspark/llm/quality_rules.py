"""Quality rules by distribution divergence.

Each document's character-class and common-word histograms are held against references of its corpus' languages with
the Jensen-Shannon distance (base 2, 0 to 1). References are built from all documents of a language that pass the base
rules; a document is judged by the nearest reference, so a wrong or missing `lang` does not condemn it.

Minimum-length guards: below `min_words` words a document fails the base rules; below `min_words_for_words` its
common-word histogram says nothing and only its characters are judged; and both limits widen by their slack /
sqrt(words), since short texts have rough histograms.

Defined cases: null and empty texts have no words and fail the base rules; equal rows give equal rows, and of references
at the same distance the first by name is the nearest; an empty table gives an empty table; extra columns, whatever their
names, are ignored; with no reference (no document of a known language passes) the verdict is that of the base rules; a
long text takes about 20 times its bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow, write_stage
from .words import LOWER, SPACE, blocks, group_sizes, hash_spans, line_spans, totals, windows, word_spans

# Frequent function words of the reference languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he are or his from at this have an had they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son".split(),
}
CLASSES = ("vowel", "consonant", "upper", "digit", "blank", "line end", "stop", "quote", "symbol", "latin letter", "other letter")
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.11
    class_slack: float = 0.7
    max_word_distance: float = 0.24
    word_slack: float = 0.9
    min_words_for_words: int = 100


def _class_table() -> np.ndarray:
    table = np.full(256, 8, np.uint8)
    table[97:123] = 1
    table[[ord(c) for c in "aeiou"]] = 0
    table[65:91] = 2
    table[48:58] = 3
    table[[32, 9, 11, 12]] = 4
    table[[10, 13]] = 5
    table[[ord(c) for c in ".,;:!?"]] = 6
    table[[ord(c) for c in "'\"()-"]] = 7
    table[0x80:0xC0] = 255  # continuation bytes belong to the code point before
    table[0xC2:0xC6] = 9
    table[0xC6:] = 10
    return table


_CLASS = _class_table()
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _vocabulary() -> list[bytes]:
    return sorted({w.encode() for ws in COMMON.values() for w in ws})


def _word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return hash_spans(data, ends - [len(w) for w in words], ends)


FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, commons array<int>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary()
    hashes = _word_hashes(vocabulary)
    by_hash = np.argsort(hashes)
    hashes = hashes[by_hash]
    n_common, n_class = len(hashes), len(CLASSES)
    for batch in batches:
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        for b in blocks(batch.column("text")):
            w = word_spans(b)
            wh = hash_spans(LOWER[b.data], w.starts, w.ends)
            exact = hash_spans(b.data, w.starts, w.ends)
            lead = (b.data & 0xC0) != 0x80
            chars = totals(lead & ~SPACE[b.data], b.offsets)
            symbols = totals(_IS_SYMBOL[b.data], b.offsets)
            lines = line_spans(b)
            has_word = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
            line_doc = lines.doc
            lh = hash_spans(b.data, lines.starts[has_word], lines.ends[has_word])
            order, begins, _ = group_sizes(line_doc[has_word], lh)
            firsts = np.bincount(line_doc[has_word][order[begins]], minlength=b.docs) if len(begins) else np.zeros(b.docs, np.int64)
            dups = np.bincount(line_doc[has_word], minlength=b.docs) - firsts
            doc = w.doc
            key, at = windows(exact, w, 3)
            order, begins, sizes = group_sizes(doc[at], key)
            again = at[order[np.repeat(sizes, sizes) > 1]]
            marked = np.zeros(len(doc), bool)
            for k in range(3):
                marked[again + k] = True
            repeated = np.bincount(doc[marked], minlength=b.docs)
            cls = _CLASS[b.data]
            byte_doc = np.repeat(np.arange(b.docs), np.diff(b.offsets))[lead]
            classes = np.bincount(byte_doc * n_class + cls[lead], minlength=b.docs * n_class).reshape(b.docs, n_class)
            slot = np.minimum(np.searchsorted(hashes, wh), n_common - 1)
            hit = hashes[slot] == wh
            commons = np.bincount(doc[hit] * (n_common + 1) + slot[hit], minlength=b.docs * (n_common + 1)).reshape(b.docs, n_common + 1)
            commons[:, n_common] = w.counts - commons.sum(1)
            for kept, new in zip(columns, (w.counts, chars, symbols, dups, repeated, classes, commons)):
                kept.append(new)
        if not batch.num_rows:
            continue
        flat = [np.concatenate(c) for c in columns]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.reshape(-1).astype(np.int32))) for c in flat[5:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string()), *[pa.array(c.astype(np.int64)) for c in flat[:5]], *lists], names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "commons"])


def text_features(docs: DataFrame) -> DataFrame:
    """Base counts and both histograms of every document: columns as in FEATURES."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return map_arrow(docs.select("doc_id", lang.alias("lang"), "text"), _features, FEATURES)


def _base_failed(limits: Limits):
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def language_references(features: DataFrame, limits: Limits = Limits()) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language of COMMON: mean class and common-word distribution over all its documents that pass the base rules.

    The result has one row per language of COMMON, whatever the corpus.
    """
    n_class, n_common = len(CLASSES), len(_vocabulary()) + 1
    good = features.where(F.col("lang").isin(list(COMMON)) & ~_base_failed(limits))
    mean = lambda column, i, of: F.avg(F.col(column)[i] / of)
    n_chars = F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    good = good.withColumn("_n", n_chars.cast("double"))
    sums = good.groupBy("lang").agg(
        F.array(*[mean("classes", i, F.col("_n")) for i in range(n_class)]).alias("classes"),
        F.array(*[mean("commons", i, F.col("n_words")) for i in range(n_common)]).alias("commons"),
    )
    return {r["lang"]: (np.array(r["classes"]), np.array(r["commons"])) for r in sums.collect()}


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence in bits) of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
        return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def with_distances(features: DataFrame, references: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add class_distance, word_distance and nearest_lang; without references the distances are 0."""
    names = sorted(references)
    columns = features.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            by_class, by_word, nearest = np.zeros(n), np.zeros(n), [None] * n
            if names:
                hist = [np.asarray(batch.column(c).flatten()).reshape(n, -1).astype(float) for c in ("classes", "commons")]
                shares = [h / np.maximum(h.sum(1, keepdims=True), 1) for h in hist]
                far = np.stack([np.stack([distances(s, references[k][i]) for k in names]) for i, s in enumerate(shares)])
                best = far.sum(0).argmin(0)
                by_class, by_word = far[0][best, np.arange(n)], far[1][best, np.arange(n)]
                nearest = [names[i] for i in best]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(by_class), pa.array(by_word), pa.array(nearest, pa.string())], names=[*columns, "class_distance", "word_distance", "nearest_lang"])

    return map_arrow(features, add, f"{FEATURES}, class_distance double, word_distance double, nearest_lang string")


def trimmed_references(features: DataFrame, limits: Limits = Limits()) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """References rebuilt from the half of each language's documents that lies nearest to the plain mean, so that junk
    does not bend what it is judged by."""
    first = language_references(features, limits)
    if not first:
        return first
    near = with_distances(features, first)
    known = near.where(F.col("lang").isin(list(COMMON)) & ~_base_failed(limits))
    middle = {r["lang"]: r["m"] for r in known.groupBy("lang").agg(F.percentile_approx("class_distance", 0.5, 10000).alias("m")).collect()}
    keep = F.lit(False)
    for lang, m in sorted(middle.items()):
        keep = keep | ((F.col("lang") == lang) & (F.col("class_distance") <= m))
    return language_references(near.where(keep), limits)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every document with its base counts, its two distances, the nearest language, base_failed and kept."""
    features = write_stage(text_features(docs), "quality")
    judged = with_distances(features, trimmed_references(features, limits))
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    far_class = F.col("class_distance") > limits.max_class_distance + limits.class_slack / root
    far_word = (F.col("word_distance") > limits.max_word_distance + limits.word_slack / root) & (F.col("n_words") >= limits.min_words_for_words)
    off = far_class | far_word
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed(limits).alias("base_failed"), (~_base_failed(limits) & ~off).alias("kept"), "class_distance", "word_distance", "nearest_lang")
