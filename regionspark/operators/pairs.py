"""Candidate pairs of two region lists, scored in blocks.

A file's regions are dealt into chunks of at most `CHUNK` a side; every two chunks of a file are a block, which is one group
of its own, so a long file is spread over as many groups as it has blocks and a region's text is sent once a chunk of the
other side, not once a pair. In a block one region is held against a whole chunk at a time: the chunk's texts are packed
into one number, and a few operations on it a character give the longest common subsequence with every one of them (a bit
set per text, with a guard bit that takes its carry). That length bounds both measures from above: matching blocks are a
common subsequence, so ratio <= 2 lcs / (a + b); and a part with k errors in a container keeps all but k of its characters,
so lcs >= part - k. Only pairs that pass are scored.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Align
from ..functions.text import POPULAR, infix_of, ratio_of
from ..stages import fresh

CHUNK = 512
OUT_ROWS = 1 << 13
SLAB = 1 << 22  # bytes of columns that a walk over a container keeps, or of places of letters
GUARD = 0xFFFFFFFF  # no character
WORD = 64  # characters of a needle whose column of the table is one machine word
MOST_WORDS = 8  # words of a needle that is walked with others
LANES = 1 << 20  # places, and letters of needles, of a block of pairs that are walked at once
TOGETHER = 1 << 14  # regions of files that are walked together


class Chunk:
    """Texts packed into one number, for their common subsequences with another text."""

    def __init__(self, texts: Iterable[str]):
        self.texts = list(texts)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        self.size = -(-int(self.lengths.sum() + len(self.texts)) // 8)
        codes = np.full(self.size * 8, GUARD, np.uint32)
        joined = np.frombuffer("\0".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[: len(joined)] = joined
        codes[self.begins + self.lengths] = GUARD

        def numbers(flags: np.ndarray) -> Iterator[int]:
            return (int.from_bytes(row.tobytes(), "little") for row in np.packbits(flags, axis=1, bitorder="little"))

        letters = sorted(set().union(*self.texts))
        (self.full,) = numbers(codes[None] != GUARD)
        self.masks: dict[str, int] = {}
        some = max(1, SLAB // max(len(codes), 1))
        for k in range(0, len(letters), some):
            own = letters[k : k + some]
            self.masks.update(zip(own, numbers(codes == np.array([[ord(c)] for c in own], np.uint32))))

    def common(self, text: str) -> np.ndarray:
        """Length of the longest common subsequence of `text` and each of the texts."""
        # The bits of a text that are 0 count what is matched so far (Hyyrö).
        open_, full = self.full, self.full
        for c in text:
            mask = self.masks.get(c)
            if mask is not None:
                hit = open_ & mask
                open_ = ((open_ + hit) | (open_ - hit)) & full
        bits = np.unpackbits(np.frombuffer(open_.to_bytes(self.size, "little"), np.uint8), bitorder="little")
        sums = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        return self.lengths - (sums[self.begins + self.lengths] - sums[self.begins])

    def infix(self, hay: str) -> tuple[np.ndarray, np.ndarray]:
        """What `infix_of(text, hay)` gives for each of the texts, none of which may be empty, in one walk over `hay`."""
        lasts = self.begins + self.lengths - 1
        byte, bit = lasts >> 3, (lasts & 7).astype(np.uint8)
        full, more, less = self.full, self.full, 0
        score = self.lengths.copy()
        best, end = score.copy(), np.zeros(len(lasts), np.int64)
        slab = max(1, SLAB // max(self.size, 1))
        for begin in range(0, len(hay), slab):
            ups, downs = [], []
            for c in hay[begin : begin + slab]:
                same = self.masks.get(c, 0)
                down = same | less
                across = (((same & more) + more) ^ more) | same
                up, fewer = less | (full ^ (full & (across | more))), more & across
                ups.append(up.to_bytes(self.size, "little"))
                downs.append(fewer.to_bytes(self.size, "little"))
                up, fewer = up << 1 & full, fewer << 1 & full
                more, less = fewer | (full ^ (full & (down | up))), up & down
            flags = lambda x: (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), self.size)[:, byte] >> bit & 1).astype(np.int8)
            scores = score + np.cumsum(flags(ups) - flags(downs), axis=0, dtype=np.int64)
            at = scores.argmin(axis=0)
            least = scores[at, np.arange(len(lasts))]
            better = least < best
            best, end = np.where(better, least, best), np.where(better, begin + at + 1, end)
            score = scores[-1]
        return best, end


def infixes(chunk: Chunk, wanted: list[int], hay: str) -> Iterator[tuple[int, int, int]]:
    """(k, distance, end) of the chunk's texts `wanted`: few are walked one by one, many all at once."""
    if len(wanted) > 1 + chunk.size / 450:
        best, end = chunk.infix(hay)
        yield from ((k, int(best[k]), int(end[k])) for k in wanted)
    else:
        yield from ((k, *infix_of(chunk.texts[k], hay)) for k in wanted)


def infixes_of(wanted: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """`infix_of(needle, hay)` for many pairs, a column of all pairs of a block in one operation; the block's hays have about
    one length. Needles beyond `MOST_WORDS` words, and hays much longer than the next, are walked one by one."""
    out: list = [None] * len(wanted)
    by_words: dict[int, list[int]] = {}
    for i, (needle, hay) in enumerate(wanted):
        words = -(-len(needle) // WORD)
        if 0 < words <= MOST_WORDS and hay:
            by_words.setdefault(words, []).append(i)
        else:
            out[i] = infix_of(needle, hay)
    for words, order in by_words.items():
        order.sort(key=lambda i: -len(wanted[i][1]))
        few = 12 * words  # pairs that cost as much one by one as a step of all
        letters = len(set().union(*[wanted[i][0] for i in order]))
        while order:
            # The longest of few are walked alone.
            alone = 0
            while len(order) - alone >= few and 5 * len(wanted[order[alone + few - 1]][1]) < 4 * len(wanted[order[alone]][1]):
                alone += 1
            if len(order) - alone < few:
                alone = len(order)
            for i in order[:alone]:
                out[i] = infix_of(*wanted[i])
            order = order[alone:]
            if order:
                n = max(1, LANES // max(len(wanted[order[0]][1]), words * letters))
                block, order = order[:n], order[n:]
                for i, x in zip(block, _infixes_of([wanted[i][0] for i in block], [wanted[i][1] for i in block])):
                    out[i] = x
    return out


def _infixes_of(needles: list[str], hays: list[str]) -> Iterator[tuple[int, int]]:
    """The steps of `infix_of`; hays come longest first, so those that have a place are always the first ones."""
    codes = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own, other = codes(needles), codes(hays)
    letters, own = np.unique(own, return_inverse=True)
    at = np.searchsorted(letters, other)
    other = np.where(letters[np.minimum(at, len(letters) - 1)] == other, at, len(letters))  # the last is no needle's
    n, m = (np.array([len(t) for t in texts], np.int64) for texts in (needles, hays))
    width, one = len(letters) + 1, np.uint64(1)
    words = -(-int(n.max()) // WORD)
    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    places = np.zeros((words, len(n) * width), np.uint64)
    np.bitwise_or.at(places, (place // WORD, np.repeat(np.arange(len(n)), n) * width + own), one << (place % WORD).astype(np.uint64))
    begin, last, top = np.cumsum(m) - m, ((n - 1) % WORD).astype(np.uint64), np.uint64(WORD - 1)
    first = np.arange(len(n)) * width
    steps = int(m[0])
    active = np.searchsorted(-m, -np.arange(steps), "left")  # hays with a place there
    rise = np.zeros((steps + 1, len(n)), np.int8)
    more, less = np.full((words, len(n)), ~np.uint64(0)), np.zeros((words, len(n)), np.uint64)
    for j, k in enumerate(active.tolist()):
        letter, plus, minus = first[:k] + other[begin[:k] + j], None, None
        for w in range(words):
            eq, mo, le = places[w][letter], more[w, :k], less[w, :k]
            down = eq | le
            if w:
                eq = eq | minus  # what comes from the word below
            across = (((eq & mo) + mo) ^ mo) | eq
            up, fewer = le | ~(across | mo), mo & across
            if w == words - 1:
                rise[j + 1, :k] = (up >> last[:k] & one).astype(np.int8) - (fewer >> last[:k] & one).astype(np.int8)
            below = (plus, minus)
            if words > 1:
                plus, minus = up >> top, fewer >> top
            up, fewer = up << one, fewer << one
            if w:
                up, fewer = up | below[0], fewer | below[1]
            more[w, :k], less[w, :k] = fewer | ~(down | up), up & down
    scores = np.cumsum(rise, axis=0, dtype=np.int32)
    end = scores.argmin(axis=0)
    return zip((n + scores[end, np.arange(len(n))]).tolist(), end.tolist())


def near(rows: list[tuple[int, str]], columns: list[tuple[int, str]], lengths: np.ndarray, common: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
    """(row, column, ratio) of the pairs with a ratio of at least `least`. `lengths` are the rows', `common[column, row]`
    bounds what they share."""
    for (j, b), lcs in zip(columns, common):
        matcher = None
        size = lengths + len(b)
        for k in np.flatnonzero((2.0 * lcs / np.maximum(size, 1) >= least) | (size == 0)).tolist():
            i, a = rows[k]
            if a == b or len(b) < POPULAR:
                score = ratio_of(a, b)
            else:
                if matcher is None:  # of a long text difflib's table serves many rows
                    matcher = difflib.SequenceMatcher(None, "", b)
                matcher.set_seq1(a)
                score = matcher.ratio()
            if score >= least:
                yield i, j, score


def most_errors(length: int, rules: Align) -> int:
    """Errors that a part of this length may have in its container."""
    return max(rules.group_floor, int(length * rules.group_tolerance)) if rules.group_tolerance > 0 else 0


def everywhere(text: str, rules: Align) -> bool:
    """Whether a part counts as present in every container: it may lose all its characters."""
    return len(text) >= max(rules.min_group_part, 1) and most_errors(len(text), rules) >= len(text)


def place(part: str, container: str, rules: Align) -> int:
    """Where a part stands in a container, -1 if it does not: literally, else with as many errors as it may have."""
    at = container.find(part)
    if at >= 0 or rules.group_tolerance <= 0:
        return at
    distance, end = infix_of(part, container)
    return max(0, end - len(part)) if distance <= most_errors(len(part), rules) else -1


def contained(parts: list[tuple[int, str]], containers: list[tuple[int, str]], common: np.ndarray, rules: Align) -> Iterator[tuple[int, int, int]]:
    """(container, part, place) of the parts that stand in a container, but for those that stand everywhere.

    `common[container, part]` bounds what they share.
    """
    fit = [k for k, (_, text) in enumerate(parts) if len(text) >= max(rules.min_group_part, 1) and not everywhere(text, rules)]
    need = np.array([len(parts[k][1]) - most_errors(len(parts[k][1]), rules) for k in fit], np.int64)
    chunk = None
    for (c, text), lcs in zip(containers, common[:, fit]):
        if not text:
            continue
        inexact = []
        for k in np.flatnonzero(lcs >= need).tolist():
            p, part = parts[fit[k]]
            at = text.find(part)
            if at >= 0:
                yield c, p, at
            else:
                inexact.append(k)
        if inexact and rules.group_tolerance > 0:
            chunk = chunk or Chunk(parts[k][1] for k in fit)
            for k, distance, end in infixes(chunk, inexact, text):
                p, part = parts[fit[k]]
                if distance <= most_errors(len(part), rules):
                    yield c, p, max(0, end - len(part))


def standing(parts: dict[int, str], containers: dict[int, str], common: np.ndarray, rules: Align, least: Callable[[int, int, int], bool]) -> tuple[list, list]:
    """What `contained` looks for, in containers of which (length, parts, sum of their lengths) may give a group: the (container,
    part, place) rows that are there literally, and the (container, part) that may stand with errors."""
    fit = [k for k, text in enumerate(parts.values()) if len(text) >= max(rules.min_group_part, 1) and not everywhere(text, rules)]
    every = list(parts.items())
    sizes = np.array([len(every[k][1]) for k in fit], np.int64)
    need = sizes - np.array([most_errors(n, rules) for n in sizes.tolist()], np.int64)
    found, wanted = [], []
    passes = common[:, fit] >= need
    for (c, text), n, total, row in zip(containers.items(), passes.sum(axis=1).tolist(), (passes @ sizes).tolist(), passes):
        if not text or not least(len(text), n, total):
            continue
        for k in np.flatnonzero(row).tolist():
            p, part = every[fit[k]]
            at = text.find(part)
            if at >= 0:
                found.append((c, p, at))
            elif rules.group_tolerance > 0:
                wanted.append((c, p))
    return found, wanted


def common_lengths(rows: list[tuple[int, str]], columns: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' lengths and, by column and row, the lengths of their longest common subsequences."""
    chunk = Chunk(t for _, t in rows)
    known: dict[str, np.ndarray] = {}
    out = np.zeros((len(columns), len(rows)), np.int64)
    for k, (_, text) in enumerate(columns):
        if text not in known:
            known[text] = chunk.common(text)
        out[k] = known[text]
    return chunk.lengths, out


def blocks(left: DataFrame, right: DataFrame, work: Callable[[list, list], Iterable[tuple]], schema: str, chunk: int = CHUNK) -> DataFrame:
    """source_file and the rows (`schema`) of `work(left regions, right regions)` for every block of every file.

    Regions are (ix, norm). Chunks are runs of indices, so a chunk has at most `chunk` regions.
    """
    file, ix, other, side, lo, hi, text = fresh([], "source_file", "ix", "other", "side", "lo", "hi", "norm")
    part = lambda df: df.select(file, ix, text, F.floor(F.col(ix) / chunk).cast("long").alias(lo))
    a, b = part(left), part(right)
    chunks = lambda df: df.select(F.col(file).alias("_f"), F.col(lo).alias(other)).distinct()
    meet = lambda df, chunks_: df.join(chunks_, F.col(file) == F.col("_f")).drop("_f")
    rows = meet(a, chunks(b)).select(file, F.col(lo).alias("lo"), F.col(other).alias("hi"), F.lit(0).alias(side), ix, text)
    rows = rows.unionByName(meet(b, chunks(a)).select(file, F.col(other).alias("lo"), F.col(lo).alias("hi"), F.lit(1).alias(side), ix, text))
    # The work grows with the product of a block's sides, not with bytes: partitions are not to be merged by size.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        sides = ([(i, t) for s, i, t in group if s == which] for which in (0, 1))
        return ((key[0], *x) for x in work(*sides))

    kind = left.schema["source_file"].dataType.simpleString()
    dealt = rows.repartition(n, file, "lo", "hi").sortWithinPartitions(file, "lo", "hi", ix)
    return grouped(dealt, 3, run, f"source_file {kind}, {schema}")


def grouped(rows: DataFrame, keys: int, work: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows of `work(key, rows)` for every group of `rows`, whose partitions hold whole groups in order of their keys, the
    first `keys` columns. Groups come many to an Arrow batch, so a small one costs little; one may go on in the next batch."""
    return grouped_together(rows, keys, lambda some: (x for key, group in some for x in work(key, group)), schema, 1)


def grouped_together(rows: DataFrame, keys: int, work: Callable[[list[tuple[tuple, list[tuple]]]], Iterable[tuple]], schema: str, together: int) -> DataFrame:
    """The same, with `work` called for as many groups [(key, rows)] as it takes for `together` rows."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, found, some, size = None, [], [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:keys] != key:
                    if found:
                        some.append((key, found))
                        size += len(found)
                        if size >= together:
                            yield from work(some)
                            some, size = [], 0
                    key, found = row[:keys], []
                found.append(row[keys:])
        if found:
            some.append((key, found))
        if some:
            yield from work(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = groups(batches)
        while some := list(islice(out, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def ratio_candidates(gt: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """(source_file, gt_ix, pred_ix, similarity) of the pairs of a file with a ratio of at least `least`."""

    def work(a: list, b: list) -> Iterable[tuple]:
        return near(a, b, *common_lengths(a, b), least)

    return blocks(gt, pred, work, "gt_ix long, pred_ix long, similarity double")


def infix_candidates(parts: DataFrame, containers: DataFrame, rules: Align = Align(), least: int = 0) -> DataFrame:
    """(source_file, part_ix, container_ix, distance, end) of the parts of at least `least` characters that stand in a region
    of the same file, no shorter than they are, with as many errors as they may have: end is the first place where one ends."""

    def work(a: list, b: list) -> Iterable[tuple]:
        a = [x for x in a if len(x[1]) >= least]
        chunk = Chunk(t for _, t in a)
        _, common = common_lengths(a, b)
        sizes = np.array([len(t) for _, t in a], np.int64)
        need = sizes - np.array([most_errors(n, rules) for n in sizes.tolist()], np.int64)
        for (j, text), lcs in zip(b, common):
            for k, distance, end in infixes(chunk, np.flatnonzero((lcs >= need) & (sizes <= len(text))).tolist(), text):
                if distance <= most_errors(len(a[k][1]), rules):
                    yield a[k][0], j, distance, end

    return blocks(parts, containers, work, "part_ix long, container_ix long, distance long, end long")
