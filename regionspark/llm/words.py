"""Word, line and shingle tables of Arrow text columns, made with numpy over the UTF-8 bytes of many documents at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Words, lines and windows are known by 64-bit hashes
(a polynomial modulo 2**64, then mixed); two different ones agree with a probability of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    table = _POWERS.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 20), base, np.uint64)
        table[0] = 1
        _POWERS[int(base)] = table = np.multiply.accumulate(table)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of data[start:end] for sorted, non-overlapping spans."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + piece, "right")))
        hi = int(ends[j - 1])
        n = hi - lo
        sums = np.zeros(n + 1, np.uint64)
        terms = data[lo:hi].astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers(_P, n)
        np.cumsum(terms, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * _powers(_P_INV, n + 1)[s] + (e - s).astype(np.uint64) * _Q
        i = j
    return mix(out)


@dataclass
class Block:
    """Some whole documents of a batch: rows lo..hi of it, their bytes, and where each document begins in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a block: byte spans, and the first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def blocks(column: pa.Array, limit: int = 4 << 20) -> Iterator[Block]:
    """The column's documents (null: empty) in blocks of about `limit` bytes; a longer document is a block of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_binary())
    _, ofs, buf = wide.buffers()
    offsets = np.frombuffer(ofs, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(wide):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(wide))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def word_spans(block: Block) -> Words:
    inside = ~SPACE[block.data]
    n = len(inside)
    heads, tails = inside.copy(), inside.copy()
    heads[1:] &= ~inside[:-1]
    tails[:-1] &= ~inside[1:]
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    heads[cuts] = inside[cuts]
    tails[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(heads)
    return Words(starts, np.flatnonzero(tails) + 1, np.searchsorted(starts, block.offsets))


def line_spans(block: Block) -> Words:
    """Lines between newlines: every document has one more than its newlines."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([block.offsets[1:], breaks]), kind="stable")
    per_doc = np.diff(np.searchsorted(breaks, block.offsets)) + 1
    return Words(starts, ends, np.concatenate([[0], np.cumsum(per_doc)]))


def windows(hashes: np.ndarray, spans: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first span) of every run of `size` spans within one document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = spans.doc
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out *= _Q
        out += hashes[at + k]
    return mix(out), at


def group_sizes(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the items (doc, key): their order by group, where each group begins in it, and the groups' sizes."""
    joint = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(joint, kind="stable")
    j = joint[order]
    begins = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]])) if len(j) else np.zeros(0, np.int64)
    return order, begins, np.diff(np.append(begins, len(j)))


def totals(per_item: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of per_item between consecutive offsets."""
    sums = np.zeros(len(per_item) + 1, np.int64)
    np.cumsum(per_item, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
