"""Best-fit packing: pattern packing by non-negative least squares.

Texts become token ids plus one end id. A document longer than a sequence is cut into whole sequences' lengths, its
first piece taking what is left over. From the histogram of piece lengths (at most `size` entries, whatever the corpus)
patterns of one to three lengths that fill a sequence are enumerated on a grid, repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what they leave over is packed best-fit, longest first, on
the histogram. Pieces then take the places of their length by rank, so no step holds the pieces themselves.

Ids are those of the byte-level tokenizer file; the installed byte-pair encoder over the same vocabulary makes them
about five times faster, and the tokenizer itself takes texts with characters outside the scripts on which both
pre-tokenizers surely agree.

Defined cases: null and empty texts are the end id alone; rows equal in doc_id and text share their ids and get places
of their own, and pieces that tie in length and order may change places; an empty table gives an empty table; extra
columns, whatever their names, are ignored; a text of any length is encoded as a whole, in about 40 times its bytes of
memory, and cut into pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow, prefix_sums, write_stage

SIZE, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏΆ-ώЀ-џ‐-‧‰-⁞€]|\s{4096}|\S{65536}")


class Encoder:
    """Ids of texts under a byte-level vocabulary file."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(name))
        self.exact.encode_special_tokens = True
        self.fast = None
        try:
            table = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
            with open(table, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except OSError:
            pass

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not _PLAIN.search(text):
            return np.frombuffer(array("I", self.fast.encode_ordinary(text)), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids themselves."""
    names = [*(part.split()[0] for part in PIECES.split(", ")), *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=names)

            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                n = -(-len(ids) // size)
                cuts = [0, *range(len(ids) - size * (n - 1), len(ids) + 1, size)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    made = (doc_id.as_py(), piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), *[ids[a:b].tolist()] * with_ids)
                    for r, v in zip(rows, made):
                        r.append(v)
                held += len(ids)
                if held > 4_000_000:
                    yield flush()
                    rows, held = [[] for _ in names], 0
            if rows[0]:
                yield flush()

    return map_arrow(docs.select("doc_id", "text"), cut, PIECES + ", ids array<int>" * with_ids)


@dataclass(frozen=True)
class Plan:
    """Repeated patterns: pattern i holds lengths[i], `repeats[i]` times over."""

    lengths: list[tuple[int, ...]]
    repeats: list[int]

    @property
    def sequences(self) -> int:
        return sum(self.repeats)

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: (ranks at which runs begin, first sequence of each run, offset in the sequence)."""
        runs: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for pattern, n in zip(self.lengths, self.repeats):
            at = 0
            for length in pattern:
                runs.setdefault(length, []).append((taken.get(length, 0), first, at))
                taken[length] = taken.get(length, 0) + n
                at += length
            first += n
        return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that about minimises |ax - b|, by accelerated projected gradient steps."""
    ata, atb = a.T @ a, a.T @ b
    step = 1 / max(np.linalg.norm(ata, np.inf), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (ata @ y - atb), 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / u * (new - x)
        x, t = new, u
    return x


def patterns_on_grid(cells: int) -> list[tuple[int, ...]]:
    """One to three cell counts that add up to the whole grid."""
    found = [(cells,)]
    found += [(cells - j, j) for j in range(1, cells // 2 + 1)]
    found += [(cells - j - k, j, k) for k in range(1, cells // 3 + 1) for j in range(k, (cells - k) // 2 + 1)]
    return found


def make_plan(histogram: dict[int, int], size: int = SIZE, cells: int = 64, slack: int = 0) -> Plan:
    """A plan that places every piece of the histogram: fitted patterns first, then best fit for the rest."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    lengths: list[tuple[int, ...]] = []
    repeats: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        lengths.append(pattern)
        repeats.append(n)
        for x in pattern:
            left[x] -= n

    if left[size]:
        put((size,), int(left[size]))
    cells = min(cells, size)
    width = size / cells
    cell = np.minimum(np.ceil(np.arange(size + 1) / width).astype(int), cells)
    count = np.bincount(cell, weights=left, minlength=cells + 1)
    candidates = patterns_on_grid(cells)[1:]
    if count.sum() and candidates:
        a = np.zeros((cells + 1, len(candidates)))
        for i, p in enumerate(candidates):
            for x in p:
                a[x, i] += 1
        fit = np.floor(nnls(a, count) + 1e-6).astype(np.int64)
        members = [[int(x) for x in np.flatnonzero(cell == c)[::-1] if left[x]] for c in range(cells + 1)]

        def longest(room: int, chosen: list[int]) -> int:
            """The longest length up to `room` of which pieces are left."""
            open_ = np.flatnonzero(left[1 : room + 1] > 0)[::-1] + 1
            return next((int(x) for x in open_ if left[x] > chosen.count(x)), 0)

        for i in np.argsort(-fit, kind="stable"):
            todo = int(fit[i])
            while todo > 0:  # real lengths stand in for cells: the last one is the longest that fits, then what still fits
                chosen: list[int] = []
                for c in candidates[i][:-1]:
                    x = next((x for x in members[c] if left[x] > chosen.count(x)), 0)
                    if not x:
                        break
                    chosen.append(x)
                if len(chosen) < len(candidates[i]) - 1:
                    break
                while (fill := size - sum(chosen)) > 0 and (x := longest(fill, chosen)):
                    chosen.append(x)
                n = min(todo, *(int(left[x]) // chosen.count(x) for x in chosen))
                if n < 1 or fill > slack:
                    break
                put(tuple(sorted(chosen, reverse=True)), n)
                todo -= n
    # Best fit, longest first, over open patterns by their room.
    open_by_room: dict[int, list[list]] = {}
    for length in range(size, 0, -1):
        todo = int(left[length])
        while todo:
            room = next((r for r in range(length, size + 1) if open_by_room.get(r)), None)
            if room is None:
                fits = size // length
                whole, rest = divmod(todo, fits)
                for k, n in ((fits, whole), (rest, 1)):
                    if k and n:
                        open_by_room.setdefault(size - k * length, []).append([(length,) * k, n])
                todo = 0
                continue
            pattern, n = open_by_room[room].pop()
            k = min(room // length, max(todo // n, 1))
            used = min(n, todo // k)
            if used < n:
                open_by_room[room].append([pattern, n - used])
            open_by_room.setdefault(room - k * length, []).append([pattern + (length,) * k, used])
            todo -= used * k
    for room in sorted(open_by_room):
        for pattern, n in open_by_room[room]:
            lengths.append(pattern)
            repeats.append(n)
    return Plan(lengths, repeats)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Every piece with its sequence_id and offset. `pieces` is read three times: give a written table."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = make_plan(histogram, size).places()
    ranked = prefix_sums(pieces.withColumn("_one", F.lit(1)), "length", ["doc_id", "piece", "ids_crc32"], "_one", "_rank", sum(histogram.values()))
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                begins, firsts, offsets = places[int(x)]
                run = np.searchsorted(begins, rank[own], "right") - 1
                sequence[own], offset[own] = firsts[run] + rank[own] - begins[run], offsets[run]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_arrow(ranked.select(*names, "_rank"), place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = SIZE) -> DataFrame:
    return pack(write_stage(token_pieces(docs, tokenizer, size), "pieces"), size)
