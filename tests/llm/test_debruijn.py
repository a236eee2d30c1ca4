"""Substring dedup against windows compared in memory; paths against the occurrences they stand for."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from regionspark.llm import debruijn

SCHEMA = "doc_id long, text string, n_chars long, doc string, hash string, marks string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def occurrence(row):
    """Rows equal in doc_id and text are one occurrence; null doc_ids come last."""
    return (row[0] is None, row[0] or 0)


def first_places(rows, size):
    """Places in order: rows that share a doc_id go by the hash of their text (xxhash64 with Spark's seed)."""
    texts = sorted({(occurrence(r), r[1]) for r in rows}, key=lambda x: (x[0], np.uint64(xxhash.xxh64_intdigest((x[1] or "").encode(), 42)).astype(np.int64)))
    seen = {}
    for key, text in texts:
        w = words(text)
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append((key, text, i))
    return seen


def plain(rows, size):
    seen = first_places(rows, size)
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])][0] != (occurrence(r), r[1], i):
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((r[0], len(w), len(gone), None if r[1] is None else " ".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, size, anchor):
    docs = spark.createDataFrame([(i, t, len(t or ""), "clash", "clash", "clash") for i, t in rows], SCHEMA).repartition(3)
    out = debruijn.dedup_substrings(docs, size, anchor, counts=("n_words", "n_removed"))
    assert out.columns == [*docs.columns, "n_words", "n_removed"]
    got = out.collect()
    assert all(r.doc == r.hash == r.marks == "clash" and (r.text is None or r.n_chars == len(r.text)) for r in got)
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got], key=str)


def passages(seed, docs, alphabet, shared):
    """Texts of a small alphabet around shared passages, cut and joined at random."""
    rng = random.Random(seed)
    stock = [[rng.choice(alphabet) for _ in range(rng.randrange(5, 60))] for _ in range(shared)]
    out = []
    for k in range(docs):
        text = []
        for _ in range(rng.randrange(1, 5)):
            own = rng.choice(stock)
            lo = rng.randrange(len(own))
            text += own[lo:] if rng.random() < 0.4 else own
            text += [rng.choice(alphabet) for _ in range(rng.randrange(0, 12))]
        out.append((k, rng.choice([" ", "  ", "\n", "\t"]).join(text)))
    return out


AWKWARD = [
    (None, "a b c d e f g h"), (None, "a b c d e f g h x"), (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "é ü 漢字 😀 é ü 漢字 😀 é ü"),
    (5, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "z a b c d e f"), (6, "w " * 300), (7, "p q " * 200), (8, "q p " * 150), (9, "w"),
    (10, "\x1c a\x0bb\x0cc d\re f"),
]


@pytest.mark.parametrize("size,anchor", [(6, 3), (6, 6), (5, 1)])
def test_awkward_rows(spark, size, anchor):
    assert run(spark, AWKWARD, size, anchor) == plain(AWKWARD, size)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed):
    rows = passages(seed, 60, "abcdefgh"[: 3 + 2 * seed], 6)
    assert run(spark, rows, 6, 3) == plain(rows, 6)


def test_production_size_and_a_long_text(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(200_000))
    middle = " ".join(long.split()[70_000:70_060])
    rows = [(1, long), (2, "before it " + middle + " and after"), (3, middle), (4, " ".join(long.split()[:19]))]
    got = run(spark, rows, debruijn.SIZE, debruijn.ANCHOR)
    assert got == plain(rows, debruijn.SIZE)
    assert got[1][2] == 60 and got[2][2] == 60 and got[3][2] == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert debruijn.dedup_substrings(empty, counts=("n_words", "n_removed")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_paths_and_spans(spark, seed):
    """Each repeated window lies at one place of one path; spans are the repeated windows; each is its source's words."""
    size = 6
    rows = passages(seed + 10, 50, "abcdef", 5) + [(90, "x y z " * 12), (91, "y z x " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = {i: words(t) for i, t in rows}
    seen = first_places(rows, size)
    repeated = {w: places for w, places in seen.items() if len(places) > 1}
    place_on_path, covered = collections.defaultdict(set), set()
    for s in debruijn.repeated_spans(docs, size, 3).collect():
        own = text[s.doc][s.start : s.start + s.n_words]
        source = text[s.first_doc][s.first_start : s.first_start + s.n_words]
        assert own == source
        for k in range(s.n_words - size + 1):
            w = tuple(own[k : k + size])
            place_on_path[w].add((s.path, s.path_offset + k))
            assert (s.doc, s.start + k) not in covered
            covered.add((s.doc, s.start + k))
            assert s.later == (seen[w][0][0][1:] + (seen[w][0][2],) != (s.doc, s.start + k))
    assert covered == {(key[1], i) for places in repeated.values() for key, _, i in places}
    assert set(place_on_path) == set(repeated) and all(len(x) == 1 for x in place_on_path.values())
    # Two windows at one place of a path would be a path of two texts.
    assert len({next(iter(x)) for x in place_on_path.values()}) == len(repeated)


def test_paths_cross_documents_and_cycles(spark):
    """a..z is first seen in two halves, in the wrong order: one path. A cycle is one path, cut once."""
    letters = [f"w{k}" for k in range(26)]
    rows = [(1, " ".join(letters[12:])), (2, " ".join(letters)), (3, " ".join(letters)), (4, "x y z " * 9), (5, "z x y " * 9)]
    spans = debruijn.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), 5, 2).collect()
    in_two = sorted((s.start, s.n_words, s.path_offset) for s in spans if s.doc == 2)
    assert len({s.path for s in spans if s.doc in (1, 2, 3)}) == 1 and in_two[0][2] == 0 and in_two[-1][0] + in_two[-1][1] == 26
    assert len({s.path for s in spans if s.doc in (4, 5)}) == 1


def test_chains(spark):
    """Pointer doubling against a walk, over chains of many lengths and cycles."""
    rng, links, want = random.Random(1), [], {}
    name = lambda k: (k, 0, 0)
    at = 0
    for length in [2, 3, 1, 17, 40]:
        ids = [name(at + k) for k in range(length)]
        rng.shuffle(ids)
        links += [(b, a, 10 + a[0]) for a, b in zip(ids, ids[1:])]
        dist = 0
        for a, b in zip(ids, ids[1:]):
            dist += 10 + a[0]
            want[b] = (ids[0], dist)
        at += length
    for length in [2, 9]:
        ids = [name(at + k) for k in range(length)]
        links += [(b, a, 5) for a, b in zip(ids, ids[1:] + ids[:1])]
        want |= {b: (ids[0], 5 * (k + 1)) for k, b in enumerate(ids[1:])}
        at += length
    place = "struct<doc:bigint,hash:bigint,at:int>"
    got, _ = debruijn.chains(spark.createDataFrame(links, f"seg {place}, ptr {place}, dist long"))
    assert {tuple(r.seg): (tuple(r.top), r.dist) for r in got.collect()} == want


def test_digest(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    got = debruijn.dedup_substrings(docs, 6, 3).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("s"))
    assert sorted(r.s for r in got.collect()) == sorted(hashlib.sha256((r[3] or "").encode()).hexdigest() for r in plain(AWKWARD, 6))
