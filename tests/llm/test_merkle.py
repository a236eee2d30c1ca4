"""The Merkle manifest against a plain version that builds whole trees in memory."""

import hashlib
import random
import zlib

import pytest

from regionspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, `group` long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[k] for k in merkle.FIELDS)])


def tree(nodes, fanout):
    """The root and every node's (before, after) pairs from the bottom up."""
    paths, at, rows = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(rows) > 1:
        for path, a in zip(paths, at):
            lo = a // fanout * fanout
            path.append(("".join(rows[lo:a]), "".join(rows[a + 1 : lo + fanout])))
        rows = [digest(*rows[k : k + fanout]) for k in range(0, len(rows), fanout)]
        at = [a // fanout for a in at]
    return rows[0], paths


def plain(rows, fanout=3):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    groups = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        groups.append((own, *tree([leaf(r) for r in own], fanout)))
    root, above = tree([subroot for _, subroot, _ in groups], fanout)
    out = []
    for (own, subroot, paths), rest in zip(groups, above):
        for r, path in zip(own, paths):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r | {"text": text})
            for before, after in path + rest:
                folded = digest(before, folded, after)
            proof = digest(*[x for pair in path + rest for x in pair])
            out.append((r["doc_id"], leaf(r), subroot, root, proof, folded, folded == root))
    return out


def rows_of(spark, docs, **more):
    return sorted(map(tuple, merkle.manifest(docs, **more).collect()), key=str)


def awkward(n):
    rng = random.Random(n)
    ids = [None, 5, 5, -3, -(1 << 63), (1 << 63) - 1, 1 << 40, *range(n // 3)]
    texts = [None, "", "x\ny", "z", "漢\n", "w " * 70_000]
    pick = lambda *values: rng.choice(values)
    rows = [(rng.choice(ids), rng.choice(texts), pick(None, "en"), pick(None, "a", "a", "é", "b\n", ""), pick(None, 1), "clash", 3) for _ in range(n)]
    return rows + [(7, "same", "en", "a", 4, "clash", 3)] * 30


@pytest.mark.parametrize("fanout,levels", [(3, 5), (3, 1), (2, 3)])
def test_whole_trees(spark, fanout, levels):
    docs = spark.createDataFrame(awkward(400), SCHEMA).repartition(5)
    want = sorted(plain([r.asDict() for r in docs.collect()], fanout), key=str)
    assert rows_of(spark, docs, fanout=fanout, levels=levels) == want


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "a", None, None, 1, "", 0)], SCHEMA)
    (row,) = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == digest() and row.verified
    assert merkle.manifest(one.limit(0)).count() == 0


def test_ties_beyond_a_block_and_two_steps_of_copies(spark):
    rows = [(9, f"t{k}", "en", "a", k, "", 0) for k in range(700)] + [(9, "same", "en", "a", 4, "", 0)] * 4_200
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(spark, docs) == sorted(plain([r.asDict() for r in docs.collect()]), key=str)


def test_many_sources(spark):
    rows = [(k, "t", "en", f"s{k % 400}", k, "", 0) for k in range(1_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(spark, docs, levels=2) == sorted(plain([r.asDict() for r in docs.collect()]), key=str)


def test_tampering_is_seen(spark):
    docs = spark.createDataFrame([(k, f"line\n{k}", "en", "a", k, "", 0) for k in range(20)], SCHEMA)
    got = {r.doc_id: r.verified for r in merkle.manifest(docs).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 2 == 1 for k in range(20)}


def test_heights():
    assert [merkle.height(n) for n in (0, 1, 2, 3, 4, 9, 10, 27, 28)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
