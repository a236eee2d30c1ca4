"""Alignment on scored edges: bounds, blocks and walks against plain versions."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionspark.config import Align
from regionspark.functions import text
from regionspark.functions.text import infix_of, similarity_of
from regionspark.operators import align, pairs


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_groups(whole, parts, rules, joint):
    """Every part is looked for in every container."""
    found, claimed = [], set()
    for c in sorted(whole, key=lambda i: (-len(whole[i]), i)):
        placed = []
        for p, part in parts.items():
            if whole[c] and p not in claimed and len(part) >= max(rules.min_group_part, 1):
                at = whole[c].find(part)
                if at < 0 and rules.group_tolerance > 0:
                    distance, end = infix_of(part, whole[c])
                    if distance <= max(rules.group_floor, int(len(part) * rules.group_tolerance)):
                        at = max(0, end - len(part))
                if at >= 0:
                    placed.append((at, p))
        if len(placed) > 1:
            members = [p for _, p in sorted(placed)]
            score = similarity_of(whole[c], joint.join(parts[p] for p in members))
            if score >= rules.group_similarity:
                claimed.update(members)
                found.append((c, members, score))
    return found


def plain_walk(gt, pred, rules, joint=""):
    """All four passes without a judge, every pair scored."""
    gt, pred, rows = dict(gt), dict(pred), []
    for kind, whole, parts in (("merge", pred, gt), ("split", gt, pred)):
        for c, members, score in plain_groups(whole, parts, rules, joint):
            rows.append((kind, *((members, [c]) if kind == "merge" else ([c], members)), score))
            whole.pop(c)
            for p in members:
                parts.pop(p)
    near = sorted((-similarity_of(a, b), i, j) for i, a in gt.items() for j, b in pred.items() if similarity_of(a, b) >= rules.reject_below)
    for pass_ in ("pair", "uncertain"):
        for minus, i, j in near:
            if i in gt and j in pred and (-minus >= rules.auto_match) == (pass_ == "pair"):
                rows.append((pass_, [i], [j], -minus))
                if pass_ == "pair":
                    gt.pop(i)
                    pred.pop(j)
    return sorted(rows)


def some_file(seed, n):
    """Regions of a few words, and predictions that lose, change, join and cut them; tiny ones and repeats too."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh"[: 3 + seed % 5]) for _ in range(r.randrange(1, 7)))
    gt = ["".join(word() for _ in range(r.randrange(0, 7))) for _ in range(n)]
    pred, k = [], 0
    while k < n:
        text, what = gt[k], r.random()
        if what < 0.2 and k + 1 < n:
            text += gt[k := k + 1]
        if what > 0.3:
            text = "".join(c for c in text if r.random() > 0.08)
        pred += [text] if what < 0.8 else [text[: len(text) // 2], text[len(text) // 2 :]]
        k += 1
    r.shuffle(pred)
    return [x for x in gt if x], [x for x in pred if x]


RULES = [Align(), Align(group_tolerance=0), Align(group_tolerance=1.5), Align(reject_below=0.3, auto_match=0.6, group_similarity=0.6), Align(min_group_part=1, group_floor=0)]


def test_common_subsequences():
    r = random.Random(7)
    for k in range(60):
        letters = "ab漢字 é"[: 2 + k % 5]
        rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(0, 90)))) for i in range(r.randrange(1, 9))]
        columns = [(i, "".join(r.choice(letters + "z") for _ in range(r.randrange(0, 70)))) for i in range(4)]
        lengths, common = pairs.common_lengths(rows, columns)
        assert lengths.tolist() == [len(t) for _, t in rows]
        assert common.tolist() == [[plain_lcs(a, b) for _, a in rows] for _, b in columns]


def test_bounds_lose_nothing():
    """Every ratio is within 2 lcs / (a + b), with the library's own junk rule; every part keeps all but its errors."""
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randrange(1, 320))) for _ in range(2))
        lcs = plain_lcs(a, b)
        assert difflib.SequenceMatcher(None, a, b).ratio() <= 2.0 * lcs / (len(a) + len(b))
        assert infix_of(a, b)[0] >= len(a) - lcs


@pytest.mark.parametrize("rules", RULES)
def test_walks_of_random_files(rules):
    for seed in range(40):
        gt, pred = (dict(enumerate(x)) for x in some_file(seed, 4 + seed))
        want = plain_walk(gt, pred, rules)
        strip = lambda rows: sorted((x["kind"], x["gt_ixs"], x["pred_ixs"], x["similarity"]) for x in rows)
        assert strip(align.resolve(gt, pred, {}, rules, "", None, "auto")) == want
        edges = []
        a, b = list(gt.items()), list(pred.items())
        for lo in range(0, len(a), 5):
            for hi in range(0, len(b), 5):
                lengths, common = pairs.common_lengths(a[lo : lo + 5], b[hi : hi + 5])
                edges += [(align.MERGE, *x) for x in pairs.contained(a[lo : lo + 5], b[hi : hi + 5], common, rules)]
                edges += [(align.SPLIT, *x) for x in pairs.contained(b[hi : hi + 5], a[lo : lo + 5], common.T, rules)]
                edges += [(align.NEAR, *x) for x in pairs.near(a[lo : lo + 5], b[hi : hi + 5], lengths, common, rules.reject_below)]
        assert strip(align.resolve(gt, pred, {}, rules, "", None, "auto", align.Given(edges))) == want


def frames(spark, files):
    rows = [[(f, i, t, t) for f, sides in files.items() for i, t in enumerate(sides[k])] for k in range(2)]
    return [spark.createDataFrame(x, "source_file string, ix long, raw string, norm string").repartition(3) for x in rows]


def test_blocks_give_the_rows_of_one_walk(spark):
    files = {f"f{k}": some_file(k, 5 + 3 * k) for k in range(16)} | {"left": (["only left"], []), "right": ([], ["only right"])}
    gt, pred = frames(spark, files)
    judged = spark.createDataFrame([(a, b, (len(a) + len(b)) % 2 == 0) for g, p in files.values() for a in set(g) for b in set(p)], "gt string, pred string, same boolean")
    for verdicts in (None, judged):
        rows = lambda **how: sorted(map(str, align.matches(gt, pred, judged=verdicts, **how).collect()))
        whole = rows()
        assert rows(long_pairs=0, chunk=7) == whole and rows(long_pairs=300, chunk=4) == whole and len(whole) > 100


def test_candidates_against_all_pairs(spark):
    files = {f"f{k}": some_file(k, 4 + 2 * k) for k in range(12)}
    gt, pred = frames(spark, files)
    got = {(r.source_file, r.gt_ix, r.pred_ix, r.similarity) for r in align.ratio_candidates(gt, pred, 0.55).collect()}
    every = [(f, i, j, a, b) for f, (g, p) in files.items() for i, a in enumerate(g) for j, b in enumerate(p)]
    assert got == {(f, i, j, similarity_of(a, b)) for f, i, j, a, b in every if similarity_of(a, b) >= 0.55}
    found = {(r.source_file, r.part_ix, r.container_ix, r.distance, r.end) for r in pairs.infix_candidates(gt, pred).collect()}
    want = {(f, i, j, *infix_of(a, b)) for f, i, j, a, b in every if len(a) <= len(b) and infix_of(a, b)[0] <= max(3, int(len(a) * 0.25))}
    assert found == want


def test_few_pairs_reach_the_costly_measures(monkeypatch):
    """Of prose, less than a tenth of the pairs is scored by ratio or by infix distance."""
    r = random.Random(11)
    words = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()
    lines = lambda n: [(k, "".join(r.choice(words) for _ in range(r.randrange(8, 25)))) for k in range(n)]
    a, b = lines(120), lines(120)
    calls = {"ratio": 0, "infix": 0}
    matcher = difflib.SequenceMatcher

    class Counted(matcher):
        def ratio(self):
            calls["ratio"] += 1
            return super().ratio()

    monkeypatch.setattr(pairs.difflib, "SequenceMatcher", Counted)
    monkeypatch.setattr(pairs, "infix_of", lambda n, h: calls.__setitem__("infix", calls["infix"] + 1) or infix_of(n, h))
    lengths, common = pairs.common_lengths(a, b)
    list(pairs.near(a, b, lengths, common, 0.8))
    list(pairs.contained(a, b, common, Align()))
    assert calls["ratio"] < 0.1 * len(a) * len(b) and calls["infix"] < 0.1 * len(a) * len(b)


def test_a_file_of_many_regions(spark):
    """3,000 x 3,000 regions in blocks; exact text apart, every region has one changed partner."""
    r = random.Random(2)
    n = 3_000
    text = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(n)]
    changed = ["#" + t[1:] for t in text]
    r.shuffle(order := list(range(n)))
    gt, pred = frames(spark, {"long": (text, [changed[k] for k in order])})
    got = align.matches(gt, pred).where("kind = 'pair' and matched_by = 'similarity'").select(F.col("gt_ixs")[0], F.col("pred_ixs")[0]).collect()
    assert sorted((i, order[j]) for i, j in got) == [(k, k) for k in range(n)]


def test_chunk_of_nothing():
    lengths, common = pairs.common_lengths([], [(0, "a")])
    assert len(lengths) == 0 and common.shape == (1, 0)
    assert pairs.common_lengths([(0, "")], [(0, "")])[1].tolist() == [[0]]
    assert np.array_equal(pairs.common_lengths([(0, "a")], [])[1], np.zeros((0, 1)))


def test_infix_of_a_whole_chunk(monkeypatch):
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abc漢") for _ in range(n))
    for slab in (1, 1 << 22):
        monkeypatch.setattr(pairs, "SLAB", slab)
        for _ in range(60):
            texts, hay = [some(r.randrange(1, 90)) for _ in range(r.randrange(1, 9))], some(r.randrange(0, 140))
            best, end = pairs.Chunk(texts).infix(hay)
            assert list(zip(best.tolist(), end.tolist())) == [infix_of(t, hay) for t in texts]


def test_many_parts_are_placed_in_one_walk(monkeypatch):
    r = random.Random(6)
    parts = [(k, "".join(r.choice("abcd") for _ in range(40))) for k in range(30)]
    whole = [(0, "".join(t[:7] + "#" + t[8:] for _, t in parts))]
    monkeypatch.setattr(pairs, "infix_of", None)
    _, common = pairs.common_lengths(parts, whole)
    assert [p for _, p, _ in pairs.contained(parts, whole, common, Align())] == list(range(30))


def test_small_files_share_batches(spark):
    """Groups are worked on in one call a partition, and one that goes on in the next batch stays whole."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).selectExpr("id div 10 as file", "id").repartition(3, "file").sortWithinPartitions("file", "id")
        got = pairs.grouped(rows, 1, lambda key, group: [(key[0], len(group), group[-1][0])], "file long, n long, last long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got)) == [(k, 10, 10 * k + 9) for k in range(10)]


def test_the_exact_pass_is_one_shuffle(spark, tmp_path):
    """Both sides are shuffled once, by file and text, and only an alignment with verdicts takes their raw texts along."""
    gt, pred = frames(spark, {f"f{k}": some_file(k, 12) for k in range(3)})
    gt.write.parquet(f"{tmp_path}/gt")
    pred.write.parquet(f"{tmp_path}/pred")
    sides = [spark.read.parquet(f"{tmp_path}/{name}") for name in ("gt", "pred")]
    for df, raw in ((align.left_over(*sides), False), (align.left_over(*sides, "raw"), True), (align.exact_matches(*sides), False)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and ("raw" in plan) == raw


@pytest.mark.parametrize("lanes", [1, 900, 1 << 20])
def test_infixes_of_many_pairs(monkeypatch, lanes):
    r = random.Random(12)
    some = lambda n: "".join(r.choice("abcd漢🙂") for _ in range(n))
    wanted = [(some(r.choice((0, 1, 5, 30, 63, 64, 65, 90, 150, 600))), some(r.choice((0, 1, 20, 21, 22, 50, 51, 400)))) for _ in range(400)]
    monkeypatch.setattr(pairs, "LANES", lanes)
    assert pairs.infixes_of(wanted) == [infix_of(*x) for x in wanted]
    assert pairs.infixes_of([]) == []


def test_files_ask_for_infix_distances_together(monkeypatch):
    """The rows are those of files walked one by one, and a round of questions is one call for all of them."""
    files = [(dict(enumerate(g)), dict(enumerate(p))) for g, p in (some_file(k, 10 + 2 * k) for k in range(8))]
    alone = [align.resolve(g, p, {}, Align(), "", None, "auto") for g, p in files]
    calls, once = [], pairs.infixes_of
    monkeypatch.setattr(pairs, "infixes_of", lambda wanted: calls.append(len(wanted)) or once(wanted))
    monkeypatch.setattr(pairs, "infix_of", infix_of)
    assert align.together([align.resolving(g, p, {}, Align(), "", None, "auto") for g, p in files]) == alone
    assert len(calls) <= 3 and sum(calls) > 0


def test_ratio_is_that_of_difflib(monkeypatch):
    """Of short texts without its table; those from which on it leaves out frequent characters go through it."""
    r = random.Random(14)
    some = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    cases = [(some(r.randrange(40), "ab漢"), some(r.randrange(40), "abc")) for _ in range(2000)]
    cases += [(some(r.randrange(150, 260), "abcde fgh"), some(n, "abcde fgh")) for n in range(190, 210)]
    want = [1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio() for a, b in cases]
    assert [text.ratio_of(a, b) for a, b in cases] == want
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert [text.ratio_of(a, b) for a, b in cases[:2000]] == want[:2000]
