"""Judges, readers and mergers that ask: against plain runs that ask one by one."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from regionspark.config import Align
from regionspark.functions.text import infix_of
from regionspark.operators import align, hooks
from regionspark.plans import judge, two_stage
from regionspark.sources.verdicts import append_verdicts, load_verdicts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests
RULES = Align(auto_match=0.95, reject_below=0.3, group_similarity=1.1)


def some_files(seed, n_files):
    """Regions that are near many others, so that verdicts decide about each other."""
    r = random.Random(seed)
    text = lambda: "".join(r.choice("abc") for _ in range(r.randrange(4, 9)))
    return {f"f{k}": ([text() for _ in range(r.randrange(1, 6))], [text() for _ in range(r.randrange(1, 6))]) for k in range(n_files)}


def frames(spark, files):
    rows = [[(f, i, t, t) for f, sides in files.items() for i, t in enumerate(sides[k])] for k in range(2)]
    return [spark.createDataFrame(x, "source_file string, ix long, raw string, norm string").repartition(3) for x in rows]


def says(a, b):
    return (sum(map(ord, a)) * 7 + sum(map(ord, b))) % 3 == 0


def fails(a, b):
    return (len(a) * 5 + len(b)) % 4 == 0


class Asked(dict):
    """Verdicts that are asked for when they are looked up, as a judge with a cache would be."""

    def __init__(self, cache, failing):
        self.cache, self.failing, self.calls, self.hits, self.failures = dict(cache), failing, 0, 0, 0

    def get(self, key, fallback):
        if key in self.cache:
            self.hits += 1
            return self.cache[key]
        if self.failing and fails(*key):
            self.failures += 1
            return fallback
        self.calls += 1
        self.cache[key] = says(*key)
        return self.cache[key]


def plain(files, cache, failing, on_failure):
    asked, rows = Asked(cache, failing), []
    for f, (gt, pred) in files.items():
        left, right = dict(enumerate(gt)), dict(enumerate(pred))
        for i, a in enumerate(gt):
            j = next((j for j, b in right.items() if a == b), None)
            if j is not None:
                left.pop(i), right.pop(j)
                rows.append((f, "pair", [i], [j], "exact"))
        raw = {"gt": dict(enumerate(gt)), "pred": dict(enumerate(pred))}
        found = align.resolve(left, right, raw, RULES, "", asked, on_failure)
        rows += [(f, x["kind"], x["gt_ixs"], x["pred_ixs"], x["matched_by"]) for x in found]
    return sorted(rows), (asked.calls, asked.hits, asked.failures)


def fake_judge():
    """Fails the first two times for every pair, for some pairs always."""
    tries = {}

    def ask(a, b):
        tries[a, b] = tries.get((a, b), 0) + 1
        if tries[a, b] < 3 or fails(a, b):
            raise TimeoutError("no answer")
        return says(a, b)

    return ask


def sure_judge():
    return says


@pytest.mark.parametrize("on_failure", ["auto", "accept"])
def test_judged_matches(spark, on_failure, tmp_path):
    files = some_files(4, 9)
    gt, pred = frames(spark, files)
    texts = sorted({(a, b) for g, p in files.values() for a in g for b in p})
    held = {x: not says(*x) for x in texts[::5]}  # a cache that says otherwise shows that it is used
    asking = judge.Asking(fake_judge, f"fake-{on_failure}", "m", "p", retries=3, wait=0.0, on_failure=on_failure, tasks=2)
    key = judge.verdict_key(F.lit("m"), F.lit("p"), F.col("gt"), F.col("pred"))
    store = str(tmp_path / "cache")
    cache = spark.createDataFrame([(*k, v) for k, v in held.items()], "gt string, pred string, same boolean").select(key.alias("key"), "same")
    append_verdicts(cache, store)
    got = judge.judged_matches(gt, pred, asking, store, RULES)
    want, counts = plain(files, held, True, on_failure)
    assert sorted((r.source_file, r.kind, r.gt_ixs, r.pred_ixs, r.matched_by) for r in got.matches.collect()) == want
    assert tuple(judge.tallies(got, gt, pred).first()) == counts and got.rounds > 1
    assert load_verdicts(spark, store).count() == len(held) + counts[0]
    if on_failure == "auto":  # what was answered is in the store: a second run asks only what failed
        again = judge.judged_matches(gt, pred, asking, store, RULES)
        assert sorted(map(str, again.matches.collect())) == sorted(map(str, got.matches.collect()))
        calls, hits, failures = judge.tallies(again, gt, pred).first()
        assert (calls, failures) == (0, counts[2]) and hits == counts[0] + counts[1]


def test_a_failure_that_is_an_error(spark):
    gt, pred = frames(spark, some_files(4, 9))
    with pytest.raises(Exception, match="judge failed: TimeoutError"):
        judge.judged_matches(gt, pred, judge.Asking(fake_judge, "fake-error", retries=1, wait=0.0, on_failure="error"), rules=RULES).matches.collect()
    with pytest.raises(ValueError):
        judge.judged_matches(gt, pred, judge.Asking(sure_judge, on_failure="maybe"))


def test_a_verdict_decides_what_is_asked(spark):
    """The best pair is asked first; only if it is rejected are its sides free for the next ones."""
    files = {"f": (["abcdef", "abcdxy"], ["abcdez", "abcxyz"])}
    gt, pred = frames(spark, files)
    rules = Align(auto_match=0.99, reject_below=0.4, group_similarity=1.1)
    yes = judge.judged_matches(gt, pred, judge.Asking(lambda: lambda a, b: True, "yes", wait=0.0), rules=rules)
    no = judge.judged_matches(gt, pred, judge.Asking(lambda: lambda a, b: False, "no", wait=0.0), rules=rules)
    assert (yes.verdicts.count(), no.verdicts.count()) == (2, 4)


def test_failing_rows_are_apart(spark):
    made = lambda: lambda x: 10 // x
    df = spark.createDataFrame([(k, k % 3) for k in range(9)], "i int, x int")
    got = hooks.call_rows(df, "divide", made, ["x"], "y", "int", tasks=2).collect()
    assert all((r.y, r.error is None) == ((10 // r.x, True) if r.x else (None, False)) for r in got) and len(got) == 9
    assert "ZeroDivisionError" in next(r.error for r in got if r.x == 0)


def reader():
    def read(path, prompt):
        n = int(path.split("/")[-1].split(".")[0])
        if n == 3:
            raise OSError("no such picture")
        if n == 4:
            return "I cannot read this"
        blanks = 5 if n % 2 and not prompt.startswith("The last reading") else 1
        lines = [{"text": f"line {n} {k}"} for k in range(4)] + [{"text": " "}] * blanks
        return "```json\n" + json.dumps({"lines": lines if n % 5 else lines[:-1] + ["bare"]}) + ("" if n % 7 else ",")

    return read


def merger():
    def merge(path, prompt, data):
        lines = json.loads(data)
        n = int(path.split("/")[-1].split(".")[0])
        if n == 6:
            raise OSError("busy")
        drop = {2: {2, 3}, 5: {1}}.get(n, set()) if prompt.startswith("The last reply") else {3} if n % 2 else {2, 3} if n == 2 else set()
        kept = [x for x in lines if x["line_id"] not in drop]
        merged = [{"merged_id": 9, "original_line_ids": [str(x["line_id"]), "?"], "merged_text": x["text"].upper()} for x in kept]
        return json.dumps(merged if n % 2 else {"merged_lines": merged})

    return merge


def test_two_stages(spark):
    images = spark.createDataFrame([(f"in/{k}.png",) for k in range(9)], "path string")
    one = two_stage.read_pictures(images, reader, "Read.", name="fake-reader", tasks=2)
    got = {r.file_name: r for r in one.collect()}
    assert len(got) == 9 and got["3.png"].error == "OSError: no such picture" and got["4.png"].error == "reply is no JSON"
    for k in set(range(9)) - {3, 4}:
        want = [f"line {k} {i}" for i in range(4)] + (["bare"] if k % 5 == 0 else [])
        assert [(x.line_id, x.text) for x in got[f"{k}.png"].lines] == list(enumerate(want, 1)) and got[f"{k}.png"].error is None
    stage1 = one.where("error is null")
    two = {r.file_name: r for r in two_stage.merge_lines(stage1, merger, "Merge.", name="fake-merger").collect()}
    assert set(two) == {f"{k}.png" for k in set(range(9)) - {3, 4}}
    assert two["6.png"].error == "OSError: busy" and two["6.png"].merged_lines == []
    assert {k: r.fallback_ids for k, r in two.items() if r.fallback_ids} == {"2.png": [2, 3], "5.png": [1]}
    for k, r in two.items():
        if r.error is None:
            lines = {x.line_id: x.text for x in got[k].lines}
            assert sorted(i for m in r.merged_lines for i in m.original_line_ids) == sorted(lines)
            assert [m.merged_id for m in r.merged_lines] == list(range(1, len(r.merged_lines) + 1)) and r.total_merged_lines == len(lines)
            fell = r.fallback_ids
            assert [m.merged_text for m in r.merged_lines] == [lines[i].upper() for i in lines if i not in fell] + [lines[i] for i in fell]


def test_infix_helper():
    assert infix_of("abc", "xxabcxx") == (0, 5)


def test_rounds_do_not_repeat_the_exact_pass(spark, monkeypatch):
    from regionspark.operators import align

    calls = []
    once = align.partners
    monkeypatch.setattr(align, "partners", lambda *a: calls.append(a) or once(*a))
    rows = lambda texts: spark.createDataFrame([("f", i, t, t) for i, t in enumerate(texts)], "source_file string, ix long, raw string, norm string")
    found = judge.judged_matches(rows(["abcdefghij"]), rows(["abcdefgxyz"]), judge.Asking(lambda: lambda a, b: True, "yes", wait=0.0, tasks=1))
    assert found.rounds == 1 and len(calls) == 2
    assert [(r.kind, r.matched_by) for r in found.matches.orderBy("kind").collect()] == [("pair", "judge"), ("uncertain", "same")]


def test_regions_are_scored_once_for_all_rounds(spark, monkeypatch):
    from regionspark.operators import align

    calls = []
    once = align.resolved
    monkeypatch.setattr(align, "resolved", lambda *a, **k: calls.append(a) or once(*a, **k))
    files = some_files(4, 9)
    found = judge.judged_matches(*frames(spark, files), judge.Asking(sure_judge, "sure", wait=0.0, tasks=2), rules=RULES)
    assert found.rounds > 1 and len(calls) == 1
    assert sorted((r.source_file, r.kind, r.gt_ixs, r.pred_ixs, r.matched_by) for r in found.matches.collect()) == plain(files, {}, False, "auto")[0]
