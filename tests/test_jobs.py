"""The jobs: whole results, reruns, growing input, failures; on copies below tmp_path."""

import hashlib
import json
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import queries, score_predictions, training_set
from jobs.common import load_config
from regionspark.functions.text import normalize_ascii
from regionspark.operators import align, metrics
from regionspark.operators.dataset import split_sizes
from regionspark.stages import drop_stage

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string, extra string"


def documents(n, lang=("en", "de", None)):
    text = lambda k: None if k % 17 == 0 else "" if k % 19 == 0 else f"line {k}　\n\n with the\t{k}\x1c{k} words\r\n<EMPTY>\nthird"
    return [(k, text(k), lang[k % len(lang)], f"s{k % 3}", "x") for k in range(n)]


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_training_set(spark, tmp_path):
    docs = documents(200) + [(None, "lost", "en", "s0", "x"), (5, "another five", "en", "s1", "x"), (5, "zz five", "en", "s1", "x"), (5, "zz five", "en", "s1", "x")]
    labels = [(k, int(k % 10 > 1), int(k % 25 == 0)) for k in range(0, 200, 2)] + [(7, None, None), (None, 0, 1), (9, 1, 0), (9, 0, 0)]
    write(spark, docs, DOCS, tmp_path / "docs")
    write(spark, labels, "doc_id long, quality int, toxic int", tmp_path / "labels")
    paths = [str(tmp_path / x) for x in ("docs", "labels", "out")]
    counts = training_set.build(spark, *paths)
    first = rows_of(training_set.read_back(spark, paths[2]))
    bad = {k for k, q, t in labels if k is not None and (q == 0 or t == 1)}
    kept = sorted(set(range(200)) - bad)
    sizes = split_sizes(len(kept))
    assert counts == {"read": 201, "rejected": len(bad) + 1, **sizes}
    order = sorted(kept, key=lambda k: (k * 7919 % 1_000_003, k))
    got = {r.doc_id: r for r in training_set.read_back(spark, paths[2]).collect()}
    assert set(got) == set(kept)
    for place, k in enumerate(order):
        assert got[k].split == ("test" if place < sizes["test"] else "eval" if place < sizes["test"] + sizes["eval"] else "train")
    text = dict((k, t) for k, t, *_ in docs) | {5: "zz five"}
    for k in kept:
        lines = [x.strip() for x in (text[k] or "").splitlines() if x.strip()] or ["<EMPTY>"]
        assert got[k].messages[1].content[0].text == "\n".join(lines) and got[k].n_lines == len(lines)
        assert got[k].images == [f"images/{k}.png"] and got[k].messages[0].content[1].text == training_set.TrainingSet.prompt
    rejected = {(r.doc_id, r.reason) for r in spark.read.parquet(f"{paths[2]}/rejected").collect()}
    assert (None, "no key") in rejected and (9, "quality") in rejected and len(rejected) == len(bad) + 1
    report = spark.read.json(f"{paths[2]}/report").groupBy("split").sum("n").collect()
    assert {r[0]: r[1] for r in report} == sizes
    assert training_set.build(spark, *paths) == counts and rows_of(training_set.read_back(spark, paths[2])) == first


def test_training_set_of_nothing(spark, tmp_path):
    write(spark, [], DOCS, tmp_path / "docs")
    write(spark, [], "doc_id long, quality int, toxic int", tmp_path / "labels")
    counts = training_set.build(spark, *[str(tmp_path / x) for x in ("docs", "labels", "out")])
    assert counts == {"read": 0, "rejected": 0, "train": 0, "eval": 0, "test": 0}


@pytest.fixture
def scoring(spark, tmp_path):
    """Documents and a folder of predictions that grows; `add` writes one more file, `go` runs the job."""
    write(spark, documents(60), DOCS, tmp_path / "docs")
    (tmp_path / "predictions").mkdir()

    class Case:
        docs, out, checkpoint = (str(tmp_path / x) for x in ("docs", "out", "checkpoint"))

        def add(self, rows):
            write(spark, rows, score_predictions.PREDICTIONS, tmp_path / "predictions")

        def go(self, **config):
            return score_predictions.run(spark, self.docs, str(tmp_path / "predictions"), self.out, self.checkpoint, score_predictions.Scoring(**config))

        def items(self):
            return {r.source_file: r for r in score_predictions.items(spark, self.out).collect()}

        def all(self):
            return rows_of(score_predictions.read_back(spark, self.out))

    return Case()


def own_lines(k):
    text = documents(60)[k][1]
    return [x.strip() for x in (text or "").splitlines() if x.strip() and x.strip() != "<EMPTY>"]


def test_scores_of_growing_predictions(spark, scoring):
    assert scoring.go() == {"batches": 0, "records": 0, "scored": 0, "without_prediction": 60}
    scoring.add([(k, 0, own_lines(k)) for k in range(20)] + [(1, -1, ["older"]), (900, 0, ["unknown"]), (None, 0, ["lost"]), (2, 0, own_lines(2))])
    assert scoring.go() == {"batches": 1, "records": 24, "scored": 20, "without_prediction": 40}
    first = scoring.items()
    assert set(first) == set(range(20)) and all(r.cer == 0 and r.f1 == 1 for r in first.values())
    assert scoring.go()["batches"] == 0 and scoring.items() == first
    scoring.add([(3, 0, ["other words"]), (30, 0, None), (31, 5, own_lines(31)[:1])])
    assert scoring.go() == {"batches": 1, "records": 3, "scored": 22, "without_prediction": 38}
    second = scoring.items()
    n = len(own_lines(3))
    assert (second[3].matched_gt, second[3].gt, second[3].pred, second[3].recall) == (0, n, 1, 0) and second[30].pred == 0
    assert second[31].matched_gt == 1 and {k: v for k, v in second.items() if k not in (3, 30, 31)} == {k: v for k, v in first.items() if k != 3}
    summary = spark.read.parquet(f"{scoring.out}/summary").collect()
    assert sum(r.n_files for r in summary) == 22
    for r in summary:
        mine = [x for x in second.values() if (x.lang, x.source) == (r.lang, r.source)]
        assert r.char_errors == sum(x.char_errors for x in mine) and r.gt == sum(x.gt for x in mine)
        assert r.cer == (r.char_errors / r.char_length if r.char_length else float(r.char_errors > 0))


def test_a_batch_that_failed_is_run_again(spark, scoring, monkeypatch):
    """The batch writes its items, then its run fails before the checkpoint has it: the next run writes the same folder."""
    scoring.add([(k, 0, own_lines(k)) for k in range(10)])
    whole = score_predictions.score

    def broken(rows, documents, config):
        scored, tables = whole(rows, documents, config)
        scored.write.mode("overwrite").partitionBy("lang").parquet(f"{scoring.out}/items/batch=0")
        raise RuntimeError("lost")

    monkeypatch.setattr(score_predictions, "score", broken)
    with pytest.raises(Exception, match="lost"):
        scoring.go()
    monkeypatch.setattr(score_predictions, "score", whole)
    assert scoring.go() == {"batches": 1, "records": 10, "scored": 10, "without_prediction": 50}
    assert {x.name for x in Path(scoring.out, "items").iterdir()} == {"batch=0"}


def test_batches_of_files_give_the_same_scores(spark, scoring, tmp_path):
    for k in range(0, 30, 10):
        scoring.add([(i, 0, own_lines(i)[: i % 3]) for i in range(k, k + 10)])
    assert scoring.go(files_per_batch=1)["batches"] == 3
    apart = scoring.all()
    shutil.rmtree(scoring.checkpoint)
    shutil.rmtree(scoring.out)
    assert scoring.go()["batches"] == 1 and scoring.all() == apart


def test_all_passes(spark, scoring):
    scoring.add([(1, 0, [" ".join(own_lines(1))]), (2, 0, ["ｌｉｎｅ 2", *own_lines(2)[1:]])])
    scoring.go(passes="all", normalize="unicode")
    got = scoring.items()
    assert got[1].recall == 1 and got[1].cer == 0 and got[2].recall == 1 and got[2].cer == 0
    with pytest.raises(ValueError):
        scoring.go(passes="some")


def test_exact_scores_count_texts(spark, monkeypatch):
    """The exact passes give what per_file gives of the exact matches, but no region is numbered, sorted or joined: the only
    join of the plan is the one of records."""
    monkeypatch.setattr(metrics, "charges_by_kind", None)  # the joins of regions
    docs = spark.createDataFrame([(1, "A b\r\nc\nc\nd ３４", "en", "s"), (2, "x", "en", "s"), (3, None, None, None)], DOCS.rsplit(",", 1)[0])
    records = spark.createDataFrame([(1, 0, ["c", "aB", "c", "c", None, " "]), (2, 0, None), (3, 0, [None]), (4, 0, ["z"])], score_predictions.PREDICTIONS)
    scored, tables = score_predictions.score(records, docs, score_predictions.Scoring())
    got = {r.source_file: tuple(r[c] for c in score_predictions.ITEMS[:8]) for r in scored.collect()}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert got == {1: (4, 6, 3, 3, 4, 7, 4, 6), 2: (1, 0, 0, 0, 1, 1, 1, 1), 3: (0, 1, 0, 0, 0, 0, 0, 0)}
    assert plan.count("Join Inner") == 1 and "Window" not in plan
    drop_stage(*tables)


def test_exact_per_file_is_per_file(spark):
    r = random.Random(7)
    some = lambda: r.choice([[], None]) if r.random() < 0.1 else [r.choice(["a b", "A  B", "ab", "c, 12.5", "", None, "ｄ　"]) for _ in range(r.randrange(9))]
    records = spark.createDataFrame([(k, some(), some()) for k in range(60)], "source_file long, gt array<string>, pred array<string>")
    side = lambda name: records.select("source_file", F.posexplode(name).alias("ix", "raw")).select("source_file", F.col("ix").cast("long").alias("ix"), "raw", normalize_ascii(F.col("raw")).alias("norm"))
    gt, pred = side("gt"), side("pred")
    whole = metrics.per_file(align.exact_matches(gt, pred), gt, pred, records.select("source_file"))
    assert rows_of(metrics.exact_per_file(records, normalize_ascii).select(*whole.columns)) == rows_of(whole)


def test_config_files():
    for module, kind in ((training_set, training_set.TrainingSet), (score_predictions, score_predictions.Scoring)):
        path = module.__file__.replace(".py", ".json")
        assert load_config(kind, path) == kind()
        assert set(json.loads(Path(path).read_text())) == set(kind.__dataclass_fields__)
    with pytest.raises(ValueError, match="unknown keys"):
        load_config(score_predictions.Scoring, text='{"pass": 1}')


def test_command_line(spark, tmp_path):
    write(spark, documents(30), DOCS, tmp_path / "docs")
    write(spark, [(1, 0, 0)], "doc_id long, quality int, toxic int", tmp_path / "labels")
    args = [f"--{k}={tmp_path / v}" for k, v in (("documents", "docs"), ("labels", "labels"), ("out", "out"))]
    done = subprocess.run([sys.executable, "-m", "jobs.training_set", *args, "--config=jobs/training_set.json"], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 30 documents" in done.stderr and "1 rejected" in done.stderr
    assert training_set.read_back(spark, f"{tmp_path}/out").count() == 29


def test_queries_leave_settings_alone(spark, tmp_path):
    write(spark, documents(40), DOCS, tmp_path / "documents.parquet")
    write(spark, [(1, 0, 0)], "doc_id long, quality int, toxic int", tmp_path / "labels.parquet")
    before = dict(spark.conf.getAll)
    a = queries.job1_training_set(spark, str(tmp_path))
    b = queries.job2_score_predictions(spark, str(tmp_path))
    assert a.count() == 39 and b.where("level = 'file'").count() == len([k for k in range(40) if k % 9 != 4])
    assert dict(spark.conf.getAll) == before and not spark.catalog.listTables()
    assert hashlib.sha256(b"<EMPTY>").hexdigest() in {r.answer_sha256 for r in a.collect()}
