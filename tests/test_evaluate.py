"""The evaluator: worked cases, an independent aligner, invariance, readers, lines, layout, datasets."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from regionspark.config import Align, Input, Settings, load
from regionspark.functions import claims, text
from regionspark.operators import align, compare, dataset, layout, lines, metrics
from regionspark.plans.evaluate import evaluate
from regionspark.sources import records


def run(spark, gt, pred, **rules):
    df = lambda x: spark.createDataFrame([(k, v) for k, v in x.items()], "source_file string, regions array<string>")
    return evaluate(df(gt), df(pred), Settings(align=Align(**rules)))


def one(spark, gt, pred, **rules):
    return run(spark, {"f": gt}, {"f": pred}, **rules).items.first()


def test_merge_and_split_lose_no_characters(spark):
    m = one(spark, ["深层补水效果好", "温和不刺激肌肤"], ["深层补水效果好 温和不刺激肌肤"])
    assert (m.cer, m.recall, m.chunking_accuracy, m.merge_layout_only) == (0, 1, 0, 1)
    s = one(spark, ["深层补水效果好温和不刺激肌肤"], ["深层补水效果好", "温和不刺激肌肤"])
    assert (s.cer, s.recall, s.chunking_accuracy, s.chunk_split) == (0, 1, 0, 2)


def test_marks_lost_in_a_merge(spark):
    m = one(spark, ["72H（2）锁水保湿", "深层补水效果好"], ["72h锁水保湿 深层补水效果好"])
    assert (m.char_errors, m.char_length, m.credited_groups) == (3, 17, 1)
    assert one(spark, ["72H（2）锁水保湿", "深层补水效果好"], ["72h锁水保湿 深层补水效果好"], group_similarity=1.1).cer > 1


def test_empty_sides(spark):
    for gt, pred, want in (([], [], (1, 1, 1)), ([], ["abc"], (0, 1, 0)), (["abc"], [], (1, 0, 0))):
        m = one(spark, gt, pred)
        assert (m.precision, m.recall, m.f1) == want


def test_credit_flags_leave_chunking(spark):
    gt, pred = {"f": ["甲乙丙丁戊己", "庚辛壬癸子丑", "whole row here"]}, {"f": ["甲乙丙丁戊己 庚辛壬癸子丑", "whole row here"]}
    a, b = run(spark, gt, pred).summary.first(), run(spark, gt, pred, merge_credit=False).summary.first()
    assert a.cer == 0 and b.cer > 0 and a.chunking_accuracy == b.chunking_accuracy == 0.5 and b.penalized_groups == 1


def test_files_without_prediction_are_counted(spark):
    e = run(spark, {"a": ["x y"], "b": ["z"]}, {"a": ["x y"], "c": ["q"]})
    assert e.coverage.first().asDict() == {"gt_files": 2, "scored_files": 1, "unpredicted_files": 1} and e.items.count() == 1


def test_judge_verdicts_are_looked_up(spark):
    gt, pred = ["abcdefghij klm", "zz"], ["abcdefgxyz klm"]
    df = lambda v: spark.createDataFrame([("f", v)], "source_file string, regions array<string>")
    assert evaluate(df(gt), df(pred)).items.first().uncertain == 1
    judged = spark.createDataFrame([(gt[0], pred[0], True)], "gt string, pred string, same boolean")
    m = evaluate(df(gt), df(pred), judged=judged).items.first()
    assert (m.matched_gt, m.uncertain) == (1, 1)
    refused = judged.select("gt", "pred", F.lit(False).alias("same"))
    assert evaluate(df(gt), df(pred), judged=refused).items.first().matched_gt == 0


def plain_align(gt: list[str], pred: list[str], rules: Align) -> list[tuple]:
    """Pairs and groups by the definition, without any pruning."""
    free_g, free_p, out = set(range(len(gt))), set(range(len(pred))), []
    for i in range(len(gt)):
        j = next((j for j in sorted(free_p) if pred[j] == gt[i]), None)
        if j is not None:
            out.append(("pair", (i,), (j,)))
            free_g.discard(i)
            free_p.discard(j)

    def infix(a, b):
        rows = [[0] * (len(b) + 1)]
        for i, c in enumerate(a, 1):
            row = [i]
            for j, d in enumerate(b, 1):
                row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (c != d)))
            rows.append(row)
        return min(rows[-1]), rows[-1].index(min(rows[-1]))

    def groups(whole, part, fw, fp):
        claimed = set()
        for c in sorted(fw, key=lambda i: (-len(whole[i]), i)):
            hits = []
            for p in fp - claimed:
                if len(part[p]) < rules.min_group_part or not whole[c]:
                    continue
                at = whole[c].find(part[p])
                if at < 0:
                    d, end = infix(part[p], whole[c])
                    at = max(0, end - len(part[p])) if d <= max(3, int(len(part[p]) * rules.group_tolerance)) else -1
                if at >= 0:
                    hits.append((at, p))
            hits.sort()
            if len(hits) > 1 and text.similarity_of(whole[c], "".join(part[p] for _, p in hits)) >= rules.group_similarity:
                claimed |= {p for _, p in hits}
                yield c, tuple(p for _, p in hits)

    for c, ps in list(groups(pred, gt, set(free_p), set(free_g))):
        out.append(("merge", ps, (c,)))
        free_g -= set(ps)
        free_p.discard(c)
    for c, ps in list(groups(gt, pred, set(free_g), set(free_p))):
        out.append(("split", (c,), ps))
        free_p -= set(ps)
        free_g.discard(c)
    near = sorted((-text.similarity_of(gt[i], pred[j]), i, j) for i in free_g for j in free_p)
    for s, i, j in near:
        if -s >= rules.auto_match and i in free_g and j in free_p:
            out.append(("pair", (i,), (j,)))
            free_g.discard(i)
            free_p.discard(j)
    return sorted(out)


def test_alignment_against_an_independent_aligner(spark):
    rng = random.Random(5)
    gt, pred = {}, {}
    for f in range(40):
        g = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 14))) for _ in range(rng.randrange(0, 7))]
        p = []
        for x in g:
            k = rng.random()
            p += [x] if k < 0.3 else [x[: len(x) // 2], x[len(x) // 2 :]] if k < 0.5 else [x.replace("a", "b", 1)] if k < 0.7 else []
        if len(g) > 1:
            p.append(g[0] + g[1])
        rng.shuffle(p)
        gt[str(f)], pred[str(f)] = g, [x for x in p if x]
    found = {}
    for r in run(spark, gt, pred).matches.where("kind != 'uncertain'").collect():
        found.setdefault(r.source_file, []).append((r.kind, tuple(r.gt_ixs), tuple(r.pred_ixs)))
    for f in gt:
        assert sorted(found.get(f, [])) == plain_align(gt[f], pred[f], Align()), f


def test_self_alignment_and_sums(spark):
    rows = {str(k): [f"region {k} {i}" for i in range(k)] for k in range(1, 6)}
    s = run(spark, rows, rows).summary.first()
    assert (s.cer, s.wer, s.f1, s.chunking_accuracy) == (0, 0, 1, 1) and s.matched_gt == s.gt == 15


def test_published_report(spark):
    """The published corpus rates follow from the published per-sample report."""
    path = os.environ.get("REGIONSPARK_REPORT", "")
    if not os.path.exists(path):
        pytest.skip("no report given")
    r = records.read_markdown_report(spark, path).withColumn("source_file", F.col("row_ix").cast("string"))
    pred = r.select("source_file", F.filter("prediction", lambda x: ~x.isin("<think></think>")).alias("regions"))
    s = evaluate(r.select("source_file", F.col("ground_truth").alias("regions")), pred).summary.first()
    assert [round(x, 4) for x in (s.cer, s.wer, s.precision, s.recall, s.f1, s.chunking_accuracy)] == [1.3978, 1.1811, 0.4421, 0.7261, 0.5496, 0.5981]


def test_text_functions(spark):
    row = spark.range(1).select(text.tokenize(F.lit("累计40,000,000+件热销")).alias("t"), text.normalize(F.lit(" （5）　Straße ")).alias("n"), text.token_distance(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("d"), text.similarity(F.lit("abcbd"), F.lit("dbcab")).alias("s"), text.infix_distance(F.lit("abx"), F.lit("zzabczz")).alias("i")).first()
    assert row.t == ["累", "计", "40,000,000", "+", "件", "热", "销"] and row.n == "(5)strasse" and row.d == 1
    assert row.s == pytest.approx(0.4) and (row.i.distance, row.i.end) == (1, 4)
    assert text.infix_of("", "abc") == (0, 0) and text.infix_of("abc", "") == (3, 0)


def test_claim_gate(spark):
    texts = ["全新添加0.2%甘草酸二钾", "2周改善法令纹", "72H锁水保湿", "敏感肌适用", "￥ 99 保湿", "12345678", "50 ml", " ", "SK-II", "净含量 保湿"]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(claims.is_claim(F.col("t"), ["sk-ii"]).alias("c")).collect()]
    assert got == [True, True, True, False, False, False, False, False, False, False]


@pytest.mark.parametrize("body", ['[{"source_file":"x/a.png","claim_text":["q"]},{"source_file":"a.png","claim_text":[" x ","","<EMPTY>","y"]},{"file_name":"b.png","text":"u\\nv"},{"image":"c.png","lines":[]}]', '{"items":[{"source_file":"a.png","claim_text":["x","y"]},{"file_name":"b.png","text":"u\\r\\nv"},{"image":"c.png","text":"<EMPTY>"}]}', '[\n{"source_file":"a.png","claim_text":["x","y"]},\n\n{"file_name":"b.png","text":"u\\nv"},\n{"image":"c.png","lines":""}\n]\n{"image":"c.png","lines":[]},', '{"source_file":"a.png","claim_text":["x","y"]}\n{"file_name":"b.png","text":"u\\nv"},\n{"image":"c.png","lines":[]}'])
def test_record_dialects(spark, tmp_path, body):
    (tmp_path / "r.json").write_text(body)
    got = {r.source_file: r.regions for r in records.load_regions(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"a.png": ["x", "y"], "b.png": ["u", "v"], "c.png": []}


@pytest.mark.parametrize("body", ['[{"claim_text":["x"]}]', '[{"source_file":"a","claim_text":null,"lines":["x"]}]', '{"source_file":"a","lines":["x"]}\nnot json'])
def test_bad_records_raise(spark, tmp_path, body):
    (tmp_path / "r.json").write_text(body)
    with pytest.raises(Exception):
        records.load_regions(spark, str(tmp_path / "r.json"), Input()).collect()


def test_lines_are_never_lost(spark):
    stage1 = spark.createDataFrame([("a", ["h", " ", "x", "y", "z"]), ("b", [])], "file_name string, t array<string>").select("file_name", lines.number_lines(F.col("t")).alias("lines"))
    replies = spark.createDataFrame([("a", [(1, [2, 3], "x y")])], f"file_name string, merged_lines {lines.MERGED}")
    got = {r.file_name: r for r in lines.consolidate(stage1, replies).collect()}
    assert [(m.merged_id, m.original_line_ids, m.merged_text) for m in got["a"].merged_lines] == [(1, [2, 3], "x y"), (2, [1], "h"), (3, [4], "z")]
    assert got["a"].fallback_ids == [1, 4] and got["b"].error == "no reply" and got["b"].merged_lines == []
    simple = {r.file_name: r for r in lines.simplify(lines.consolidate(stage1, replies)).collect()}
    assert simple["a (Manual Revision Needed)"].lines == ["x y", "h", "z"] and simple["b"].status is None


def test_replies_are_repaired(spark):
    replies = ['```json\n{"lines": ["a", {"text": "b"}]}\n```', '[{"text":"a"},"b"]', 'so: {"lines": ["a", "b"', '{"lines": ["a", "b",]}', "nothing"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").orderBy("i")
    got = [r.t for r in df.select(F.coalesce(lines.reply_lines(lines.parse_reply(F.col("r"))), F.array()).alias("t")).collect()]
    assert got == [["a", "b"]] * 4 + [[]]


def test_reading_order(spark):
    b = [("p", "right", 50, 0, 90, 10), ("p", "left", 0, 1, 40, 11), ("p", "low", 0, 30, 20, 40), ("p", "er", 21, 31, 40, 41)]
    df = spark.createDataFrame([(*x[:2], *map(float, x[2:])) for x in b], "page string, text string, x_min double, y_min double, x_max double, y_max double")
    assert [r.text for r in layout.render_lines(layout.cluster_lines(df)).orderBy("line_ix").collect()] == ["left right", "lower"]


def test_split_and_chat(spark):
    df = spark.createDataFrame([(f"f{i}", ["x"]) for i in range(311)], "file_name string, lines array<string>")
    split = dataset.exact_split(df)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"test": 31, "eval": 31, "train": 249}
    assert split.select("file_name").distinct().count() == 311 and sorted(split.collect()) == sorted(dataset.exact_split(df.repartition(9)).collect())
    chat = dataset.chat_records(df.limit(1), "root/", "Read.").first()
    assert chat.images[0].startswith("root/f") and [m.role for m in chat.messages] == ["user", "assistant"] and chat.messages[0].content[0].type == "image"
    assert spark.range(1).select(dataset.clean_lines(F.array(F.lit(" "))).alias("c")).first().c == ["<EMPTY>"]


def test_frames_and_config(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "model string, s double, c double")
    got = {r.model: (r.s, r.c) for r in compare.min_max(df, ["s", "c"], ["s"]).collect()}
    assert got == {"a": (1.0, None), "b": (0.0, None)} and compare.melt(df, ["model"], ["s", "c"]).count() == 4
    (tmp_path / "c.toml").write_text('[align]\nauto_match = 0.8\nmerge_credit = "no"\n')
    s = load(str(tmp_path / "c.toml"), {"align": {"split_credit": False}})
    assert (s.align.auto_match, s.align.merge_credit, s.align.split_credit) == (0.8, False, False) and load(None) == Settings()


def test_stream_evaluates_each_batch(spark, tmp_path):
    from regionspark.streaming.evaluation import evaluate_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"source_file": "a", "regions": ["x y"]}))
    stream = spark.readStream.schema("source_file string, regions array<string>").json(str(tmp_path / "in"))
    gt = spark.createDataFrame([("a", ["x y"]), ("b", ["z"])], "source_file string, regions array<string>")
    evaluate_stream(stream, gt, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().f1 == 1


def test_metrics_sum_before_dividing(spark):
    e = run(spark, {"a": ["abcd"], "b": ["x" * 96]}, {"a": ["zzzz"], "b": ["x" * 96]})
    s = e.summary.first()
    assert s.cer == pytest.approx(8 / 100) and metrics.corpus(e.items, "source_file").count() == 2
    assert align.MATCHES.startswith("kind")


@pytest.mark.parametrize("side", ["gt_regions", "pred_regions"])
def test_no_filter_splits_the_texts_again(spark, tmp_path, side):
    """A filter of that kind had a document's whole split in its lambdas, once for each of its sentences."""
    from regionspark import carrier

    spark.createDataFrame([(1, "one. two.\nthree"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = getattr(carrier, side)(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert {r.source_file for r in rows.collect()} == {1}
