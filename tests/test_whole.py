"""Nothing is cut or capped: long token lists, exact splits, numbered errors, verdict caches, listings."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionspark.functions import claims, text
from regionspark.operators import align, compare, dataset, lines
from regionspark.plans.evaluate import evaluate
from regionspark.sources import records, verdicts
from regionspark.streaming.evaluation import streamed_items


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_token_distance_of_any_number_of_tokens(spark):
    r = random.Random(3)
    pairs = [([str(r.randrange(k)) for _ in range(n)], [str(r.randrange(k)) for _ in range(m)]) for k, n, m in ((3, 20, 30), (500, 200, 90), (4, 0, 7), (9, 0, 0))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: r.d for r in df.select("i", text.token_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: plain_distance(a, b) for i, (a, b) in enumerate(pairs)}
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(21_000)), lambda x: x.cast("string")).alias("a"))
    assert wide.select(text.token_distance(F.col("a"), F.slice("a", 3, 30_000))).first()[0] == 2
    none = spark.sql("select cast(null as array<string>) a, array('x') b")
    assert none.select(text.token_distance(F.col("a"), F.col("b"))).first()[0] is None


@pytest.mark.parametrize("block", [1, 500, 1 << 18])
def test_distances_of_many_pairs(monkeypatch, block):
    monkeypatch.setattr(text, "BLOCK", block)
    r = random.Random(block)
    sizes = [(n, m) for n in (0, 1, 2, 9, 63, 64, 65, 70) for m in (0, 1, 5, 64, 66, 130)]
    lists = [[r.randrange(k) for _ in range(n)] for k in (2, 9, 500) for pair in sizes for n in pair]
    size = np.array([len(x) for x in lists])
    got = text.distances_of(np.array([t for x in lists for t in x]), tuple((np.cumsum(size) - size)[i::2] for i in (0, 1)), (size[::2], size[1::2]))
    assert got.tolist() == [plain_distance(a, b) for a, b in zip(lists[::2], lists[1::2])]


def test_list_distance_of_a_batch(spark):
    """Short lists are not looked up in each other token by token; nulls and empty lists keep their places in a batch."""
    r = random.Random(4)
    some = lambda: r.choice([None, []]) if r.random() < 0.2 else [r.choice("abcdefé") for _ in range(r.randrange(100))]
    pairs = [(some(), some()) for _ in range(200)] + [(["a"], ["a"]), (["a", None], ["b", None])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>").coalesce(1)
    found = df.select("i", text.list_distance(F.col("a"), F.col("b")).alias("d"))
    none = lambda a, b: None if a is None or b is None else 2 if None in a else plain_distance(a, b)
    assert {x.i: x.d for x in found.collect()} == {i: none(a, b) for i, (a, b) in enumerate(pairs)}
    assert "array_position" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_and_line_ends_are_those_of_python(spark):
    chars = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    both = df.select("c", text.strip(F.concat("c", F.lit("a"), "c", F.lit("b "), "c")).alias("s"), F.size(text.split_at(F.concat(F.lit("x"), "c", F.lit("y")), text.LINE_ENDS)).alias("n"))
    for r in both.collect():
        assert r.s == f"{r.c}a{r.c}b {r.c}".strip() and r.n == len(f"x{r.c}y".splitlines()), hex(ord(r.c))


@pytest.mark.parametrize("n", [0, 1, 9, 10, 1000])
@pytest.mark.parametrize("order", [None, "same", "value"])
def test_exact_split_is_exact(spark, n, order):
    """Also with repeated keys, with all rows tied, and with uneven orders."""
    df = spark.range(n).select((F.col("id") % 700).cast("string").alias("file_name"), (F.col("id") * F.col("id")).alias("v"))
    by = {None: None, "same": F.lit(5), "value": F.col("v")}[order]
    got = dataset.exact_split(df, order=by, span=7, rows=3)
    assert got.columns == ["file_name", "v", "split"]
    sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert sizes == {k: v for k, v in dataset.split_sizes(n).items() if v}
    if order == "value" and n == 1000:
        rows = sorted((r.v, r.split) for r in got.collect())
        assert [s for _, s in rows] == ["test"] * 100 + ["eval"] * 100 + ["train"] * 800


def test_bad_lines_are_named(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"file_name": "a"}\n\n]\n{"file_name": \n')
    with pytest.raises(Exception, match="line 4"):
        records.read_records(spark, str(path)).collect()
    path.write_text("[\n\n")
    with pytest.raises(Exception, match="no records"):
        records.read_records(spark, str(path)).collect()


def test_verdict_store(spark, tmp_path):
    load = lambda name: {tuple(r) for r in verdicts.load_verdicts(spark, str(tmp_path / name)).collect()}
    made = lambda *rows: spark.createDataFrame(rows, verdicts.SCHEMA)
    assert load("none.json") == set()
    (tmp_path / "bad.json").write_text("{not json")
    assert load("bad.json") == set()
    (tmp_path / "good.json").write_text('{"k1": true,\n "k2": false, "k3": "x"}')
    assert load("good.json") == {("k1", True), ("k2", False)}
    (tmp_path / "lines.json").write_text('{"k1": true}\n{broken\n{"k2": false}\n')
    assert load("lines.json") == {("k1", True), ("k2", False)}
    store = str(tmp_path / "store")
    assert verdicts.append_verdicts(made(("a", True), ("b", True)), store) == 0
    assert verdicts.append_verdicts(made(("b", False), ("c", True), (None, True)), store) == 1
    assert load("store") == {("a", True), ("b", False), ("c", True)}
    (tmp_path / "store" / "part=1" / "part-x.json").write_text("{half a li")
    (tmp_path / "store" / "old.json").write_text('{"a": false, "d": true}')
    assert load("store") == {("a", True), ("b", False), ("c", True), ("d", True)}
    verdicts.compact_verdicts(spark, store)
    assert load("store") == {("a", True), ("b", False), ("c", True), ("d", True)}
    assert {x.name for x in (tmp_path / "store").iterdir() if x.is_dir()} == {"part=0"}
    assert verdicts.append_verdicts(made(("a", False)), store) == 1 and ("a", False) in load("store")
    verdicts.write_verdicts(made(("z", True)), store)
    assert load("store") == {("z", True)}


def test_layout_of_one_entry_a_line(spark):
    square = "[[1,2],[5,2],[5,6],[1,6]]"
    bodies = [f'[[{square},["a ",0.9]],[{square},["b",0.4]]]', f'[[[{square},["c",0.5]]],null,[[{square},["d",1]]]]']
    pages = spark.createDataFrame(list(enumerate(bodies)), "page int, body string").select("page", F.parse_json("body").alias("lines"))
    got = sorted((r.page, r.box_ix, r.text, r.confidence, r.x_min, r.y_max) for r in records.box_rows_by_line(pages).collect())
    assert got == [(0, 0, "a", 0.9, 1, 6), (0, 1, "b", 0.4, 1, 6), (1, 0, "c", 0.5, 1, 6), (1, 1, "d", 1.0, 1, 6)]


def test_images_of_every_kind_of_input(spark, tmp_path):
    for name in ("x.png", "y.txt", "w.webp", "g.gif", "T.TIFF", "a.pdf", "deep/er/b.Bmp", "deep/no"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    names = lambda x: [r.file_name for r in records.images_of(spark, x).collect()]
    assert names(str(tmp_path)) == ["T.TIFF", "a.pdf", "b.Bmp", "x.png"]
    assert names("http://h/p/z.JPG?size=2") == ["z.JPG"]
    assert names(str(tmp_path / "y.txt")) == ["y.txt"] and names(str(tmp_path / "none.png")) == []
    assert names(f'["http://h/p/img?id=3", "{tmp_path}/deep", "/q/a.webp", "/q/b"]') == ["img", "b.Bmp", "a.webp", "b"]
    assert names(["/q/b", str(tmp_path / "y.txt")]) == ["b", "y.txt"] and names([]) == [] and names("[") == []
    assert [r.file_name for r in records.list_images(spark, str(tmp_path), False, "*.png").collect()] == ["x.png"]


def test_json_lines_in_splits(spark, tmp_path):
    """Line numbers run through a file that is read in many splits; errors name their line."""
    bodies = [f'{{"file_name": "f{k}", "text": "{"x" * (k % 97)}"}}' + ("," if k % 3 else "") for k in range(2_000)]
    lines = [x for k, body in enumerate(bodies) for x in ([body] if k % 5 else ["", "[", body])]
    (tmp_path / "a.jsonl").write_text("\r\n".join(lines))
    (tmp_path / "b.jsonl").write_text('{"file_name": "only"}\n]\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = records.read_json_lines(spark, f"{tmp_path}/*.jsonl")
        assert found.rdd.getNumPartitions() >= 1 and spark.read.text(f"{tmp_path}/a.jsonl").rdd.getNumPartitions() > 5
        got = found.select(F.regexp_extract("path", "[^/]+$", 0).alias("p"), "line", F.try_variant_get("record", "$.file_name", "string").alias("f")).collect()
        want = {("a.jsonl", n, f"f{bodies.index(x)}") for n, x in enumerate(lines, 1) if x.startswith("{")}
        assert {tuple(r) for r in got} == want | {("b.jsonl", 1, "only")} and len(got) == 2_001
        whole = records.read_records(spark, f"{tmp_path}/a.jsonl").select(F.try_variant_get("record", "$.file_name", "string")).collect()
        assert {r[0] for r in whole} == {x[2] for x in want}
        assert records.read_annotations(spark, f"{tmp_path}/a.jsonl").count() == 2_000
        lines[1_500] = "{broken"
        (tmp_path / "a.jsonl").write_text("\n".join(lines))
        with pytest.raises(Exception, match="a.jsonl is neither JSON nor JSON lines: line 1501"):
            records.read_json_lines(spark, f"{tmp_path}/*.jsonl").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c.jsonl").write_text("[\n\n]")
    with pytest.raises(Exception, match="c.jsonl has no records"):
        records.read_json_lines(spark, f"{tmp_path}/c.jsonl").collect()


def test_annotations_by_suffix(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r.record_ix for r in records.read_annotations(spark, f"{tmp_path}/a.json").orderBy("record_ix").collect()] == [0, 1]
    for text in ("[]", '{"a": 1}', '{"a": 1}\n{"a": 2}'):
        (tmp_path / "a.json").write_text(text)
        with pytest.raises(Exception, match="no JSON list"):
            records.read_annotations(spark, f"{tmp_path}/a.json").collect()


def test_only_what_needs_python_is_sent(spark, monkeypatch):
    """Replies that parse, and texts in ASCII, reach the Arrow UDFs as nulls."""
    texts = ["Ab  C", " x\ty ", "ＡＢ ß", "", None, "a\x1cb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.n for r in df.select("i", text.normalize(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [None if t is None else text.normalize_text(t) for t in texts]
    replies = ['```json\n{"lines": ["a"]}\n```', '{"lines": ["a", ]', "[1, 2]", "no json", None]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = {r.i: r.v for r in lines.parsed_replies(df).select("i", F.to_json("v").alias("v")).collect()}
    assert got == {0: '{"lines":["a"]}', 1: '["a"]', 2: "[1,2]", 3: None, 4: None}


@pytest.mark.parametrize("most,bins", [(3, 7), (10_000, 1024)])
def test_group_median(spark, most, bins):
    r = random.Random(5)
    groups = {"one": [4.0], "two": [1.0, 2.0], "same": [3.5] * 40, "wide": [10.0**k for k in range(-6, 6)], "odd": [r.random() for _ in range(101)], "even": [-r.expovariate(1) for _ in range(100)], None: [1.0, 5.0, 5.0, 9.0], "none": []}
    rows = [(k, v, j) for k, values in groups.items() for v in [*values, None] for j in (1, 2)]
    df = spark.createDataFrame(rows, "g string, v double, j int").repartition(3)
    got = {(x.g, x.j): x.median for x in compare.group_median(df, "v", ["g", "j"], bins, most).collect()}
    assert got == {(k, j): statistics.median(v) for k, v in groups.items() if v for j in (1, 2)}
    out = {x.g: (x.n, x.median) for x in compare.latency(df.where("j = 1"), "v", "g").collect()}
    assert out["none"] == (0, None) and out[None] == (4, 5.0)


def test_columns_that_clash_pass_through(spark):
    df = spark.range(30).select((F.col("id") % 7).cast("string").alias("file_name"), F.lit(1).alias("_o"), F.lit(2).alias("order"), F.lit(3).alias("border"), F.lit(4).alias("nth"), F.lit(5).alias("listed"), F.lit(6).alias("_l"))
    got = dataset.exact_split(df)
    assert got.columns == [*df.columns, "split"] and got.select("_o", "order", "border", "nth").distinct().collect() == [(1, 2, 3, 4)]
    assert dataset.existing(df, df.limit(1)).columns == df.columns
    regions = spark.createDataFrame([("f", 0, "a", 1, 2), ("f", 1, "b", 1, 2)], "source_file string, ix long, norm string, _f int, file int")
    taken = spark.createDataFrame([("f", 0, 0)], "source_file string, gt_ix long, pred_ix long")
    assert [tuple(r) for r in align.unmatched(regions, taken, "gt").collect()] == [("f", 1, "b", 1, 2)]


def test_claims_with_default_brands(spark):
    df = spark.createDataFrame([(["保湿", "skinceuticals", "修丽可 精华", "修丽可", "water"],)], "l array<string>")
    assert df.select(claims.claim_lines(F.col("l"))).first()[0] == ["保湿", "修丽可 精华"]
    assert df.select(claims.claim_lines(F.col("l"), ["保湿"])).first()[0] == ["修丽可 精华"]
    assert len(df.select(claims.claim_lines(F.col("l"), all_text=True)).first()[0]) == 5


def test_listings_and_tallies(spark):
    regions = lambda v: spark.createDataFrame([("f", v)], "source_file string, regions array<string>")
    gt, pred = ["abcdefghij klm", "one part", "two part"], ["abcdefgxyz klm", "one part two part"]
    from regionspark.config import Settings
    from regionspark.plans.evaluate import exploded

    e = evaluate(regions(gt), regions(pred))
    sides = exploded(regions(gt), Settings()), exploded(regions(pred), Settings())
    rejected = align.rejected_pairs(e.matches, *sides).collect()
    assert [(r.gt, r.pred, r.nth) for r in rejected] == [(gt[0], pred[0], 1)]
    groups = align.group_texts(e.matches, *sides).collect()
    assert [(r.kind, r.gt, r.pred) for r in groups] == [("merge", "one part | two part", "one part two part")]
    none = spark.createDataFrame([], "gt string, pred string")
    known = spark.createDataFrame([(gt[0], pred[0])], "gt string, pred string")
    tally = lambda cached, said: tuple(align.judge_tallies(e.matches, sides, cached, said).first())
    assert (tally(none, none), tally(known, none), tally(none, known)) == ((0, 0, 1), (0, 1, 0), (1, 0, 0))


def test_a_file_in_two_batches_counts_once(spark, tmp_path):
    for batch, cer in ((1, 0.5), (2, 0.25)):
        spark.createDataFrame([("a", cer), (f"b{batch}", 1.0)], "source_file string, cer double").write.parquet(f"{tmp_path}/out/batch={batch}")
    got = {r.source_file: r.cer for r in streamed_items(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": 0.25, "b1": 1.0, "b2": 1.0}


def test_infix_distance_against_a_table():
    r = random.Random(1)
    for k in range(300):
        needle, hay = ("".join(r.choice("abc") for _ in range(r.randrange(n))) for n in (12, 25))
        row = [0] * (len(hay) + 1)
        for i, x in enumerate(needle, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(hay, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert text.infix_of(needle, hay) == (min(row), row.index(min(row)))


def test_years_beyond_four_digits(spark):
    rows = spark.createDataFrame([(0,), (253402300799,), (253402300800,), (6_000_000 * 86461,)], "s long")
    got = [r[0] for r in rows.coalesce(1).select(text.local_timestamp(F.timestamp_seconds("s"))).collect()]
    assert got == ["1970-01-01T00:00:00", "9999-12-31T23:59:59", "10000-01-01T00:00:00", "18409-01-15T02:40:00"]


def test_distances_of_long_texts(spark):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("ab c漢") for _ in range(n))
    texts = [(some(r.randrange(0, 150)), some(r.randrange(0, 150))) for _ in range(60)]
    texts += [(t := some(120), t), (t, t[:50] + "x" + t[60:]), ("", t), (t, ""), ("", "")]
    assert [text.distance_of(a, b) for a, b in texts] == [plain_distance(a, b) for a, b in texts]
    df = spark.createDataFrame([(i, a, b, list(a), list(b)) for i, (a, b) in enumerate(texts)], "i int, a string, b string, ta array<string>, tb array<string>")
    got = df.select("i", text.edit_distance(F.col("a"), F.col("b")).alias("d"), text.list_distance(F.col("ta"), F.col("tb")).alias("t")).orderBy("i").collect()
    assert [(x.d, x.t) for x in got] == [(plain_distance(a, b),) * 2 for a, b in texts]


def test_a_distance_of_very_long_texts_takes_no_table():
    import time

    r = random.Random(9)
    a = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    begun = time.monotonic()
    assert text.distance_of("x" + a[1:-1] + "y", a) <= 2 and text.distance_of(a, a.replace("ab", "b")) == a.count("ab")
    assert time.monotonic() - begun < 20


def test_flags_share_one_count_of_errors(spark):
    from regionspark.config import Align
    from regionspark.operators import metrics

    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(12))
    gt = [word() for _ in range(24)]
    pred = [gt[0] + gt[1], gt[2][:6], gt[2][6:], *[t[1:] for t in gt[3:12]], *gt[12:20], word()]
    g, p = (spark.createDataFrame([("f", i, t, t) for i, t in enumerate(x)], "source_file string, ix long, raw string, norm string") for x in (gt, pred))
    matches = align.matches(g, p)
    found = spark.createDataFrame(matches.collect(), matches.schema)
    errors = spark.createDataFrame(metrics.error_counts(metrics.charges_by_kind(found, g, p), "kind", "whole").collect(), "source_file string, kind string, whole boolean, char_errors long, char_length long, token_errors long, token_length long")
    rows = []
    for credit in (True, False):
        rules = Align(merge_credit=credit, split_credit=credit)
        (one,) = metrics.counted(errors, rules).groupBy("source_file").agg(*[F.sum(c) for c in metrics.COUNTS[:4]]).collect()
        rows.append(tuple(one))
        assert [rows[-1]] == [tuple(x) for x in metrics.error_counts(metrics.charges(found, g, p, rules)).collect()]
    assert rows[0][1] < rows[1][1]


def test_errors_from_what_the_exact_pass_leaves(spark):
    """Lengths of exact pairs come from sums; rates and counts are those of all matches charged one by one."""
    from regionspark.config import Align
    from regionspark.operators import metrics

    r = random.Random(13)
    word = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(2))
    gt, pred = [], []
    for f in ("a", "b", "c"):
        texts = [word() for _ in range(20)]
        changed = [texts[0] + texts[1], texts[2][:5], texts[2][5:], *[t[1:] for t in texts[3:9]], *texts[9:18], texts[9], word()]
        gt += [(f, i, t, t) for i, t in enumerate(texts)]
        pred += [(f, i, t, t) for i, t in enumerate(changed)]
    gt += [("no prediction", 0, "abc", "abc")]
    g, p = (spark.createDataFrame(x, "source_file string, ix long, raw string, norm string") for x in (gt, pred))
    exact, left = align.exact_and_left(g, p)
    found = align.resolved(left)
    assert sorted(map(str, exact.unionByName(found).collect())) == sorted(map(str, align.matches(g, p).collect()))
    files = g.select("source_file").distinct().join(p.select("source_file").distinct(), "source_file", "left_semi")
    sized = metrics.sizes(g, p)
    errors = metrics.errors_by_kind(found, left, sized)
    for rules in (Align(), Align(merge_credit=False, split_credit=False)):
        one = metrics.counts_per_file(sized, exact.unionByName(found), None, None, rules, errors=errors)
        want = metrics.per_file(align.matches(g, p), g, p, files, rules)
        assert sorted(map(str, one.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() == 3


@pytest.mark.parametrize("name", ["group_listing", "rejected_listing", "chunking_accuracy", "credit_flag_variants"])
def test_no_side_is_written(spark, monkeypatch, name):
    """What is written is what the exact pass leaves and what comes of it, not the regions of both sides."""
    from regionspark import queries

    written, once = [], queries.write_stage
    monkeypatch.setattr(queries, "write_stage", lambda df, stage="stage": written.append((stage, df.columns)) or once(df, stage))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert written and not any("raw" in columns for _, columns in written)
    assert not any("norm" in columns for stage, columns in written if stage != "left-over")
