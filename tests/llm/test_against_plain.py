"""Learned scores and verdicts against plain versions of the methods, from dictionaries and loops."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from regionspark.llm import language_model, line_windows, near_dedup, quality_net, quality_rules, toxicity, words
from regionspark.stages import shared_dir

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def corpus(n, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "漢字", "A-B", "x"]
    texts = [" ".join(vocabulary[min(int(r.expovariate(0.08)), 63)] for _ in range(r.randrange(0, 60))) for _ in range(n)]
    return [(k, t) for k, t in enumerate(texts)] + [(None, texts[3]), (7, None), (8, ""), (9, texts[9])]


def plain_scores(rows):
    """(weights, scores): bigrams, unigrams and uniform, mixed by weights of the same cells, all in dictionaries."""
    end = None
    docs = [(i, [*(t or "").encode().translate(LOWER).split(), end]) for i, t in rows]
    role = lambda i: "fit" if i is None else {2: "held", 3: "dev"}.get(zlib.crc32(str(i).encode()) % 7, "fit")
    one, two = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for i, w in docs:
        one[role(i)].update(w)
        two[role(i)].update(zip([end, *w], w))
    n_fit = sum(one["fit"].values())
    vocabulary = len(set(one["fit"]) | set(one["dev"]))
    bucket = lambda c: 0 if c == 0 else min(int(math.log2(c)) + 1, language_model.CONTEXT_BUCKETS - 1)
    bin_ = lambda f: 0 if f == 0 else min(max(math.floor(2 * math.log2(f)) + language_model.BINS - 1, 1), language_model.BINS - 1)
    cells, exact = {}, collections.defaultdict(list)
    for (a, b), n in two["dev"].items():
        context = one["fit"][a]
        f2, f1 = two["fit"][a, b] / max(context, 1), one["fit"][b] / n_fit
        cell = cells.setdefault((bucket(context), bin_(f2), bin_(f1)), [0, 0.0, 0.0])
        cell[0] += n
        cell[1] += n * f2
        cell[2] += n * f1
        exact[bucket(context)].append((f2, f1, n))
    table = np.array([[(k[0] * language_model.BINS + k[1]) * language_model.BINS + k[2], *v] for k, v in sorted(cells.items())], float)
    weights = language_model.fit_weights(table, vocabulary)
    seen1, seen2 = one["fit"] + one["dev"], two["fit"] + two["dev"]
    n = sum(seen1.values())
    scores = []
    for i, w in docs:
        total = 0.0
        for a, b in zip([end, *w], w):
            k = weights[bucket(seen1[a])]
            total += math.log10(k[0] * seen2[a, b] / max(seen1[a], 1) + k[1] * seen1[b] / n + k[2] / (vocabulary + 1))
        scores.append((str(i), len(w), round(total, 6)))
    return weights, exact, vocabulary, sorted(scores)


@pytest.mark.parametrize("chunk_tokens,direct", [(1 << 20, 4096), (150, 4096), (150, 0), (40, 3)])
def test_deleted_interpolation(spark, chunk_tokens, direct):
    """Scores of one chunk, of many, and of many by way of relays."""
    rows = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = language_model.score_documents(docs, chunk_tokens, bucket_tokens=200, direct=direct).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got) == plain_scores(rows)[3]


def test_cells_move_the_weights_little():
    """EM on cells of half a power of two against EM on every held-out bigram: mean log10 likelihoods differ by 0.001 at most."""
    weights, exact, vocabulary, _ = plain_scores(corpus(400, seed=5))
    worst = 0.0
    for b, rows in exact.items():
        f2, f1, n = (np.array(x, float) for x in zip(*rows))
        best = language_model.expectation_maximisation(f2, f1, n, vocabulary)
        if b == 0:
            best[0] = 0
            best /= best.sum()
        mean = lambda w: (n * np.log10(w[0] * f2 + w[1] * f1 + w[2] / (vocabulary + 1))).sum() / n.sum()
        worst = max(worst, abs(mean(best) - mean(weights[b])))
    assert worst < 0.001


def plain_verdicts(rows, limits):
    """kept by the rules: histograms by loops, references from the nearer half, nearest reference, widened limits."""
    vocabulary = quality_rules._vocabulary()

    def histograms(text):
        data = (text or "").encode()
        classes = [0] * len(quality_rules.CLASSES)
        for c in text or "":
            classes[quality_rules._CLASS[c.encode()[0]]] += 1
        w = data.translate(LOWER).split()
        common = collections.Counter(w)
        counts = [common[x] for x in vocabulary]
        return len(w), np.array(classes, float), np.array([*counts, len(w) - sum(counts)], float), data.split()

    def failed(n, w):
        runs = collections.Counter(zip(w, w[1:], w[2:]))
        marked = {k + d for k in range(n - 2) if runs[tuple(w[k : k + 3])] > 1 for d in range(3)}
        return n < limits.min_words or 100 * len(marked) > limits.max_repeat_percent * n

    made = [(i, lang, *histograms(t)) for i, t, lang in rows]
    base = [failed(n, w) for _, _, n, _, _, w in made]
    share = lambda x: x / max(x.sum(), 1)

    def references(keep):
        out = {}
        for lang in quality_rules.COMMON:
            own = [k for k, m in enumerate(made) if m[1] == lang and not base[k] and keep(k)]
            if own:
                out[lang] = [np.mean([share(made[k][c]) for k in own], 0) for c in (3, 4)]
        return out

    def js(p, q):
        m = (p + q) / 2
        part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return math.sqrt(min(max((part(p) + part(q)) / 2, 0), 1))

    def nearest(k, refs):
        each = [(js(share(made[k][3]), r[0]), js(share(made[k][4]), r[1])) for _, r in sorted(refs.items())]
        return min(each, key=sum) if each else (0.0, 0.0)

    first = references(lambda k: True)
    far = [nearest(k, first)[0] for k in range(len(made))]
    middle = {}
    for lang in first:
        own = sorted(far[k] for k, m in enumerate(made) if m[1] == lang and not base[k])
        middle[lang] = own[math.ceil(len(own) / 2) - 1]
    refs = references(lambda k: far[k] <= middle[made[k][1]])
    out = []
    for k, (i, _, n, *_rest) in enumerate(made):
        c, w = nearest(k, refs)
        root = math.sqrt(max(n, 1))
        off = c > limits.max_class_distance + limits.class_slack / root
        off |= w > limits.max_word_distance + limits.word_slack / root and n >= limits.min_words_for_words
        out.append((i, not base[k] and not off, round(c, 9), round(w, 9)))
    return sorted(out)


def test_quality_verdicts(spark):
    r = random.Random(8)
    prose = lambda lang, n: " ".join(r.choice(quality_rules.COMMON[lang]) if r.random() < 0.5 else "".join(r.choice("aeiounstrl") for _ in range(r.randrange(3, 9))) for _ in range(n)) + "."
    rows = [(k, prose(lang, r.randrange(40, 260)), lang) for k, lang in enumerate(["en", "de", "fr"] * 25)]
    junk = ["7 3 9 $ % " * 60, "XQZ KPT " * 90, "".join(r.choice("|#*0123456789 ") for _ in range(900)), "the of and " * 60, "漢字 " * 80, "", None]
    rows += [(100 + k, t, "en") for k, t in enumerate(junk)] + [(200, prose("es", 120), None), (201, prose("es", 30), "xx")]
    limits = quality_rules.Limits()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted((x.doc_id, x.kept, round(x.class_distance, 9), round(x.word_distance, 9)) for x in quality_rules.judge(docs, limits).collect())
    assert got == plain_verdicts(rows, limits)
    assert {x[1] for x in got} == {True, False}


def test_context_vectors():
    """Sums of the index vectors of two words on either side and of the shape, over all places, word by word."""
    import pyarrow as pa

    r = random.Random(3)
    texts = [" ".join(r.choice(["ab", "Ab,", "c", "dd", "dd.", "12", "é"]) for _ in range(r.randrange(0, 40))) for _ in range(30)]
    want = collections.defaultdict(lambda: np.zeros(quality_net.DIM + 1, np.int64))
    shapes = quality_net.shape_vectors()
    (block,) = words.blocks(pa.array(texts))
    doc, key, shape = quality_net.words_and_shapes(block)
    for k in range(len(key)):
        want[key[k]] += shapes[shape[k]]
        for j in (k - 2, k - 1, k + 1, k + 2):
            if 0 <= j < len(key) and doc[j] == doc[k]:
                want[key[k]] += quality_net.index_vectors(key[j : j + 1])[0]
    distinct, place, _, sums = quality_net.contexts(doc, key, shape)
    assert {int(k): v.tolist() for k, v in zip(distinct, sums)} == {int(k): v.tolist() for k, v in want.items()}
    slots = 1 << 8
    total = np.zeros((slots + quality_net.SHAPES, quality_net.DIM + 1), np.int64)
    quality_net.add_contexts(total, pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    sketch = np.zeros_like(total[:slots])
    for word, vector in want.items():
        slot, sign = quality_net.slots_and_signs(np.array([word], np.uint64), slots)
        sketch[slot[0]] += vector * int(sign[0])
    assert (total[:slots] == sketch).all()


def small_corpus(spark, folder):
    """Toxic texts, repeated lines, copies and clean documents of two sources, with labels."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 5)))
    stock = [word() for _ in range(8_000)]
    prose = lambda n: " ".join(r.choice(stock) for _ in range(n))
    rows, labels = [], []
    for k in range(300):
        toxic = k % 6 == 0
        lines = [prose(12) for _ in range(8)]
        if toxic:
            lines[3] += " moron idiot"
            lines[5] = "idiots m0r0n " + lines[5]
        rows.append([k, "\n".join(lines), "en", "s1" if k % 3 else "s2"])
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    block = "\n".join(prose(12) for _ in range(5))
    for k in (31, 62, 93):
        rows[k][1] += "\n" + block
    for k in (121, 122, 123):
        rows[k][1] = rows[61][1]
    rows[124][1] = rows[61][1].replace(" ", "  ", 1) + " more"
    docs = [(*x, len(x[1])) for x in rows] + [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, dict((k, t) for k, _, t in labels), block


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs, labels, block = small_corpus(spark, tmp_path)
    sf = str(tmp_path)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(frame, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    clean = stages["toxicity"](spark, frame, sf)
    kept = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == frame.columns and set(kept) == {k for k, p in scores.items() if not p}
    toxic = {k for k in kept if k is not None and k < 300 and k % 6 == 0}
    assert len(toxic) <= 5 and len(kept) > 240
    lines = stages["line dedup"](spark, clean, sf)
    lined = {r.doc_id: r.text for r in lines.collect()}
    assert lined[31].endswith(block) and block not in lined[62] and block not in lined[93]
    near = stages["near dedup"](spark, lines, sf)
    left = {r.doc_id for r in near.collect()}
    classes = collections.defaultdict(set)
    for r in near_dedup.near_duplicate_classes(lines).collect():
        classes[r.label].add(r.doc_id)
    assert len(left) == len(classes) and all(len(left & c) == 1 for c in classes.values()) and near.columns == frame.columns
    mixed = stages["mixing"](spark, near, sf)
    assert mixed.columns == frame.columns and {r.doc_id for r in mixed.collect()} <= left
    packed = stages["packing"](spark, mixed, sf)
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in mixed.collect()}
    whole = sorted(map(str, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()))
    assert whole == sorted(map(str, packed.drop("sequence_id", "offset").collect()))
    assert line_windows.LINES == 3 and shared_dir(spark)
