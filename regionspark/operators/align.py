"""Aligning two region lists of each file: exact, structural, similar, judged.

Regions are rows (source_file, ix, raw, norm) on each side. Exact matches are a join; what is left of a file meets in one
group for the order-dependent rest. Only files with something left on both sides are walked.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Align
from ..functions.text import similarity_of
from ..stages import fresh, write_stage
from . import pairs


def partners(gt: DataFrame, pred: DataFrame, *columns: str) -> DataFrame:
    """(source_file, side, ix, norm, columns, partner) of the regions of both sides, side GT or PRED: the k-th region of a text
    meets the k-th on the other side, `partner` is its index or null. One shuffle of both sides, by file and text: both windows
    have the same partitions."""
    part = lambda df, side: df.select("source_file", F.lit(side).alias("side"), "ix", "norm", *columns)
    text = Window.partitionBy("source_file", "norm")
    so_far = text.orderBy("ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = part(gt, GT).unionByName(part(pred, PRED))
    own = F.col("side") == GT
    rows = rows.withColumn("nth", F.when(own, F.count_if(own).over(so_far)).otherwise(F.count_if(~own).over(so_far)))
    ranked = text.orderBy("nth", "side")
    rows = rows.withColumns({"after": F.lead(F.struct("nth", "ix")).over(ranked), "before": F.lag(F.struct("nth", "ix")).over(ranked)})
    other = F.when(F.col("side") == GT, F.col("after")).otherwise(F.col("before"))
    return rows.withColumn("partner", F.when(other["nth"] == F.col("nth"), other["ix"])).drop("nth", "after", "before")


def exact_of(met: DataFrame) -> DataFrame:
    """The rows of `partners` that are exact pairs, each once."""
    return met.where((F.col("side") == GT) & F.col("partner").isNotNull() & F.col("source_file").isNotNull())


def exact_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(source_file, norm, gt_ix, pred_ix): the k-th region of a text meets the k-th on the other side."""
    met = exact_of(partners(gt, pred).where("norm is not null"))
    return met.select("source_file", "norm", F.col("ix").alias("gt_ix"), F.col("partner").alias("pred_ix"))


def exact_matches(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """The exact pairs in the columns of MATCHES, after source_file."""
    return _as_matches(exact_pairs(gt, pred), "gt_ix", "pred_ix")


def _as_matches(exact: DataFrame, gt_ix: str, pred_ix: str) -> DataFrame:
    array = lambda c: F.array(F.col(c).cast("long"))
    return exact.select(
        "source_file", F.lit("pair").alias("kind"), array(gt_ix).alias("gt_ixs"), array(pred_ix).alias("pred_ixs"),
        F.lit(1.0).alias("similarity"), F.lit("exact").alias("matched_by"),
    )


def unmatched(regions: DataFrame, taken: DataFrame, side: str) -> DataFrame:
    """The regions that are in no pair on this side ("gt" or "pred")."""
    file, ix = fresh(regions.columns, "file", "other")
    other = taken.select(F.col("source_file").alias(file), F.col(f"{side}_ix").alias(ix))
    return regions.join(other, (F.col("source_file") == F.col(file)) & (F.col("ix") == F.col(ix)), "left_anti")


#: A walk that asks for the infix distances of [(part, container)] and is sent [(distance, end)], so many files can ask at once.
Walk = Generator[list[tuple[str, str]], list[tuple[int, int]], list]


class Scored:
    """What may match in one file, scored in memory: every pair's common subsequence first, then only what it lets pass."""

    def __init__(self, gt: dict[int, str], pred: dict[int, str], rules: Align):
        self.rules = rules
        self.rows, self.columns = ({i: k for k, i in enumerate(x)} for x in (gt, pred))
        _, self.common = pairs.common_lengths(list(gt.items()), list(pred.items()))

    def _free(self, gt: dict[int, str], pred: dict[int, str]) -> np.ndarray:
        return self.common[np.ix_([self.columns[j] for j in pred], [self.rows[i] for i in gt])]

    def _standing(self, whole: dict[int, str], parts: dict[int, str], common: np.ndarray, joint: str) -> Walk:
        free = [t for t in parts.values() if pairs.everywhere(t, self.rules)]

        def least(length: int, n: int, total: int) -> bool:
            """A group has two parts at least, and with all that may stand there its length must come near the container's."""
            n, total = n + len(free), total + sum(map(len, free))
            total = min(length, total + (n - 1) * len(joint))
            return n > 1 and 2.0 * total / (length + total) >= self.rules.group_similarity

        found, wanted = pairs.standing(parts, whole, common, self.rules, least)
        for (c, p), (distance, end) in zip(wanted, (yield [(parts[p], whole[c]) for c, p in wanted])):
            if distance <= pairs.most_errors(len(parts[p]), self.rules):
                found.append((c, p, max(0, end - len(parts[p]))))
        return found

    def merges(self, gt: dict[int, str], pred: dict[int, str], joint: str) -> Walk:
        return self._standing(pred, gt, self._free(gt, pred), joint)

    def splits(self, gt: dict[int, str], pred: dict[int, str], joint: str) -> Walk:
        return self._standing(gt, pred, self._free(gt, pred).T, joint)

    def near(self, gt: dict[int, str], pred: dict[int, str], least: float) -> Iterable[tuple[int, int, float]]:
        lengths = np.array([len(t) for t in gt.values()], np.int64)
        return pairs.near(list(gt.items()), list(pred.items()), lengths, self._free(gt, pred), least)


class Given:
    """What may match in one file, scored block by block beforehand: (kind, ix, jx, value) rows of `block_edges`."""

    def __init__(self, rows: Iterable[tuple[int, int, int, float]]):
        self.rows: dict[int, list[tuple[int, int, float]]] = {MERGE: [], SPLIT: [], NEAR: []}
        for kind, i, j, value in rows:
            self.rows[kind].append((i, j, value))

    def merges(self, gt: dict[int, str], pred: dict[int, str], joint: str) -> Walk:
        return [(c, p, int(at)) for c, p, at in self.rows[MERGE] if c in pred and p in gt]
        yield

    def splits(self, gt: dict[int, str], pred: dict[int, str], joint: str) -> Walk:
        return [(c, p, int(at)) for c, p, at in self.rows[SPLIT] if c in gt and p in pred]
        yield

    def near(self, gt: dict[int, str], pred: dict[int, str], least: float) -> Iterable[tuple[int, int, float]]:
        return ((i, j, score) for i, j, score in self.rows[NEAR] if score >= least and i in gt and j in pred)


def structural_groups(whole: dict[int, str], parts: dict[int, str], hits: Iterable[tuple[int, int, int]], rules: Align, joint: str) -> list[tuple[int, list[int], float]]:
    """(container, its parts in order of place, similarity): containers longest first, each part claimed once.

    `hits` are (container, part, place), without the parts that stand everywhere: those are placed only where a group is
    not ruled out by its length.
    """
    placed_in: dict[int, list[tuple[int, int]]] = {}
    for c, p, at in hits:
        placed_in.setdefault(c, []).append((at, p))
    free = {p: t for p, t in parts.items() if pairs.everywhere(t, rules)}
    length = sum(map(len, free.values()))
    found, claimed = [], set()
    for c in sorted(whole, key=lambda i: (-len(whole[i]), i)):
        text = whole[c]
        placed = [x for x in placed_in.get(c, ()) if x[1] not in claimed]
        n = len(placed) + len(free)
        if not text or n < 2:
            continue
        total = length + sum(len(parts[p]) for _, p in placed) + (n - 1) * len(joint)
        if 2.0 * min(len(text), total) / (len(text) + total) < rules.group_similarity:
            continue
        members = [p for _, p in sorted([*placed, *((pairs.place(t, text, rules), p) for p, t in free.items())])]
        score = similarity_of(text, joint.join(parts[p] for p in members))
        if score >= rules.group_similarity:
            claimed.update(members)
            free, length = {}, 0  # all of them stood here
            found.append((c, members, score))
    return found


def resolve(
    gt: dict[int, str], pred: dict[int, str], raw: dict[str, dict[int, str]], rules: Align, joint: str,
    verdicts: dict[tuple[str, str], bool] | None, on_failure: str, scored: Scored | Given | None = None, defer: bool = False,
) -> list[dict]:
    """What exact matching left of one file: merges, splits, similar pairs, judged pairs, and the deferred ones counted.

    With `defer` no verdict is looked up: the pairs that need one are rows of kind "deferred", for `settled`.
    """
    return together([resolving(gt, pred, raw, rules, joint, verdicts, on_failure, scored, defer)])[0]


def together(walks: list[Walk]) -> list[list]:
    """What the walks give; what they ask for is answered for all of them at once."""
    out: list = [None] * len(walks)
    open_: dict[int, list | None] = dict.fromkeys(range(len(walks)))
    while open_:
        asked = {}
        for k, answers in open_.items():
            try:
                asked[k] = walks[k].send(answers)
            except StopIteration as done:
                out[k] = done.value
        answers = iter(pairs.infixes_of([x for wanted in asked.values() for x in wanted]))
        open_ = {k: list(islice(answers, len(wanted))) for k, wanted in asked.items()}
    return out


def resolving(
    gt: dict[int, str], pred: dict[int, str], raw: dict[str, dict[int, str]], rules: Align, joint: str,
    verdicts: dict[tuple[str, str], bool] | None, on_failure: str, scored: Scored | Given | None = None, defer: bool = False,
) -> Walk:
    """`resolve`, step by step."""
    rows = []
    gt, pred = dict(gt), dict(pred)
    scored = scored or Scored(gt, pred, rules)

    def take(kind: str, gts: list[int], preds: list[int], score: float, how: str) -> None:
        rows.append({"kind": kind, "gt_ixs": gts, "pred_ixs": preds, "similarity": float(score), "matched_by": how})
        for i in gts:
            gt.pop(i)
        for j in preds:
            pred.pop(j)

    for j, members, score in structural_groups(pred, gt, (yield from scored.merges(gt, pred, joint)), rules, joint):
        take("merge", members, [j], score, "merge")
    for i, members, score in structural_groups(gt, pred, (yield from scored.splits(gt, pred, joint)), rules, joint):
        take("split", [i], members, score, "split")
    # What matches by itself goes first, so the other pairs of its regions need no score.
    for minus, i, j in sorted((-score, i, j) for i, j, score in scored.near(gt, pred, max(rules.auto_match, rules.reject_below))):
        if i in gt and j in pred:
            take("pair", [i], [j], -minus, "similarity")
    near = sorted((-score, i, j) for i, j, score in scored.near(gt, pred, rules.reject_below))
    later = [(-minus, i, j) for minus, i, j in near if -minus < rules.auto_match]
    for score, i, j in later:
        if i not in gt or j not in pred:
            continue
        if defer:
            rows.append({"kind": "deferred", "gt_ixs": [i], "pred_ixs": [j], "similarity": float(score), "matched_by": "judge"})
            continue
        same = False
        if verdicts is not None:
            same = verdicts.get((raw["gt"][i], raw["pred"][j]), on_failure == "accept")
        how = "same" if same else "different" if verdicts is not None else "no judge"
        rows.append({"kind": "uncertain", "gt_ixs": [i], "pred_ixs": [j], "similarity": float(score), "matched_by": how})
        if same:
            take("pair", [i], [j], score, "judge")
    return rows


def settle(later: Iterable[tuple[int, int, float, bool | None]]) -> Iterable[tuple[str, int, int, float, str]]:
    """(kind, gt index, predicted index, similarity, matched_by) of a file's deferred pairs, in the order of the walk, with their
    verdicts, null for none yet.

    Kinds uncertain and pair are final. A pair of kind "ask" needs a verdict, one of kind "wait" hangs on a pair before it
    that has none; both come again. A pair that another has taken a side of is gone.
    """
    gone, open_ = (set(), set()), (set(), set())
    for i, j, score, same in later:
        if i in gone[0] or j in gone[1]:
            continue
        waits = i in open_[0] or j in open_[1]
        if waits or same is None:
            open_[0].add(i)
            open_[1].add(j)
            yield ("wait" if waits else "ask"), i, j, score, "no verdict"
            continue
        yield "uncertain", i, j, score, "same" if same else "different"
        if same:
            gone[0].add(i)
            gone[1].add(j)
            yield "pair", i, j, score, "judge"


def settled(deferred: DataFrame) -> DataFrame:
    """source_file and the columns of MATCHES: `settle` for every file of `deferred` (source_file, gt_ix, pred_ix, similarity,
    same)."""

    def walk(key: tuple, group: list[tuple]) -> Iterable[tuple]:
        later = ((i, j, -minus, same) for minus, i, j, same in group)
        return ((key[0], kind, [i], [j], score, how) for kind, i, j, score, how in settle(later))

    rows = deferred.select("source_file", (-F.col("similarity")).alias("minus"), "gt_ix", "pred_ix", "same")
    dealt = rows.repartition("source_file").sortWithinPartitions("source_file", "minus", "gt_ix", "pred_ix")
    return pairs.grouped(dealt, 1, walk, f"source_file {deferred.schema['source_file'].dataType.simpleString()}, {MATCHES}")


MATCHES = "kind string, gt_ixs array<long>, pred_ixs array<long>, similarity double, matched_by string"
GT, PRED, VERDICT, MERGE, SPLIT, NEAR = range(6)
LONG_PAIRS = 1 << 20  # pairs of regions of a file from which on they are scored in blocks


def block_edges(gt: DataFrame, pred: DataFrame, rules: Align, chunk: int = pairs.CHUNK) -> DataFrame:
    """(source_file, kind, ix, jx, value): what may match in each file, scored in blocks over all tasks.

    Kind MERGE: a predicted region, a part of it, its place; SPLIT: the same the other way; NEAR: the two regions' ratio.
    """

    def work(a: list, b: list) -> Iterable[tuple]:
        lengths, common = pairs.common_lengths(a, b)
        yield from ((MERGE, c, p, float(at)) for c, p, at in pairs.contained(a, b, common, rules))
        yield from ((SPLIT, c, p, float(at)) for c, p, at in pairs.contained(b, a, common.T, rules))
        yield from ((NEAR, i, j, score) for i, j, score in pairs.near(a, b, lengths, common, rules.reject_below))

    return pairs.blocks(gt, pred, work, "kind int, ix long, jx long, value double", chunk)


def left_over(gt: DataFrame, pred: DataFrame, *columns: str) -> DataFrame:
    """(source_file, side, ix, norm, columns) of the regions that exact matching leaves, side GT or PRED: those beyond the number
    of times that the other side has their text. One shuffle of both sides, by file and text."""
    return partners(gt, pred, *columns).where("partner is null").drop("partner")


def exact_and_left(gt: DataFrame, pred: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """What `exact_matches` and `left_over` give, of one written table: the exact pass is made once, and of its pairs no text
    is written."""
    met, free = partners(gt, pred, *columns), F.col("partner").isNull()
    texts = {c: F.when(free, F.col(c)).alias(c) for c in ("norm", *columns)}
    # Regions without a text take part in nothing exact, on either side.
    kept = met.where(free | ((F.col("side") == GT) & F.col("source_file").isNotNull() & F.col("norm").isNotNull()))
    met = write_stage(kept.select("source_file", "side", "ix", "partner", *texts.values()), "left-over")
    return _as_matches(exact_of(met), "ix", "partner"), met.where("partner is null").drop("partner")


def side_of(left: DataFrame, side: int) -> DataFrame:
    """One side of `left_over`."""
    return left.where(F.col("side") == side).drop("side")


def matches(
    gt: DataFrame, pred: DataFrame, rules: Align = Align(), ignore_whitespace: bool = True, judged: DataFrame | None = None,
    on_failure: str = "auto", long_pairs: int = LONG_PAIRS, chunk: int = pairs.CHUNK,
) -> DataFrame:
    """All matches of all files, source_file and columns as in MATCHES: kinds pair, merge, split and uncertain (deferred, counted).

    `judged` holds verdicts (gt, pred, same) on raw texts; without it deferred pairs stay unmatched, and raw texts are not
    read.

    The exact pairs, and what exact matching leaves, are written once, when this is called. The order-dependent rest is a walk
    over one file's regions and the pairs that may match. A file of up to `long_pairs` pairs is scored where it is walked; a
    longer one in blocks of `chunk` regions a side over all tasks, and only indices, places and scores of the pairs that may
    match come to its walk. Both ways give the same rows.
    """
    exact, left = exact_and_left(gt, pred, *(() if judged is None else ("raw",)))
    return exact.unionByName(resolved(left, rules, ignore_whitespace, judged, on_failure, long_pairs, chunk))


def resolved(
    left: DataFrame, rules: Align = Align(), ignore_whitespace: bool = True, judged: DataFrame | None = None, on_failure: str = "auto",
    long_pairs: int = LONG_PAIRS, chunk: int = pairs.CHUNK, defer: bool = False,
) -> DataFrame:
    """The matches of `left`, a written table of `left_over`, with raw if there are verdicts. With `defer`, pairs that need a
    verdict are of kind "deferred"."""
    joint = "" if ignore_whitespace else " "
    sizes = left.groupBy(F.col("source_file").alias("file")).agg(F.count_if(F.col("side") == GT).alias("n"), F.count_if(F.col("side") == PRED).alias("m"))
    long = sizes.where(F.col("n") * F.col("m") > long_pairs).select("file")
    none = lambda kind: F.lit(None).cast(kind)
    frame = lambda df, kind, ix, jx, a, b, value: df.select(
        "source_file", kind.alias("kind"), ix.alias("ix"), jx.alias("jx"), a.alias("a"), b.alias("b"), value.alias("value")
    )
    rows = frame(left, F.col("side"), F.col("ix"), none("long"), F.col("norm"), none("string") if judged is None else F.col("raw"), none("double"))
    if judged is not None:  # verdicts of the files' own texts only travel with the files
        said = judged.select(F.col("gt").alias("_g"), F.col("pred").alias("_p"), F.col("same").cast("double").alias("_s")).distinct()
        own = left.where(F.col("side") == GT).select("source_file", "raw").distinct().join(said, F.col("raw") == F.col("_g"))
        rows = rows.unionByName(frame(own, F.lit(VERDICT), none("long"), none("long"), F.col("_g"), F.col("_p"), F.col("_s")))
    if long.limit(1).count():
        open_ = left.join(long, F.col("source_file") == F.col("file"), "left_semi")
        side = lambda which: open_.where(F.col("side") == which)
        edges = block_edges(side(GT), side(PRED), rules, chunk)
        rows = rows.unionByName(frame(edges, F.col("kind"), F.col("ix"), F.col("jx"), none("string"), none("string"), F.col("value")))
    judged_here = judged is not None

    def walk(group: list[tuple]) -> Walk:
        of = {kind: [x[1:] for x in group if x[0] == kind] for kind in (GT, PRED, VERDICT)}
        if not of[GT] or not of[PRED]:
            return []
        norm, raw = ({"gt": {x[0]: x[c] for x in of[GT]}, "pred": {x[0]: x[c] for x in of[PRED]}} for c in (2, 3))
        known = {(a, b): bool(v) for _, _, a, b, v in of[VERDICT] if v is not None} if judged_here else None
        scored = None
        if len(norm["gt"]) * len(norm["pred"]) > long_pairs:
            scored = Given((x[0], x[1], x[2], x[5]) for x in group if x[0] >= MERGE)
        return (yield from resolving(norm["gt"], norm["pred"], raw, rules, joint, known, on_failure, scored, defer))

    def walk_all(files: list[tuple[tuple, list[tuple]]]) -> Iterable[tuple]:
        for (key, _), found in zip(files, together([walk(group) for _, group in files])):
            for x in found:
                yield key[0], x["kind"], x["gt_ixs"], x["pred_ixs"], x["similarity"], x["matched_by"]

    # The work grows with the product of a file's sides, not with bytes: partitions are not to be merged by size.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "source_file").sortWithinPartitions("source_file", "kind", "ix")
    return pairs.grouped_together(dealt, 1, walk_all, f"source_file {left.schema['source_file'].dataType.simpleString()}, {MATCHES}", pairs.TOGETHER)


def ratio_candidates(gt: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """(source_file, gt_ix, pred_ix, similarity) of the pairs of a file with a ratio of at least `least`."""
    return pairs.ratio_candidates(gt, pred, least)


def best_similarity(candidates: DataFrame, by: Iterable[str] = ("source_file", "gt_ix")) -> DataFrame:
    """The best partner of each region; of ties the least index."""
    best = F.max(F.struct("similarity", (-F.col("pred_ix")).alias("_o"))).alias("_b")
    return candidates.groupBy(*by).agg(best).select(*by, F.col("_b.similarity").alias("similarity"), (-F.col("_b._o")).alias("pred_ix"))


def judge_tallies(found: DataFrame, regions: tuple[DataFrame, DataFrame], cached: DataFrame, answered: DataFrame) -> DataFrame:
    """calls, cache_hits and failures of the deferred pairs among `found`, the columns of MATCHES.

    A pair's texts (raw, by index, of the two sides) are looked up among the `cached` verdicts (gt, pred), else asked:
    those among the `answered` ones are calls, the others failures. A pair of texts that was answered once is cached
    from then on.
    """
    asked = texts_of(found.where("kind = 'uncertain'"), *regions)
    texts = asked.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    for known, name in ((cached, "held"), (answered, "said")):
        texts = texts.join(known.select("gt", "pred", F.lit(True).alias(name)).distinct(), ["gt", "pred"], "left")
    held, said, n = F.coalesce("held", F.lit(False)), F.coalesce("said", F.lit(False)), F.col("n")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    calls, hits = F.when(~held & said, 1).otherwise(0), F.when(held, n).when(said, n - 1).otherwise(0)
    return texts.agg(total(calls, "judge_calls"), total(hits, "judge_cache_hits"), total(F.when(~held & ~said, n).otherwise(0), "judge_failures"))


def texts_of(found: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """`found`, whose rows are of one region a side, with the regions' raw texts gt and pred."""
    score = [c for c in found.columns if c == "similarity"]
    out = found.select("source_file", F.col("gt_ixs")[0].alias("_g"), F.col("pred_ixs")[0].alias("_p"), *score)
    for side, ix, name in ((gt, "_g", "gt"), (pred, "_p", "pred")):
        own = side.select(F.col("source_file").alias("_f"), F.col("ix").alias("_i"), F.col("raw").alias(name))
        out = out.join(own, (F.col("source_file") == F.col("_f")) & (F.col(ix) == F.col("_i"))).drop("_f", "_i")
    return out


def rejected_pairs(found: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(source_file, gt, pred, similarity, nth) of the deferred pairs that were not accepted, from the most similar on."""
    out = texts_of(found.where("kind = 'uncertain' and matched_by != 'same'"), gt, pred).withColumn("similarity", F.round("similarity", 4))
    nth = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("similarity"), "_g", "_p"))
    return out.select("source_file", "gt", "pred", "similarity", nth.alias("nth"))


def group_texts(found: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(source_file, kind, gt, pred, similarity) of the merges and splits: raw texts of a side joined by " | "."""
    groups = found.where("kind in ('merge', 'split')").withColumn("_m", F.struct("kind", "gt_ixs", "pred_ixs"))
    out = groups.select("source_file", "_m", F.round("similarity", 4).alias("similarity"))
    for side, ixs, name in ((gt, "gt_ixs", "gt"), (pred, "pred_ixs", "pred")):
        own = side.select(F.col("source_file").alias("_f"), F.col("ix").alias("_i"), "raw")
        placed = groups.select("source_file", "_m", F.posexplode(ixs).alias("_at", "_ix"))
        placed = placed.join(own, (F.col("source_file") == F.col("_f")) & (F.col("_ix") == F.col("_i")))
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "raw"))), lambda x: x["raw"]), " | ")
        out = out.join(placed.groupBy("source_file", "_m").agg(texts.alias(name)), ["source_file", "_m"])
    return out.select("source_file", F.col("_m.kind").alias("kind"), "gt", "pred", "similarity")
