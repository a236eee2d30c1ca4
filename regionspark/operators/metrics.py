"""Error charges, chunk counts and rates: counts are summed first and divided last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Align
from ..functions.text import edit_distance, list_distance, precision_recall, rate, tokenize
from .align import GT, PRED, side_of

COUNTS = ("char_errors", "char_length", "token_errors", "token_length", "chunk_located", "chunk_whole", "chunk_merged", "chunk_split", "gt", "pred", "matched_gt", "matched_pred", "merge_count", "split_count", "merge_layout_only", "credited_groups", "penalized_groups", "uncertain")


def credited(rules: Align) -> Column:
    """Whether a match of this `kind` counts; null for none."""
    kind = F.col("kind")
    return (kind == "pair") | ((kind == "merge") & F.lit(rules.merge_credit)) | ((kind == "split") & F.lit(rules.split_credit))


def charges_by_kind(matches: DataFrame, gt: DataFrame, pred: DataFrame, joint: str = "") -> DataFrame:
    """(source_file, kind, whole, a, b): texts to be charged. `whole` rows are matches, charged by distance if their kind is
    credited; the others are regions, `kind` the group's that they are in or null, charged if it is not."""
    scored = matches.where("kind in ('pair', 'merge', 'split')")
    exact = F.col("matched_by").eqNullSafe("exact")
    same = scored.where(exact).select(F.col("source_file").alias("_f"), F.col("gt_ixs")[0].alias("_i"))
    same = gt.join(same, (F.col("source_file") == F.col("_f")) & (F.col("ix") == F.col("_i")))
    same = same.select("source_file", F.lit("pair").alias("kind"), F.lit(True).alias("whole"), F.col("norm").alias("a"), F.col("norm").alias("b"))
    other = scored.where(~exact).withColumn("_m", F.struct("kind", "gt_ixs", "pred_ixs"))

    def side(regions: DataFrame, ixs: str, name: str) -> DataFrame:
        placed = other.select("source_file", "_m", F.posexplode(ixs).alias("_at", "ix"))
        texts = placed.join(regions.select("source_file", "ix", "norm"), ["source_file", "ix"])
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "norm"))), lambda x: x["norm"]), joint)
        return texts.groupBy("source_file", "_m").agg(ordered.alias(name))

    both = side(gt, "gt_ixs", "a").join(side(pred, "pred_ixs", "b"), ["source_file", "_m"])
    both = both.select("source_file", F.col("_m.kind").alias("kind"), F.lit(True).alias("whole"), "a", "b")

    def rest(regions: DataFrame, ixs: str) -> DataFrame:
        taken = scored.select(F.col("source_file").alias("_f"), F.explode(ixs).alias("_i"), "kind")
        found = regions.join(taken, (F.col("source_file") == F.col("_f")) & (F.col("ix") == F.col("_i")), "left")
        return found.where("kind is null or kind <> 'pair'")

    none = F.lit(None).cast("string")
    missing = rest(gt, "gt_ixs").select("source_file", "kind", F.lit(False).alias("whole"), F.col("norm").alias("a"), none.alias("b"))
    extra = rest(pred, "pred_ixs").select("source_file", "kind", F.lit(False).alias("whole"), none.alias("a"), F.col("norm").alias("b"))
    return same.unionByName(both).unionByName(missing).unionByName(extra)


def counted(charged: DataFrame, rules: Align) -> DataFrame:
    """Of rows by kind those that these rules charge."""
    return charged.where(F.col("whole") == F.coalesce(credited(rules), F.lit(False)))


def charges(matches: DataFrame, gt: DataFrame, pred: DataFrame, rules: Align = Align(), joint: str = "") -> DataFrame:
    """(source_file, a, b): texts to be charged; a is null for an extra region, b for a missing one.

    Pairs and credited groups are charged by distance; regions of other groups count as missing or extra.
    """
    return counted(charges_by_kind(matches, gt, pred, joint), rules).select("source_file", "a", "b")


def error_counts(charged: DataFrame, *by: str) -> DataFrame:
    """char_errors, char_length, token_errors and token_length of each file, and of each of `by` in it. Only texts that differ
    are held against each other."""
    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    texts = charged.select("source_file", *by, a.alias("a"), b.alias("b"))
    texts = texts.withColumns({"ta": tokenize(F.col("a")), "tb": tokenize(F.col("b"))})
    ce, te = edit_distance(F.col("a"), F.col("b")), list_distance(F.col("ta"), F.col("tb"))
    each = texts.select("source_file", *by, ce.alias("ce"), F.length("a").alias("cl"), te.alias("te"), F.size("ta").alias("tl"))
    return _summed(each, {"ce": "char_errors", "cl": "char_length", "te": "token_errors", "tl": "token_length"}, *by)


def _summed(rows: DataFrame, names: dict[str, str], *by: str) -> DataFrame:
    return rows.groupBy("source_file", *by).agg(*[F.sum(F.col(c).cast("long")).alias(name) for c, name in names.items()])


def sizes(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(source_file, gt, pred, chars, tokens) of the files that both sides have: numbers of regions, lengths of the annotated."""
    total = lambda c, name: F.sum(c.cast("long")).alias(name)
    norm = F.col("norm")
    own = gt.groupBy("source_file").agg(F.count(F.lit(1)).alias("gt"), total(F.length(norm), "chars"), total(F.size(tokenize(norm)), "tokens"))
    return own.join(pred.groupBy("source_file").agg(F.count(F.lit(1)).alias("pred")), "source_file")


def errors_by_kind(found: DataFrame, left: DataFrame, sized: DataFrame, joint: str = "") -> DataFrame:
    """The error counts of `charges_by_kind` by kind and whole, for files in `sized` (`sizes`), from what the exact pass leaves
    (`left`, with its sides) and its matches.

    Exact pairs have no errors, and their lengths are what the left regions' leave of the file's. So no text of theirs is
    joined or shuffled again.
    """
    g, p = side_of(left, GT), side_of(left, PRED)
    norm = F.col("norm")
    lengths = sized.select("source_file", "chars", "tokens")
    lengths = lengths.unionByName(g.select("source_file", (-F.length(norm)).cast("long").alias("chars"), (-F.size(tokenize(norm))).cast("long").alias("tokens")))
    zero = F.lit(0).cast("long")
    exact = lengths.groupBy("source_file").agg(F.sum("chars").alias("char_length"), F.sum("tokens").alias("token_length"))
    exact = exact.select("source_file", F.lit("pair").alias("kind"), F.lit(True).alias("whole"), zero.alias("char_errors"), "char_length", zero.alias("token_errors"), "token_length")
    return exact.unionByName(error_counts(charges_by_kind(found, g, p, joint), "kind", "whole"))


def match_counts(matches: DataFrame, rules: Align = Align()) -> DataFrame:
    """Chunk and match counts of each file that has a match."""
    kind, n_gt, n_pred = F.col("kind"), F.size("gt_ixs"), F.size("pred_ixs")
    group = kind.isin("merge", "split")
    credit = (kind == "pair") | ((kind == "merge") & F.lit(rules.merge_credit)) | ((kind == "split") & F.lit(rules.split_credit))
    total = lambda cond, what, name: F.sum(F.when(cond, what).otherwise(0).cast("long")).alias(name)
    counts = matches.groupBy("source_file").agg(
        total(kind == "pair", n_pred, "chunk_whole"), total(kind == "merge", n_pred, "chunk_merged"), total(kind == "split", n_pred, "chunk_split"),
        total(credit, n_gt, "matched_gt"), total(credit, n_pred, "matched_pred"),
        total(kind == "merge", F.lit(1), "merge_count"), total(kind == "split", F.lit(1), "split_count"),
        total(group & credit, F.lit(1), "credited_groups"), total(group & ~credit, F.lit(1), "penalized_groups"), total(kind == "uncertain", F.lit(1), "uncertain"),
    )
    # A merge of regions whose texts are joined without change is one of layout only.
    merges = matches.where("kind = 'merge'").select("source_file", (F.col("similarity") >= 1.0).cast("long").alias("one"))
    layout = merges.groupBy("source_file").agg(F.sum("one").alias("merge_layout_only"))
    counts = counts.join(layout, "source_file", "left").withColumn("merge_layout_only", F.coalesce("merge_layout_only", F.lit(0)).cast("long"))
    return counts.withColumn("chunk_located", F.col("chunk_whole") + F.col("chunk_merged") + F.col("chunk_split"))


def with_rates(counts: DataFrame) -> DataFrame:
    c = F.col
    p, r, f1 = precision_recall(c("matched_gt"), c("matched_pred"), c("gt"), c("pred"))
    chunking = F.when(c("chunk_located") > 0, c("chunk_whole") / c("chunk_located")).otherwise(0.0)
    return counts.withColumns({"cer": rate(c("char_errors"), c("char_length")), "wer": rate(c("token_errors"), c("token_length")), "precision": p, "recall": r, "f1": f1, "chunking_accuracy": chunking})


def per_file(
    matches: DataFrame, gt: DataFrame, pred: DataFrame, files: DataFrame, rules: Align = Align(), joint: str = "", errors: DataFrame | None = None,
) -> DataFrame:
    """A row of counts and rates for each of `files` (source_file).

    `errors`: the error counts of `charges_by_kind` by kind and whole, for several rules over the same matches.
    """
    count = lambda df, name: df.groupBy("source_file").agg(F.count(F.lit(1)).alias(name))
    return counts_per_file(files.join(count(gt, "gt"), "source_file", "left").join(count(pred, "pred"), "source_file", "left"), matches, gt, pred, rules, joint, errors)


def counts_per_file(
    sized: DataFrame, matches: DataFrame, gt: DataFrame | None, pred: DataFrame | None, rules: Align = Align(), joint: str = "", errors: DataFrame | None = None,
) -> DataFrame:
    """The same for files whose numbers of regions are known: `sized` (source_file, gt, pred). With `errors` no regions are read."""
    if errors is None:
        errors = error_counts(charges(matches, gt, pred, rules, joint))
    else:
        errors = _summed(counted(errors, rules), {c: c for c in COUNTS[:4]})
    out = sized.select("source_file", "gt", "pred")
    for part in (errors, match_counts(matches, rules)):
        out = out.join(part, "source_file", "left")
    return with_rates(out.fillna(0, subset=list(COUNTS)))


def exact_per_file(records: DataFrame, form: Callable[[Column], Column], *by: str) -> DataFrame:
    """What per_file gives of the exact matches alone, from records (source_file, by, gt, pred) with both region lists of a
    file, one for each file. `form` makes a region's comparison form.

    As the k-th region of a text meets the k-th on the other side, how often a text stands on both sides says how many pairs
    it has, and only what is over is charged, by its length. So regions are counted once, not numbered, sorted or joined; a
    file's are together already, and nothing is shuffled beyond the records.
    """
    keys = ["source_file", *by]
    sides = records.select(*keys, F.stack(F.lit(2), F.lit(True), "gt", F.lit(False), "pred").alias("own", "texts"))
    rows = sides.select(*keys, "own", F.posexplode_outer("texts").alias("at", "text"))  # a list without regions keeps its file
    is_region = F.col("at").isNotNull()
    texts = rows.groupBy(*keys, form(F.col("text")).alias("norm")).agg(F.count_if(is_region & F.col("own")).alias("gt"), F.count_if(is_region & ~F.col("own")).alias("pred"))
    met = F.when(F.col("norm").isNull(), 0).otherwise(F.least("gt", "pred")).cast("long")
    norm = F.coalesce("norm", F.lit(""))
    sized = texts.select(*keys, "gt", "pred", met.alias("met"), F.length(norm).alias("chars"), F.size(tokenize(norm)).alias("tokens"))
    over = F.col("gt") + F.col("pred") - 2 * F.col("met")
    total = {
        "char_errors": F.col("chars") * over, "char_length": F.col("chars") * F.col("gt"), "token_errors": F.col("tokens") * over, "token_length": F.col("tokens") * F.col("gt"),
        "gt": F.col("gt"), "pred": F.col("pred"), **{name: F.col("met") for name in ("chunk_located", "chunk_whole", "matched_gt", "matched_pred")},
    }
    zero = F.lit(0).cast("long")
    out = sized.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in total.items()])
    return with_rates(out.select(*keys, *[name if name in total else zero.alias(name) for name in COUNTS]))


def corpus(items: DataFrame, *by: str) -> DataFrame:
    """Micro rates over all items, or over each group of them."""
    sums = items.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).alias(c) for c in COUNTS])
    return with_rates(sums.fillna(0, subset=list(COUNTS)))
