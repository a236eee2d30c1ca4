"""Merkle manifest of a dataset: a trie keyed by the digits of each document's rank, one per source, under one root.

A leaf is the SHA-256 of a document's fields. Leaves of a source ascend by doc_id; every `fanout` neighbours become their
hash until one is left (subroot), and subroots, ordered by source, do the same (root).

Ranks are radix ranks: the digits of doc_id (8 bits, then 14 at a time) are counted from the lowest prefix up, and a row's
rank is the number of rows under smaller sibling digits at every level, so no level sorts more than 2**14 counts and
nothing is sorted as a whole. Rows that share a doc_id go on by the first 16 bits of their leaf. Sources are ranked in
ranges. The rank's digits in base `fanout` are a node's key. Nodes are reduced by longest prefix, LEVELS digits at a time:
one group holds at most fanout**LEVELS nodes, keyed by the digits left, so the shuffles are log of the largest source in
that base. Text is read once and only digests are shuffled.

Each document's path is its siblings, level by level; `fold` recomputes the root from a leaf and its path.

Defined cases: a null field is `-`; null doc_ids come first in their source, null sources first of all; rows that share a
doc_id ascend by leaf, and rows equal in all five fields are leaves of their own, side by side; texts of any length are
hashed where they are read; a null doc_id is never tampered with; an empty table gives an empty table; extra columns are
not part of a leaf and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import drop_stage, write_stage

FANOUT = 3
LEVELS = 5
DIGITS = (8, 14, 14, 14)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(values: dict[str, Column]) -> Column:
    """The leaf of these fields: `-` for null, else UTF-8 byte count, colon, value."""
    texts = [values[name].cast("string") for name in FIELDS]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, other, times): other is the leaf of the tampered document, null where tampering changes nothing;
    equal rows are one row, counted."""
    values = {name: F.col(name) for name in FIELDS}
    cut = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = values | {"text": F.when(cut, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    changes = F.coalesce(cut & F.contains("text", F.lit("\n")), F.lit(False))
    made = docs.select("source", "doc_id", leaf_of(values).alias("leaf"), F.when(changes, leaf_of(tampered)).alias("other"))
    return made.groupBy("source", "doc_id", "leaf", "other").agg(F.count(F.lit(1)).alias("times"))


def _running(weight: str, keys: list[str], order: list[str]) -> Column:
    """The sum of `weight` over the earlier rows of a group."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(window), F.lit(0))


def _offsets(rows: DataFrame, keys: list[str], digits: tuple[int, ...]) -> DataFrame:
    """`rows` (keys, has, prefix, n) with `before`: the rows of the same keys under a smaller prefix."""
    if not digits:  # the top 14 bits are left, and the rows without a doc_id
        return rows.withColumn("before", _running("n", keys, ["has", "prefix"]))
    up = rows.withColumn("up", F.shiftright("prefix", digits[0]))
    above = up.groupBy(*keys, "has", "up").agg(F.sum("n").alias("n")).withColumnRenamed("up", "prefix")
    above = _offsets(above, keys, digits[1:]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("has").alias("_has"), F.col("prefix").alias("_up"), F.col("before").alias("_before"))
    inner = up.withColumn("inner", _running("n", [*keys, "has", "up"], ["prefix"]))
    on = (F.col("has") == F.col("_has")) & (F.col("up") == F.col("_up"))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return inner.join(above.hint("merge"), on).select(*rows.columns, (F.col("inner") + F.col("_before")).alias("before"))


def source_ranks(rows: DataFrame) -> DataFrame:
    """(source, s_rank, n): sources in order, null first, with their rows; a written table. Ranges keep any number of them apart."""
    sources = rows.groupBy("source").agg(F.sum("times").alias("n")).repartitionByRange(F.col("source").asc_nulls_first())
    sources = write_stage(sources.withColumn("part", F.spark_partition_id()), "sources")
    parts = sources.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first())) - 1
    ranked = sources.withColumn("own", own).join(parts, F.col("part") == F.col("p")).select("source", (F.col("own") + F.col("first")).cast("long").alias("s_rank"), "n")
    ranked = write_stage(ranked, "source-ranks")
    drop_stage(sources)
    return ranked


def ranked_leaves(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The leaves, one row each, by group (the rank of their source) and rank in it. `rows` is a written table."""
    sources = sources.select(F.col("source").alias("s"), F.col("s_rank").alias("group"))
    keyed = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).select(
        "group", "doc_id", "leaf", "other", "times", F.col("doc_id").isNotNull().cast("int").alias("has"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.conv(F.substring("leaf", 1, 4), 16, 10).cast("int").alias("tie"),
    )
    keyed = write_stage(keyed, "keyed")
    low = keyed.groupBy("group", "has", F.shiftright("id", DIGITS[0]).alias("prefix")).agg(F.sum("times").alias("n"))
    low = _offsets(write_stage(low, "digits"), ["group"], DIGITS[1:])
    low = low.select(F.col("group").alias("_g"), F.col("has").alias("_h"), F.col("prefix").alias("_p"), F.col("before").alias("_before"))
    spots = keyed.groupBy("group", "has", "id", "tie").agg(F.sum("times").alias("n")).withColumn("prefix", F.shiftright("id", DIGITS[0]))
    spots = spots.withColumn("inner", _running("n", ["group", "has", "prefix"], ["id", "tie"]))
    spots = spots.join(low.hint("merge"), (F.col("group") == F.col("_g")) & (F.col("has") == F.col("_h")) & (F.col("prefix") == F.col("_p")))
    spots = spots.select(
        F.col("group").alias("_g"), F.col("has").alias("_h"), F.col("id").alias("_i"), F.col("tie").alias("_t"), (F.col("inner") + F.col("_before")).alias("base")
    )
    on = (F.col("group") == F.col("_g")) & (F.col("has") == F.col("_h")) & (F.col("id") == F.col("_i")) & (F.col("tie") == F.col("_t"))
    placed = keyed.withColumn("own", _running("times", ["group", "has", "id", "tie"], ["leaf"])).join(spots.hint("merge"), on)
    placed = placed.select("group", "doc_id", "leaf", "other", "times", (F.col("base") + F.col("own")).alias("first"))
    block = 4096  # copies are laid out in two steps, so no array grows with their number
    tens = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / block)))
    placed = placed.withColumn("part", tens).withColumn("more", F.least(F.lit(block), F.col("times") - F.col("part") * block) - 1)
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("more")))
    return placed.withColumn("step", step).select("group", (F.col("first") + F.col("part") * block + F.col("step")).alias("rank"), "doc_id", "leaf", "other")


def height(nodes: int, fanout: int = FANOUT) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def _height(nodes: Column, fanout: int) -> Column:
    """Levels above `nodes` nodes, exact for every long."""
    powers = [fanout**k for k in range(1, height(1 << 62, fanout) + 1) if fanout**k < 1 << 62]
    return sum([(nodes > F.lit(p)).cast("int") for p in powers], (nodes > 1).cast("int"))


def _blocks(nodes: DataFrame, carry: list[str], fanout: int, levels: int) -> DataFrame:
    """(group, up, left, kids, rows): runs of fanout**levels nodes of (group, rank, node, left, *carry), `left` levels being
    above them; rows are their hashes, level by level from the nodes themselves."""
    up = F.floor(F.col("rank") / fanout**levels).alias("up")
    kids = F.sort_array(F.collect_list(F.struct("rank", "node", *carry)))
    blocks = nodes.groupBy("group", up).agg(kids.alias("kids"), F.max("left").alias("left"))

    def shorter(row: Column) -> Column:
        ends = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / fanout).cast("int"))
        return F.transform(ends, lambda i: F.sha2(F.array_join(F.slice(row, i * fanout + 1, F.lit(fanout)), "").cast("binary"), 256))

    first = F.array(F.col("kids.node"))
    steps = F.sequence(F.lit(1), F.least("left", F.lit(levels)))
    climbed = F.aggregate(steps, first, lambda rows, _: F.concat(rows, F.array(shorter(F.element_at(rows, -1)))))
    return blocks.withColumn("rows", F.when(F.col("left") > 0, climbed).otherwise(first))


def _siblings(index: Column, level: Column, fanout: int) -> Column:
    """What stands before and after the node over `index` in its run on this level of `rows`."""
    at = F.floor(index / F.pow(F.lit(fanout), level)).cast("int")
    digit = at % fanout
    part = lambda lo, n: F.array_join(F.slice(F.element_at("rows", level + 1), lo, n), "")
    return F.struct(part(at - digit + 1, digit).alias("before"), part(at + 2, fanout - 1 - digit).alias("after"))


def climb(nodes: DataFrame, most: int, carry: list[str], finish: Callable[[DataFrame], DataFrame], fanout: int, levels: int) -> DataFrame:
    """(group, rank, node, *carry, path, and what `finish` adds) of every node of a written table, whose largest `left` is `most`.

    `finish` takes the tops (group, node) and gives (g, rest, ...): for each group the path from its top on. Blocks are
    made once for the step above and once for the way down, where the rest of the path meets the block, not each node.
    """
    blocks = _blocks(nodes, carry, fanout, levels)
    node = F.element_at(F.element_at("rows", -1), 1).alias("node")
    above = write_stage(blocks.select("group", F.col("up").alias("rank"), node, F.greatest(F.col("left") - levels, F.lit(0)).alias("left")), "nodes")
    if most > levels:
        rest = climb(above, most - levels, [], finish, fanout, levels)
        rest = rest.drop("node").withColumnsRenamed({"group": "g", "rank": "u", "path": "rest"})
    else:
        rest = finish(above.select("group", "node")).withColumn("u", F.lit(0).cast("long"))
    found = [c for c in rest.columns if c not in ("g", "u", "rest")]
    joined = blocks.join(rest.hint("merge"), (F.col("group") == F.col("g")) & (F.col("up") == F.col("u")))
    inner = F.when(F.size("rows") > 1, F.sequence(F.lit(0), F.size("rows") - 2)).otherwise(F.array().cast("array<int>"))
    path = lambda i: F.concat(F.transform(inner, lambda level: _siblings(i, level, fanout)), "rest").alias("path")
    out = F.transform("kids", lambda kid, i: F.struct(*[kid[c].alias(c) for c in ("rank", "node", *carry)], path(i)))
    return joined.select("group", F.inline(out), *found)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, p: hashed(p["before"], acc, p["after"]))


def proofs(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per document: source_rank, rank, doc_id, leaf, other (the tampered document's leaf), path (its siblings, level
    by level to the root: before and after it), subroot and root."""
    rows = write_stage(leaves(docs), "leaves")
    sources = source_ranks(rows)
    n, largest = sources.agg(F.count(F.lit(1)), F.max("n")).first()
    left = sources.select(F.col("s_rank").alias("g"), _height(F.col("n"), fanout).alias("left"))
    ranked = ranked_leaves(rows, sources).join(left, F.col("group") == F.col("g")).withColumnRenamed("leaf", "node")
    ranked = write_stage(ranked.select("group", "rank", "node", "left", "doc_id", "other"), "ranked")
    drop_stage(rows, sources)

    def root(tops: DataFrame) -> DataFrame:
        none = F.array().cast("array<struct<before:string,after:string>>")
        return tops.select(F.col("group").alias("g"), none.alias("rest"), F.col("node").alias("root"))

    def over_sources(tops: DataFrame) -> DataFrame:
        top = F.lit(0).cast("long").alias("group")
        nodes = tops.select(top, F.col("group").alias("rank"), "node", F.lit(height(n, fanout)).alias("left"))
        out = climb(write_stage(nodes, "subroots"), height(n, fanout), [], root, fanout, levels)
        return out.select(F.col("rank").alias("g"), F.col("path").alias("rest"), F.col("node").alias("subroot"), "root")

    out = climb(ranked, height(largest or 0, fanout), ["doc_id", "other"], over_sources, fanout, levels)
    return out.withColumnsRenamed({"group": "source_rank", "node": "leaf"})


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the path), folded_root (of the tampered document) and verified."""
    whole = F.aggregate("path", F.lit(""), lambda acc, p: F.concat(acc, p["before"], p["after"]))
    out = proofs(docs, fanout, levels).withColumns({"proof_sha256": F.sha2(whole.cast("binary"), 256), "folded_root": fold(F.coalesce("other", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
