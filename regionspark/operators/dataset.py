"""Datasets: cleaning, exact splits, chat records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..stages import fresh

EMPTY = "<EMPTY>"


def clean_lines(lines: Column) -> Column:
    """Stripped lines without blanks; none: the empty token."""
    kept = F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.when(F.size(kept) == 0, F.array(F.lit(EMPTY))).otherwise(kept)


def existing(records: DataFrame, listing: DataFrame, how: str = "left_semi") -> DataFrame:
    """Records whose file is listed (left_semi), or those whose is not (left_anti)."""
    (name,) = fresh(records.columns, "listed")
    return records.join(listing.select(F.col("file_name").alias(name)), F.col("file_name") == F.col(name), how)


def split_sizes(n: int, val_ratio: float = 0.1, test_ratio: float = 0.1) -> dict[str, int]:
    test, val = int(n * test_ratio), int(n * val_ratio)
    return {"test": test, "eval": val, "train": n - test - val}


def _around(keyed: DataFrame, ranks: list[int], span: int, rows: int) -> list[tuple[int, int, int]]:
    """(low, high, rows below low) for each rank: a range of `_o` that holds the rank-th row, of `rows` rows at most
    unless it is one value. Each pass counts the rows of `span` parts of the ranges, so little reaches the driver."""
    least, most, n = keyed.agg(F.min("_o"), F.max("_o"), F.count(F.lit(1))).first()
    found = [(least, most, 0, n)] * len(ranks)
    while True:
        open_ranges = sorted({(lo, hi, below) for lo, hi, below, held in found if held > rows and hi > lo})
        if not open_ranges:
            return [(lo, hi, below) for lo, hi, below, _ in found]
        part, own = None, None
        for k, (lo, hi, _) in enumerate(open_ranges):
            width = -(-(hi - lo + 1) // span)
            here = F.col("_o").between(lo, hi)
            place = F.floor((F.col("_o").cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).cast("long")
            part = F.when(here, F.lit(k)) if part is None else part.when(here, F.lit(k))
            own = F.when(here, place) if own is None else own.when(here, place)
        counts = keyed.select(part.alias("k"), own.alias("p")).where("k is not null").groupBy("k", "p").agg(F.count(F.lit(1)).alias("n")).collect()
        held = {(r["k"], r["p"]): r["n"] for r in counts}
        for i, rank in enumerate(ranks):
            lo, hi, below, size = found[i]
            if size <= rows or hi == lo:
                continue
            k, width = open_ranges.index((lo, hi, below)), -(-(hi - lo + 1) // span)
            for p in sorted(p for j, p in held if j == k):
                if below + held[k, p] >= rank:
                    found[i] = (lo + p * width, min(hi, lo + (p + 1) * width - 1), below, held[k, p])
                    break
                below += held[k, p]


def exact_split(
    records: DataFrame, key: str = "file_name", val_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42,
    order: Column | None = None, span: int = 4096, rows: int = 10_000,
) -> DataFrame:
    """Records with `split`: exact sizes, the same for every run and partitioning.

    Records go by `order` (integers; else a hash of the key, in which equal keys are the only ties), then by key. The
    two borders are found by counting ranges of the order; only the rows of a border's last range, about `rows` of them,
    are ranked, and the others are told by their order alone. Ties of a border's order are ranked together.
    """
    order = F.xxhash64(F.lit(seed), F.col(key)) if order is None else order.cast("long")
    o, b, n = fresh(records.columns, "order", "border", "nth")
    keyed = records.withColumn(o, order)
    sizes = split_sizes(records.count(), val_ratio, test_ratio)
    ranks = [sizes["test"], sizes["test"] + sizes["eval"]]
    wanted = [r for r in ranks if r > 0]
    if not wanted:
        return records.withColumn("split", F.lit("train"))
    ranges = dict(zip(wanted, _around(keyed.select(F.col(o).alias("_o")), wanted, span, rows)))
    rank, near = F.col(o), None
    for number, (lo, hi, _) in enumerate(sorted(set(ranges.values()))):
        here = rank.between(lo, hi)
        near = F.when(here, F.lit(number)) if near is None else near.when(here, F.lit(number))
    placed = keyed.withColumn(b, near)
    nth = F.row_number().over(Window.partitionBy(b).orderBy(o, key))

    def within(r: int, ranked: bool) -> Column:
        """Whether a record is among the first `r`."""
        if r <= 0:
            return F.lit(False)
        lo, hi, below = ranges[r]
        return (rank < lo) | (rank.between(lo, hi) & (F.lit(below) + F.col(n) <= r)) if ranked else rank < lo

    def named(df: DataFrame, ranked: bool) -> DataFrame:
        test, head = (within(r, ranked) for r in ranks)
        return df.withColumn("split", F.when(test, "test").when(head, "eval").otherwise("train")).select(*records.columns, "split")

    border = placed.where(F.col(b).isNotNull()).withColumn(n, nth)
    return named(placed.where(F.col(b).isNull()), False).unionByName(named(border, True))


def chat_records(records: DataFrame, root: str, prompt: str, keep: Iterable[str] = ()) -> DataFrame:
    """(images, messages) of (file_name, lines): a user turn with image and prompt, an assistant turn with the lines.

    Columns named in `keep` come first."""
    text = F.array_join("lines", "\n")
    answer = F.when(strip(text) == "", EMPTY).otherwise(text)
    part = lambda kind, value=None: F.struct(F.lit(kind).alias("type"), (F.lit(None).cast("string") if value is None else value).alias("text"))
    turn = lambda role, *content: F.struct(F.lit(role).alias("role"), F.array(*content).alias("content"))
    images = F.array(F.concat(F.lit(root.rstrip("/") + "/"), "file_name")).alias("images")
    messages = F.array(turn("user", part("image"), part("text", F.lit(prompt))), turn("assistant", part("text", answer)))
    return records.select(*keep, images, messages.alias("messages"))
