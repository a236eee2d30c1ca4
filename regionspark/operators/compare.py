"""Comparison frames: macro means, unpivot, min-max, latency, hardware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..stages import drop_stage, fresh, write_stage


def model_means(items: DataFrame, metrics: list[str], by: str = "model") -> DataFrame:
    return items.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics])


def melt(frame: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return frame.unpivot(ids, metrics, "metric", "value")


def min_max(frame: DataFrame, columns: list[str], inverted: list[str] = ()) -> DataFrame:
    """Columns scaled to 0..1 over all rows (a comparison frame has one row per model); a zero range gives null."""
    bounds = frame.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = frame.join(F.broadcast(bounds))  # one row
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in columns}
    return joined.select(*[(1 - scaled[c] if c in inverted else scaled[c]).alias(c) if c in scaled else F.col(c) for c in frame.columns])


def group_median(rows: DataFrame, value: str, by: list[str], bins: int = 1024, most: int = 10_000) -> DataFrame:
    """(*by, median): the exact median of each group, the mean of the two middle values of an even number; nulls don't count.

    Ranges of values are counted, not held: each pass cuts every group's open range into `bins` and goes on with the bin that
    holds a middle rank, from its own least to its greatest value. The last `most` values of a range at most are sorted, or
    one value however often it occurs. Groups are shuffled as counts of bins, so a group of any size is spread.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    data = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_v"))
    whole = data.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    state = whole.withColumn("rank", F.explode(ranks)).withColumn("below", F.lit(0).cast("long"))
    state = write_stage(state, "ranges")
    own = lambda df, *names: df.select(*[F.col(k).alias(f"s{k}") for k in keys], *names)

    def met(ranges: DataFrame) -> DataFrame:
        on = F.col("_v").between(F.col("lo"), F.col("hi"))
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"s{k}"))
        return data.join(ranges, on)

    while state.where((F.col("n") > most) & (F.col("hi") > F.col("lo"))).limit(1).count():
        wide = (F.col("n") > most) & (F.col("hi") > F.col("lo"))
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        counts = met(own(state.where(wide).select(*keys, "lo", "hi", "below", "rank"), "lo", "hi", "below", "rank"))
        counts = counts.groupBy(*keys, "rank", "below", bin_.alias("bin")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin")) + F.col("below")
        closer = counts.withColumn("upto", upto).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        closer = closer.select(*keys, "lo", "hi", "n", "rank", (F.col("upto") - F.col("n")).alias("below"))
        new = write_stage(closer.unionByName(state.where(~wide)), "ranges")
        drop_stage(state)
        state = new
    point = state.where("hi = lo").select(*keys, F.col("lo").alias("v"))
    rest = met(own(state.where("hi > lo").select(*keys, "lo", "hi", "below", "rank"), "lo", "hi", "below", "rank"))
    nth = F.row_number().over(Window.partitionBy(*keys, "rank").orderBy("_v")) + F.col("below")
    rest = rest.withColumn("nth", nth).where("nth = rank").select(*keys, F.col("_v").alias("v"))
    return point.unionByName(rest).groupBy(*[F.col(k).alias(c) for c, k in zip(by, keys)]).agg(F.avg("v").alias("median"))


def latency(rows: DataFrame, seconds: str, *by: str) -> DataFrame:
    """n, total, mean, median, least and most of each group."""
    c = F.col(seconds)
    sums = rows.groupBy(*by).agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))
    names = fresh(sums.columns, *by)
    middle = group_median(rows, seconds, list(by)).withColumnsRenamed(dict(zip(by, names)))
    on = F.lit(True)
    for c, k in zip(by, names):
        on &= F.col(c).eqNullSafe(F.col(k))
    return sums.join(middle, on, "left").select(*by, "n", "total", "mean", "median", "least", "most")


def hardware(samples: DataFrame, columns: list[str]) -> DataFrame:
    return samples.agg(*[F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("peak", F.max))])


def cpu_percent(user: Column, system: Column, wall: Column) -> Column:
    return F.greatest(user + system, F.lit(0.0)) / F.greatest(wall, F.lit(1e-9)) * 100


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    return rows.groupBy(F.expr(f"width_bucket({column}, {low}, {high}, {bins})").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def in_order(frame: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose `column` is among the names, in their order."""
    rank = F.array_position(F.lit(names) if not isinstance(names, list) else F.array(*map(F.lit, names)), F.col(column))
    return frame.where(F.col(column).isin(names)).orderBy(rank)


def model_kind(name: Column) -> Column:
    return F.when(F.lower(name).contains("glm"), "glm").otherwise("qwen")
