"""Reading order from boxes: filter, line clustering, rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OVERLAP, CENTER, GAP = 0.45, 0.35, 0.8


def filter_boxes(boxes: DataFrame, min_confidence: float = 0.50, min_height_ratio: float = 0.008) -> DataFrame:
    height = F.col("y_max") - F.col("y_min")
    return boxes.where((F.col("text") != "") & (F.col("confidence") >= min_confidence) & (height / F.col("image_height") >= min_height_ratio))


def assign_lines(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """Line numbers of boxes (x_min, y_min, x_max, y_max), top to bottom. Lines grow as boxes join them."""
    order = sorted(range(len(boxes)), key=lambda i: ((boxes[i][1] + boxes[i][3]) / 2, boxes[i][0]))
    lines: list[list] = []  # [top, bottom, members]
    for i in order:
        _, top, _, bottom = boxes[i]
        height, center = bottom - top, (top + bottom) / 2
        best = None
        for n, (a, z, _) in enumerate(lines):
            apart = abs(center - (a + z) / 2)
            shared = max(0.0, min(bottom, z) - max(top, a)) / max(1.0, min(height, z - a))
            if (shared >= OVERLAP or apart <= CENTER * max(height, z - a)) and (best is None or apart < best[0]):
                best = (apart, n)
        if best is None:
            lines.append([top, bottom, [i]])
        else:
            line = lines[best[1]]
            line[0], line[1] = min(line[0], top), max(line[1], bottom)
            line[2].append(i)
    ranked = sorted(lines, key=lambda x: ((x[0] + x[1]) / 2, min(boxes[i][0] for i in x[2])))
    out = [0] * len(boxes)
    for n, (_, _, members) in enumerate(ranked):
        for i in members:
            out[i] = n
    return out


def cluster_lines(boxes: DataFrame) -> DataFrame:
    """Boxes with line_ix. A page is what one engine call saw, so a group is bounded by a page."""
    schema = boxes.select("page", "text", "x_min", "y_min", "x_max", "y_max").schema

    def run(page: pd.DataFrame) -> pd.DataFrame:
        own = page[[f.name for f in schema]].copy()
        own["line_ix"] = assign_lines(list(own[["x_min", "y_min", "x_max", "y_max"]].itertuples(index=False, name=None)))
        return own

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return boxes.groupBy("page").applyInPandas(run, f"{fields}, line_ix long")


def render_lines(boxes: DataFrame) -> DataFrame:
    """(page, line_ix, text): boxes left to right, a blank where the gap exceeds GAP times the greater height."""
    w = Window.partitionBy("page", "line_ix").orderBy("x_min", "y_min", "text")
    height = F.col("y_max") - F.col("y_min")
    gap = F.col("x_min") - F.lag("x_max").over(w)
    wide = gap > GAP * F.greatest(height, F.lag(height).over(w))
    pieces = boxes.withColumn("_piece", F.concat(F.when(wide, " ").otherwise(""), F.col("text"))).withColumn("_n", F.row_number().over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_piece"))), lambda x: x["_piece"]), "")
    return pieces.groupBy("page", "line_ix").agg(F.trim(joined).alias("text"))
