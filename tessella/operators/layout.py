"""Joins and checks over placed rectangles (id, x, y, w, h)."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import connected
from .storage import cut


def _fitting(boxes: DataFrame, cell: float) -> float:
    """The cell, or a smaller one of about the boxes' sizes where these are small: large cells make boxes meet that lie far apart."""
    size = boxes.agg(F.avg("w").alias("w"), F.avg("h").alias("h")).first()
    most = max((v for v in size if v is not None), default=0.0)
    return min(cell, most) if 0 < most < float("inf") else cell


def _met(boxes: DataFrame, cell: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of boxes (ida, xa, ... hb) that overlap by more than the tolerance both ways; boxes meet in grid cells, each pair in the cell of its corner only.

    They meet by a merge join: the size of a table that was dealt out to cells is underrated, and a broadcast would leave the work to few tasks.
    """
    cell = _fitting(boxes, cell)
    reach = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor((F.col(lo) + F.col(size)) / cell).cast("long"))
    dealt = boxes.withColumn("cx", F.explode(reach("x", "w"))).withColumn("cy", F.explode(reach("y", "h")))
    side = lambda s: dealt.select("cx", "cy", *[F.col(c).alias(c + s) for c in ("id", "x", "y", "w", "h")], (F.col("x") + F.col("w")).alias("r" + s), (F.col("y") + F.col("h")).alias("l" + s))
    # An overlap is the least of the four differences; these two are told first, as they part most boxes.
    apart = [(F.col(far) - F.col(near)) > tolerance for far, near in (("la", "yb"), ("lb", "ya"), ("ra", "xb"), ("rb", "xa"))]
    met = side("a").join(side("b").hint("merge"), ["cx", "cy"]).where(reduce(and_, apart)).where("ida < idb")
    ox = F.least("ra", "rb") - F.greatest("xa", "xb")
    oy = F.least("la", "lb") - F.greatest("ya", "yb")
    corner = (F.floor(F.greatest("xa", "xb") / cell) == F.col("cx")) & (F.floor(F.greatest("ya", "yb") / cell) == F.col("cy"))
    return met.where(corner).withColumns({"ox": ox, "oy": oy}).where((F.col("ox") > tolerance) & (F.col("oy") > tolerance))


def overlaps(boxes: DataFrame, cell: float, tolerance: float = 0.0) -> DataFrame:
    """(a, b, area) of boxes that overlap by more than the tolerance in width and height; touching is none."""
    return _met(boxes, cell, tolerance).select(F.col("ida").alias("a"), F.col("idb").alias("b"), (F.col("ox") * F.col("oy")).alias("area"))


def rated_overlaps(boxes: DataFrame, cell: float) -> DataFrame:
    """(a, b, area, iou) of boxes that overlap."""
    area, all_ = F.col("ox") * F.col("oy"), F.col("wa") * F.col("ha") + F.col("wb") * F.col("hb")
    return _met(boxes, cell).select(F.col("ida").alias("a"), F.col("idb").alias("b"), area.alias("area"), (area / (all_ - area)).alias("iou"))


def collisions(boxes: DataFrame, cell: float) -> DataFrame:
    """(a, b, ox, oy, dx, dy): overlaps with the shortest vector that parts them, along the smaller overlap and towards b's centre."""
    mid = lambda s, at, size: F.col(at + s) + F.col(size + s) / 2
    push = lambda o, at, size: F.when(mid("a", at, size) < mid("b", at, size), F.col(o)).otherwise(-F.col(o))
    flat = F.col("ox") <= F.col("oy")
    return _met(boxes, cell).select(F.col("ida").alias("a"), F.col("idb").alias("b"), "ox", "oy", F.when(flat, push("ox", "x", "w")).otherwise(0.0).alias("dx"), F.when(flat, 0.0).otherwise(push("oy", "y", "h")).alias("dy"))


def _frames(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """The row whose frame each box ends in, after x, y, x2, y2 were grown in place; a finished frame meets no other one that is left."""
    of, left = np.arange(len(x)), np.arange(len(x))
    at = 0
    while at < len(left):
        i = left[at]
        met = (np.minimum(x2[left], x2[i]) - np.maximum(x[left], x[i]) > 0) & (np.minimum(y2[left], y2[i]) - np.maximum(y[left], y[i]) > 0)
        met[at] = False
        if not met.any():
            at += 1
            continue
        rows = left[met]
        x[i], y[i] = min(x[i], x[rows].min()), min(y[i], y[rows].min())
        x2[i], y2[i] = max(x2[i], x2[rows].max()), max(y2[i], y2[rows].max())
        of[rows] = i
        at -= int(met[:at].sum())
        left = left[~met]
    while (of != of[of]).any():
        of = of[of]
    return of


def _merged_within(boxes: DataFrame, *by: Column) -> DataFrame:
    """Boxes (id, x, y, w, h, n) merged as far as they are in one group."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(float, copy=True), pdf["y"].to_numpy(float, copy=True)
        x2, y2 = x + pdf["w"].to_numpy(float), y + pdf["h"].to_numpy(float)
        of = _frames(x, y, x2, y2)
        told = pdf.groupby(of)[["id", "n"]].agg({"id": "min", "n": "sum"})
        at = told.index.to_numpy()
        return pd.DataFrame({"id": told["id"].to_numpy(), "x": x[at], "y": y[at], "w": x2[at] - x[at], "h": y2[at] - y[at], "n": told["n"].to_numpy()})

    grouped = boxes.withColumns({f"_{k}": c for k, c in enumerate(by)}).groupBy(*[f"_{k}" for k in range(len(by))])
    return grouped.applyInPandas(run, boxes.schema)


def merged(boxes: DataFrame, cell: float, few: int = 20_000) -> DataFrame:
    """(id, x, y, w, h, n): overlapping boxes grown into their common frame, again and again until no frames overlap; id is the smallest one.

    Whatever the order, the frames in the end are the same. So those of a grid cell are merged first, which leaves few where boxes lie close;
    at most `few` frames are then merged in one task, more by rounds of joins.
    """
    now = boxes.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], F.lit(1).cast("long").alias("n"))
    now = cut(_merged_within(now, F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)))
    while now.count() > few:
        links = cut(overlaps(now, cell).select("a", "b"))
        if not links.take(1):
            return now
        of = connected(links).withColumnRenamed("node", "id")
        at = now.join(of, "id", "left").withColumn("to", F.coalesce("component", "id"))
        grown = at.groupBy("to").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"), F.sum("n").alias("n"))
        now = cut(grown.select(F.col("to").alias("id"), "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "n"))
    return _merged_within(now, F.lit(0))


def covered(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(coverage): share of the canvas's unit cells that whole-numbered boxes paint, counted once.

    A box goes out as one run per line, and a line's runs are joined by a sorted window, so nothing grows with the boxes' areas.
    """
    edge = lambda at, size, most: F.least(F.lit(most), F.floor(F.col(at) + F.col(size))).cast("long")
    runs = boxes.select(F.greatest(F.lit(0), F.floor("x")).cast("long").alias("x1"), edge("x", "w", width).alias("x2"), F.greatest(F.lit(0), F.floor("y")).cast("long").alias("y1"), edge("y", "h", height).alias("y2"))
    runs = runs.where("x2 > x1 and y2 > y1").withColumn("line", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1))).select("line", "x1", "x2").distinct()
    before = Window.partitionBy("line").orderBy("x1", "x2").rowsBetween(Window.unboundedPreceding, -1)
    new = runs.withColumn("seen", F.coalesce(F.max("x2").over(before), F.lit(0))).select(F.greatest(F.lit(0), F.col("x2") - F.greatest("x1", "seen")).alias("n"))
    return new.agg((F.coalesce(F.sum("n"), F.lit(0)) / float(width * height)).alias("coverage"))


# Weights of a layout's parts.
LAYOUT_WEIGHTS = {"coverage": 1.0, "uniformity": 0.5, "score": 1.0, "overlap": 1.0}


def layout_score(boxes: DataFrame, width: int, height: int, cell: float, weights: dict[str, float] | None = None) -> DataFrame:
    """(coverage, overlap_ratio, uniformity, mean_score, total) of boxes(id, x, y, w, h, score): the overlap's weight counts against and in the divisor."""
    w = weights or LAYOUT_WEIGHTS
    cx, cy = width / 2, height / 2
    off = F.sqrt((F.col("x") + F.col("w") / 2 - cx) ** 2 + (F.col("y") + F.col("h") / 2 - cy) ** 2) / ((cx * cx + cy * cy) ** 0.5 + 1e-12)
    sums = boxes.agg(F.coalesce(F.sum(F.col("w") * F.col("h")), F.lit(0.0)).alias("area"), F.coalesce(F.stddev_pop(off), F.lit(0.0)).alias("spread"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.count("*").alias("n"))
    shared = overlaps(boxes, cell).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("shared"))
    rows = sums.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(covered(boxes, width, height)))  # one row each
    ratio = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("shared"), F.col("area")), F.lit(0.0)))
    rows = rows.select("coverage", ratio.alias("overlap_ratio"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("spread"))).alias("uniformity"), "mean_score", "n")
    total = (w["coverage"] * F.col("coverage") + w["uniformity"] * F.col("uniformity") + w["score"] * F.col("mean_score") - w["overlap"] * F.col("overlap_ratio")) / (sum(w.values()) + 1e-12)
    return rows.withColumn("total", F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))).drop("n")


def placement_quality(density: Column, coverage: Column, overlap: Column, scale: float = 1e4) -> Column:
    """0.4 density + 0.4 coverage + 0.2 (1 - overlap / scale), in [0, 1]."""
    fine = 1 - F.least(F.lit(1.0), overlap / max(scale, 1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * density + 0.4 * coverage + 0.2 * fine))


def significant_overlaps(pairs: DataFrame, iou: float = 0.05, area: float = 1.0) -> DataFrame:
    """Pairs (a, b, area, iou) that reach both thresholds, with the IoU as their penalty."""
    return pairs.where((F.col("iou") >= iou) & (F.col("area") >= area)).withColumn("penalty", F.col("iou"))


def overlap_summary(significant: DataFrame) -> DataFrame:
    """(n_overlaps, total_area, max_iou, mean_penalty, is_valid) over the significant ones."""
    sums = significant.agg(F.count("*").alias("n_overlaps"), *[F.coalesce(f, F.lit(0.0)).alias(n) for n, f in (("total_area", F.sum("area")), ("max_iou", F.max("iou")), ("mean_penalty", F.avg("penalty")))])
    return sums.withColumn("is_valid", F.col("n_overlaps") == 0)


def with_iou(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    area = boxes.select("id", (F.col("w") * F.col("h")).alias("s"))
    rows = pairs.join(area.toDF("a", "sa"), "a").join(area.toDF("b", "sb"), "b")
    return rows.select("a", "b", "area", (F.col("area") / (F.col("sa") + F.col("sb") - F.col("area"))).alias("iou"))


def gaps(pairs: DataFrame, near: float = 5.0) -> DataFrame:
    """Signed gaps of box pairs (xa, ya, wa, ha, xb, yb, wb, hb) and their kind."""
    gx = F.greatest(F.expr("xb - (xa + wa)"), F.expr("xa - (xb + wb)"))
    gy = F.greatest(F.expr("yb - (ya + ha)"), F.expr("ya - (yb + hb)"))
    most = F.greatest("gap_x", "gap_y")
    kind = F.when(most < 0, "overlap").when(most == 0, "touching").when(most <= near, "near").otherwise("far")
    return pairs.withColumns({"gap_x": gx, "gap_y": gy}).withColumn("kind", kind)


def out_of_bounds(boxes: DataFrame, width: float, height: float) -> DataFrame:
    return boxes.where((F.col("x") + F.col("w") > width) | (F.col("y") + F.col("h") > height))


def duplicate_places(boxes: DataFrame) -> DataFrame:
    """(first_id, id) of boxes at the place of an earlier one."""
    first = boxes.groupBy("x", "y", "w", "h").agg(F.min("id").alias("first_id"))
    return boxes.join(first, ["x", "y", "w", "h"]).where("id > first_id").select("first_id", "id")
