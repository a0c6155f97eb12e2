"""Boxes (x, y, w, h): overlap, suppression, thinning, reading order, choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import patterns as P


def box(array: Column) -> Column:
    """A box struct of an array [x, y, w, h]; null unless all four are there."""
    ok = (F.size(array) == 4) & ~F.exists(array, lambda v: v.isNull())
    return F.when(ok, F.struct(*[array[i].alias(n) for i, n in enumerate(("x", "y", "w", "h"))]))


def overlap(a: Column, b: Column) -> Column:
    """Pixels that two boxes share."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the union is empty."""
    shared = overlap(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def suppress(boxes: DataFrame, group: Sequence[str], score: str, order: Sequence[str], threshold: float = P.NMS_IOU) -> DataFrame:
    """(*group, *order, x, y, w, h, score): greedy suppression in each group.

    Boxes go from the best score on (ties by ``order``); one that overlaps a kept one
    by ``threshold`` or more is dropped. A fold over the group's ordered array in
    the JVM; groups are the boxes of one figure.
    """
    kept = F.struct((-F.col(score)).alias("_s"), *order, "x", "y", "w", "h")
    gathered = boxes.groupBy(*group).agg(F.array_sort(F.collect_list(kept)).alias("_all"))
    fold = F.aggregate("_all", F.slice("_all", F.lit(1), F.lit(0)), lambda done, c: F.when(F.exists(done, lambda k: iou(k, c) >= threshold), done).otherwise(F.array_append(done, c)))
    return gathered.select(*group, F.explode(fold).alias("_k")).select(*group, *[F.col(f"_k.{c}") for c in (*order, "x", "y", "w", "h")], (-F.col("_k._s")).alias(score))


def thin_points(points: DataFrame, group: Sequence[str], order: Sequence[str], gap: float = P.POINT_GAP) -> DataFrame:
    """(*group, *order, x, y): points in order, those nearer than ``gap`` to a kept one left out."""
    gathered = points.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, "x", "y"))).alias("_all"))

    def near(k: Column, c: Column) -> Column:
        return (k["x"] - c["x"]) * (k["x"] - c["x"]) + (k["y"] - c["y"]) * (k["y"] - c["y"]) <= gap * gap

    fold = F.aggregate("_all", F.slice("_all", F.lit(1), F.lit(0)), lambda done, c: F.when(F.exists(done, lambda k: near(k, c)), done).otherwise(F.array_append(done, c)))
    return gathered.select(*group, F.explode(fold).alias("_k")).select(*group, "_k.*")


def dedup_on_grid(boxes: DataFrame, group: Sequence[str], order: Sequence[str], cell: int = P.GRID_CELL) -> DataFrame:
    """Of boxes (x0, y0, x1, y1) in the same cells of a grid the first by ``order``."""
    same = Window.partitionBy(*group, *[F.floor(F.col(c) / cell) for c in ("x0", "y0", "x1", "y1")]).orderBy(*order)
    return boxes.withColumn("_rank", F.row_number().over(same)).where("_rank = 1").drop("_rank")


def figure_regions(boxes: DataFrame, image_area: Column) -> DataFrame:
    """Boxes that can be figures by area, share of the page and aspect, with their score."""
    area = F.col("w") * F.col("h")
    aspect = F.col("w") / F.greatest(F.lit(1), F.col("h"))
    fit = (area >= P.REGION_AREA) & (area <= image_area * P.REGION_SHARE) & (aspect >= P.REGION_ASPECT[0]) & (aspect <= P.REGION_ASPECT[1])
    return boxes.where(fit).withColumn("area", area).withColumn("region_score", F.least(F.lit(0.99), area / image_area))


def panel_candidates(boxes: DataFrame, image_area: Column) -> DataFrame:
    """Boxes that can be panels, with their score."""
    area = F.col("w") * F.col("h")
    return boxes.where((area >= P.PANEL_AREA) & (area <= image_area * P.PANEL_SHARE)).withColumn("panel_score", F.least(F.lit(1.0), area / image_area))


def reading_order(boxes: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``boxes`` with panel_index: their rank by row, then column, then ``order``, from 0."""
    return boxes.withColumn("panel_index", F.row_number().over(Window.partitionBy(*group).orderBy("y", "x", *order)) - 1)


def best_region(regions: DataFrame, group: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """Of each group the region of the highest score, ties by page, row, column and ``order``."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), "page_index", "y", "x", *order))
    return regions.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def centre_in(token: Column, panel: Column) -> Column:
    """Whether a token's centre lies in a panel, edges included."""
    cx, cy = token["x"] + token["w"] * 0.5, token["y"] + token["h"] * 0.5
    return cx.between(panel["x"], panel["x"] + panel["w"]) & cy.between(panel["y"], panel["y"] + panel["h"])
