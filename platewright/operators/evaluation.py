"""Predictions against gold annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions import patterns as P
from platewright.operators.boxes import iou


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 with 0 for empty denominators."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def greedy_iou_match(pred: DataFrame, gold: DataFrame, group: Sequence[str], threshold: float = P.EVAL_IOU) -> DataFrame:
    """(*group, n_pred, n_gold, matched, iou_sum): gold boxes in order, each with the
    best box that is left, if it overlaps enough.

    Boxes are (id, x, y, w, h); the first box wins a tie. A fold over a group's arrays
    in the JVM; a group is a figure. Without columns to group by all boxes are one
    group, as if they lay in one picture: one task's work, for small gold sets.
    """
    b = ("id", "x", "y", "w", "h")
    if not group:
        return greedy_iou_match(pred.withColumn("_all", F.lit(0)), gold.withColumn("_all", F.lit(0)), ["_all"], threshold).drop("_all")
    p = pred.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*b))).alias("p"))
    g = gold.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*b))).alias("g"))
    both = p.join(g, list(group), "full").withColumns({"p": F.coalesce("p", F.slice("g", F.lit(1), F.lit(0))), "g": F.coalesce("g", F.slice("p", F.lit(1), F.lit(0)))})
    start = F.struct(F.col("p").alias("left"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).cast("double").alias("s"))

    def step(acc: Column, gold_box: Column) -> Column:
        scored = F.transform(acc["left"], lambda c: F.struct(iou(c, gold_box).alias("v"), (-c["id"]).alias("k")))
        best = F.array_max(scored)
        hit = F.coalesce((best["v"] >= threshold) & (best["v"] > 0), F.lit(False))
        return F.when(
            hit, F.struct(F.filter(acc["left"], lambda c: c["id"] != -best["k"]).alias("left"), (acc["n"] + 1).alias("n"), (acc["s"] + best["v"]).alias("s"))
        ).otherwise(acc)

    folded = both.withColumn("_r", F.aggregate("g", start, step))
    return folded.select(*group, F.size("p").alias("n_pred"), F.size("g").alias("n_gold"), F.col("_r.n").alias("matched"), F.col("_r.s").alias("iou_sum"))


def summary(per_group: DataFrame) -> DataFrame:
    """One row of precision, recall, F1 and mean IoU over all groups."""
    t = per_group.agg(F.sum("matched").alias("tp"), F.sum(F.col("n_pred") - F.col("matched")).alias("fp"), F.sum(F.col("n_gold") - F.col("matched")).alias("fn"), F.sum("iou_sum").alias("s"))
    return t.select("tp", "fp", "fn", *[c.alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()], ratio(F.col("s"), F.col("tp")).alias("mean_iou"))


def evaluation(pred: DataFrame, gold: DataFrame, group: Sequence[str], pos: str, confidence: Column, threshold: float = P.EVAL_IOU) -> DataFrame:
    """One row of all measures: precision, recall and F1 of figures and of panels (the same
    boxes), mean IoU, how often labels (panel_id) agree position by position (``pos``),
    the mean confidence of answers, and n_samples, the gold rows.

    Boxes are (id, x, y, w, h); rows without a box count for the labels only.
    """
    boxed = [d.where("x is not null") for d in (pred, gold)]
    s = summary(greedy_iou_match(*boxed, group, threshold)).drop("tp", "fp", "fn").withColumnsRenamed({k: f"figure_{k}" for k in ("precision", "recall", "f1")})
    s = s.withColumns({f"panel_{k}": F.col(f"figure_{k}") for k in ("precision", "recall", "f1")})
    accuracy = zip_accuracy(pred, gold, pos, "panel_id").select(F.col("accuracy").alias("match_accuracy"))
    sure = pred.agg(F.coalesce(F.avg(confidence.try_cast("double")), F.lit(0.0)).alias("answer_confidence_mean"))
    return s.join(accuracy).join(sure).join(gold.agg(F.count(F.lit(1)).alias("n_samples")))  # a row each


def zip_accuracy(pred: DataFrame, gold: DataFrame, pos: str, label: str) -> DataFrame:
    """One row: the share of positions at which both sides agree, up to the shorter one's length."""
    p, g = pred.select(pos, F.col(label).alias("_p")), gold.select(pos, F.col(label).alias("_g"))
    return p.join(g, pos).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("_p").eqNullSafe(F.col("_g")).cast("double")), F.lit(0.0)).alias("accuracy"))


def before_after(before: DataFrame, after: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: accuracy of panel_id and species before and after, and the difference.

    Rows meet on ``keys``, null with null; a missing or null gold value is never right.
    """

    def on(a: str, b: str) -> Column:
        c = F.col(f"{a}.{keys[0]}").eqNullSafe(F.col(f"{b}.{keys[0]}"))
        for k in keys[1:]:
            c = c & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return c

    rows = before.alias("b").join(after.alias("a"), on("b", "a")).join(gold.alias("g"), on("b", "g"), "left")

    def right(side: str) -> Column:
        return F.coalesce((F.col(f"{side}.panel_id") == F.col("g.panel_id")) & (F.col(f"{side}.species") == F.col("g.species")), F.lit(False)).cast("double")

    t = rows.agg(F.count(F.lit(1)).alias("n_samples"), F.avg(right("b")).alias("b"), F.avg(right("a")).alias("a"))
    b, a = F.coalesce("b", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return t.select("n_samples", F.round(b, 4).alias("match_acc_before"), F.round(a, 4).alias("match_acc_after"), F.round(a - b, 4).alias("match_improvement"))


def mean_answer_confidence(rows: DataFrame, nested: Column, top: Column) -> DataFrame:
    """One row: the mean confidence of answers, the nested value first; what is no number is left out."""
    return rows.agg(F.coalesce(F.avg(F.coalesce(nested.try_cast("double"), top.try_cast("double"))), F.lit(0.0)).alias("mean_confidence"))
