"""Association of panels with labels, names and recognised text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from platewright.functions import patterns as P
from platewright.functions.text import all_matches, distinct_in_order, label_scalar, strip
from platewright.operators.boxes import centre_in

FIGURE = ("paper_id", "figure_id")


def label_tokens(tokens: DataFrame, group: Sequence[str] = FIGURE) -> DataFrame:
    """(*group, pos, token_id, text): the tokens that are a panel label, stripped."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return tokens.select(*group, "pos", "token_id", text.alias("text")).where(F.col("text").rlike(P.unicode_aware(P.LABEL_TOKEN)))


def text_in_panels(panels: DataFrame, tokens: DataFrame, group: Sequence[str] = FIGURE) -> DataFrame:
    """(*group, panel_index, ocr_text): the tokens whose centre lies in a panel, in reading order.

    The figure is the join's key, the geometry its condition: tokens meet only the
    panels of their own figure.
    """
    p, t = panels.alias("p"), tokens.alias("t")
    same = [F.col(f"p.{g}") == F.col(f"t.{g}") for g in group]
    on = same[0]
    for c in same[1:]:
        on = on & c
    inside = p.join(t, on & centre_in(F.col("t.bbox"), F.struct("p.x", "p.y", "p.w", "p.h")))
    words = F.array_sort(F.collect_list(F.struct("t.pos", "t.token_id", "t.text")))
    return inside.groupBy(*[F.col(f"p.{g}") for g in group], "p.panel_index").agg(F.array_join(words["text"], " ").alias("ocr_text"))


def numbered(items: DataFrame, group: Sequence[str], order: Sequence[str], as_: str = "panel_index") -> DataFrame:
    """``items`` with their position in the group's order, from 0: a key for positional joins."""
    return items.withColumn(as_, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def taxa_or_found(figures: DataFrame, taxa: DataFrame, text: Column) -> DataFrame:
    """(*FIGURE, panel_index, species): ``taxa``, for figures without any the names that their caption ``text`` holds."""
    bare = figures.join(taxa.select(*FIGURE).distinct(), list(FIGURE), "left_anti")
    found = bare.select(*FIGURE, F.posexplode(distinct_in_order(all_matches(text, P.TAXON_IN_CAPTION))).alias("panel_index", "species"))
    return taxa.select(*FIGURE, "panel_index", "species").unionByName(found)


def match_panels(figures: DataFrame, panels: DataFrame, labels: DataFrame, taxa: DataFrame, tokens: DataFrame, neural: DataFrame | None = None) -> DataFrame:
    """Panels matched with labels, species and recognised text, by position.

    ``figures``: (paper_id, figure_id, caption), one row each. ``panels``: their boxes with
    panel_index from 0 and score. ``labels`` and ``taxa``: (paper_id, figure_id,
    panel_index, label / species), positions from 0. A panel gets the label at its
    position (a figure without labels those of its label tokens), the species there,
    else the figure's first. The confidence is the panel's score with increments
    for what was found. A figure without panels gives one row of low confidence if
    it has a label or a species. ``neural`` (see :func:`neural_matches`) replaces labels and
    species of the figures for which it found any; their confidence is the greater of
    the panel's score and its own, without increments.
    """
    found = numbered(label_tokens(tokens), FIGURE, ("pos", "token_id")).select(*FIGURE, "panel_index", F.col("text").alias("label"))
    unlabelled = found.join(labels.select(*FIGURE).distinct(), list(FIGURE), "left_anti")
    labels = labels.select(*FIGURE, "panel_index", "label").unionByName(unlabelled)
    known = label_tokens(tokens).select(*FIGURE, F.col("text").alias("label")).distinct().withColumn("seen", F.col("label"))
    first = taxa.where("panel_index = 0").select(*FIGURE, F.col("species").alias("first_species"))
    keys = [*FIGURE, "panel_index"]
    rows = (
        panels.select(*keys, "x", "y", "w", "h", "score").join(figures.select(*FIGURE, "caption"), list(FIGURE))
        .join(labels, keys, "left")
        .join(taxa.select(*keys, "species"), keys, "left")
        .join(first, list(FIGURE), "left")
        .join(text_in_panels(panels, tokens), keys, "left")
        .withColumn("species", F.coalesce("species", "first_species"))
    )
    used = F.lit(False)
    if neural is not None:
        some = neural.groupBy(*FIGURE).agg(F.max(F.col("label").isNotNull() | F.col("species").isNotNull()).alias("_used"))
        told = neural.select(*keys, F.col("label").alias("_label"), F.col("species").alias("_species"), "neural_confidence").join(some, list(FIGURE))
        used = F.coalesce("_used", F.lit(False))
        rows = rows.join(told, keys, "left").withColumns({"label": F.when(used, F.col("_label")).otherwise(F.col("label")), "species": F.when(used, F.col("_species")).otherwise(F.col("species"))})
    rows = rows.join(known, [*FIGURE, "label"], "left")
    plus = [(F.col("label") != "", P.PLUS_LABEL), (F.col("species") != "", P.PLUS_SPECIES), (F.col("ocr_text") != "", P.PLUS_OCR)]
    confidence = F.col("score")
    for what, by in plus:
        confidence = confidence + F.when(what, by).otherwise(0.0)
    confidence = F.least(F.lit(P.CONF_MOST), confidence)
    if neural is not None:
        confidence = F.when(used, F.greatest("score", "neural_confidence")).otherwise(confidence)
    matched = rows.select(
        *FIGURE, "panel_index", F.col("label").alias("panel_id"), "species", F.coalesce("seen", "label").alias("label_text"), "x", "y", "w", "h",
        confidence.alias("confidence"), F.substring("caption", 1, P.SNIPPET).alias("caption_snippet"), F.nullif("ocr_text", F.lit("")).alias("ocr_text"),
    )
    bare = figures.join(panels.select(*FIGURE).distinct(), list(FIGURE), "left_anti")
    lone = bare.join(labels.where("panel_index = 0").select(*FIGURE, "label"), list(FIGURE), "left").join(first, list(FIGURE), "left").where("label is not null or first_species is not null")
    nothing = F.lit(None)
    lone = lone.select(
        *FIGURE, nothing.cast("int").alias("panel_index"), F.col("label").alias("panel_id"), F.col("first_species").alias("species"), F.col("label").alias("label_text"),
        *[nothing.cast("int").alias(c) for c in "xywh"], F.lit(P.CONF_NO_PANEL).alias("confidence"), F.substring("caption", 1, P.SNIPPET).alias("caption_snippet"), nothing.cast("string").alias("ocr_text"),
    )
    return matched.unionByName(lone)


def panel_features(width: Column, height: Column) -> Column:
    """Twelve numbers that describe a panel (x, y, w, h, panel_index, score) of an image."""
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    iw, ih = F.greatest(F.lit(1.0), width), F.greatest(F.lit(1.0), height)
    area = F.greatest(F.lit(1.0), w * h)
    return F.array(x / iw, y / ih, w / iw, h / ih, (x + w * 0.5) / iw, (y + h * 0.5) / ih, area / (iw * ih), F.col("panel_index") / 100.0, F.col("score").cast("double"), F.lit(1.0), F.lit(0.0), F.lit(0.0))


def label_features(width: Column, height: Column) -> Column:
    """Twelve numbers that describe a label token (bbox, text, confidence, label_index)."""
    x, y, w, h = (F.col(f"bbox.{c}").cast("double") for c in "xywh")
    iw, ih = F.greatest(F.lit(1.0), width), F.greatest(F.lit(1.0), height)
    area = F.greatest(F.lit(1.0), w * h)
    return F.array(x / iw, y / ih, w / iw, h / ih, (x + w * 0.5) / iw, (y + h * 0.5) / ih, area / (iw * ih), F.col("label_index") / 100.0, F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), label_scalar(F.col("text")), F.lit(1.0), F.lit(0.0))


def species_features(name: Column, index: Column) -> Column:
    """Twelve numbers that describe a species name and its position."""
    n = F.coalesce(name, F.lit(""))
    bare = strip(n)
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, P.unicode_aware(r"\s+"))))
    qualified = F.when(n.rlike(P.unicode_aware(P.QUALIFIER)), 1.0).otherwise(0.0)
    return F.array(F.length(F.split(n, " ")[0]) / 30.0, words / 6.0, qualified, index / 100.0, *[F.lit(0.0)] * 7, F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def softmax_over(logits: DataFrame, group: Sequence[str], logit: str) -> DataFrame:
    """``logits`` with p: their softmax within each group."""
    w = Window.partitionBy(*group)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return logits.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def optimal_assignment(weights: np.ndarray) -> list[int | None]:
    """For each row the column that it gets in the assignment of greatest total
    weight; None for rows left over. Shortest augmenting paths with potentials,
    O(rows² columns)."""
    rows, columns = weights.shape
    if rows == 0 or columns == 0:
        return [None] * rows
    if rows > columns:
        back = optimal_assignment(weights.T)
        out: list[int | None] = [None] * rows
        for c, r in enumerate(back):
            if r is not None:
                out[r] = c
        return out
    cost = weights.max() - weights
    u, v = np.zeros(rows + 1), np.zeros(columns + 1)
    owner = np.zeros(columns + 1, dtype=int)
    for i in range(1, rows + 1):
        owner[0], j0 = i, 0
        least, seen, came = np.full(columns + 1, np.inf), np.zeros(columns + 1, dtype=bool), np.zeros(columns + 1, dtype=int)
        while True:
            seen[j0] = True
            i0 = owner[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            free = ~seen[1:]
            better = free & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[came[j0]], came[j0]
    out = [None] * rows
    for j in range(1, columns + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def greedy_assignment(weights: np.ndarray) -> list[int | None]:
    """Rows in order, each with the best column that is left; the first on a tie."""
    used: set[int] = set()
    out: list[int | None] = []
    for row in weights:
        best = next((int(c) for c in np.argsort(-row, kind="stable") if int(c) not in used), None)
        used |= {best} - {None}
        out.append(best)
    return out


def assign(scores: DataFrame, group: Sequence[str], row: str, column: str, weight: str, optimal: bool = True) -> DataFrame:
    """(*group, ``row``, ``column``): one column for each row of a group, so that the
    total weight is greatest, or greedily. Missing pairs weigh 0; rows left over get
    null. A group is the panels and names of one figure and is solved by one task.
    """
    solve = optimal_assignment if optimal else greedy_assignment

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        rows, columns = sorted(pairs[row].unique()), sorted(pairs[column].unique())
        table = np.zeros((len(rows), len(columns)))
        at_r, at_c = {r: i for i, r in enumerate(rows)}, {c: i for i, c in enumerate(columns)}
        for r, c, w in pairs[[row, column, weight]].itertuples(index=False):
            table[at_r[r], at_c[c]] = w
        chosen = solve(table)
        first = pairs.iloc[0]
        return pd.DataFrame([{**{g: first[g] for g in group}, row: r, column: None if c is None else columns[c]} for r, c in zip(rows, chosen)])

    wanted = StructType([StructField(c, scores.schema[c].dataType, True) for c in (*group, row, column)])
    return scores.select(*group, row, column, weight).groupBy(*group).applyInPandas(run, wanted)


class TwoTower:
    """A panel-to-item scorer: linear, GELU, layer norm, linear on either side, then dot products."""

    def __init__(self, left: dict[str, np.ndarray], right: dict[str, np.ndarray]):
        self.left, self.right = left, right

    @staticmethod
    def encode(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
        h = x @ w["w1"] + w["b1"]
        h = 0.5 * h * (1 + np.vectorize(__import__("math").erf)(h / np.sqrt(2.0)))
        h = (h - h.mean(-1, keepdims=True)) / np.sqrt(h.var(-1, keepdims=True) + 1e-5) * w["g"] + w["b"]
        return h @ w["w2"] + w["b2"]

    def logits(self, panels: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Dot products of every panel with every item of a figure."""
        return self.encode(panels, self.left) @ self.encode(items, self.right).T

    def match(self, panels: np.ndarray, labels: np.ndarray, species: np.ndarray, right_species: dict[str, np.ndarray] | None = None) -> tuple[list[int | None], list[int | None], list[float]]:
        """Of a figure's panels the label and the species that each is assigned, and the mean of the
        two greatest probabilities as its confidence. No label or no species counts as one of zeros."""

        def softmax(z: np.ndarray) -> np.ndarray:
            e = np.exp(z - z.max(-1, keepdims=True))
            return e / e.sum(-1, keepdims=True)

        left = self.encode(panels, self.left)
        chances = []
        for items, tower in ((labels, self.right), (species, right_species or self.right)):
            chances.append(softmax(left @ self.encode(items if len(items) else np.zeros((1, panels.shape[1])), tower).T))
        found = [optimal_assignment(c) if len(items) else [None] * len(panels) for c, items in zip(chances, (labels, species))]
        return found[0], found[1], [float((a.max() + b.max()) * 0.5) for a, b in zip(*chances)]


def neural_matches(panels: DataFrame, tokens: DataFrame, labels: DataFrame, taxa: DataFrame, tower: TwoTower, species_tower: dict[str, np.ndarray] | None, width: Column, height: Column) -> DataFrame:
    """(*FIGURE, panel_index, label, species, neural_confidence): every panel matched by a trained two-tower scorer.

    ``panels``, ``labels`` and ``taxa`` as for :func:`match_panels`. A figure without label
    tokens is matched with its ``labels``, each a token of confidence 0.5 at the corner;
    one without labels and names has nulls and the confidence 0. The features are made
    in the JVM and gathered per figure, whose few panels one task scores and assigns.
    """
    listed = numbered(label_tokens(tokens), FIGURE, ("pos", "token_id"), "label_index").select(*FIGURE, "token_id", "label_index", "text")
    read = listed.join(tokens.select("token_id", "bbox", "confidence"), "token_id")
    corner = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    stated = labels.join(read.select(*FIGURE).distinct(), list(FIGURE), "left_anti").select(*FIGURE, F.col("panel_index").alias("label_index"), F.col("label").alias("text"), corner.alias("bbox"), F.lit(0.5).alias("confidence"))
    both = read.select(*FIGURE, "label_index", "text", F.struct(*[F.col(f"bbox.{c}").alias(c) for c in "xywh"]).alias("bbox"), "confidence").unionByName(stated)

    def gathered(items: DataFrame, at: str, text: Column, features: Column, as_: str) -> DataFrame:
        return items.groupBy(*FIGURE).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), text.alias("t"), features.alias("f")))).alias(as_))

    p = gathered(panels, "panel_index", F.lit(""), panel_features(width, height), "p")
    t = gathered(both, "label_index", F.col("text"), label_features(width, height), "t")
    n = gathered(taxa, "panel_index", F.col("species"), species_features(F.col("species"), F.col("panel_index")), "n")
    rows = p.join(t, list(FIGURE), "left").join(n, list(FIGURE), "left")

    def run(batches):
        for batch in batches:
            out = []
            for paper, figure, ps, ts, ns in batch[[*FIGURE, "p", "t", "n"]].itertuples(index=False):
                ts, ns = [() if x is None else x for x in (ts, ns)]
                a, b, c = (np.array([list(x["f"]) for x in items], dtype=float).reshape(-1, 12) for items in (ps, ts, ns))
                if len(b) or len(c):
                    found = tower.match(a, b, c, species_tower)
                else:
                    found = [None] * len(a), [None] * len(a), [0.0] * len(a)
                for item, label, name, sure in zip(ps, *found):
                    out.append((paper, figure, item["i"], None if label is None else ts[label]["t"].strip(), None if name is None else ns[name]["t"], sure))
            yield pd.DataFrame(out, columns=[*FIGURE, "panel_index", "label", "species", "neural_confidence"]).astype({"panel_index": "Int32"})

    return rows.mapInPandas(run, "paper_id string, figure_id string, panel_index int, label string, species string, neural_confidence double")
