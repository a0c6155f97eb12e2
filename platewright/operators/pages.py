"""Which page of a paper a caption belongs to, and the pages around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import patterns as P


def mentions(text: Column, number: Column) -> Column:
    """Whether a page's text refers to a figure or plate of that number; for one pair, :func:`mentioned` finds them all."""
    return F.rlike(text, F.concat(F.lit(P.unicode_aware(P.FIGURE_REFERENCE) + r"\Q"), number, F.lit(r"\E" + P.unicode_aware(r"\b"))))


def mentioned(figures: DataFrame, pages: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, figure_number, page_index), distinct: the pages that refer to a figure or plate of that number, in any case.

    Every page is read once: after each word for a figure stands a text whose
    beginnings, of each length that a number has, are joined with the numbers. Work
    grows with the pages' references, not with pages times figures, and a large
    paper's rows are spread by their numbers. Null and empty numbers refer to nothing.
    """
    numbers = figures.select(paper, "figure_number").where("figure_number <> ''").distinct().withColumn("_key", F.lower("figure_number"))
    lengths = sorted(r[0] for r in numbers.select(F.length("figure_number")).distinct().collect())  # a row per length of a number
    if not lengths:
        return numbers.select(paper, "figure_number", F.lit(None).cast("int").alias("page_index")).limit(0)
    after = rf"(?s){P.unicode_aware(P.FIGURE_REFERENCE)}(?=(.{{1,{lengths[-1] + 1}}}))"
    rests = pages.select(paper, "page_index", F.explode(F.regexp_extract_all("text", F.lit(after), F.lit(1))).alias("_rest")).distinct()
    cut_at = rests.select(paper, "page_index", "_rest", F.explode(F.array(*map(F.lit, lengths))).alias("_n")).where(F.length("_rest") >= F.col("_n"))
    word = P.unicode_aware(r"\w")
    last, then = F.expr("substring(_rest, _n, 1)").rlike(word), F.expr("substring(_rest, _n + 1, 1)").rlike(word)
    keys = cut_at.where(last != then).select(paper, "page_index", F.lower(F.expr("substring(_rest, 1, _n)")).alias("_key")).distinct()
    return numbers.join(keys, [paper, "_key"]).select(paper, "figure_number", "page_index").distinct()


def best_pages(figures: DataFrame, pages: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, figure_number, page_index): the first page that mentions the figure, else the paper's first."""
    f = figures.select(paper, "figure_number").where("figure_number is not null").distinct()
    first_hit = mentioned(figures, pages, paper).groupBy(paper, "figure_number").agg(F.min("page_index").alias("hit"))
    first = pages.groupBy(paper).agg(F.min("page_index").alias("first"))
    return f.join(first, paper).join(first_hit, [paper, "figure_number"], "left").select(paper, "figure_number", F.coalesce("hit", "first").alias("page_index"))


def candidate_pages(figures: DataFrame, pages: DataFrame, window: int = P.CAPTION_WINDOW, paper: str = "paper_id") -> DataFrame:
    """(paper, figure_number, page_index): all pages that mention a figure, else the paper's first ``window`` + 1."""
    f = figures.select(paper, "figure_number").where("figure_number is not null").distinct()
    hits = mentioned(figures, pages, paper)
    rank = F.row_number().over(Window.partitionBy(paper).orderBy("page_index"))
    leading = pages.select(paper, "page_index").distinct().withColumn("_r", rank).where(F.col("_r") <= window + 1).drop("_r")
    return hits.unionByName(f.join(hits.select(paper, "figure_number").distinct(), [paper, "figure_number"], "left_anti").join(leading, paper).select(paper, "figure_number", "page_index"))


def neighbours(best: DataFrame, pages: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, figure_number, page_index): the chosen page with the ones before and after it."""
    around = best.select(paper, "figure_number", F.explode(F.sequence(F.col("page_index") - 1, F.col("page_index") + 1)).alias("page_index"))
    return around.join(pages.select(paper, "page_index"), [paper, "page_index"], "left_semi").select(paper, "figure_number", "page_index")


def sparsest_page(pages: DataFrame, density: str, paper: str = "paper_id") -> DataFrame:
    """(paper, page_index): the page with the least text, the first on a tie."""
    return pages.groupBy(paper).agg(F.min(F.struct(F.col(density), F.col("page_index"))).alias("_m")).select(paper, "_m.page_index")
