"""From a paper's captions, pages, boxes and tokens to its matches, and the route of papers without captions.

Both are plans over tables: every paper goes through the same joins, keyed by paper
and figure, and nothing is done paper by paper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import patterns as P
from platewright.functions.text import all_matches, auto_figure_id, panel_file, region_id
from platewright.operators import association as A
from platewright.operators import entities as E
from platewright.operators import geology as G
from platewright.operators import pages as PG
from platewright.plans.lineage import cut

FIG = list(A.FIGURE)


def ordered_links(species: DataFrame, sections: DataFrame, records: DataFrame, order: Sequence[str], id_col: str = "geology_id", keep: int = P.LINKS_KEPT) -> DataFrame:
    """(paper_id, species, links): the first ``keep`` records that each name is linked to, see
    :func:`platewright.operators.geology.link_records`, by the section that names it, then ``order``."""
    cols = ["section_title", "age", "formation", "locality", "confidence", *order]
    found = G.species_sections(species, sections, id_col).join(sections.select("paper_id", id_col, "section_title"), ["paper_id", id_col])
    n, r = found.withColumnRenamed(id_col, "_at").alias("n"), records.alias("r")
    on = (F.col("n.paper_id") == F.col("r.paper_id")) & F.col("n.section_title").eqNullSafe(F.col("r.section_title"))
    linked = n.join(r, on).select("n.paper_id", "n.species", "n._at", *[f"r.{c}" for c in cols])
    rank = F.row_number().over(Window.partitionBy("paper_id", "species").orderBy("_at", *order))
    first = records.groupBy("paper_id").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_f")).select("paper_id", *[F.col(f"_f.{c}") for c in cols])
    lone = species.join(linked.select("paper_id", "species").distinct(), ["paper_id", "species"], "left_anti").join(first, "paper_id").withColumn("rank", F.lit(1))
    top = linked.withColumn("rank", rank).where(F.col("rank") <= keep).drop("_at").unionByName(lone)
    return top.groupBy("paper_id", "species").agg(F.array_sort(F.collect_list(F.struct("rank", *cols))).alias("links"))


def linked_matches(matches: DataFrame, species: DataFrame, links: DataFrame) -> DataFrame:
    """``matches`` with links: those of a row's species, without any those of its paper's first name, else none."""
    first = species.groupBy("paper_id").agg(F.min("species").alias("species")).join(links, ["paper_id", "species"], "left").select("paper_id", F.col("links").alias("_first"))
    both = matches.join(links, ["paper_id", "species"], "left").join(first, "paper_id", "left")
    return both.withColumn("links", F.coalesce("links", "_first", F.slice("_first", F.lit(1), F.lit(0)))).drop("_first")


def with_whole_pages(pages: DataFrame, regions: DataFrame, width: Column, height: Column) -> DataFrame:
    """(paper_id, page_index, x, y, w, h, score, region_id): ``regions``, and each page as a whole that has none."""
    cols = ["paper_id", "page_index", "x", "y", "w", "h", "score"]
    named = regions.select(*cols, region_id(F.col("page_index"), *[F.col(c) for c in "xywh"]).alias("region_id"))
    bare = pages.select("paper_id", "page_index").distinct().join(regions.select("paper_id", "page_index").distinct(), ["paper_id", "page_index"], "left_anti")
    zero = F.lit(0)
    whole = bare.select(
        "paper_id", "page_index", zero.alias("x"), zero.alias("y"), width.cast("int").alias("w"), height.cast("int").alias("h"), F.lit(P.SCORE_WHOLE_PAGE).alias("score"),
        F.format_string("p%03d_fullpage", "page_index").alias("region_id"),
    )
    return named.unionByName(whole)


def chosen_regions(figures: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(paper_id, figure_id, best_page, region_*): each figure's page and the best region of that page and those beside it.

    ``figures`` have figure_number; a figure without one goes to its paper's first page. One without a page has no row.
    """
    best = PG.best_pages(figures, pages)
    first = pages.groupBy("paper_id").agg(F.min("page_index").alias("first"))
    placed = figures.select(*FIG, "figure_number").join(first, "paper_id").join(best, ["paper_id", "figure_number"], "left").select(*FIG, F.coalesce("page_index", "first").alias("best_page"))
    around = placed.withColumn("page_index", F.explode(F.sequence(F.col("best_page") - 1, F.col("best_page") + 1)))
    met = around.join(regions, ["paper_id", "page_index"])
    order = F.struct((-F.col("score")).alias("s"), F.col("page_index").alias("page"), "y", "x", "w", "h", "region_id", "best_page")
    return met.groupBy(*FIG).agg(F.min(order).alias("_r")).select(
        *FIG, "_r.best_page", F.col("_r.page").alias("region_page"), F.col("_r.region_id").alias("region_id"), F.col("_r.w").alias("region_w"), F.col("_r.h").alias("region_h")
    )


def with_whole_regions(panels: DataFrame, chosen: DataFrame) -> DataFrame:
    """``panels``, and for each figure of ``chosen`` without any its region as one panel of low score."""
    bare = chosen.join(panels.select(*FIG).distinct(), FIG, "left_anti")
    zero = F.lit(0)
    whole = bare.select(*FIG, zero.alias("panel_index"), zero.alias("x"), zero.alias("y"), F.col("region_w").alias("w"), F.col("region_h").alias("h"), F.lit(P.CONF_WHOLE_REGION).alias("score"))
    return panels.select(*FIG, "panel_index", "x", "y", "w", "h", "score").unionByName(whole)


def match_papers(figures: DataFrame, pages: DataFrame, regions: DataFrame, panels: DataFrame, labels: DataFrame, taxa: DataFrame, tokens: DataFrame, scales: DataFrame, species: DataFrame, links: DataFrame) -> DataFrame:
    """Every panel of every captioned figure, with page, region, label, name, text, scale and links: the whole way of a paper.

    figures: (paper_id, figure_id, figure_number, caption); pages: (paper_id, page_index,
    text); regions as of :func:`with_whole_pages`; panels, labels, taxa and tokens as of
    :func:`platewright.operators.association.match_panels`; scales: (paper_id, figure_id,
    value, unit, source); species and links as of :func:`ordered_links`. Figures without
    a page give nothing, figures without panels their region as one.
    """
    # A row per figure that four joins need: written once instead of planned four times.
    chosen = cut(chosen_regions(figures, pages, regions))
    placed = figures.join(chosen.select(*FIG), FIG, "left_semi")
    panels = with_whole_regions(panels.join(chosen.select(*FIG), FIG, "left_semi"), chosen)
    rows = A.match_panels(placed, panels, labels, taxa, tokens).where("panel_index is not null").join(chosen, FIG)
    rows = rows.join(scales.select(*FIG, F.col("value").alias("scale_value"), F.col("unit").alias("scale_unit")), FIG, "left")
    links = cut(links)
    filed = rows.withColumn("panel_file", panel_file(F.col("paper_id"), F.col("figure_id"), F.col("panel_index") + 1))
    return linked_matches(filed, species, links)


def manifest(matches: DataFrame, figures: DataFrame) -> DataFrame:
    """One record per figure: what was found of it, its panels and matches nested, as a manifest file has it.

    A figure's panels are few; they are gathered in one row.
    """
    one = F.struct("panel_index", "panel_id", "species", "label_text", "x", "y", "w", "h", "confidence", "ocr_text", "panel_file")
    per = matches.groupBy(*FIG, F.col("best_page").alias("page_index"), "region_id", "region_page", "scale_value", "scale_unit").agg(F.array_sort(F.collect_list(one)).alias("matches"), F.count(F.lit(1)).alias("n_matches"))
    return per.join(figures.select(*FIG, "caption", "figure_number"), FIG)


def entities_in_order(texts: DataFrame, ids: Sequence[str], text: str, lexicon: DataFrame, name_col: str) -> DataFrame:
    """(*ids, pos, species): the names that the rule pattern and the list find in each text, repeats at other places too, by place.

    ``ids`` is one column. A match is placed at the first occurrence after the match before it.
    """
    found = texts.select(*ids, F.col(text).alias("_t"), all_matches(F.col(text), P.TAXON_RULE).alias("_m"))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = F.call_function("locate", m, F.col("_t"), acc["at"])
        return F.struct((start + F.length(m)).alias("at"), F.array_append(acc["out"], F.struct((start - 1).alias("start"), m.alias("text"))).alias("out"))

    placed = found.select(*ids, F.explode(F.aggregate("_m", zero, step)["out"]).alias("e")).select(*ids, "e.start", "e.text", F.lit(P.SCORE_RULE).alias("score"))
    listed = E.lexicon_matches(texts, ids[0], text, lexicon, name_col).select(*ids, "start", F.col("name").alias("text"), F.lit(P.SCORE_LEXICON).alias("score"))
    both = placed.unionByName(listed).withColumn("end", F.col("start") + F.length("text"))
    return E.in_order(E.merge_entities(both, ids, ["text"]), ids).select(*ids, "pos", F.col("text").alias("species"))


def match_uncaptioned(regions: DataFrame, panels: DataFrame, tokens: DataFrame, lexicon: DataFrame, name_col: str) -> DataFrame:
    """The matches of papers without captions: every region of every page is a figure with an id and a caption made for it.

    regions: (paper_id, page_index, region, x, y, w, h), where region names it; panels:
    (paper_id, region, panel_index, x, y, w, h, score); tokens: (paper_id, region,
    token_id, pos, text, confidence, bbox). Regions of a page are numbered by row and
    column. Names come from the recognised text, else from the made caption.
    """
    number = F.row_number().over(Window.partitionBy("paper_id", "page_index").orderBy("y", "x", "region"))
    figures = regions.withColumn("figure_id", auto_figure_id(F.col("page_index"), number)).withColumn("caption", F.concat(F.lit("Auto-generated figure for page "), F.col("page_index").cast("string")))
    ids = figures.select("paper_id", "region", "figure_id")
    boxes = panels.join(ids, ["paper_id", "region"]).drop("region")
    whole = figures.select(*FIG, F.col("w").alias("region_w"), F.col("h").alias("region_h"))
    boxes = with_whole_regions(boxes, whole)
    said = tokens.join(ids, ["paper_id", "region"]).drop("region")
    block = said.groupBy(*FIG).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    texts = block.select(F.concat_ws("\t", *FIG).alias("_key"), *FIG, F.array_join("t.text", " ").alias("_text"))
    named = entities_in_order(texts, ["_key"], "_text", lexicon, name_col)
    taxa = named.join(texts.select("_key", *FIG), "_key").select(*FIG, F.col("pos").alias("panel_index"), "species")
    labels = E.labels_of(figures, FIG, F.col("caption")).withColumnRenamed("pos", "panel_index")
    rows = A.match_panels(figures.select(*FIG, "caption"), boxes, labels, A.taxa_or_found(figures, taxa, F.col("caption")), said)
    return rows.withColumns({"panel_file": panel_file(F.col("paper_id"), F.col("figure_id"), F.col("panel_index") + 1), "fallback_reason": F.lit("missing captions")})
