"""Geological records, their links to species and the knowledge graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import patterns as P
from platewright.functions.text import all_matches, first_match


def records_of(sections: DataFrame, keep: Sequence[str], text: Column) -> DataFrame:
    """Rule records of sections: each age (or one null) with the first formation and
    the first locality; sections with none of the three give nothing."""
    formation = first_match(text, P.FORMATION)
    locality = F.nullif(F.regexp_replace(first_match(text, P.LOCALITY), r"^[ .,;]+|[ .,;]+$", ""), F.lit(""))
    rows = sections.select(
        *keep, F.posexplode_outer(all_matches(text, P.AGE)).alias("age_pos", "age"), F.trim(formation).alias("formation"), locality.alias("locality"),
        F.substring(text, 1, P.EVIDENCE).alias("evidence_text"), F.lit(P.CONF_GEOLOGY_RULE).alias("confidence"),
    )
    return rows.where("age is not null or formation is not null or locality is not null")


def dedup_records(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of records that agree on ``keys`` (nulls agree) the most confident, the first on a tie."""
    same = Window.partitionBy(*keys).orderBy(F.desc("confidence"), *order)
    return records.withColumn("_rank", F.row_number().over(same)).where("_rank = 1").drop("_rank")


def species_sections(species: DataFrame, sections: DataFrame, id_col: str, paper: str = "paper_id") -> DataFrame:
    """(paper, species, ``id_col``), distinct: species (paper, species) with the sections of
    their paper whose text holds them, in any case, at any place.

    ``id_col`` identifies a section. A name is sought where its first white space is:
    the two characters before it, the white space and the two after are the key, with
    the paper, by which names meet the places of the texts that may hold them; only
    there is the text compared. Work grows with the texts and with what such places
    share, not with names times sections. Names without white space between two
    characters on either side are compared with all of their paper's sections.
    """
    at = P.unicode_aware(r"[^\s]{2}\s+[^\s]{2}")
    names = species.select(paper, "species", F.lower("species").alias("_low")).where("species <> ''").distinct().withColumn("_key", F.regexp_extract("_low", at, 0))
    texts = sections.select(paper, id_col, F.lower("text").alias("_text")).where("text is not null")
    places = texts.select(paper, id_col, F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(f"(?=({at}))"), F.lit(1)))).alias("_key"))
    near = names.where("_key <> ''").join(places, [paper, "_key"]).select(paper, "species", "_low", id_col)
    lone = names.where("_key = ''").join(texts.select(paper, id_col), paper).select(paper, "species", "_low", id_col)
    return near.unionByName(lone).join(texts, [paper, id_col]).where(F.contains("_text", "_low")).select(paper, "species", id_col).distinct()


def link_records(species: DataFrame, sections: DataFrame, records: DataFrame, order: Sequence[str], id_col: str = "geology_id", paper: str = "paper_id") -> DataFrame:
    """(paper, species, section_title, age, formation, locality, confidence, *order): names linked to rule records.

    ``species``: (paper, species), distinct. ``records``: (paper, section_title, age, formation, locality, confidence, *order),
    deduplicated per paper. A name is linked to the records that bear the title of a section of its paper that names
    it, once per such section (null titles agree); a name without any to the paper's first record by ``order``.
    """
    cols = ["section_title", "age", "formation", "locality", "confidence", *order]
    found = species_sections(species, sections, id_col, paper).join(sections.select(paper, id_col, "section_title"), [paper, id_col])
    named = found.groupBy(paper, "species", "section_title").agg(F.count(F.lit(1)).alias("_times"))
    n, r = named.alias("n"), records.alias("r")
    on = (F.col(f"n.{paper}") == F.col(f"r.{paper}")) & F.col("n.section_title").eqNullSafe(F.col("r.section_title"))
    linked = n.join(r, on).select(f"n.{paper}", "n.species", *[f"r.{c}" for c in cols], F.explode(F.array_repeat(F.lit(0), F.col("n._times").cast("int"))).alias("_again")).drop("_again")
    first = records.groupBy(paper).agg(F.min(F.struct(*order, *[c for c in cols if c not in order])).alias("_f")).select(paper, *[F.col(f"_f.{c}") for c in cols])
    lone = species.select(paper, "species").join(linked.select(paper, "species").distinct(), [paper, "species"], "left_anti").join(first, paper)
    return linked.unionByName(lone)


def graph_nodes(links: DataFrame) -> DataFrame:
    """(id, type, name) of links (species, age, formation, locality): distinct, empty ones left out."""
    kinds = ("species", "age", "formation", "locality")
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("name")) for k in kinds]))
    return links.select(named.alias("n")).select(F.concat("n.type", F.lit(":"), "n.name").alias("id"), "n.type", "n.name").where("name is not null and name <> ''").distinct()


def graph_edges(links: DataFrame) -> DataFrame:
    """(source, target, relation, confidence): an edge per link and non-empty field; repeats stay."""
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f"has_{k}").alias("relation"), F.col(k).alias("name")) for k in ("age", "formation", "locality")]))
    rows = links.where("species is not null and species <> ''").select("species", "confidence", ends.alias("e")).where("e.name is not null and e.name <> ''")
    return rows.select(F.concat(F.lit("species:"), "species").alias("source"), F.concat("e.kind", F.lit(":"), "e.name").alias("target"), "e.relation", "confidence")
