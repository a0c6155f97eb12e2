"""Answers of language models: parsing, and what they override."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import patterns as P
from platewright.functions.text import first_match

_ANSWER = "label string, species string, confidence string, reasoning string"


def parse_answer(text: Column, null_as_text: bool = False) -> Column:
    """struct(label, species, confidence, reasoning) of the JSON object in an answer.

    The confidence is rounded to two places and kept within 0 and 1, a missing
    reasoning replaced. Null where there is no object. ``null_as_text`` keeps a
    null label or species as the text 'None'.
    """
    found = F.nullif(F.regexp_extract(text, P.JSON_OBJECT, 0), F.lit(""))
    parsed = F.from_json(found, _ANSWER, {"mode": "PERMISSIVE"})

    def said(field: str) -> Column:
        value = F.nullif(F.trim(parsed[field]), F.lit(""))
        if not null_as_text:
            return value
        return F.when(F.get_json_object(found, f"$.{field}").isNull() & found.contains(f'"{field}"'), F.coalesce(value, F.lit("None"))).otherwise(value)

    confidence = F.coalesce(parsed["confidence"].try_cast("double"), F.lit(0.0))
    answer = F.struct(
        said("label").alias("label"), said("species").alias("species"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(confidence, 2))).alias("confidence"),
        F.coalesce(F.nullif(F.trim(parsed["reasoning"]), F.lit("")), F.lit("No reasoning provided.")).alias("reasoning"),
    )
    return F.when(found.isNotNull() & F.get_json_object(found, "$").isNotNull(), answer)


def override(matches: DataFrame, answers: DataFrame, keys: Sequence[str], at: float = P.OVERRIDE_AT, raise_confidence: bool = True) -> DataFrame:
    """``matches`` with the answers that are confident enough put over label and species.

    ``answers`` has the keys and label, species, answer_confidence. llm_used tells
    whether an answer was taken, llm_fallback whether one was too unsure. Exported rows keep their
    confidence (``raise_confidence`` false).
    """
    rows = matches.join(answers.withColumnsRenamed({"label": "_label", "species": "_species"}), list(keys), "left")
    sure = F.coalesce(F.col("answer_confidence") >= at, F.lit(False))

    def over(new: str, old: str) -> Column:
        return F.when(sure, F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))).otherwise(F.col(old))

    changed = {"panel_id": over("_label", "panel_id"), "species": over("_species", "species"), "label_text": over("_label", "label_text"), "llm_used": sure, "llm_fallback": F.coalesce(F.col("answer_confidence") < at, F.lit(False))}
    if raise_confidence:
        changed["confidence"] = F.when(sure, F.greatest("confidence", "answer_confidence")).otherwise(F.col("confidence"))
    return rows.withColumns(changed).drop("_label", "_species")


def best_links(links: DataFrame, group: Sequence[str], order: Sequence[str], least: float = P.LINK_LEAST, keep: int = P.LINKS_KEPT) -> DataFrame:
    """The first ``keep`` links of a group, by ``order``, of those that are confident enough."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return links.where(F.col("confidence") >= least).withColumn("rank", rank).where(F.col("rank") <= keep)


#: What a model is told before it is asked, by language.
SYSTEM_PROMPTS = {
    "en": "You read figures of fossil plates. From the caption, the labels read in the figure and the picture of one panel say which label and which species the panel shows. Answer with one JSON object only.",
    "zh": "你在阅读化石图版。请根据图注、图中识别出的标签和单个面板的图像，判断该面板的标签与物种。只输出一个 JSON 对象。",
}


def system_prompt(language: str = "zh") -> str:
    """What a model is told before it is asked; English for a language that isn't there."""
    return SYSTEM_PROMPTS.get(language, SYSTEM_PROMPTS["en"])


def link_prompt(species: Column, title: Column, kind: Column, text: Column) -> Column:
    """What a model is asked about a species and a section; the section's text is cut at what a prompt takes."""
    known = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit("Species: "), known(species), F.lit("\nSection title: "), known(title), F.lit("\nSection type: "), known(kind), F.lit("\nText: "), F.substring(known(text), 1, P.PROMPT_TEXT),
        F.lit('\nAnswer with one JSON object: label "geo_link", species, confidence from 0 to 1, reasoning as "age=..., formation=..., locality=..."'),
    )


def answered_links(answers: DataFrame, group: Sequence[str], order: Sequence[str], least: float = P.LINK_LEAST, keep: int = P.LINKS_KEPT) -> DataFrame:
    """(*group, *order, rank, section_title, section_type, age, formation, locality, evidence_text, confidence): links from a model's answers.

    ``answers``: the group's columns (paper, species), those that order its sections,
    section_title, section_type, text and answer. Of a group's answers that are sure
    enough the first ``keep`` stand, in the order of the sections, not by confidence;
    age, formation and locality are sought in the answer's reasoning. Sections without
    text and answers without an object link nothing.
    """
    told = answers.where("text <> ''").withColumn("_a", parse_answer(F.col("answer"))).where(F.col("_a.confidence") >= least)
    why = F.col("_a.reasoning")
    place = F.nullif(F.regexp_replace(first_match(why, P.LOCALITY), r"^[ .,;]+|[ .,;]+$", ""), F.lit(""))
    rows = told.select(
        *group, *order, "section_title", "section_type", first_match(why, P.AGE).alias("age"), F.trim(first_match(why, P.FORMATION)).alias("formation"), place.alias("locality"),
        F.substring("text", 1, P.EVIDENCE).alias("evidence_text"), F.col("_a.confidence").alias("confidence"),
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep)


def panel_prompt(caption: Column, labels: Column) -> Column:
    """What a model is asked about one panel."""
    return F.concat(F.lit("Caption: "), F.coalesce(caption, F.lit("")), F.lit("\nLabels read in the figure: "), F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise("none"), F.lit("\nAnswer with one JSON object: label, species, confidence, reasoning."))
