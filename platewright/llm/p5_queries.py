"""Problem 5: consensus of the reviewers of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm.canonical_names import map_names
from platewright.llm.consensus import consensus, latest_votes
from platewright.plans.lineage import cut
from platewright.sources.tables import load


def bare_label(label: Column) -> Column:
    """The capital letter or number of a panel label as somebody wrote it; null where there is none."""
    upper = F.upper(F.regexp_replace(label, r"(?i)^[\s\p{Z}]*(?:panel|fig(?:ure)?\.?|plate)?[\s\p{Z}]*|[\s\p{Z}]+$", ""))
    found = F.regexp_extract(upper, r"^[\[({]*\s*([A-Z]|\d{1,3})\s*[\])}.:,;]*$", 1)
    return F.nullif(found, F.lit(""))


def same_reviewer(code: Column) -> Column:
    """A reviewer's code irrespective of case, blanks and the kind of dash."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(code), r"[\s\p{Z}\p{Cf}]", ""), r"[_\p{Pd}]", "-"), F.lit(""))


def _votes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(votes, given): votes (field, item, annotator, answer) by reviewer's latest row,
    and (field, item, n) how many reviewers gave anything."""
    rows = load(spark, d, "corrections").select("correction_id", "panel_path", "corrected_species", "corrected_label", same_reviewer(F.col("reviewer")).alias("reviewer"), "submitted_at")
    latest = cut(latest_votes(rows, "panel_path", "reviewer", ["corrected_label", "corrected_species"], "submitted_at", "correction_id"))
    entries = load(spark, d, "species_list").select("name_id", "canonical_name")
    names = map_names(latest, "corrected_species", load(spark, d, "species_list")).join(entries, "name_id", "left").select("corrected_species", F.col("canonical_name"))
    labels = latest.select(F.lit("label").alias("field"), "item", "annotator", bare_label(F.col("corrected_label")).alias("answer"), F.col("corrected_label").alias("_raw"))
    species = latest.join(names, "corrected_species", "left").select(F.lit("species").alias("field"), "item", "annotator", F.col("canonical_name").alias("answer"), F.col("corrected_species").alias("_raw"))
    both = cut(labels.unionByName(species).where("_raw is not null and trim(_raw) <> ''"))
    return both.drop("_raw"), both.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(panel_path, field, answer) where at least three reviewers gave a value."""
    votes, given = _votes(spark, d)
    answers, _ = consensus(votes)
    return answers.join(given.where("n >= 3"), ["field", "item"], "left_semi").select(F.col("item").alias("panel_path"), "field", "answer")


def p5_panels(spark: SparkSession, d: str) -> DataFrame:
    """Every panel's answers with their probability and the reviewers' agreement."""
    return consensus(_votes(spark, d)[0])[0].withColumnRenamed("item", "panel_path")


def p5_reviewers(spark: SparkSession, d: str) -> DataFrame:
    """How reliable each reviewer is."""
    return consensus(_votes(spark, d)[0])[1].withColumnRenamed("annotator", "reviewer")


QUERIES = {"p5_found": p5_found, "p5_panels": p5_panels, "p5_reviewers": p5_reviewers}
ORACLE: dict[str, str] = {}
