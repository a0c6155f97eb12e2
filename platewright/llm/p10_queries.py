"""Problem 10: the reading level of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm.readability import reading_levels
from platewright.sources.tables import load


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, band) of the documents that can be judged."""
    return reading_levels(load(spark, d, "documents")).where("band is not null").select("doc_id", "band")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every document with what its level rests on."""
    return reading_levels(load(spark, d, "documents"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """How many documents and words of each language are at each level."""
    return reading_levels(load(spark, d, "documents")).groupBy("detected", "band").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels, "p10_profile": p10_profile}
ORACLE: dict[str, str] = {}
