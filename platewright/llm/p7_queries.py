"""Problem 7: visually identical text with different characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm.textform import canonical_form, comparison_key, not_ascii
from platewright.sources.tables import load

SOURCES = (("captions", "caption_id", "caption"), ("match_results", "match_id", "species"), ("geology", "geology_id", "locality"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [load(spark, d, t).select(F.lit(t).alias("tbl"), F.col(i).alias("row_id"), F.col(c).alias("text")) for t, i, c in SOURCES]
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id) of the texts that their consistent form differs from."""
    odd = _texts(spark, d).where(not_ascii(F.col("text")))
    return odd.where(canonical_form(F.col("text")) != F.col("text")).select("tbl", "row_id")


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its consistent form and its comparison key."""
    return _texts(spark, d).select("tbl", "row_id", canonical_form(F.col("text")).alias("form"), comparison_key(F.col("text")).alias("key"))


QUERIES = {"p7_found": p7_found, "p7_forms": p7_forms}
ORACLE: dict[str, str] = {}
