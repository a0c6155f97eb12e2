"""Problem 3: species names mapped to the reference list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm.canonical_names import map_names
from platewright.sources.tables import load

SOURCES = (("match_results", "match_id", "species"), ("corrections", "correction_id", "corrected_species"), ("taxa", "taxon_id", "text"))


def p3_names(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, name, name_id, jaccard, distance) of every value that isn't blank."""
    parts = [load(spark, d, t).select(F.lit(t).alias("tbl"), F.col(i).alias("row_id"), F.col(c).alias("name")) for t, i, c in SOURCES]
    rows = reduce(DataFrame.unionByName, parts).where("name is not null")
    return rows.join(map_names(rows, "name", load(spark, d, "species_list")), "name").select("tbl", "row_id", "name", "name_id", "jaccard", "distance")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, name_id) of every value that isn't a canonical name to the letter."""
    exact = load(spark, d, "species_list").select(F.col("canonical_name").alias("name"))
    return p3_names(spark, d).join(exact, "name", "left_anti").select("tbl", "row_id", "name_id")


QUERIES = {"p3_found": p3_found, "p3_names": p3_names}
ORACLE: dict[str, str] = {}
