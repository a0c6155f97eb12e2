"""Problem 6: nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.operators.nesting import flatten_array, flatten_json, flatten_xml, table_named, table_of
from platewright.sources.tables import load

JSON_LISTS = ("geology_links", "sources", "quotes")
XML_NAMES = ("div", "figure", "p")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return flatten_array(load(spark, d, "captions"), "caption_id", "entities", "entities").withColumn("tbl", F.lit("captions"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return flatten_json(load(spark, d, "match_results"), "match_id", "metadata", JSON_LISTS).withColumn("tbl", F.lit("match_results"))


def _body(spark: SparkSession, d: str) -> DataFrame:
    return flatten_xml(load(spark, d, "grobid_results"), "grobid_id", "tei_xml", "body", XML_NAMES).withColumn("tbl", F.lit("grobid_results"))


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every object of the three tables with its Dewey label and its parent's."""
    return _entities(spark, d).unionByName(_links(spark, d)).unionByName(_body(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, path) of every object."""
    return p6_nodes(spark, d).select("tbl", "row_id", "path")


def p6_geology_links(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of geology links."""
    links = table_of(_links(spark, d), "geology_links")
    return links.select("row_id", "dewey", *[F.col("attributes")[k].alias(k) for k in ("age", "formation", "locality")], F.col("attributes")["confidence"].try_cast("double").alias("confidence"))


def _fields(table: DataFrame, *names: str) -> DataFrame:
    """Rows with the key of their parent row and the named attributes."""
    return table.select("row_id", "dewey", "parent", "ordinals", *[F.col("attributes")[n].alias(n) for n in names])


def p6_sources(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the links' sources: parent is the link's label."""
    return _fields(table_of(_links(spark, d), "geology_links/sources"), "section_id", "title")


def p6_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the sources' quotes: parent is the source's label."""
    return _fields(table_of(_links(spark, d), "geology_links/sources/quotes"), "from", "to")


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of captions' entities; the parent is the caption itself (row_id)."""
    return _fields(table_of(_entities(spark, d), "entities"), "text", "span_start", "span_end", "label", "score")


def p6_sections(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of sections (div): parent is the enclosing section's label."""
    return _fields(table_named(_body(spark, d), "div"), "type")


def p6_figures(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of figures: parent is the enclosing section's label."""
    return _fields(table_named(_body(spark, d), "figure"), "id")


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of paragraphs with their text: parent is the enclosing section's or figure's label."""
    return table_named(_body(spark, d), "p").select("row_id", "dewey", "parent", "ordinals", F.col("content").alias("text"))


QUERIES = {
    "p6_found": p6_found, "p6_nodes": p6_nodes, "p6_geology_links": p6_geology_links, "p6_sources": p6_sources, "p6_quotes": p6_quotes, "p6_entities": p6_entities, "p6_sections": p6_sections,
    "p6_figures": p6_figures, "p6_paragraphs": p6_paragraphs,
}
_ENTITY = "SELECT caption_id AS row_id, unnest(list_filter(entities, lambda e: e IS NOT NULL)) AS e, unnest(range(1, len(list_filter(entities, lambda e: e IS NOT NULL)) + 1)) AS k FROM captions"
ORACLE: dict[str, str] = {
    "p6_entities": f"SELECT row_id, CAST(k AS VARCHAR) AS dewey, CAST(NULL AS VARCHAR) AS parent, [CAST(k AS INTEGER)] AS ordinals, e.text, CAST(e.span_start AS VARCHAR) AS span_start, CAST(e.span_end AS VARCHAR) AS span_end, e.label, CAST(e.score AS VARCHAR) AS score FROM ({_ENTITY})",
}
