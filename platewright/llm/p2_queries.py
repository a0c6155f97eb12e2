"""Problem 2: noise in text from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewright.llm.scan_repair import learn, repair_texts, repair_tokens
from platewright.sources.tables import load


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, text, names, following, around) of captions and sections."""
    nothing = F.lit(None).cast("string")
    captions = load(spark, d, "captions").select(
        F.lit("captions").alias("tbl"), F.col("caption_id").alias("row_id"), F.col("caption").alias("text"), F.array_join("entities.text", " ; ").alias("names"), nothing.alias("following"), nothing.alias("around")
    )
    geology = load(spark, d, "geology").select(F.lit("geology").alias("tbl"), F.col("geology_id").alias("row_id"), F.col("evidence_text").alias("text"), nothing.alias("names"), nothing.alias("following"), nothing.alias("around"))
    return captions.unionByName(geology)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, text, names, following, around) of tokens."""
    nothing = F.lit(None).cast("string")
    # The rest of a broken word is the next token of the figure, what looks like furniture left aside.
    word = ~F.col("text").rlike(r"^\s*$|^\W*\d+\W*$|\s|^[A-Z0-9]{5,}$")
    near = Window.partitionBy("paper_id", "figure_id").orderBy("pos").rangeBetween(1, 3)
    after = F.min(F.when(word, F.struct("pos", "token_id", "text"))).over(near)
    order = Window.partitionBy("paper_id", "figure_id").orderBy("pos", "token_id")
    around = F.concat_ws(" ", *[F.lag("text", n).over(order) for n in (2, 1, -1, -2)])
    tokens = load(spark, d, "ocr_tokens").select("token_id", "paper_id", "figure_id", "pos", "text").withColumn("around", around)
    return tokens.select(F.lit("ocr_tokens").alias("tbl"), F.col("token_id").alias("row_id"), "text", nothing.alias("names"), F.coalesce(after["text"], F.lit("")).alias("following"), "around")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the three tables."""
    return _texts(spark, d).unionByName(_tokens(spark, d))


def _lexicon(spark: SparkSession, d: str):
    captions = load(spark, d, "captions").select(F.col("caption").alias("text"), F.array_join("entities.text", " ; ").alias("names"))
    geology = load(spark, d, "geology").select(F.col("evidence_text").alias("text"), F.lit(None).cast("string").alias("names"))
    tokens = load(spark, d, "ocr_tokens").select("text", F.lit(None).cast("string").alias("names"))
    species = load(spark, d, "species_list").select(F.explode(F.concat(F.array("canonical_name"), "synonyms")).alias("name"))  # the reference list, fixed
    return learn(captions.unionByName(geology).unionByName(tokens), [r["name"] for r in species.collect()])


def _repaired(spark: SparkSession, d: str, damage_only: bool) -> DataFrame:
    lexicon = _lexicon(spark, d)
    return repair_texts(_texts(spark, d), lexicon, damage_only).unionByName(repair_tokens(_tokens(spark, d), lexicon, damage_only))


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text made readable, with the kinds of damage that it had."""
    return _repaired(spark, d, damage_only=False)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, kind) of the rows that were damaged, one row per kind."""
    return _repaired(spark, d, damage_only=True).select("tbl", "row_id", F.explode("kinds").alias("kind"))


QUERIES = {"p2_found": p2_found, "p2_texts": p2_texts}
ORACLE: dict[str, str] = {}
