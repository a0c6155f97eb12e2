"""Problem 9: documents in containers of fixed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm.bpe import encode_corpus
from platewright.llm.packing import pack
from platewright.plans.lineage import cut
from platewright.sources.tables import load


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container for every capacity of ``context_sizes``."""
    sizes = cut(encode_corpus(load(spark, d, "documents"), "doc_id", "text", counts_only=True))
    return pack(sizes, "doc_id", "n_tokens", load(spark, d, "context_sizes"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    used = p9_pack(spark, d).where("container is not null").groupBy("size_name", "capacity")
    return used.agg(F.sum("piece_size").alias("tokens"), F.countDistinct("container").alias("containers")).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4))


QUERIES = {"p9_pack": p9_pack, "p9_fill": p9_fill}
ORACLE: dict[str, str] = {}
