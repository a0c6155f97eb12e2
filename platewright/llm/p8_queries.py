"""Problem 8: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewright.llm.bpe import encode_corpus
from platewright.sources.tables import load


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k, without special tokens."""
    return encode_corpus(load(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
