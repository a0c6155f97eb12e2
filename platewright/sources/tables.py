"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``, a single file or a folder of part files.

    Columns are pruned and filters pushed down by Catalyst, so callers select
    what they need and never read by hand.
    """
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
