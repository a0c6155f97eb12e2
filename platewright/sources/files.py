"""Files as tables: documents, pages, JSON lines, lexica, configurations."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from platewright.functions.text import path_id


def scan_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, path, length, content) of a folder's PDF files, in no order; not below subfolders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select(path_id(F.col("path")).alias("paper_id"), "path", "length", "content")


def watch_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream: files that are dropped into the folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select(path_id(F.col("path")).alias("paper_id"), "path", "length", "content")


def with_job_ids(uploads: DataFrame) -> DataFrame:
    """``uploads`` with job_id: a random id for each, another on every reading. Write them once before anything refers to them."""
    return uploads.withColumn("job_id", F.expr("uuid()"))


def is_pdf(name):
    """Whether an uploaded file's name is that of a PDF."""
    return F.lower(name).endswith(".pdf")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, missing_ok: bool = False) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, a missing file is empty where that is allowed."""
    if missing_ok and "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


#: One figure of the matcher's training set: features of panels, labels and names, and which of them belong together.
MATCHER_TRAINING = (
    "panel_features array<array<double>>, label_features array<array<double>>, species_features array<array<double>>, target_panel_label array<int>, target_panel_species array<int>"
)


def read_matcher_training(spark: SparkSession, path: str) -> DataFrame:
    """The matcher's training set, a figure a line; fields that a line lacks are null."""
    return read_jsonl(spark, path, MATCHER_TRAINING)


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(name): the distinct lines of a text file that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def read_text(path: str, default: str = "") -> str:
    """A small file's text, or the default where it is missing."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return default


@dataclass
class PipelineConfig:
    """What a run is told; unknown settings are kept in ``extra``."""

    pdf_dir: str = "input"
    output_dir: str = "output"
    grobid_url: str = "http://localhost:8070"
    dpi: int = 200
    num_workers: int = 4
    caption_window: int = 2
    lexicon_path: str | None = None
    override_threshold: float = 0.70
    extra: dict[str, Any] = field(default_factory=dict)

    def folder(self, name: str) -> str:
        """A folder of the output: figures, tei, panels or manifests."""
        return os.path.join(self.output_dir, name)


def load_config(path: str) -> PipelineConfig:
    """A configuration from JSON, defaults for what it doesn't say."""
    said = json.loads(read_text(path, "{}"))
    known = {f.name for f in fields(PipelineConfig)} - {"extra"}
    rest = {k: v for k, v in said.items() if k not in known and k != "extra"}
    return PipelineConfig(**{k: v for k, v in said.items() if k in known}, extra={**said.get("extra", {}), **rest})


def save_config(config: PipelineConfig, path: str) -> None:
    """A configuration as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(config), f, ensure_ascii=False, indent=2)
