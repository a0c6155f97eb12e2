"""Image tables: regions, panels and bars found in parallel, pixels never shuffled."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.vision import pixels


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data) of a folder's images, BGR bytes; broken files left out."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def png(image: np.ndarray) -> bytes:
    """A grey or BGR image as PNG."""
    shown = image if image.ndim == 2 else image[..., ::-1]
    rows = b"".join(b"\0" + shown[y].tobytes() for y in range(shown.shape[0]))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", shown.shape[1], shown.shape[0], 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _arrays(batch: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    for path, w, h, c, data in batch[["path", "width", "height", "channels", "data"]].itertuples(index=False):
        image = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
        yield path, image[..., 0] if c == 1 else image[..., :3]


def _mapped(images: DataFrame, find, schema: str, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *r) for p, image in _arrays(batch) for r in find(image)], columns=["path", *columns])

    return images.select("path", "width", "height", "channels", "data").mapInPandas(run, f"path string, {schema}")


def find_regions(images: DataFrame) -> DataFrame:
    """(path, x, y, w, h, score, kind): figures on page images."""
    return _mapped(images, lambda i: [(*b, s, k) for b, s, k in pixels.figure_regions(i)], "x int, y int, w int, h int, score double, kind string", ["x", "y", "w", "h", "score", "kind"])


def find_panels(images: DataFrame) -> DataFrame:
    """(path, panel_index, x, y, w, h, score): panels of figure images in reading order."""
    return _mapped(images, lambda i: [(k, *b, s) for k, (b, s) in enumerate(pixels.panels(i))], "panel_index int, x int, y int, w int, h int, score double", ["panel_index", "x", "y", "w", "h", "score"])


def find_bars(images: DataFrame) -> DataFrame:
    """(path, pixel_length): the scale bar of each image; null where none is found."""
    return _mapped(images, lambda i: [(pixels.scale_bar_length(i),)], "pixel_length double", ["pixel_length"])


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(path, panel_index, png): the panels' pixels. Only boxes are shuffled: they are
    gathered per image and joined to it, and cut where the image lies."""
    gathered = boxes.groupBy("path").agg(F.collect_list(F.struct("panel_index", "x", "y", "w", "h")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for (path, image), listed in zip(_arrays(batch), batch["boxes"]):
                rows += [(path, b["panel_index"], png(pixels.crop(image, (b["x"], b["y"], b["w"], b["h"])))) for b in listed]
            yield pd.DataFrame(rows, columns=["path", "panel_index", "png"])

    return images.join(gathered, "path").mapInPandas(run, "path string, panel_index int, png binary")
