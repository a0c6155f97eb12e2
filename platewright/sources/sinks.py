"""Where results go: JSON lines, JSON, CSV, manifests, logs, assets."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8, unescaped; nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One JSON array in one file, for reports: more than ``most`` rows are refused."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use write_jsonl")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)


def _flat(df: DataFrame, c: str) -> Column:
    nested = isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType))
    return F.to_json(c).alias(c) if nested else F.col(c)


def csv_columns(df: DataFrame) -> DataFrame:
    """``df`` as CSV takes it: columns in the order of their names, nested values as JSON."""
    return df.select(*[_flat(df, c) for c in sorted(df.columns)])


def write_csv(df: DataFrame, path: str, quote_all: bool = False, sort_columns: bool = True, mode: str = "overwrite") -> None:
    """CSV with a header; quotes within values are doubled."""
    shaped = csv_columns(df) if sort_columns else df.select(*[_flat(df, c) for c in df.columns])
    shaped.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", quote_all).csv(path)


def write_csv_rows(rows: list[dict], path: str) -> None:
    """A small CSV file of rows under the keys of the first; a row with another key is an error, no rows an empty file."""
    import csv

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        if rows:
            writer = csv.DictWriter(f, fieldnames=list(rows[0]))
            writer.writeheader()
            writer.writerows(rows)


def write_pictures(pictures: DataFrame, folder: str, name: str = "panel_file", data: str = "png") -> DataFrame:
    """(name, bytes): pictures written below ``folder``, which all executors share, under their names.

    A retried task writes the same file again. Rows without a picture are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for to, content in zip(batch["_n"], batch["_d"]):
                path = os.path.join(folder, to)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.part", path)
            yield pd.DataFrame({"name": batch["_n"], "bytes": [len(x) for x in batch["_d"]]})

    rows = pictures.select(F.col(name).alias("_n"), F.col(data).alias("_d")).where("_n is not null and _d is not null")
    return rows.mapInPandas(run, "name string, bytes bigint")


def panels_of_figures(panels: DataFrame, by: str = "path") -> DataFrame:
    """(``by``, panels): one record per figure with its panels nested in order, as the file of panels has it."""
    one = F.struct("panel_index", F.array("x", "y", "w", "h").alias("bbox"), "score")
    return panels.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("panels"))


def write_manifests(df: DataFrame, path: str, by: str = "paper_id") -> None:
    """JSON lines in a folder per paper, so that later reads prune by paper."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def append_log(df: DataFrame, path: str, at: str = "timestamp") -> None:
    """Rows appended to a log of JSON lines with the time of appending."""
    df.withColumn(at, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.mode("append").json(path)


def write_cache(df: DataFrame, path: str) -> None:
    """Parsed documents as Parquet, so that a rerun need not parse them again."""
    df.write.mode("overwrite").parquet(path)


def copy_assets(df: DataFrame, to: str, key: str = "panel_path") -> DataFrame:
    """``df`` with the files of ``key`` copied to the folder ``to`` and the column
    rewritten; rows whose file is missing stay as they are. ``to`` must be shared."""
    schema, columns = df.schema, df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(to, exist_ok=True)
        for batch in batches:
            out = []
            for p in batch[key]:
                if isinstance(p, str) and os.path.isfile(p):
                    target = os.path.join(to, os.path.basename(p))
                    if os.path.abspath(target) != os.path.abspath(p):
                        shutil.copyfile(p, target)
                    out.append(target)
                else:
                    out.append(p)
            batch[key] = out
            yield batch[columns]

    return df.mapInPandas(run, schema)


def browser_columns(rows: DataFrame) -> DataFrame:
    """The five columns of the browser's export under its header; written with quotes around all values."""
    # The header of the export.
    header = {"paper_id": "论文ID", "figure_id": "图版ID", "panel_id": "Panel标签", "species": "物种", "confidence": "置信度"}
    empty = {"panel_id", "species"}
    return rows.select(*[(F.coalesce(c, F.lit("")) if c in empty else F.col(c)).alias(name) for c, name in header.items()])
