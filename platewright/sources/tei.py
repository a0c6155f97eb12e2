"""Captions and sections out of structured full text (TEI)."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.functions.text import all_matches, distinct_in_order, figure_number, section_type
from platewright.functions import patterns as P

_XML_ID = "{http://www.w3.org/XML/1998/namespace}id"


def _tree(text: str | None):
    """The root without namespaces, or None for null, blank or broken text."""
    if not text or not text.strip():
        return None
    try:
        root = ET.fromstring(text.encode("utf-8", "replace"))
    except ET.ParseError:
        return None
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return root


def _text(e) -> str:
    return " ".join(t.strip() for t in e.itertext() if t.strip())


def _figures(text: str | None, use_xml_id: bool, description_first: bool = False) -> Iterator[tuple]:
    root = _tree(text)
    tags = ("figDesc", "head", "note") if description_first else ("head", "figDesc", "note", "label")
    for k, fig in enumerate(root.iter("figure") if root is not None else (), 1):
        parts = [_text(p) for p in (fig.find(t) for t in tags) if p is not None]
        caption = " ".join(x for x in parts if x) or _text(fig)
        name = (fig.get(_XML_ID) if use_xml_id else None) or fig.get("id") or f"fig{k}"
        yield k, name, fig.get("n"), caption


def _sections(text: str | None) -> Iterator[tuple]:
    root = _tree(text)
    divs = [] if root is None else list(dict.fromkeys(d for t in root.iter("text") for b in t.iter("body") for d in b.iter("div")))
    for k, div in enumerate(divs, 1):
        head = div.find("head")
        body = "\n".join(_text(p) for p in div.findall("p")).strip()
        if body:
            yield k, f"sec_{k}", _text(head) if head is not None else f"section_{k}", body


def _parsed(docs: DataFrame, id_col: str, xml_col: str, parse, schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch["_id"], batch["_xml"]) for r in parse(t)]
            yield pd.DataFrame(rows, columns=["_id", *names])

    docs = docs.select(F.col(id_col).alias("_id"), F.col(xml_col).alias("_xml")).where("_xml is not null")
    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)


def captions_of(docs: DataFrame, id_col: str, xml_col: str, use_xml_id: bool = False, description_first: bool = False) -> DataFrame:
    """(id, ord, figure_id, caption, figure_number, panel_labels, taxa) of every figure.

    A figure without an ``id`` is called by its place; ``use_xml_id`` takes xml:id first,
    ``description_first`` the description before the heading, without the label.
    Null, blank and broken texts give nothing. Parsed where the text lies, no shuffle.
    """
    rows = _parsed(docs, id_col, xml_col, lambda t: _figures(t, use_xml_id, description_first), "ord int, figure_id string, n string, caption string", ["ord", "figure_id", "n", "caption"])
    c = F.col("caption")
    return rows.select(
        id_col, "ord", "figure_id", "caption", figure_number(F.col("n"), c, F.col("figure_id")).alias("figure_number"),
        distinct_in_order(all_matches(c, P.PANEL_LABEL)).alias("panel_labels"), distinct_in_order(all_matches(c, P.TAXON_CANDIDATE)).alias("taxa"),
    )


def sections_of(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, ord, section_id, title, section_type, text) of every division with text of its own."""
    rows = _parsed(docs, id_col, xml_col, _sections, "ord int, section_id string, title string, text string", ["ord", "section_id", "title", "text"])
    return rows.select(id_col, "ord", "section_id", "title", section_type(F.col("title")).alias("section_type"), "text")
