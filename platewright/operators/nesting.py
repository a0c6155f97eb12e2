"""Deeply nested records as flat tables with parent links, by Dewey labels.

Every node of a JSON or XML document gets the ordinal path that leads to it from
the root, e.g. ``2.1.3``. The parent's label is the child's without its last
number, an ancestor's a prefix, document order the order of the labels' numbers
(column ordinals). Nodes of one schema path (``geology_links/sources``) form one table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "row_id bigint, dewey string, schema_path string, path string, depth int, attributes map<string,string>, content string"
#: Nodes handed to the JVM at a time, whatever a document's size.
BATCH = 20_000


def parent_label(dewey: Column) -> Column:
    """The label of a node's parent: its own without the last ordinal; null at the top."""
    return F.nullif(F.regexp_replace(dewey, r"(^|\.)\d+$", ""), F.lit(""))


def ordinals(dewey: Column) -> Column:
    """The numbers of a label: rows of a document sorted by them are in document order."""
    return F.transform(F.split(dewey, r"\."), lambda x: x.cast("int"))


def json_nodes(text: str | None, lists: Sequence[str]) -> list[tuple]:
    """Objects of a JSON text below its root, with Dewey labels.

    ``lists`` names the lists of objects to follow, each below the one before it
    (["geology_links", "sources", "quotes"]). A lone object counts as a list of
    one; a string that holds JSON is unpacked first, however often it was packed;
    anything else is no list. Siblings are counted over objects. The ordinals of
    the label and of the path agree.
    """
    root = _unpacked(text)
    if not isinstance(root, dict):
        return []
    nodes: list[tuple] = []
    waiting = [((), (), root)]
    while waiting:
        label, path, here = waiting.pop()
        if len(path) == len(lists):
            continue
        name = lists[len(path)]
        found = _unpacked(here.get(name))
        items = [found] if isinstance(found, dict) else [x for x in map(_unpacked, found) if isinstance(x, dict)] if isinstance(found, list) else []
        for k, item in enumerate(items, 1):
            step = ((*label, k), (*path, f"{name}:{k}"), item)
            plain = {a: (v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for a, v in item.items() if v is not None and not isinstance(v, (dict, list))}
            nodes.append((".".join(map(str, step[0])), "/".join(lists[: len(path) + 1]), "/".join(step[1]), len(step[0]), plain, None))
            waiting.append(step)
    return nodes


def _unpacked(value):
    """``value``, or the JSON that it holds as text; None where that can't be parsed."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def xml_nodes(text: str | None, root: str, names: Sequence[str]) -> list[tuple]:
    """Elements called ``names`` below ``root`` of an XML text, with Dewey labels.

    Namespaces and prefixes are ignored. An element's parent is the nearest
    enclosing one of ``names``; path steps count like-named siblings from 1, labels
    count all siblings of ``names``. A text that can't be parsed as a whole, null,
    empty or blank gives nothing. No external entity is ever resolved.
    """
    if not text or not text.strip():
        return []
    wanted, nodes, contents = set(names), [], []
    # Of each open element: its name below the root (or None), its node's label and path, counters for the children.
    open_: list[tuple] = []
    inside = 0

    def begin(tag: str, attributes: dict[str, str]) -> None:
        nonlocal inside
        name = tag.rpartition(":")[2]
        if not inside:
            inside += name == root
            open_.append((None, (), (), {}, None) if name == root else None)
            return
        inside += 1
        _, label, path, counts, at = open_[-1]
        if name in wanted:
            counts[name] = counts.get(name, 0) + 1
            counts[""] = counts.get("", 0) + 1
            label, path = (*label, counts[""]), (*path, f"{name}:{counts[name]}")
            nodes.append((".".join(map(str, label)), "/".join(s.partition(":")[0] for s in path), "/".join(path), len(label), {k.rpartition(":")[2]: v for k, v in attributes.items()}, None))
            contents.append([])
            open_.append((name, label, path, {}, len(nodes) - 1))
        else:
            open_.append((name, label, path, counts, at))

    def end(tag: str) -> None:
        nonlocal inside
        inside -= inside > 0
        open_.pop()

    def said(data: str) -> None:
        if open_ and open_[-1] and open_[-1][4] is not None:
            contents[open_[-1][4]].append(data)

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, said
    try:
        parser.Parse(text.encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return []
    return [(*node[:5], " ".join("".join(c).split()) or None) for node, c in zip(nodes, contents)]


def flatten(docs: DataFrame, id_col: str, text_col: str, label: Callable[[str | None], list[tuple]]) -> DataFrame:
    """All nodes that ``label`` finds in the texts of ``docs``, one row each.

    Result: row_id, dewey, ordinals (the label's numbers), parent (label, null at the
    top), schema_path, path, depth, attributes, content. Null, empty and broken texts give no rows; repeated
    rows give their nodes each; an empty table gives an empty result; other columns
    aren't read. A map over the scan without a shuffle: a document is parsed by one
    task, its nodes leave in bounded batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["row_id", "dewey", "schema_path", "path", "depth", "attributes", "content"]
        out: list[tuple] = []
        for batch in batches:
            for row_id, text in zip(batch["_id"], batch["_text"]):
                out += [(row_id, *node) for node in label(text)]
                while len(out) >= BATCH:
                    yield pd.DataFrame(out[:BATCH], columns=columns)
                    del out[:BATCH]
        if out:
            yield pd.DataFrame(out, columns=columns)

    rows = docs.select(docs[id_col].cast("bigint").alias("_id"), docs[text_col].alias("_text")).where("_text is not null")
    return rows.mapInPandas(run, NODE).select("row_id", "dewey", ordinals(F.col("dewey")).alias("ordinals"), parent_label(F.col("dewey")).alias("parent"), "schema_path", "path", "depth", "attributes", "content")


def flatten_json(docs: DataFrame, id_col: str, text_col: str, lists: Sequence[str]) -> DataFrame:
    """:func:`flatten` for JSON texts; see :func:`json_nodes`."""
    lists = tuple(lists)
    # Texts that don't name the outermost list, plainly or by escapes, hold no node: they stay in the JVM.
    return flatten(docs.where(docs[text_col].contains(lists[0]) | docs[text_col].contains("\\u")), id_col, text_col, lambda text: json_nodes(text, lists))


def flatten_xml(docs: DataFrame, id_col: str, text_col: str, root: str, names: Sequence[str]) -> DataFrame:
    """:func:`flatten` for XML texts; see :func:`xml_nodes`."""
    names = tuple(names)
    return flatten(docs.where(docs[text_col].contains("<")), id_col, text_col, lambda text: xml_nodes(text, root, names))


def flatten_array(docs: DataFrame, id_col: str, array_col: str, name: str) -> DataFrame:
    """The elements of an array of structs in the same form, made in the JVM.

    Null arrays, empty arrays and null elements give no rows; ordinals count the
    elements that are there.
    """
    whole = F.filter(docs[array_col], lambda e: e.isNotNull())
    kinds = docs.schema[array_col].dataType.elementType.fields
    pairs = [x for f in kinds for x in (F.lit(f.name), F.col(f"_e.{f.name}").cast("string"))]
    rows = docs.select(docs[id_col].cast("bigint").alias("row_id"), F.posexplode(whole).alias("_k", "_e")).withColumn("_k", F.col("_k") + 1)
    filled = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return rows.select(
        "row_id", F.col("_k").cast("string").alias("dewey"), F.array(F.col("_k").cast("int")).alias("ordinals"), F.lit(None).cast("string").alias("parent"), F.lit(name).alias("schema_path"),
        F.concat(F.lit(f"{name}:"), "_k").alias("path"), F.lit(1).alias("depth"), filled.alias("attributes"), F.lit(None).cast("string").alias("content"),
    )


def table_of(nodes: DataFrame, schema_path: str) -> DataFrame:
    """The flat table of one schema path, with the key of each row and of its parent."""
    return nodes.where(F.col("schema_path") == schema_path).drop("schema_path", "depth")


def table_named(nodes: DataFrame, name: str) -> DataFrame:
    """The flat table of all nodes called ``name``, whatever encloses them."""
    return nodes.where(F.element_at(F.split("schema_path", "/"), -1) == name).drop("schema_path", "depth")
