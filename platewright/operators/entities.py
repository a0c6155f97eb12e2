"""Taxon names and panel labels out of captions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import patterns as P
from platewright.functions.text import all_matches, distinct_in_order, strip


def extracted(docs: DataFrame, ids: Sequence[str], text: Column, pattern: str, score: float) -> DataFrame:
    """(*ids, pos, text, score): every distinct match of a pattern, by first occurrence."""
    return docs.select(*ids, F.posexplode(distinct_in_order(all_matches(text, pattern))).alias("pos", "text")).withColumn("score", F.lit(score))


def labels_of(docs: DataFrame, ids: Sequence[str], text: Column) -> DataFrame:
    """(*ids, pos, label): a caption's distinct panel labels in order."""
    return docs.select(*ids, F.posexplode(distinct_in_order(all_matches(text, P.PANEL_LABEL))).alias("pos", "label"))


def stored_or_found_labels(docs: DataFrame, ids: Sequence[str], stored: Column, text: Column) -> DataFrame:
    """(*ids, pos, label): the labels ``stored`` with a caption, where there are none those of its ``text``."""
    labels = F.when(F.size(stored) > 0, stored).otherwise(distinct_in_order(all_matches(text, P.PANEL_LABEL)))
    return docs.select(*ids, F.posexplode(labels).alias("pos", "label"))


def lexicon_matches(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, name_col: str, at_once: int = 1_000_000) -> DataFrame:
    """(``id_col``, name, start): the first occurrence of every listed name in every
    text, in any case, at any place.

    Names are searched all at once by an automaton in one pass over the texts, so
    the cost doesn't grow with the list, and no text is paired with a name that it
    doesn't hold. The list is broadcast; one of more than ``at_once`` names is dealt
    into parts by hash, each of which takes a pass of its own.
    """
    listed = lexicon.where(F.trim(name_col) != "").select(F.trim(name_col).alias("_name")).distinct()
    parts = max(1, -(-listed.count() * 5 // (4 * at_once)))  # a fifth to spare, since a hash doesn't deal evenly
    if parts > 1:
        mine = [lexicon.where(F.pmod(F.xxhash64(F.trim(name_col)), F.lit(parts)) == k) for k in range(parts)]
        return reduce(DataFrame.unionByName, [_lexicon_pass(docs, id_col, text_col, m.where(F.trim(name_col) != "").select(F.trim(name_col).alias("_name")).distinct()) for m in mine])
    return _lexicon_pass(docs, id_col, text_col, listed)


def _lexicon_pass(docs: DataFrame, id_col: str, text_col: str, listed: DataFrame) -> DataFrame:
    names = [r[0] for r in listed.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        listed: dict[str, list[str]] = {}
        for name in shared.value:
            listed.setdefault(name.lower(), []).append(name)
        for low in listed:
            tree.add_word(low, low)
        if listed:
            tree.make_automaton()
        for batch in batches:
            out = []
            for doc, text in zip(batch["_id"], batch["_text"]):
                seen: dict[str, int] = {}
                for end, low in tree.iter(text.lower()) if text and listed else ():
                    seen.setdefault(low, end - len(low) + 1)
                out += [(doc, name, start) for low, start in seen.items() for name in listed[low]]
            yield pd.DataFrame(out, columns=["_id", "name", "start"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, name string, start int").withColumnRenamed("_id", id_col)


def model_entities(rows: DataFrame, group: str = "label", text: str = "text") -> DataFrame:
    """The entities of a model that are taxa: their group names a taxon, a species or an
    organism; marks of word pieces are taken out of the text, empty texts left out."""
    low, bare = F.lower(F.coalesce(group, F.lit("taxon"))), strip(F.replace(text, F.lit("##"), F.lit("")))
    return rows.where(low.contains("tax") | low.contains("species") | low.contains("org")).withColumn(text, bare).where(F.col(text) != "").withColumn(group, F.lit("taxon"))


def in_order(entities: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``entities`` with pos: their place in their text by start and end, then by text, from 0."""
    return entities.withColumn("pos", F.row_number().over(Window.partitionBy(*ids).orderBy("start", "end", "text")) - 1)


def merge_entities(entities: DataFrame, ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of entities with the same place and text (in any case) the best scored one,
    the first by ``order`` on a tie."""
    same = Window.partitionBy(*ids, "start", "end", F.lower("text")).orderBy(F.desc("score"), *order)
    return entities.withColumn("_rank", F.row_number().over(same)).where("_rank = 1").drop("_rank")
