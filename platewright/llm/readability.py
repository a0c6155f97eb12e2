"""How demanding documents are to read, on one scale for several languages.

A familiar-word formula: the share of words outside a list of short words that
many of the corpus's documents in that language use, plus the mean length of the
sentences. Only running sentences count; lists, tables and references don't.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.plans.lineage import cut

# Frequent function words, by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for as with are was on by this from at which or be has have an not they its their these were but can so",
    "de": "der die das und in den von zu ist mit dem des auf für sich ein eine nicht auch es sie wird im aus dass durch einer wir man sind als wie",
    "fr": "le la les de des et un une du en est que qui dans pour sur par au il elle ce sont ne se aux avec plus sa son leur cette ces on",
    "es": "el la los las de y un una en que del es por con para se su al como más lo no este esta son sus pero muy entre hay cuando",
}
#: A familiar word is at most so long and is in at least this share of the language's documents.
LONGEST_FAMILIAR, WIDESPREAD = 7, 0.02
#: Weight of a word of sentence length, and the least that it counts up to (see ``score``).
PER_WORD, LENGTH_FLOOR, LENGTH_SLOPE, LENGTH_MOST = 0.015, 12.0, 200.0, 30.0
#: Scores at which bands 2, 3 and 4 begin; words that a document needs to be judged.
BANDS, LEAST_WORDS = (0.225, 0.44, 0.725), 40

_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_REFERENCE = re.compile(r"^[^\d(]{2,120}\((?:1[6-9]|20)\d\d[a-z]?\)[.,:;]?\s")
_ITEM = re.compile(r"^\s*(?:[-–—*•·▪◦‣]\s|\(?\d{1,3}[.)]\s|\(?[a-z][.)]\s|\[\d+\])")
_PARAGRAPH = re.compile(r"\n\s*\n")
_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"'“‘«¿¡(\[]*[^\W\d_a-zß-öø-ÿ])")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")


def running_sentences(text: str | None) -> list[list[str]]:
    """The words of each running sentence of a text: what ends with a full stop,
    exclamation or question mark and has two words or more, after rows of tables,
    items of lists and references are left out."""
    found = []
    for paragraph in _PARAGRAPH.split(text or ""):
        lines = [x for x in paragraph.split("\n") if "\t" not in x and x.count("|") < 2 and not _REFERENCE.match(x) and not _ITEM.match(x)]
        for sentence in _END.split(" ".join(" ".join(lines).split())):
            if sentence.rstrip("\"'”’»)] ")[-1:] in (".", "!", "?", "…") and sentence:
                words = _WORD.findall(sentence)
                if len(words) > 1:
                    found.append(words)
    return found


def language(words: list[str]) -> str | None:
    """The language of which the most function words occur; English for Latin text
    without any, as in terse descriptions; None for text in other scripts."""
    counted = Counter(w.lower() for w in words)
    hits = {k: sum(counted[w] for w in v) for k, v in _FUNCTION.items()}
    best = max(hits, key=lambda k: hits[k])
    if hits[best] * 50 >= len(words) and hits[best]:
        return best
    latin = sum(len(_LATIN.findall(w)) for w in words)
    return "en" if latin >= 0.9 * sum(map(len, words)) and words else None


def score(strange: float, length: float) -> float:
    """The formula. Sentence length counts up to a bound that rises with the share
    of unfamiliar words: trivial clauses strung together are no harder to read."""
    return strange + PER_WORD * min(length, LENGTH_FLOOR + LENGTH_SLOPE * strange, LENGTH_MOST)


def parsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, detected, n_words, n_sentences, n_long, words, times) of every document: what its
    level rests on. ``words`` are its distinct words, in lower case, of at most
    ``LONGEST_FAMILIAR`` letters, ``times`` how often each occurs. The one pass over the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["_id"], batch["_text"]):
                sentences = running_sentences(text)
                words = [w for s in sentences for w in s]
                short = Counter(w.lower() for w in words if len(w) <= LONGEST_FAMILIAR)
                out.append((doc, language(words), len(words), len(sentences), len(words) - sum(short.values()), list(short), list(short.values())))
            yield pd.DataFrame(out, columns=["_id", "detected", "n_words", "n_sentences", "n_long", "words", "times"])

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, detected string, n_words int, n_sentences int, n_long int, words array<string>, times array<int>")


def familiar_words(documents: DataFrame, share: float = WIDESPREAD) -> dict[str, frozenset[str]]:
    """Per language the short words that are in at least ``share`` of its documents, of
    documents as :func:`parsed` gives them, counted in the JVM over the whole corpus.

    The lists come to the driver: together they can't exceed a language's mean
    number of distinct words a document divided by ``share`` (some thousands),
    however large the corpus.
    """
    known = documents.where("detected is not null")
    totals = {r["detected"]: r["n"] for r in known.groupBy("detected").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not totals:
        return {}
    counts = known.select("detected", F.explode("words").alias("word")).groupBy("detected", "word").agg(F.count(F.lit(1)).alias("n"))
    least = F.element_at(F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, n * share)]), F.col("detected"))
    lists: dict[str, set[str]] = {}
    for row in counts.where(F.col("n") >= least).select("detected", "word").toLocalIterator():
        lists.setdefault(row["detected"], set()).add(row["word"])
    return {k: frozenset(v) for k, v in lists.items()}


def reading_levels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, detected, n_words, strange_share, sentence_length, score, band) of every document.

    Band: 1 up to about age 10, 2 ages 11-14, 3 ages 15-18, 4 university. Documents
    without ``LEAST_WORDS`` words in running sentences of English, German, French or
    Spanish - null, empty and blank texts, tables, references, other scripts - have
    n_words as counted and nulls for score and band. Texts are read whole, however
    long, and parsed once; repeated rows are judged each; other columns aren't read.
    What was parsed is written to the checkpoint folder, since it is counted and then
    judged by the counts; one shuffle of word counts.
    """
    documents = cut(parsed(docs, id_col, text_col))
    lists = docs.sparkSession.sparkContext.broadcast(familiar_words(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, lang, n, sentences, long, words, times in batch.itertuples(index=False, name=None):
                if lang is None or n < LEAST_WORDS:
                    out.append((doc, lang, n, None, None, None, None))
                    continue
                familiar = lists.value.get(lang, frozenset())
                strange = (long + sum(t for w, t in zip(words, times) if w not in familiar)) / n
                length = n / sentences
                x = score(strange, length)
                out.append((doc, lang, n, strange, length, x, 1 + sum(x >= b for b in BANDS)))
            frame = pd.DataFrame(out, columns=["_id", "detected", "n_words", "strange_share", "sentence_length", "score", "band"])
            yield frame.astype({"band": "Int32"})

    kind = documents.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, detected string, n_words int, strange_share double, sentence_length double, score double, band int"
    return documents.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
