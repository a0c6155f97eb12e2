"""Byte-level BPE with a public rank file, for whole corpora.

A text is split by the vocabulary's pattern; each piece is encoded by a segment
tree over its adjacent pairs: a leaf holds the rank of the pair that starts
there, the root the leftmost pair of the lowest rank. A merge changes at most
three leaves, so a piece of n bytes takes O(n log n) however it is made up.
Pieces recur, so that each distinct one is encoded once per Python worker, up to
a bounded memory of pieces.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

DEFAULT_FOLDER = "/opt/tokenizers"
# Fixed value: the pattern that splits text before merging, as the vocabulary's documentation gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces that a worker remembers at most, and the longest that it remembers (in characters).
MEMORY, LONGEST = 200_000, 64
_NONE = 1 << 62


def read_ranks(folder: str = DEFAULT_FOLDER, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """The ranks of a vocabulary: bytes -> id. About 50,000 entries, fixed by the file."""
    ranks = {}
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by a segment tree over the ranks of its adjacent pairs."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    if n == 1:
        return [ranks[piece]]
    width = 1
    while width < n - 1:
        width *= 2
    # A node is rank * n + position: the minimum is the lowest rank, leftmost among equals.
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return _NONE
        rank = ranks.get(parts[i] + parts[j])
        return _NONE if rank is None else rank * n + i

    while tree[1] != _NONE:
        i = tree[1] % n
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if j < n - 1:
            put(j, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes texts without special tokens; their strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks, self.split, self.known = ranks, regex.compile(PATTERN).findall, {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none, as an empty list, for null and for empty text."""
        ids: list[int] = []
        known = self.known
        for piece in self.split(text) if text else ():
            found = known.get(piece)
            if found is None:
                found = encode_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(piece) <= LONGEST:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, folder: str = DEFAULT_FOLDER, name: str = "byte_bpe_50k", counts_only: bool = False) -> DataFrame:
    """(``id_col``, ids array<int>) of every row, or (``id_col``, n_tokens int).

    Null and empty texts have the empty list (0 tokens); blank texts have the ids
    of their blanks; very long texts are encoded whole; repeated rows stay, each
    with its ids; an empty table gives an empty result; other columns, of whatever
    name, are not read. A map over the scan: no shuffle. ``folder`` holds the rank
    file on the driver; executors get the ranks (about 1 MB) by broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(folder, name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"], "n_tokens": [len(i) for i in ids]} if counts_only else {"_id": batch["_id"], "ids": ids})

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"_id {kind}, " + ("n_tokens int" if counts_only else "ids array<int>"))
    return out.withColumnRenamed("_id", id_col)
