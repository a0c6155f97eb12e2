"""Filling containers of fixed capacity by bounded-space online best fit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers that a stream keeps open at once, and items that a stream has on average.
OPEN, STREAM = 4096, 100_000
#: Capacities that one call packs for at most: a short list of settings, read to the driver.
MOST_SIZES = 100


class BestFit:
    """Open containers, keyed by free room in a bitset; the fullest closes first."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.rooms, self.by_room, self.n_open, self.used = 0, {}, 0, 0

    def place(self, size: int) -> int:
        """The number of the container that an item of ``size`` <= capacity goes into:
        the open one with the least room that holds it, else a new one."""
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            waiting = self.by_room[room]
            container = waiting.pop()
            if not waiting:
                self.rooms ^= 1 << room
            self.n_open -= 1
        else:
            room, container = self.capacity, self.used
            self.used += 1
        if room > size:
            self._open(room - size, container)
        return container

    def _open(self, room: int, container: int) -> None:
        if self.n_open == self.most_open:
            fullest = (self.rooms & -self.rooms).bit_length() - 1
            if fullest >= room:
                return
            self.by_room[fullest].pop()
            if not self.by_room[fullest]:
                self.rooms ^= 1 << fullest
            self.n_open -= 1
        self.by_room.setdefault(room, []).append(container)
        self.rooms |= 1 << room
        self.n_open += 1


def pack(items: DataFrame, id_col: str, size_col: str, capacities: DataFrame, most_open: int = OPEN, stream: int = STREAM) -> DataFrame:
    """Items assigned to containers of each capacity.

    ``capacities`` has (size_name, capacity); capacities that are null or below 1
    are left out. Result, one row per piece: size_name, capacity, ``id_col``,
    piece (0 for an item kept whole, else 1, 2, ...), piece_size, container. An
    item above the capacity fills containers of its own with all but its last
    piece, which is packed like an item; no other item is split. An item of no or
    null size needs no room: piece 0, piece_size 0, container null. Repeated rows
    are packed each; an empty table gives an empty result; other columns are not read.

    Items are dealt by the hash of their id to streams of about ``stream`` items,
    each packed on its own by one task with at most ``most_open`` containers open,
    so that memory is bounded and a stream's last, half-empty containers are a
    small part of all. Containers are named capacity/stream/number.
    """
    rows = items.select(items[id_col].alias("_id"), F.coalesce(items[size_col], F.lit(0)).cast("int").alias("_size"))
    n_streams = max(1, -(-rows.count() // stream))
    sizes = [tuple(r) for r in capacities.where("capacity >= 1").select("size_name", F.col("capacity").cast("int")).distinct().limit(MOST_SIZES + 1).collect()]
    if len(sizes) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} capacities")
    listed = F.array(*[F.struct(F.lit(n).alias("size_name"), F.lit(c).alias("capacity")) for n, c in sorted(sizes, key=str)]) if sizes else F.array().cast("array<struct<size_name:string,capacity:int>>")
    kind = rows.schema["_id"].dataType.simpleString()
    keyed = rows.withColumn("_stream", F.pmod(F.xxhash64("_id"), F.lit(n_streams)).cast("int")).select("_id", "_size", "_stream", F.explode(listed).alias("_s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins: dict[tuple[str, int, int], BestFit] = {}
        for batch in batches:
            out = []
            for item, size, at, name, capacity in batch.itertuples(index=False):
                fit = bins.get((name, capacity, at))
                if fit is None:
                    fit = bins[name, capacity, at] = BestFit(capacity, most_open)
                if size <= 0:
                    out.append((name, capacity, item, 0, 0, None))
                    continue
                pieces, rest = divmod(size, capacity)
                if size == capacity:
                    pieces, rest = 0, size
                sizes = [capacity] * pieces + [rest] * (rest > 0)
                for k, s in enumerate(sizes):
                    out.append((name, capacity, item, k + 1 if len(sizes) > 1 else 0, s, f"{capacity}/{at}/{fit.place(s)}"))
            yield pd.DataFrame(out, columns=["size_name", "capacity", "_id", "piece", "piece_size", "container"])

    dealt = keyed.select("_id", "_size", "_stream", "_s.size_name", "_s.capacity").repartition(n_streams * 3, "_stream", "size_name").sortWithinPartitions("size_name", "_stream", F.xxhash64(F.col("_id"), F.lit(1)), "_id")
    schema = f"size_name string, capacity int, _id {kind}, piece int, piece_size int, container string"
    return dealt.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
