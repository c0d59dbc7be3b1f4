"""Filling fixed-capacity containers with items (problem 8).

Items are hashed into shards of about `shard_items`, a fixed number whatever the size of the data, and every shard is packed on its own: next fit
in the order of the rows, then a local search over the bins filled less than `good_fill`, which moves documents and exchanges one for one or two for one
wherever that raises the sum of squared fills, until bins empty and no exchange raises it more. What a shard still leaves in such bins goes
round again in shards of its own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import Stages


class _Bins:
    def __init__(self, capacity: int, good_fill: float):
        self.capacity = capacity
        self.good_room = capacity - good_fill * capacity
        self.items: list[list[tuple[int, int]]] = []  # (size, item), per bin
        self.room: list[int] = []

    def next_fit(self, sizes: list[int]) -> None:
        """Each item, as they come, into the last bin, or a new one if it doesn't fit."""
        for item, size in enumerate(sizes):
            if not self.items or self.room[-1] < size:
                self.items.append([])
                self.room.append(self.capacity)
            self.items[-1].append((size, item))
            self.room[-1] -= size

    def _exchange(self, a: int, b: int, out: list[tuple[int, int]], into: list[tuple[int, int]]) -> None:
        """out goes from a to b, into from b to a."""
        for bin_, gone, come in ((a, out, into), (b, into, out)):
            for x in gone:
                self.items[bin_].remove(x)
            self.items[bin_] += come
            self.room[bin_] += sum(s for s, _ in gone) - sum(s for s, _ in come)

    def _improve(self, a: int, b: int) -> bool:
        """One change that raises the squared fill of a, the fuller, and b; the one that leaves the least room in a."""
        room = self.room[a]
        if room <= 0 or not self.items[b]:
            return False
        theirs = sorted(self.items[b])
        sizes = [s for s, _ in theirs]

        def largest(limit: int, skip: int = -1) -> int:
            k = bisect.bisect_right(sizes, limit) - 1
            return k - 1 if k == skip else k

        best, change = 0, None
        k = largest(room)
        if k >= 0 and sizes[k] > best:
            best, change = sizes[k], ([], [theirs[k]])
        for mine in self.items[a]:
            limit = room + mine[0]
            k = largest(limit)
            if k >= 0 and sizes[k] - mine[0] > best:
                best, change = sizes[k] - mine[0], ([mine], [theirs[k]])
            i, j = 0, len(sizes) - 1  # the two of theirs that come nearest to the limit together
            while i < j:
                both = sizes[i] + sizes[j]
                if both > limit:
                    j -= 1
                    continue
                if both - mine[0] > best:
                    best, change = both - mine[0], ([mine], [theirs[i], theirs[j]])
                i += 1
            if best == room:
                break
        if change is None:
            return False
        self._exchange(a, b, *change)
        return True

    def search(self) -> None:
        """The fullest of the underfull bins takes from the emptiest ones until nothing raises the squared fill."""
        changed = True
        while changed:
            changed = False
            under = sorted((r, k) for k, r in enumerate(self.room) if r > self.good_room and self.items[k])
            for _, a in under:
                for _, b in reversed(under):
                    if a == b or self.room[b] < self.room[a]:
                        continue
                    while self.room[a] > self.good_room and self._improve(a, b):
                        changed = True

    def result(self) -> list[list[int]]:
        return [[i for _, i in items] for items in self.items if items]


def pack(sizes: list[int], capacity: int, good_fill: float = 0.995) -> list[list[int]]:
    """Item numbers by bin. No size may exceed the capacity; items of size 0 take no room."""
    bins = _Bins(capacity, good_fill)
    bins.next_fit(sizes)
    bins.search()
    return bins.result()


def _pack_shards(capacity: int, good_fill: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(shard: pa.Table) -> pa.RecordBatch:
            sizes = shard.column("size").to_pylist()
            place, fill = [0] * len(sizes), [0] * len(sizes)
            for k, items in enumerate(pack(sizes, capacity, good_fill)):
                full = sum(sizes[i] for i in items)
                for i in items:
                    place[i], fill[i] = k, full
            out = shard.append_column("bin", pa.array(place, pa.int32())).append_column("fill", pa.array(fill, pa.int32()))
            return out.combine_chunks().to_batches()[0]

        now = None
        for batch in batches:
            shards = batch.column("shard").to_pylist()
            at = 0
            while at < len(shards):
                end = bisect.bisect_right(shards, shards[at])
                if shards[at] != now and held:
                    yield packed(pa.Table.from_batches(held))
                    held = []
                now = shards[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield packed(pa.Table.from_batches(held))

    return run


def _round(items: DataFrame, shards: int, seed: int, capacity: int, good_fill: float) -> DataFrame:
    kind = items.schema["id"].dataType.simpleString()
    placed = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.lit(seed)), F.lit(shards)))
    width = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 64))  # a number, else small shuffles end in one task
    return placed.repartition(width, "shard").sortWithinPartitions("shard", "id", "piece").mapInArrow(_pack_shards(capacity, good_fill), f"id {kind}, piece int, size int, shard long, bin int, fill int")


def fill_containers(sizes: DataFrame, id_col: str, size_col: str, capacity: int = 4096, shard_items: int = 5000, good_fill: float = 0.995, seed: int = 3) -> DataFrame:
    """(id_col, piece, first, size, container): a container for each item, or for each piece of an item larger than a container.

    Pieces of an item are numbered from 0 and begin at `first`; all but the last are of the whole capacity. An item without size, or null, has
    one piece of size 0. Rows with a null id are left out; a row that comes twice counts once, ids in rows of different sizes are items each.
    A container holds no more than the capacity. Container names are `s<shard>-<bin>`, `r<shard>-<bin>` (second round), `w<id>-<piece>` (whole pieces).
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    stages = Stages(sizes.sparkSession)
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint")
    rows = sizes.select(F.col(id_col).alias("id"), size.alias("all")).where("id IS NOT NULL").distinct()
    pieces = F.greatest(F.lit(1), F.ceil(F.col("all") / capacity)).cast("int")
    cut = rows.select("id", "all", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    cut = stages.write(cut.select("id", "piece", F.least(F.lit(capacity), F.col("all") - F.col("piece").cast("bigint") * capacity).cast("int").alias("size")), "pieces")
    whole = cut.where(F.col("size") == capacity).withColumn("container", F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")))
    rest = cut.where(F.col("size") < capacity)
    name = lambda letter: F.concat(F.lit(letter), F.col("shard").cast("string"), F.lit("-"), F.col("bin").cast("string"))
    first = stages.write(_round(rest, -(-max(1, cut.count()) // shard_items), seed, capacity, good_fill), "packed")
    poor = F.col("fill") < F.lit(good_fill * capacity)
    again = first.where(poor).select("id", "piece", "size")
    second = _round(again, -(-max(1, again.count()) // shard_items), seed + 1, capacity, good_fill)
    out = ["id", "piece", "size", "container"]
    every = first.where(~poor).withColumn("container", name("s")).select(*out)
    every = every.unionByName(second.withColumn("container", name("r")).select(*out)).unionByName(whole.select(*out))
    return every.select(F.col("id").alias(id_col), "piece", (F.col("piece").cast("bigint") * capacity).alias("first"), "size", "container")
