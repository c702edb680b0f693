"""Shards of near-equal size by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that is never split.  Groups in descending size enter the bin with the
tightest remaining capacity that holds them, found in a balanced search tree.  The packing has two levels, so
that no task and no driver sees all groups: each partition packs its small groups into parcels of a fixed
capacity, a fixed fraction of all bytes; the parcels and the few groups above a quarter of that capacity (both
bounded in number by that fraction, whatever the input) are then packed into the shards.  The shard capacity is
the smallest one found for which the packing needs no more than the wanted shards.  A group larger than an even
share gets a shard of its own, and the rest is shared by the others.

A null text has no bytes, size 1 and the checksum of no bytes; null texts form one group.  Repeated rows each
take a slot.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.shared import written

FINENESS = 512  # parcels in an even shard
SLOT_ROWS = 4096  # rows that are numbered together


class Room:
    """A treap of (remaining capacity, bin); finds the smallest entry that holds a size."""

    def __init__(self):
        self.root = None
        self.draw = random.Random(7).random

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return (node[0], node[1], node[2], left), right
        left, right = self._split(node[2], key)
        return left, (node[0], node[1], right, node[3])

    def _join(self, left, right):
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            return left[0], left[1], left[2], self._join(left[3], right)
        return right[0], right[1], self._join(left, right[2]), right[3]

    def put(self, room: int, bin_: int) -> None:
        left, right = self._split(self.root, (room, bin_))
        self.root = self._join(self._join(left, ((room, bin_), self.draw(), None, None)), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest entry with at least this room."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            left, rest = self._split(self.root, best)
            _, right = self._split(rest, (best[0], best[1] + 1))
            self.root = self._join(left, right)
        return best


def best_fit(sizes, capacity: int) -> Iterator[int]:
    """The bin of each size, sizes given in descending order; larger ones get a bin of their own."""
    room, bins = Room(), 0
    for size in sizes:
        found = room.take(size)
        if found is None:
            found = (capacity, bins)
            bins += 1
        if found[0] > size:
            room.put(found[0] - size, found[1])
        yield found[1]


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size (descending), with the smallest capacity found that needs no more shards."""
    total = sum(sizes)
    alone = 0
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) > total:
        total -= sizes[alone]
        alone += 1
    rest, left = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low = max(rest[0], math.ceil(total / left))
    high = low + rest[0]
    while max(best_fit(rest, high)) >= left:
        high += rest[0]
    while low < high:
        middle = (low + high) // 2
        if max(best_fit(rest, middle)) < left:
            high = middle
        else:
            low = middle + 1
    return list(range(alone)) + [alone + b for b in best_fit(rest, high)]


def document_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, _group`` of every document, written once so that texts are read once."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(data) + 1).cast("bigint").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit("")).otherwise(F.sha2(data, 256)).alias("_group"),
        ),
        "shard-rows",
    )


def parcels(groups: DataFrame, capacity: int) -> DataFrame:
    """``_group, bytes, part, parcel``: small groups packed within their hash partition."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        frames = []

        def sizes():
            for batch in batches:
                frames.append(batch)
                yield from batch["bytes"].tolist()

        bins: list[int] = []
        for bin_ in best_fit(sizes(), capacity):
            bins.append(bin_)
            if frames and len(bins) == len(frames[0]):
                frame = frames.pop(0)
                yield frame.assign(part=part, parcel=bins)
                bins = []

    return (
        groups.repartition(n, "_group")
        .sortWithinPartitions(F.desc("bytes"), "_group")
        .mapInPandas(pack, "_group string, bytes bigint, part int, parcel int")
    )


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every document; slots of a shard run from 0 without gaps."""
    spark = docs.sparkSession
    rows = document_rows(docs)
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not count:
        return rows.select(
            "doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot")
        )
    capacity = max(4, math.ceil(total / (shards * FINENESS)))
    sums = rows.groupBy("_group").agg(F.sum("size").alias("bytes"))
    large = sums.where(F.col("bytes") * 4 > capacity)  # at most 4 * shards * FINENESS groups
    small = written(parcels(sums.where(F.col("bytes") * 4 <= capacity), capacity), "shard-parcels")
    heads = [(r["bytes"], r["_group"], -1, -1) for r in large.collect()]
    # All parcels of a partition but one are more than three quarters full.
    heads += [
        (r["bytes"], "", r["part"], r["parcel"])
        for r in small.groupBy("part", "parcel").agg(F.sum("bytes").alias("bytes")).collect()
    ]
    heads.sort(key=lambda h: (-h[0], *h[1:]))
    placed = [(*h[1:], s) for h, s in zip(heads, into_shards([h[0] for h in heads], shards))]
    schema = "_group string, part int, parcel int, shard int"
    of_large = spark.createDataFrame([p for p in placed if p[1] < 0], schema).select("_group", "shard")
    of_parcel = spark.createDataFrame([p for p in placed if p[1] >= 0], schema).drop("_group")
    of_small = small.join(F.broadcast(of_parcel), ["part", "parcel"]).select("_group", F.col("shard").alias("_shard"))
    # Hot groups are among the large ones, whose map is broadcast; only the others move by group.
    marked = rows.join(F.broadcast(of_large), "_group", "left")
    sharded = marked.where("shard IS NOT NULL").unionByName(
        marked.where("shard IS NULL").drop("shard").join(of_small.withColumnRenamed("_shard", "shard"), "_group")
    )
    return _with_slots(sharded, count).select("doc_id", "size", "text_crc32", "shard", "slot")


def _with_slots(rows: DataFrame, count: int) -> DataFrame:
    """Number the rows of each shard: by id within buckets, buckets one after the other."""
    buckets = math.ceil(count / SLOT_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_group"), F.lit(buckets)).cast("int"))
    totals = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "_group")
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(before, ["shard", "_bucket"])
        .withColumn("slot", F.col("_before") + F.col("_rank") - 1)
    )
