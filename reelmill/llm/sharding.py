"""Sharding over fixed virtual slots.

A record's id hashes into one of thousands of virtual slots, for ever. Bytes are
aggregated by slot, and a versioned map says which shard holds each slot; growing
or rebalancing edits the map, so that whole slots move and no record is rehashed.
The map has a row for each slot, whatever the input's size: it may be collected
and broadcast.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


@dataclass(frozen=True)
class ShardMap:
    """shard_of[virtual slot] at a version, for a number of shards."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.version, self.shards, v, s) for v, s in enumerate(self.shard_of)],
            "version int, shards int, virtual_slot int, shard int",
        )


def save_map(spark: SparkSession, shard_map: ShardMap, path: str) -> None:
    """Adds a version of the map to those stored at path; a version is written once."""
    shard_map.rows(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/v{shard_map.version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> ShardMap:
    rows = spark.read.parquet(f"{path}/v{version:06d}").orderBy("virtual_slot").collect()
    return ShardMap(version, rows[0].shards, tuple(r.shard for r in rows))


def virtual_slot(id_col, text=None, slots: int = SLOTS):
    """The virtual slot of an id; a null id has that of its text, so that rows without one don't share a slot, or slot 0 without a text."""
    other = F.lit(0) if text is None else F.pmod(F.xxhash64(text), F.lit(slots))
    return F.when(id_col.isNull(), other).otherwise(F.pmod(F.xxhash64(id_col), F.lit(slots))).cast("int")


def slot_bytes(records: DataFrame) -> list[tuple[int, int]]:
    """(bytes, rows) by virtual slot of records (virtual_slot, size); a list as long as the map."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    by = {r.virtual_slot: (r.size, r.n) for r in rows}
    return [by.get(v, (0, 0)) for v in range(SLOTS if not by else max(SLOTS, max(by) + 1))]


def first_map(sizes: list[int], shards: int) -> ShardMap:
    """Version 1: slots go by falling size to the shard that has least."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * len(sizes)
    for v in sorted(range(len(sizes)), key=lambda v: (-sizes[v], v)):
        load, s = heapq.heappop(heap)
        shard_of[v] = s
        heapq.heappush(heap, (load + sizes[v], s))
    return ShardMap(1, shards, tuple(shard_of))


def rebalanced(shard_map: ShardMap, sizes: list[int], shards: int) -> ShardMap:
    """The next version for so many shards: slots leave full shards, and go only where there is room.

    With more shards than before, slots move only into the new ones; with as many
    or fewer, the slots of dropped shards and of those above their share move to the
    shards that have least.
    """
    share, load, shard_of = sum(sizes) / shards, [0] * shards, list(shard_of_ := shard_map.shard_of)
    held: list[list[int]] = [[] for _ in range(max(shards, shard_map.shards))]
    for v, s in enumerate(shard_of_):
        held[s].append(v)
        if s < shards:
            load[s] += sizes[v]
    loose = [v for s in range(shards, shard_map.shards) for v in held[s]]
    for s in range(min(shards, shard_map.shards)):
        for v in sorted(held[s], key=lambda v: (-sizes[v], v)):
            if sizes[v] and load[s] - sizes[v] >= share - sizes[v] / 2:
                load[s] -= sizes[v]
                loose.append(v)
    new = range(shard_map.shards, shards) if shards > shard_map.shards else range(shards)
    heap = [(load[s], s) for s in new]
    heapq.heapify(heap)
    for v in sorted(loose, key=lambda v: (-sizes[v], v)):
        has, s = heapq.heappop(heap)
        shard_of[v] = s
        heapq.heappush(heap, (has + sizes[v], s))
    return replace(shard_map, version=shard_map.version + 1, shards=shards, shard_of=tuple(shard_of))


def shard_records(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", shard_map: ShardMap | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, map_version, shard, slot) for every row of df.

    size is the text's UTF-8 bytes (null: none) plus 1. slot is the row's place in its
    shard, gapless from 0: by virtual slot, then id, CRC and size; repeated rows take
    places of their own in any order. Null ids are dealt by their text. Without a map
    given, the map is version 1 of these sizes. An empty df gives no rows; other
    columns of df play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(id_col).cast("long"), text).alias("virtual_slot"),
    )
    counted = slot_bytes(records)
    shard_map = shard_map or first_map([b for b, _ in counted], shards)
    before, rows = [0] * shard_map.shards, []
    for v, s in enumerate(shard_map.shard_of):
        rows.append((v, shard_map.version, s, before[s]))
        before[s] += counted[v][1]
    places = df.sparkSession.createDataFrame(rows, "virtual_slot int, map_version int, shard int, before long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(places), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "map_version", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))
    )
