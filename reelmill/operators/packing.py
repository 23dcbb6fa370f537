"""Work dealt over shards and workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.operators.fold import folded

#: Different loads of a plan; they, not the items, are what the driver sees.
MOST_LOADS = 1 << 20


def shard_packing(items: DataFrame, key: str, group: tuple[str, ...], size: str, most: int) -> DataFrame:
    """(*group, key, size, shard): greedy packing of each group's items in key order.

    Neighbours share a shard while they fit; an item larger than most has one by itself.
    A group is a stream in order, of which a task holds the open shard's number and size.
    """

    def step(s: dict, row: dict) -> dict:
        if s["used"] and s["used"] + row[size] > most:
            s.update(used=0, shard=s["shard"] + 1)
        s["used"] += row[size]
        return {size: row[size], "shard": s["shard"]}

    rows = items.select(*group, key, F.col(size).cast("long").alias(size))
    return folded(rows, group, (key,), lambda: {"used": 0, "shard": 0}, step, f"{size} long, shard int")


def deal_loads(counts: list[tuple[int, int]], bins: int) -> tuple[list[int], dict[int, list[int]]]:
    """((load of each bin), {load: what the bins held before its items}) when items go by falling load to the bin with least so far, ties to the smaller bin.

    counts are (load, items of that load). Items of one load are dealt together: a bin
    that holds b takes them at b, b + load, b + 2 load, and so on, and the lowest of all
    these places are taken.
    """
    held, before = [0] * bins, {}
    for load, n in sorted(counts, reverse=True):
        before[load] = list(held)
        level, rest = _level(np.array(held, object), load, n)
        for b in range(bins):
            held[b] += load * _below(held[b], load, level)
        for b in [b for b in range(bins) if load and held[b] == level][:rest]:
            held[b] += load
    return held, before


def _below(held: int, load: int, level: int) -> int:
    """How many of held, held + load, ... are below level."""
    return max(0, -(-(level - held) // load)) if load else 0


def _level(held, load: int, n: int) -> tuple[int, int]:
    """(the highest level below which no more than n places lie, how many of the n are left for places at it)."""
    if not load:
        return 0, 0
    lo, hi = int(min(held)), int(max(held)) + load * (n + 1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if sum(_below(int(b), load, mid) for b in held) <= n:
            lo = mid
        else:
            hi = mid
    return lo, n - sum(_below(int(b), load, lo) for b in held)


def _bins_of(load: int, before: list[int], ranks: np.ndarray) -> np.ndarray:
    """The bin of each rank (from 0) among the items of one load: that of the rank-th lowest place, ties to the smaller bin."""
    held = np.array(before, np.int64)
    if not load:
        return np.full(len(ranks), int(held.argmin()))
    lo, hi = np.full(len(ranks), held.min()), held.max() + load * (ranks + 1)
    while (hi - lo > 1).any():
        mid = (lo + hi) // 2
        few = np.maximum(0, -(-(mid[:, None] - held) // load)).sum(1) <= ranks
        lo, hi = np.where(few, mid, lo), np.where(few, hi, mid)
    left = ranks - np.maximum(0, -(-(lo[:, None] - held) // load)).sum(1)
    here = (held <= lo[:, None]) & ((lo[:, None] - held) % load == 0)
    return (np.cumsum(here, axis=1) > left[:, None]).argmax(1)


def longest_first(items: DataFrame, name: str, load: str, bins: int, out: str, group: tuple[str, ...] = ()) -> DataFrame:
    """items with out: the bin of each, by falling load to the bin of its group with least so far, ties by name and to the smaller bin.

    The greedy order needs only how many items of each load there are: that table, with a
    row a group and load, goes through the driver, and each item finds its bin by its
    place among those of its load. More than MOST_LOADS different loads are an error.
    """
    sizes = items.groupBy(*group, load).agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.limit(MOST_LOADS + 1).collect()
    if len(counts) > MOST_LOADS:
        raise ValueError(f"more than {MOST_LOADS} different loads: round {load}")
    by_group: dict[tuple, list[tuple[int, int]]] = {}
    for r in counts:
        by_group.setdefault(tuple(r[c] for c in group), []).append((r[load], r.n))
    plan = {(g, w): before for g, own in by_group.items() for w, before in deal_loads(own, bins)[1].items()}
    held = items.sparkSession.sparkContext.broadcast(plan)
    ranked = items.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, load).orderBy(name)) - 1)
    schema = T.StructType([*items.schema.fields, T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([*group, load, "__rank"]).to_pylist()
            by_load: dict[tuple, list[int]] = {}
            for i, r in enumerate(rows):
                by_load.setdefault((tuple(r[c] for c in group), r[load]), []).append(i)
            bins_ = np.zeros(batch.num_rows, np.int32)
            for (g, w), at in by_load.items():
                bins_[at] = _bins_of(w, held.value[g, w], np.array([rows[i]["__rank"] for i in at], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins_)], names=[f.name for f in schema])

    return ranked.mapInArrow(run, schema)


def lpt_shards(items: DataFrame, name: str, load: str, machines: int, workers: int) -> DataFrame:
    """(name, load, machine, worker): items over machines, and each machine's over its workers, longest first."""
    rows = items.select(name, F.col(load).cast("long").alias(load))
    return longest_first(longest_first(rows, name, load, machines, "machine"), name, load, workers, "worker", ("machine",))


def top_per_group(rows: DataFrame, key: tuple[str, ...], order, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= n)
