"""Nearest neighbours by a block matrix join with int8 tiles.

Rows lie in stripes, queries in blocks; each pair of a query block and a stripe is
one group of rows, which a task reads as a stream: first the queries, then the
stripe, a tile at a time. An int8 product tile gives each inner product with a
bound of its quantisation error. Only pairs whose upper bound reaches the query's
k-th best lower bound are computed again, in double precision, and merged into the
query's heap; a last merge joins the stripes' heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import _arrow, map_batches

#: Queries of a block, rows of a stripe (until there are MOST_STRIPES), rows of a tile.
BLOCK, STRIPE, MOST_STRIPES, TILE = 1024, 1 << 14, 256, 1 << 12


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>) of the rows whose vector is neither null nor empty, zero or holding null or non-finite components."""
    vec = F.col(vec_col).cast("array<double>")
    fine = (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & vec.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a double matrix; other lengths are an error."""
    lengths = np.unique(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors must share one length, and these have {lengths.tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


class Quantised:
    """Vectors as int8 with a scale each, and what the rounding leaves of them.

    Vectors whose squares could leave the range of doubles are taken times a power of
    two, which products give back in the end.
    """

    def __init__(self, x: np.ndarray) -> None:
        power = np.frexp(np.abs(x).max(1, initial=0.0))[1]
        self.power = np.where(np.abs(power) > 400, power, 0)
        self.wide = bool(self.power.any())
        if self.wide:
            x = np.ldexp(x, -self.power[:, None])
        top = np.abs(x).max(1, initial=0.0)
        self.scale = np.where(top > 0, top / 127.0, 1.0)
        self.codes = np.rint(x / self.scale[:, None]).astype(np.int8)
        rest = x - self.codes * self.scale[:, None]
        self.rest = np.sqrt((rest * rest).sum(1))
        self.norm = np.sqrt((x * x).sum(1))

    def products(self, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """(inner products of the rounded vectors, bound of their error) for all rows of both.

        Integer sums of up to 1,024 products of int8 are exact in float32; longer vectors
        add up such slabs in double.
        """
        a, b = self.codes, other.codes
        total = np.zeros((len(a), len(b)))
        for d in range(0, a.shape[1], 1024):
            total += a[:, d : d + 1024].astype(np.float32) @ b[:, d : d + 1024].astype(np.float32).T
        # <x, y> - <x', y'> = <x - x', y> + <x', y - y'>; the last factor pays for the rounding of this very sum
        error = self.rest[:, None] * other.norm + (self.norm + self.rest)[:, None] * other.rest
        about, error = total * self.scale[:, None] * other.scale, error + 1e-12 * (self.norm[:, None] * other.norm)
        if self.wide or other.wide:
            power = self.power[:, None] + other.power
            with np.errstate(over="ignore"):
                # what the doubles below the normal ones lose, once a component
                return np.ldexp(about, power), np.ldexp(error, power) + a.shape[1] * 5e-324
        return about, error


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, added from the first component to the last."""
    return np.add.accumulate(q * x, axis=1)[:, -1] if q.shape[1] else np.zeros(len(q))


class Heaps:
    """The k best (score, -vec_id) of each query of a block so far."""

    def __init__(self, ids: list[int], k: int) -> None:
        self.ids, self.k, self.heaps = ids, k, [[] for _ in ids]

    def floor(self) -> np.ndarray:
        """Each query's k-th best score; below any score while it has fewer."""
        return np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        for i, s, v in zip(query.tolist(), score.tolist(), vec_id.tolist(), strict=True):
            heap, item = self.heaps[i], (s, -v)
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)

    def rows(self) -> Iterator[tuple[int, int, float]]:
        for q, heap in zip(self.ids, self.heaps, strict=True):
            yield from ((q, -v, s) for s, v in heap)


def search_tile(q: np.ndarray, held: Quantised, heaps: Heaps, x: np.ndarray, ids: np.ndarray) -> None:
    """Merges a tile's rows into the heaps of a query block; a query is no candidate of its own."""
    tile, k = Quantised(x), heaps.k
    about, error = held.products(tile)
    own = np.asarray(heaps.ids)[:, None] == ids
    about[own] = -np.inf
    with np.errstate(invalid="ignore"):
        low, high = about - error, about + error
    if held.wide or tile.wide:
        low = np.where(np.isnan(low), -np.inf, low)  # no bound, and so no reason to leave others out
    best = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
    rows, at = np.nonzero(~(high < np.maximum(best, heaps.floor())[:, None]) & ~own)
    for some in np.array_split(np.arange(len(rows)), len(rows) // (1 << 16) + 1):
        heaps.add(rows[some], exact(q[rows[some]], x[at[some]]), ids[at[some]])


def stripes_of(n: int) -> int:
    return max(1, min(MOST_STRIPES, -(-n // STRIPE)))


def block_join(rows: DataFrame, is_query, per_block: Callable, k: int, score_type: str, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score): what per_block finds for each pair of a query block and a stripe.

    rows (vec_id, vec). Queries go to every stripe and rows to every query block, as
    the two sides of a blocked product do; no pair of rows is made. per_block(ids,
    matrix) returns (take(matrix, ids), found()): a task calls take for each tile.
    """
    n, queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, stripes = max(1, -(-queries // block)), stripes_of(n)
    spread = lambda salt, count: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    sides = rows.where(is_query).select(
        spread(1, blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("side"), "vec_id", "vec"
    ).unionByName(
        rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), spread(2, stripes).alias("stripe"), F.lit(1).alias("side"), "vec_id", "vec")
    )
    dealt = sides.repartition(blocks * stripes, "block", "stripe").sortWithinPartitions("block", "stripe", "side", "vec_id")
    schema = f"query_id long, vec_id long, score {score_type}"
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches):
        key, queries, work, pending, size = None, [], None, [], 0

        def made(found) -> pa.RecordBatch:
            q, v, s = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, arrow.field(2).type)], schema=arrow)

        def begin():
            table = pa.concat_tables(queries)
            return per_block(table.column("vec_id").to_pylist(), matrix(table.column("vec").combine_chunks()))

        def tile() -> None:
            table = pa.concat_tables(pending)
            work[0](matrix(table.column("vec").combine_chunks()), table.column("vec_id").to_numpy())

        def end() -> pa.RecordBatch:
            if pending:
                tile()
            return made(list(work[1]()) if work else [])

        for batch in batches:
            table = pa.table(batch)
            b, s, side = (table.column(c).to_numpy() for c in ("block", "stripe", "side"))
            if not len(b):
                continue
            cuts = [0, *(np.flatnonzero((np.diff(b) != 0) | (np.diff(s) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if key != (b[lo], s[lo]):
                    if key is not None:
                        yield end()
                    key, queries, work, pending, size = (b[lo], s[lo]), [], None, [], 0
                part = table.slice(lo, hi - lo)
                if side[lo] == 0:
                    queries.append(part)
                elif queries:
                    work = work or begin()
                    for at in range(0, part.num_rows, TILE):
                        pending.append(part.slice(at, TILE))
                        size += pending[-1].num_rows
                        if size >= TILE:
                            tile()
                            pending, size = [], 0
        if key is not None:
            yield end()

    return map_batches(dealt, run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query; each task keeps no more than k of a query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each row whose id every divides.

    Exact: the bounds of the int8 tiles leave out no pair that could count. Ties go to
    the smaller id, and a query is no candidate of its own. Rows with a null id and
    vectors that are null, zero, or hold null or non-finite components take no part.
    Vectors must share one length. Queries with fewer candidates get all of them;
    rows that repeat an id and vector count as often as they are there. Without a
    query the result is empty. Other columns of df play no part.
    """
    rows = usable(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))

    def per_block(ids, q):
        held, heaps = Quantised(q), Heaps(ids, k)
        return (lambda x, of: search_tile(q, held, heaps, x, of)), heaps.rows

    return best(block_join(rows, F.col("vec_id") % every == 0, per_block, k, "double"), k)
