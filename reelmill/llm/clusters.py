"""Centroid clustering (Lloyd's rounds) of integer vectors with block-norm screening.

Vectors and centroids are cut into segments. Of each segment the mean and the norm of
what the mean leaves are kept: by the Cauchy-Schwarz inequality, two segments are at
least as far apart as these say. The sum over segments is a lower bound of a
distance from a compressed vector and a compressed centroid; only centroids whose
bound does not exceed the best exact distance so far are computed exactly, in integers.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import _arrow, checkpoint, map_batches, written

#: Components up to here leave sums of 2**16 squares of differences in 64 bits; beyond, Python's integers take over.
SAFE = 1 << 22
#: The largest long: distances beyond are given as this.
MOST = (1 << 63) - 1
#: Vectors that a task turns into matrices at once.
ROWS = 1 << 13


@dataclass(frozen=True)
class Clustering:
    """k centroids over rounds; dims: components of a vector; segment: components of a segment; scale: what a unit becomes."""

    k: int = 8
    rounds: int = 10
    dims: int = 64
    segment: int = 4
    scale: int = 1024
    seed: str = "3"


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly where the product leaves the doubles' range."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: as int64, or as Python's integers if one is large."""
    with np.errstate(over="ignore"):
        y = np.floor(vectors * float(scale))
    if not len(y) or np.abs(y).max() <= SAFE:
        return y.astype(np.int64)
    return np.array([[whole(v, scale) for v in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def segments(x: np.ndarray, size: int) -> np.ndarray:
    """The compressed rows: of each segment its mean times the root of its size, and the norm of the rest.

    These are distances along one direction and across it, so that plain squared
    distances of compressed rows never exceed those of the rows but for rounding.
    """
    if x.dtype == object:
        # no component moves away from another by this, and so no distance grows
        x = np.clip(x, -(10**300), 10**300)
    x = x.astype(np.float64)
    cuts = range(0, x.shape[1], size)
    mean = [x[:, c : c + size].mean(1) for c in cuts]
    rest = [np.sqrt(((x[:, c : c + size] - m[:, None]) ** 2).sum(1)) for c, m in zip(cuts, mean, strict=True)]
    root = [math.sqrt(min(size, x.shape[1] - c)) for c in cuts]
    return np.stack([m * r for m, r in zip(mean, root, strict=True)] + rest, axis=1) if len(root) else np.zeros((len(x), 0))


class Screen:
    """Centroids (rows of integers) and their compressed form."""

    def __init__(self, centroids: list[list[int]], size: int) -> None:
        large = max((abs(c) for row in centroids for c in row), default=0) > SAFE
        self.exact = np.array(centroids, object if large else np.int64).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        with np.errstate(over="ignore", invalid="ignore"):
            self.short = segments(self.exact, size)
        #: Pairs that were bounded, and pairs that were computed.
        self.seen = self.computed = 0

    def distances(self, x: np.ndarray, k: int) -> np.ndarray:
        y = x - self.exact[k]
        return (y * y).sum(1)

    def nearest(self, x: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row of x, whose compressed form is short; ties go to the smaller number."""
        n, k = len(x), len(self.exact)
        with np.errstate(over="ignore", invalid="ignore"):
            mine, own = (short * short).sum(1)[:, None], (self.short * self.short).sum(1)
            # rounding takes at most a small share of what is added up
            bound = mine + own - 2.0 * (short @ self.short.T) - 1e-9 * (mine + own)
        bound = np.where(np.isfinite(bound), bound, -np.inf)  # no bound, and so nothing to leave out
        first = bound.argmin(1)
        kind = object if x.dtype == object or self.exact.dtype == object else np.int64
        cluster, best, reach = first.copy(), np.empty(n, kind), np.empty(n)
        for c in np.unique(first).tolist():
            at = np.flatnonzero(first == c)
            best[at] = self.distances(x[at], c)
        self.seen, self.computed = self.seen + n * k, self.computed + n
        for c in range(k):
            reach[:] = [float(min(b, 1 << 1000)) for b in best] if kind is object else best
            at = np.flatnonzero((bound[:, c] <= reach) & (first != c))
            if not len(at):
                continue
            d = self.distances(x[at], c)
            self.computed += len(at)
            closer = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
            best[at[closer]], cluster[at[closer]] = d[closer], c
        return cluster, best


def sums(x: np.ndarray, cluster: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(count, componentwise sums as Python's integers) of each cluster that has rows."""
    made = {}
    for c in np.unique(cluster).tolist():
        rows = x[cluster == c]
        made[c] = (len(rows), [int(v) for v in rows.sum(0)])
    return made


def kept_vectors(df: DataFrame, s: Clustering, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>) of the rows whose vector has s.dims components, none null or non-finite."""
    vec = F.col(vec_col).cast("array<double>")
    fine = (F.size(vec) == s.dims) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(vec.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))


def _matrices(batches, s: Clustering):
    """(ids, integers, compressed rows) of batches, ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = lambda c, p=part: p.column(c).flatten().to_numpy(zero_copy_only=False).reshape(p.num_rows, -1)
            yield part.column("vec_id"), integers(flat("vec"), s.scale), flat("short")


def first_centroids(rows: DataFrame, s: Clustering) -> list[list[int]]:
    """The s.k vectors of least hash of their id, in the order of hashes; of repeated ids, the least vectors first."""
    order = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[whole(x, s.scale) for x in r.vec] for r in rows.select(order.alias("h"), "vec").orderBy("h", "vec").limit(s.k).collect()]


def compressed(rows: DataFrame, s: Clustering) -> DataFrame:
    """rows with short, the compressed vectors, computed once and written."""
    schema = "vec_id long, vec array<double>, short array<double>"
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                with np.errstate(over="ignore", invalid="ignore"):
                    short = segments(integers(flat, s.scale), s.segment)
                places = pa.array(np.arange(0, short.size + 1, max(1, short.shape[1])), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vec"), pa.ListArray.from_arrays(places, pa.array(short.ravel()))], schema=arrow)

    return written(map_batches(rows, run, schema))


def moved(table: DataFrame, centroids: list[list[int]], s: Clustering) -> tuple[list[list[int]], int, int]:
    """(centroids after one round, pairs bounded, pairs computed).

    A task adds up its own rows; what it gives is a row a centroid, and these meet by
    centroid, as decimal texts that no sum overflows.
    """
    schema = "cluster int, n long, sums array<string>, seen long, computed long"
    arrow = _arrow(table.sparkSession, schema)
    held = table.sparkSession.sparkContext.broadcast(centroids)

    def rows_of(total: dict, seen: int, computed: int) -> pa.RecordBatch:
        keys = sorted(total)
        first = [i == 0 for i in range(len(keys))]
        columns = [keys, [total[c][0] for c in keys], [[str(v) for v in total[c][1]] for c in keys], [seen * f for f in first], [computed * f for f in first]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def merged(total: dict, more: dict) -> None:
        for c, (n, own) in more.items():
            if c in total:
                total[c] = (total[c][0] + n, [a + b for a, b in zip(total[c][1], own, strict=True)])
            else:
                total[c] = (n, own)

    def partial(batches):
        screen, total = Screen(held.value, s.segment), {}
        for _, x, short in _matrices(batches, s):
            merged(total, sums(x, screen.nearest(x, short)[0]))
        yield rows_of(total, screen.seen, screen.computed)

    def final(batches):
        total, seen, computed = {}, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                merged(total, {r["cluster"]: (r["n"], [int(v) for v in r["sums"]])})
                seen, computed = seen + r["seen"], computed + r["computed"]
        yield rows_of(total, seen, computed)

    found = map_batches(map_batches(table, partial, schema).repartition(len(centroids), "cluster"), final, schema).collect()
    new = [list(c) for c in centroids]
    for r in found:
        new[r.cluster] = [int(v) // r.n for v in r.sums]
    return new, sum(r.seen for r in found), sum(r.computed for r in found)


def assigned(table: DataFrame, centroids: list[list[int]], s: Clustering) -> DataFrame:
    """(vec_id, cluster, distance) of each row of table."""
    schema = "vec_id long, cluster int, distance long"
    arrow = _arrow(table.sparkSession, schema)
    held = table.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        screen = Screen(held.value, s.segment)
        for ids, x, short in _matrices(batches, s):
            cluster, best = screen.nearest(x, short)
            if best.dtype == object:
                best = np.array([min(int(b), MOST) for b in best], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], schema=arrow)

    return map_batches(table, run, schema)


def fitted_centroids(df: DataFrame, s: Clustering = Clustering(), id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]], float]:
    """(the compressed table, the centroids after all rounds, the share of pairs that the bounds left out)."""
    table = compressed(kept_vectors(df, s, id_col, vec_col), s)
    centroids, seen, computed = first_centroids(table, s), 0, 0
    if centroids:
        for _ in range(s.rounds):
            centroids, more, exact = moved(table, centroids, s)
            seen, computed = seen + more, computed + exact
    return table, centroids, 1 - computed / seen if seen else 0.0


def clustered(df: DataFrame, s: Clustering = Clustering(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept.

    Vectors without s.dims components, or with one that is null or not finite, are left
    out; rows that repeat a vector or an id each count, and rows with a null id are
    clustered too. With fewer vectors than s.k there are as many centroids as vectors;
    without any, no rows. All finite components are taken exactly, whatever their size;
    distances and their sums that exceed a long are given as the largest one. Driver
    and tasks hold s.k centroids; other columns of df play no part.
    """
    table, centroids, _ = fitted_centroids(df, s, id_col, vec_col)
    found = checkpoint(assigned(table, centroids, s))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids]
    # a row a centroid
    inertias = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("own")).collect()
    total = min(sum(int(r.own) for r in inertias), MOST)
    made = [(r.cluster, min(int(r.own), MOST), total, digests[r.cluster]) for r in inertias]
    about = df.sparkSession.createDataFrame(made, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
