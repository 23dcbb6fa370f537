"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt to stripes, and each stripe has one cover tree, which serves all queries
of a large block; queries are indexed by trees of their own. A node has a centre among
its points, a covering radius and the widest angle to its centre; its children's centres
are a net of its points, taken farthest first: the first is the node's own centre, every
point is within the net's radius of one, and no two are closer to each other than that.
A pair of nodes is dropped when the largest inner product that its centres, radii and
angles allow is below the worst k-th score of the node's queries. A first pass over one
stripe gives all queries a k-th score to begin the others with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.ann import Heaps, best, usable
from reelmill.llm.clusters import MOST, whole
from reelmill.llm.common import _arrow, checkpoint, map_batches, written

#: Children of a node at most, the points of a leaf, and the rows that a leaf of queries is multiplied with first, before ever more.
NET, LEAF, ROUND = 8, 4, 64
#: Pairs of nodes that are bounded at once.
PAIRS = 1 << 13
#: Components of a stripe's rows on average; queries of a group in the first pass and in the second, and of a tree.
STRIPE, FIRST, SECOND, BLOCK = 1 << 18, 256, 1 << 16, 1024


class CoverTree:
    """The cover tree of x's rows as arrays: node i has the points order[begin[i]:end[i]] and the children first[i] to last[i].

    A node whose points are all alike is a leaf, however many they are.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.order = x, np.arange(len(x))
        if not len(x):
            self.begin = self.end = self.first = self.last = self.size = np.zeros(0, np.int64)
            return
        centre, radius, self.begin, self.end, self.first, self.last = [0], [0.0], [0], [len(x)], [0], [0]
        at = 0
        while at < len(centre):
            lo, hi = self.begin[at], self.end[at]
            points, net, owner, far = self._net(self.order[lo:hi], centre[at])
            radius[at] = far
            self.first[at] = self.last[at] = len(centre)
            if len(net) > 1:
                by_owner = np.argsort(owner, kind="stable")
                self.order[lo:hi] = points[by_owner]
                ends = lo + np.cumsum(np.bincount(owner, minlength=len(net)))
                centre += net
                radius += [0.0] * len(net)
                self.begin += [lo, *ends[:-1].tolist()]
                self.end += ends.tolist()
                self.first += [0] * len(net)
                self.last += [0] * len(net)
                self.last[at] = len(centre)
            at += 1
        self.centre, self.radius = x[centre], np.array(radius)
        self.begin, self.end = np.array(self.begin), np.array(self.end)
        self.first, self.last = np.array(self.first), np.array(self.last)
        self.leaf, self.size = self.first == self.last, self.end - self.begin
        norms = np.sqrt((x * x).sum(1))
        self.norm = norms[centre]
        self.top = np.array([norms[self.order[b:e]].max(initial=0.0) for b, e in zip(self.begin, self.end, strict=True)])
        self.angle = np.array([self._widest(i, norms) for i in range(len(centre))])

    def _net(self, points: np.ndarray, centre: int) -> tuple[np.ndarray, list[int], np.ndarray, float]:
        away = self.x[points] - self.x[centre]
        far = np.sqrt((away * away).sum(1))
        radius, net, owner = float(far.max(initial=0.0)), [centre], np.zeros(len(points), np.int64)
        if len(points) > LEAF and radius > 0:
            while len(net) < NET and far.max() > radius / 2:
                net.append(int(points[int(far.argmax())]))
                away = self.x[points] - self.x[net[-1]]
                to_new = np.sqrt((away * away).sum(1))
                owner[to_new < far] = len(net) - 1
                far = np.minimum(far, to_new)
        return points, net, owner, radius

    def _widest(self, i: int, norms: np.ndarray) -> float:
        """The widest angle between the centre and a point; that of a straight line where either has no direction."""
        own = self.order[self.begin[i] : self.end[i]]
        if self.norm[i] == 0 or not len(own) or norms[own].min() == 0:
            return math.pi
        return float(np.arccos(np.clip(self.x[own] @ self.centre[i] / (norms[own] * self.norm[i]), -1.0, 1.0)).max())

    def points(self, nodes: np.ndarray) -> np.ndarray:
        """The points of some leaves, in the order of nodes."""
        n = self.size[nodes]
        return self.order[np.repeat(self.begin[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least of the points' values in each node."""
        own = values[self.order]
        return np.array([own[b:e].min() for b, e in zip(self.begin, self.end, strict=True)])


def bounds(a: CoverTree, b: CoverTree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of a node i of a and a node j of b the largest inner product of a point of either, with room for rounding."""
    made = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        m, n = i[at : at + PAIRS], j[at : at + PAIRS]
        products = np.einsum("ij,ij->i", a.centre[m], b.centre[n])
        by_radius = products + a.radius[m] * b.norm[n] + (a.norm[m] + a.radius[m]) * b.radius[n]
        norms, tops = a.norm[m] * b.norm[n], a.top[m] * b.top[n]
        between = np.arccos(np.clip(np.divide(products, norms, out=np.ones_like(products), where=norms > 0), -1.0, 1.0))
        cosine = np.cos(np.clip(between - a.angle[m] - b.angle[n] - 1e-7, 0.0, math.pi))
        by_angle = np.where(cosine > 0, tops * cosine, 0.0)
        made[at : at + PAIRS] = np.minimum(by_radius, by_angle) + 1e-9 * (1.0 + tops + np.abs(products))
    return made


def _parted(of: CoverTree, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes (mine of the tree, other) with each inner node of the tree replaced by its children."""
    n = np.where(of.leaf[mine], 1, of.last[mine] - of.first[mine])
    start = np.repeat(np.where(of.leaf[mine], mine, of.first[mine]), n)
    return start + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(other, n)


class DualTree:
    """The searches of one block of queries (a tree of their own) in trees of rows, one after another."""

    def __init__(self, ids: list[int], queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> None:
        self.ids, self.tree, self.heaps = np.asarray(ids), CoverTree(queries), Heaps(ids, k)
        #: What a candidate must reach at least, whatever is found here.
        self.given = np.full(len(ids), -np.inf) if floors is None else floors
        #: Pairs of a query and a row that were met, those whose product was made, and pairs of nodes that were bounded.
        self.seen = self.computed = self.bounded = 0

    def floors(self, some: np.ndarray) -> np.ndarray:
        k, heaps = self.heaps.k, self.heaps.heaps
        return np.maximum(self.given[some], [heaps[i][0][0] if len(heaps[i]) == k else -np.inf for i in some.tolist()])

    def take(self, rows: CoverTree, row_ids: np.ndarray) -> None:
        q = self.tree
        self.seen += len(q.x) * len(rows.x)
        if not len(q.x) or not len(rows.x):
            return
        least = q.least(self.floors(np.arange(len(q.x))))
        a, b, pairs = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(a):
            most = bounds(q, rows, a, b)
            self.bounded += len(a)
            kept = most >= least[a]
            a, b, most = a[kept], b[kept], most[kept]
            both = q.leaf[a] & rows.leaf[b]
            pairs.append((a[both], b[both], most[both]))
            b, a = _parted(rows, b[~both], a[~both])
            a, b = _parted(q, a, b)
        a, b, most = (np.concatenate([p[i] for p in pairs]) for i in range(3))
        by_leaf = np.argsort(a, kind="stable")
        a, b, most = a[by_leaf], b[by_leaf], most[by_leaf]
        cuts = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                self._leaf(int(a[lo]), b[lo:hi], most[lo:hi], rows, row_ids)

    def _leaf(self, leaf: int, nodes: np.ndarray, most: np.ndarray, rows: CoverTree, row_ids: np.ndarray) -> None:
        """One leaf of queries against the rows' leaves that are left, the most promising first."""
        q, k = self.tree, self.heaps.k
        own = q.order[q.begin[leaf] : q.end[leaf]]
        rounds = [np.arange(len(nodes))]
        if self.floors(own).min() == -np.inf:  # nothing to begin with: the most promising rows make floors for the others
            order = np.argsort(-most, kind="stable")
            nodes, most = nodes[order], most[order]
            doubling = np.floor(np.log2(np.cumsum(rows.size[nodes]) // ROUND + 1))
            rounds = np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(doubling)) + 1)
        for some in rounds:
            floors = self.floors(own)
            some = some[most[some] >= floors.min()]
            if not len(some):
                continue
            at = rows.points(nodes[some])
            scores = q.x[own] @ rows.x[at].T
            self.computed += scores.size
            scores[self.ids[own][:, None] == row_ids[at]] = -np.inf
            if len(at) > k:
                floors = np.maximum(floors, np.partition(scores, -k, axis=1)[:, -k])
            i, j = np.nonzero((scores >= floors[:, None]) & (scores > -np.inf))
            self.heaps.add(own[i], scores[i, j], row_ids[at[j]])


def scaled(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * x) of each component, whether a row is wide): products of rows that aren't wide are exact in doubles."""
    with np.errstate(over="ignore"):
        y = np.floor(vectors * float(scale))
    limit = math.isqrt((1 << 53) // max(1, vectors.shape[1]))
    return y, ~(np.abs(y) <= limit).all(1)


class Rows:
    """A stripe's rows: the tree of the narrow ones, and the wide ones as Python's integers."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, scale: int) -> None:
        y, wide = scaled(vectors, scale)
        order = np.argsort(ids[~wide], kind="stable")
        self.narrow, self.ids = CoverTree(y[~wide][order]), ids[~wide][order]
        whole_ = lambda row: [whole(v, scale) for v in row]
        self.wide = [(i, whole_(r)) for i, r in zip(ids[wide].tolist(), vectors[wide].tolist(), strict=True)]


def search(rows: Rows, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int, scale: int) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best of each query among rows, those below its floor left out."""
    y, wide = scaled(vectors, scale)
    tree = DualTree(ids[~wide].tolist(), y[~wide], k, floors[~wide])
    tree.take(rows.narrow, rows.ids)
    product = lambda a, b: max(-MOST - 1, min(MOST, sum(x * z for x, z in zip(a, b, strict=True))))
    for i, (q, v) in enumerate(zip(ids[~wide].tolist(), y[~wide], strict=True)):
        found = [(product(map(int, v), r), n) for n, r in rows.wide if n != q]
        for score, n in found:
            tree.heaps.add(np.array([i]), np.array([score], object), np.array([n]))
    yield from ((q, n, int(s)) for q, n, s in tree.heaps.rows())
    for q, v in zip(ids[wide].tolist(), vectors[wide].tolist(), strict=True):
        own, one = [whole(x, scale) for x in v], Heaps([q], k)
        every = [(product(own, r), n) for n, r in rows.wide if n != q]
        every += [(product(own, map(int, r)), n) for n, r in zip(rows.ids.tolist(), rows.narrow.x, strict=True) if n != q]
        for score, n in every:
            one.add(np.array([0]), np.array([score], object), np.array([n]))
        yield from ((a, b, int(s)) for a, b, s in one.rows())


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1).astype(np.float64)


def _searched(data: DataFrame, queries: DataFrame, groups: int, k: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score) of each group (length, stripe, block): its rows come first and make a tree, then its queries, some at a time."""
    key = ["length", "stripe", "block"]
    none = F.lit(None).cast("double")
    sides = data.select(*key, F.lit(0).alias("side"), "vec_id", "vec", none.alias("floor")).unionByName(queries.select(*key, F.lit(1).alias("side"), "vec_id", "vec", "floor"))
    dealt = sides.repartition(groups, *key).sortWithinPartitions(*key, "side", "vec_id")
    schema = "query_id long, vec_id long, score long"
    arrow = _arrow(data.sparkSession, schema)

    def found(rows: Rows, some: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(some)
        floors = table.column("floor").fill_null(-math.inf).to_numpy()
        made = list(search(rows, table.column("vec_id").to_numpy(), _matrix(table), floors, k, scale))
        columns = zip(*made, strict=True) if made else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

    def run(batches):
        now, own, rows, pending = None, [], None, []
        for batch in batches:
            table = pa.table(batch)
            marks = np.stack([table.column(c).to_numpy() for c in (*key, "side")])
            if not table.num_rows:
                continue
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(0)) + 1).tolist(), table.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part, (*group, side) = table.slice(lo, hi - lo), marks[:, lo].tolist()
                if group != now:
                    if pending:
                        yield found(rows, pending)
                    now, own, rows, pending = group, [], None, []
                if side == 0:
                    own.append(part)
                    continue
                if rows is None and own:
                    whole_ = pa.concat_tables(own)
                    rows, own = Rows(_matrix(whole_), whole_.column("vec_id").to_numpy(), scale), []
                for at in range(0, part.num_rows if rows else 0, BLOCK):
                    pending.append(part.slice(at, BLOCK))
                    if sum(t.num_rows for t in pending) >= BLOCK:
                        yield found(rows, pending)
                        pending = []
        if pending:
            yield found(rows, pending)

    return map_batches(dealt, run, schema)


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long): the k highest integer inner products for each row whose id every divides.

    A component x becomes floor(scale * x), exactly, however large x is; products beyond
    a long count as the nearest one. Ties go to the smaller id, and a query is no
    candidate of its own. Rows with a null id and vectors that are null, empty or hold
    null or non-finite components take no part; zero vectors do. A vector meets those of
    its own length only. Queries with fewer candidates get all of them; without a query
    the result is empty. Rows that repeat an id and vector count as often as they are
    there. Other columns play no part.
    """
    rows = usable(df, id_col, vec_col).withColumn("length", F.size("vec"))
    n = rows.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    stripes = max(1, -(-n[0] // STRIPE))
    # dealt by place as well, so that rows that share an id don't share a stripe; written, as both passes must see the same stripes
    dealt = written(rows.withColumn("stripe", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(stripes)).cast("int")))
    queries = dealt.where(F.col("vec_id") % every == 0).drop("stripe")

    def searched(stripe_from: int, stripe_to: int, per_group: int, asked: DataFrame) -> DataFrame:
        blocks, many = max(1, -(-n[1] // per_group)), stripe_to - stripe_from
        every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        data = dealt.where(F.col("stripe").between(stripe_from, stripe_to - 1)).select("length", "stripe", every_block, "vec_id", "vec")
        block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block")
        every_stripe = F.explode(F.sequence(F.lit(stripe_from), F.lit(stripe_to - 1))).alias("stripe")
        return _searched(data, asked.select("length", every_stripe, block, "vec_id", "vec", "floor"), blocks * many, k, scale)

    first = checkpoint(searched(0, 1, FIRST, queries.withColumn("floor", F.lit(None).cast("double"))))
    if stripes == 1:
        return best(first, k)
    # the k-th best so far, where doubles hold it exactly; queries that share an id share their k best, too
    exact = F.when(F.abs("score") < (1 << 53), F.col("score")).cast("double")
    ranked = best(first, k).where(F.col("rank") == k).select("query_id", exact.alias("floor"))
    asked = queries.join(ranked, queries.vec_id == ranked.query_id, "left").select("length", "vec_id", "vec", "floor")
    return best(first.unionByName(searched(1, stripes, SECOND, asked)), k)
