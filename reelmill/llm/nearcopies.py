"""Near copies at a similarity of 0.8: SimHash balls first, then whatever they can't reach, exactly.

A text is the set of its five-word shingles. Its SimHash has two halves; every half
emits all its variants within one bit, so that fingerprints within five bits of each
other, which have one half within two, meet at a variant. Each member is compared
with one other there, on whole sets. Texts alike to 0.8 differ in ten bits of 64 on
average, and so balls that are small enough to emit find some links only. The rest
come from prefixes: two sets alike to s share s of the larger one at least, so that
in any order common to all they share a shingle within the first 1 - s of each. Only
those prefixes are shuffled, and no pair is missed. The order puts shingles first
that the counts of all documents call rare, so that a passage in many texts brings
few together; the order decides the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import TASK_ROWS, _arrow, checkpoint, freed, map_batches, may_match, settled, sliced, texts, written
from reelmill.llm.components import connected_components
from reelmill.llm.shingles import shingle_sets
from reelmill.llm.simhash import half_variants, majority

#: Counters of shingles, and rows that they are summed in; strangers of a block of pairs, and members that they are compared with.
SLOTS, PARTS, BLOCK, CHUNK = 1 << 20, 64, 256, 4096
#: Bits that linked fingerprints may differ in: two in one half at most, by the halves' balls.
RADIUS = 5
#: Variants that a fingerprint emits: each half, and each half with one bit changed.
VARIANTS = 66


def least_shared(n: int, similarity: float) -> int:
    """The shingles of n that a set alike to similarity shares at least."""
    return ceil(n * Fraction(str(similarity)))


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def shingle_counts(own: DataFrame) -> np.ndarray:
    """How many texts of all have a shingle of each slot: SLOTS counters, whatever the input's size."""
    schema = "part int, counts binary"
    arrow, width = _arrow(own.sparkSession, schema), SLOTS // PARTS

    def batch_of(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        rows = [pa.array(list(counts), pa.int32()), pa.array([c.tobytes() for c in counts.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(rows, schema=arrow)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in sliced(batches):
            total += np.bincount(_slot(np.concatenate([np.zeros(0, np.int64), *shingle_sets(batch.column("text"))])), minlength=SLOTS)
        few = np.minimum(total, 65535).astype(np.uint16)  # a task's count beyond that is as good as any
        yield batch_of({p: few[p * width : (p + 1) * width] for p in range(PARTS)})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, np.zeros(width, np.uint64)) + np.frombuffer(counts, np.uint16)
        yield batch_of(sums)

    with freed(own.sparkSession):
        rows = map_batches(map_batches(own.select("text"), counted, schema).repartition(PARTS, "part"), summed, schema).orderBy("part").collect()
    found = {r.part: np.frombuffer(bytes(r.counts), np.uint64) for r in rows}
    return np.concatenate([found.get(p, np.zeros(width, np.uint64)) for p in range(PARTS)])


def _alike(shared: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m elements with so many in common are alike: shared / (n + m - shared) >= similarity, in whole numbers."""
    s = Fraction(str(similarity))
    return shared * (s.numerator + s.denominator) >= (n + m) * s.numerator


def _may_be(a: str, b: str, similarity: float) -> Column:
    """Whether rows of one shingle may be the first one that an alike pair shares: by sizes, and by what is left after their places."""
    c = lambda side, col: F.col(f"{side}.{col}").cast("long")
    return _alike(1 + F.least(c(a, "n") - c(a, "pos") - 1, c(b, "n") - c(b, "pos") - 1), c(a, "n"), c(b, "n"), similarity)


def near_copies(df: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row of df: texts that near copies link, over any number of links, share the smallest id.

    Two texts are near copies if the Jaccard similarity of their shingle sets is
    similarity or more; equal sets link without a comparison, so that copies meet as
    one. Null and empty texts count as equal. A null id stays null; an empty df gives
    no rows; other columns of df play no part.
    """
    docs = texts(df, id_col, text_col).withColumn("key", F.xxhash64("text"))
    sets = written(_prefixes(docs, similarity))
    ids = settled(sets.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "key")).alias("rep"), F.min("n").alias("n"), F.min("sim").alias("sim")))
    rows = sets.groupBy("fp").agg(F.min("n").alias("n"), F.min("prefix").alias("prefix")).select("fp", "n", F.posexplode("prefix").alias("pos", "shingle"))
    met = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("size > 1")
    links = _links(settled(met), ids, docs, similarity)
    rooted = ids.select("fp", "first").join(_components(links), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return sets.select("doc_id", "fp").join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def _prefixes(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, key, fp, n, sim, prefix) of docs (doc_id, text, key): a set's own hash, its size, its SimHash and its rarest shingles."""
    schema = "doc_id long, key long, fp long, n long, sim long, prefix array<long>"
    arrow = _arrow(docs.sparkSession, schema)
    held = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in sliced(batches):
            made = []
            for s in shingle_sets(batch.column("text")):
                rare = s[np.lexsort((s, counts[_slot(s)]))][: len(s) - least_shared(len(s), similarity) + 1]
                made.append((int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)), len(s), majority(s), rare))
            columns = [pa.array([r[i] for r in made], arrow.field(i + 2).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], schema=arrow)

    return map_batches(docs.select("doc_id", "key", "text"), run, schema)


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("fp"), "root")


def _links(met: DataFrame, ids: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """met (fp, n, pos, shingle, size) -> links (a, b) that join all alike pairs, directly or over others.

    Members of a ball and of a prefix's shingle are first compared with the member that
    meets most others; after that, all pairs that meet at a shingle and are still in
    different components are compared, in blocks. Nothing that meets is left out.
    """
    # a text that others are copies of meets more of them than they meet each other
    nodes = settled(met.groupBy("fp").agg(F.sum("size").alias("popular")).join(ids.select("fp", "n", "sim", "rep"), "fp"))
    group = Window.partitionBy("shingle")
    hubs = met.join(nodes.select("fp", "popular"), "fp").withColumn("hub", F.max(F.struct("popular", "fp", "n", "pos")).over(group)).where("fp <> hub.fp")
    hubs = hubs.select(F.struct("fp", "n", "pos").alias("x"), F.col("hub").alias("y")).where(_may_be("x", "y", similarity))
    # dealt by the rows to come: a table of one task would emit and sort all variants in that task
    dealt = nodes.repartition(nodes.count() * VARIANTS // TASK_ROWS + 1, "fp")
    balls = dealt.select("fp", "n", "sim", "popular", F.explode(half_variants(F.col("sim"))).alias("variant"))
    balls = balls.withColumn("hub", F.max(F.struct("popular", "fp", "n", "sim")).over(Window.partitionBy("variant"))).where("fp <> hub.fp")
    near = F.bit_count(F.col("sim").bitwiseXOR(F.col("hub.sim"))) <= RADIUS
    balls = balls.where(near & _alike(F.least("n", "hub.n"), F.col("n"), F.col("hub.n"), similarity))
    pairs = hubs.select("x.fp", F.col("y.fp").alias("hub")).unionByName(balls.select("fp", F.col("hub.fp").alias("hub")))
    pairs = settled(pairs.distinct())
    whole = _whole(pairs, nodes, docs)
    seen = settled(_compared(pairs, whole, similarity))
    links = seen.where("alike").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    rest = settled(_rest(met, seen, _components(links), similarity))
    more = _whole(rest, nodes.join(whole.select("fp"), "fp", "left_anti"), docs).unionByName(may_match(whole, "fp", _ends(rest), "fp"))
    found = _compared(rest, more, similarity).where("alike").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return links.unionByName(found)


def _rest(met: DataFrame, seen: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The pairs (fp, hub) that meet, may be alike, and neither share a component of roots nor were seen.

    Of a shingle's members most share one root, as a rule. Only those outside of the
    largest root are compared with the others: a stranger in a group of a million copies
    makes a million rows, not their square. Strangers lie in blocks of BLOCK, all members
    in blocks of CHUNK, and each pair of blocks is a key of the join.
    """
    rooted = met.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).select("fp", "n", "pos", "root", "shingle")
    rooted = checkpoint(rooted)
    by_root = rooted.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n_root"))
    groups = by_root.groupBy("shingle").agg(F.max(F.struct("n_root", "root")).alias("most"), F.sum("n_root").alias("size"), F.count(F.lit(1)).alias("n_roots")).where("n_roots > 1")
    ceil_ = lambda c, by: F.ceil(c / by).cast("int")
    groups = groups.select("shingle", F.col("most.root").alias("main"), ceil_(F.col("size") - F.col("most.n_root"), BLOCK).alias("blocks"), ceil_(F.col("size"), CHUNK).alias("chunks"))
    mixed = checkpoint(rooted.join(groups, "shingle").withColumn("strange", F.col("root") != F.col("main")))
    strange, made = F.col("strange"), F.when(F.col("strange"), F.col("chunks")).otherwise(0) + F.col("blocks")
    parts = (mixed.agg(F.sum(made)).first()[0] or 0) // TASK_ROWS + 1
    deal = lambda salt, of: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    own = ["fp", "n", "pos", "root", "shingle", "strange"]
    dealt = mixed.repartition(parts, "fp", "shingle")
    x = dealt.where(strange).select(*own, deal(1, "blocks").alias("i"), every("chunks").alias("j"))
    y = dealt.select(*own, every("blocks").alias("i"), deal(2, "chunks").alias("j"))
    meet = " and ".join(f"x.{c} = y.{c}" for c in ("shingle", "i", "j")) + " and x.root <> y.root and (not y.strange or x.fp < y.fp)"
    pairs = x.alias("x").join(y.alias("y"), F.expr(meet) & _may_be("x", "y", similarity))
    done = seen.select(F.least("fp", "hub").alias("fp"), F.greatest("fp", "hub").alias("hub"))
    return pairs.select(F.least("x.fp", "y.fp").alias("fp"), F.greatest("x.fp", "y.fp").alias("hub")).distinct().join(done, ["fp", "hub"], "left_anti")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("fp").unionByName(pairs.select(F.col("hub").alias("fp"))).distinct()


def _whole(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, shingles): the whole sets of the nodes (fp, rep) that are in pairs, from the text of one document each."""
    schema = "fp long, shingles array<long>"
    arrow = _arrow(docs.sparkSession, schema)
    needed = settled(_ends(pairs).join(nodes, "fp").select("fp", "rep.doc_id", "rep.key"))
    same = (F.col("o.key") == F.col("w.key")) & F.col("o.doc_id").eqNullSafe(F.col("w.doc_id"))
    own = may_match(docs, "key", needed, "key").alias("o").join(needed.alias("w"), same).select("w.fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(list(shingle_sets(batch.column("text"))), arrow.field(1).type)], schema=arrow)

    return written(map_batches(own, run, schema).dropDuplicates(["fp"]))


def _compared(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """pairs (fp, hub) with alike: whether the Jaccard similarity of their whole sets reaches similarity."""
    one, other = whole.select("fp", F.col("shingles").alias("s")), whole.select(F.col("fp").alias("hub"), F.col("shingles").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    return pairs.join(one, "fp").join(other, "hub").select("fp", "hub", _alike(shared, F.size("s"), F.size("t"), similarity).alias("alike"))
