"""Target-distribution importance resampling over hashed word runs.

A vectorised byte automaton takes the words straight from the Arrow buffers: a lookup
table classifies all bytes, differences give the words' places, and the CRC-32
registers of all words advance together, a byte a step. Buckets of both corpora are
counted over all texts; a bucket's gain is the logarithm of how much more often the
target holds it; a document's weight is the sum of its gains, and seeded Gumbel noise
turns the order of scores into a draw without replacement.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import _arrow, map_batches, sliced, texts, written
from reelmill.llm.words import Words, run_crcs, words_of

#: Words whose runs are hashed at once; bounds the memory that a very long text takes.
STEP = 1 << 18


@dataclass(frozen=True)
class Resampling:
    """Features are runs of 1 to run words, in so many buckets, each counted once more for smoothing.

    gains and noise are floors of scale times a logarithm. Of the documents with at
    least least_words words, percent of a hundred are drawn.
    """

    run: int = 1
    buckets: int = 10_000
    scale: int = 1000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def bucket_runs(words: Words, s: Resampling):
    """(numbers of first words, buckets) of all features, some at a time."""
    for lo in range(0, len(words.starts), STEP):
        for begin, crc in run_crcs(words, s.run, lo, min(lo + STEP, len(words.starts))):
            yield begin, (crc % np.uint32(s.buckets)).astype(np.int64)


def bucket_counts(own: DataFrame, s: Resampling) -> list[int]:
    """How many features of all texts each bucket holds: a task sums its own first, and no more than the buckets meet."""
    schema = "bucket int, n long"
    arrow = _arrow(own.sparkSession, schema)

    def run(batches):
        total = np.zeros(s.buckets, np.int64)
        for batch in sliced(batches):
            for _, bucket in bucket_runs(words_of(batch.column("text")), s):
                total += np.bincount(bucket, minlength=s.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=arrow)

    counts = [0] * s.buckets
    for row in map_batches(own.select("text"), run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(own: list[int], target: list[int], s: Resampling) -> np.ndarray:
    """Each bucket's gain: floor(scale * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    own_all, target_all = float(sum(own) + s.buckets), float(sum(target) + s.buckets)
    return np.array([math.floor(s.scale * math.log((t + 1.0) * own_all / ((n + 1.0) * target_all))) for n, t in zip(own, target, strict=True)], np.int64)


def weighed(own: DataFrame, gain: np.ndarray, s: Resampling) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of own (doc_id, text); gain is broadcast, a number a bucket."""
    schema = "doc_id long, n_words long, n_features long, weight long"
    arrow, held = _arrow(own.sparkSession, schema), own.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for batch in sliced(batches):
            words, n = words_of(batch.column("text")), batch.num_rows
            features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for begin, bucket in bucket_runs(words, s):
                if not len(begin):
                    continue
                text = np.searchsorted(words.first, begin, side="right") - 1
                cuts = np.append(0, np.flatnonzero(np.diff(text)) + 1)
                features[text[cuts]] += np.diff(np.append(cuts, len(text)))
                weight[text[cuts]] += np.add.reduceat(held.value[bucket], cuts)
            made = [pa.array(x, pa.int64()) for x in (np.diff(words.first), features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], schema=arrow)

    return map_batches(own.select("doc_id", "text"), run, schema)


def noise(seed: str, id_col, scale: int):
    """floor(-scale * ln(-ln(u))) for a u in (0, 1) that the seed and the id give."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def in_order(df: DataFrame, *order) -> DataFrame:
    """df with place, from 1, in the given order of all rows.

    A range sort deals the rows over tasks; each row is written with its place in its
    task, and the sizes of tasks, one number each, put the tasks behind each other.
    """
    made = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before, at = [], 0
    for row in made.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        before.append((row.part, at))
        at += row.n
    sizes = df.sparkSession.createDataFrame(before, "__part long, __before long")
    placed = made.join(F.broadcast(sizes), part == F.col("__part"))
    return placed.withColumn("place", F.col("__before") + within + 1).drop("__at", "__part", "__before")


def resampled(docs: DataFrame, target: DataFrame, s: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; rank, from 1, is null for those that aren't drawn.

    Texts: null and empty ones have no feature and a weight of zero. Ties go to the
    smaller doc_id; rows that repeat an id are drawn each by itself, and rows without
    an id, whose noise is that of an empty one, come behind all others of their score. An empty
    target gives every bucket the same count; an empty docs gives no rows. Other
    columns of either table play no part.
    """
    own = texts(docs, id_col, text_col)
    wanted = target.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(own, s), bucket_counts(wanted, s), s)
    scored = weighed(own, gain, s).withColumn("score", F.col("weight") + noise(s.seed, F.col("doc_id"), s.scale))
    scored = scored.withColumn("able", F.col("n_words") >= s.least_words)
    # the last key parts rows that are alike in all others, so that they need not meet in one task
    placed = in_order(scored, F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", F.rand(0))
    able = placed.agg(F.count(F.when(F.col("able"), 1))).first()[0]
    rank = F.when(F.col("able") & (F.col("place") <= s.percent * able // 100), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, s: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are drawn; rows with a null id can't be told apart and are left out."""
    taken = resampled(docs, target, s, id_col, text_col).where("rank is not null and doc_id is not null")
    return docs.join(taken.select(F.col("doc_id").alias("__drawn_id")).distinct(), F.col(id_col) == F.col("__drawn_id"), "left_semi")
