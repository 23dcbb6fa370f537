"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import _arrow, map_batches, sliced, texts

#: ASCII but letters parts words; text is lower-cased before.
_PARTS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Words whose features are taken at once; bounds the memory that a very long text takes.
STEP = 1 << 18


@dataclass(frozen=True)
class ToxicitySettings:
    """bits: hashed features are 2**bits. most_rows and most_bytes: the bounds of the labelled sample
    that is fitted, in rows and, on average over ids, in bytes of text.

    alpha and beta set the per-coordinate rates, l1 and l2 the penalties. lift counts
    toxic rows so many times. Rows at threshold or above are predicted toxic.
    """

    bits: int = 20
    most_rows: int = 24_000
    most_bytes: int = 128 << 20
    epochs: int = 6
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.2
    lift: float = 4.0
    threshold: float = 0.7


class _Hashes(dict):
    """A word's 32-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def hashed(text: str, bits: int, hashes: dict):
    """The hashed features of a text with repeats, some at a time: words, pairs of neighbours, pairs around a word."""
    words, turn, shift = text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).split(), np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    for at in range(0, len(words), STEP):
        h = np.fromiter(map(hashes.__getitem__, words[at : at + STEP + 2]), np.uint64)
        pairs = h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA6B) + np.uint64(1)
        skips = h[:-2] * np.uint64(0xC2B2AE35) + h[2:] * np.uint64(0x27D4EB2F) + np.uint64(2)
        yield (np.concatenate([h, pairs, skips]) * turn >> shift).astype(np.uint32)


def features(text: str, bits: int, hashes: dict) -> np.ndarray:
    """The distinct hashed features of a text."""
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *hashed(text, bits, hashes)]))


def weight_of(text: str, bits: int, hashes: dict, dense: np.ndarray) -> float:
    """The sum of the weights of a text's distinct features; few have one, and only those are made distinct."""
    held = [f[dense[f] != 0] for f in hashed(text, bits, hashes)]
    return float(dense[np.unique(np.concatenate(held))].sum()) if held else 0.0


class Ftrl:
    """FTRL-proximal: each coordinate has its own rate, and weights below the L1 penalty are zero."""

    def __init__(self, s: ToxicitySettings) -> None:
        self.s, self.z, self.n = s, np.zeros(2**s.bits), np.zeros(2**s.bits)
        self.bias_z = self.bias_n = 0.0

    def _weights(self, z, n, l1):
        s = self.s
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        s, z, n = self.s, self.z[at], self.n[at]
        w, b = self._weights(z, n, s.l1), float(self._weights(self.bias_z, self.bias_n, 0.0))
        g = (sigmoid(b + w.sum()) - label) * (s.lift if label else 1.0)
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / s.alpha * b
        self.bias_n += g * g

    def model(self) -> tuple[float, np.ndarray, np.ndarray]:
        """(bias, coordinates, weights) without zeros."""
        w = self._weights(self.z, self.n, self.s.l1)
        at = np.flatnonzero(w)
        return float(self._weights(self.bias_z, self.bias_n, 0.0)), at.astype(np.uint32), w[at]


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def held_out(id_col):
    """Whether a row is kept from learning: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: ToxicitySettings = ToxicitySettings()) -> tuple[float, np.ndarray, np.ndarray]:
    """The sparse weights learned from a sample of at most s.most_rows labelled rows that are not held out, with about s.most_bytes of text at most.

    The sample takes ids by their hash, so that it is the same on every run. Features
    are made in parallel; one task reads the bounded sample and learns. No usable
    label gives a model without weights, whose scores are all 0.5.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    # labels without a document go first: what is broadcast below is a share of the labels that meet one
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).join(ids, "doc_id", "left_semi")
    # rows that repeat an id count, too; no text leaves its task here
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("bytes")).join(known, "doc_id")
    rows, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if not rows:
        return 0.0, np.zeros(0, np.uint32), np.zeros(0)
    # a share whose sample stays under the bound of rows by six deviations, and under that of bytes on average
    share = min(1.0, max(0.0, s.most_rows - 6 * s.most_rows**0.5) / rows, s.most_bytes / max(size, 1))
    known = known.withColumn("order", F.xxhash64("doc_id")).where(F.col("order") < -(2**63) + int(share * 2**64) if share < 1 else F.lit(True))
    sample = texts(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")
    made = _arrow(docs.sparkSession, "at long, weight double")

    def featured(batches):
        hashes = _Hashes()
        for b in sliced(batches):
            at = [features(t, s.bits, hashes).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("toxic"), pa.array(at, pa.binary())], ["order", "toxic", "at"])

    def learned(batches):
        seen = []
        for b in sliced(batches, "at"):
            seen += zip(b.column("toxic").to_pylist(), (np.frombuffer(x, np.uint32) for x in b.column("at").to_pylist()), strict=True)
        model = Ftrl(s)
        for epoch in range(s.epochs):
            for k in np.random.default_rng(epoch).permutation(len(seen)):
                model.learn(seen[k][1], seen[k][0])
        bias, at, weight = model.model()
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()]), pa.array([bias, *weight.tolist()])], schema=made)

    # the order of learning is the sort's, whatever order the rows come in
    drawn = map_batches(sample, featured, "order long, toxic int, at binary").repartition(1).sortWithinPartitions("order", "toxic", "at")
    rows = map_batches(drawn, learned, "at long, weight double").collect()
    if not rows:
        return 0.0, np.zeros(0, np.uint32), np.zeros(0)
    rows.sort()
    return rows[0].weight, np.array([r.at for r in rows[1:]], np.uint32), np.array([r.weight for r in rows[1:]])


def score_texts(df: DataFrame, model: tuple, s: ToxicitySettings = ToxicitySettings(), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the score of each text, 0 to 1; a null text counts as empty and has the bias' score.

    The weights are broadcast: there are 2**bits at most, whatever the input's size.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    held = df.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())])
    arrow, place = to_arrow_schema(out), df.columns.index(text_col)

    def run(batches):
        bias, at, weight = held.value
        dense, hashes = np.zeros(2**s.bits), _Hashes()
        dense[at] = weight
        for b in sliced(batches, place):
            scores = [sigmoid(bias + weight_of(t or "", s.bits, hashes, dense)) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], schema=arrow)

    return map_batches(df, run, out)


def toxicity(docs: DataFrame, labels: DataFrame, s: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Texts alone are scored: null counts as empty, repeated rows come back as often as
    they are there, a null id counts as not held out, and other columns play no part.
    """
    scored = score_texts(texts(docs, "doc_id", "text"), fit(docs, labels, s), s)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= s.threshold, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, s: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """docs without the rows whose text is predicted toxic.

    Null and empty texts have the bias' score and stay unless that is predicted toxic;
    null ids and repeated rows are judged like any other. An empty table stays empty.
    """
    return score_texts(docs, fit(docs, labels, s), s, score_col="__score").where(F.col("__score") < s.threshold).drop("__score")
