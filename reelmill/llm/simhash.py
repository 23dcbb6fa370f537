"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two
fingerprints within the radius of each other share a variant, so a shuffle on
variants brings all links together. Members of one variant are few, however many
documents share a fingerprint: no more than lie within half the radius of it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import checkpoint, map_texts, texts
from reelmill.llm.components import connected_components

BITS = 64
#: Shingles whose bits are counted at once; bounds the memory that a very long text takes.
STEP = 1 << 16


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 if it has no word."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    hash64, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        some = parts[at : min(at + STEP, n) + words - 1]
        if n == 1:
            joined = [b" ".join(some)]
        else:
            joined = map(b" ".join, zip(*(some[i:] for i in range(words))))
        h = np.fromiter((hash64(s, seed) for s in joined), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def majority(hashes: np.ndarray) -> int:
    """The signed SimHash of 64-bit hashes: the bits that over half of them have; 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for every row of df."""
    return map_texts(texts(df, id_col, text_col), lambda t: (fingerprint(t, words, seed),), "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """The signed 64-bit masks with at most radius bits set."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def half_variants(fp: Column) -> Column:
    """The variants within one bit of each half of fp, a half's number above its 32 bits.

    Fingerprints within five bits of each other have a half within two, and so share a
    variant: 66 of them do what the ball of 64 bits would need 43,745 for.
    """
    words = [F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(half << 32)) for half in (0, 1)]
    return F.array(*[w.bitwiseXOR(F.lit(m)) for w in words for m in (0, *(1 << b for b in range(32)))])


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps (fp, distinct) -> verified links (a, b) that join all fingerprints within radius bits, directly or over others.

    A variant's members are chained in order instead of paired. With an even radius
    all of them are within it of each other; with an odd one the chain is cut at
    pairs beyond it, and so all pairs of the (bounded) variant are compared.
    """
    half = (radius + 1) // 2
    variants = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in ball(half)])).alias("variant"))
    if radius % 2 == 0:
        pairs = variants.select(F.min("fp").over(Window.partitionBy("variant")).alias("a"), F.col("fp").alias("b")).where("a <> b")
    else:
        sets = variants.groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("s")).where("size(s) > 1")
        pairs = sets.select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3, seed: int = 42
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of df.

    Texts: null counts as empty; texts without a word have fingerprint zero and link
    like any other. Repeated rows come back as often as they are there. component_id
    is the smallest doc_id that links reach, over any number of links; rows with a
    null doc_id link too, and their component_id is null only if no other id is in
    reach. An empty df gives no rows; other columns of df play no part.
    """
    docs = checkpoint(fingerprints(df, id_col, text_col, words, seed))
    first = checkpoint(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(first.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each class of classes (doc_id, component_id): that of the smallest id (of rows that share it, the least text).

    Rows with a null id can't be told apart by it and stay.
    """
    own = df.columns
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    ranked = df.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("__kept_id"), "left_semi")
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))).where("__rank = 1")
    return ranked.select(*own).unionByName(df.where(F.col(id_col).isNull()))
