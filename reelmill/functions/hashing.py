"""Order and chance from hashes: the same on every run, on any number of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed, *parts) -> Column:
    """64 hex digits that order rows as if shuffled; enough wherever only the order counts."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("\x00", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def stable_rank(seed, *parts) -> Column:
    """The first 8 bytes of that hash as an unsigned number, decimal(20,0)."""
    return F.conv(F.substring(order_key(seed, *parts), 1, 16), 16, 10).cast("decimal(20,0)")


def below_share(rank: Column, share: float) -> Column:
    """Whether a stable rank falls into the given share of all ranks."""
    return rank.cast("double") / F.lit(2.0**64) < F.lit(share)


def hash_byte(key: Column, i: int) -> Column:
    """The i-th byte of an order key."""
    return F.conv(F.substring(key, 2 * i + 1, 2), 16, 10).cast("int")


def numbered(rows: DataFrame, key: tuple[str, ...], rank: Column, digits: int = 3, out: str = "nth") -> DataFrame:
    """rows with their place, from 1, in the order of rank (a text) within their key.

    Rows are first counted by key and the first digits of rank: the places before such a
    bucket are a sum over a small table, and only a bucket's rows are put in order by one
    task, however many rows a key has.
    """
    own = rows.columns
    made = rows.withColumns({"__rank": rank, "__bucket": F.left(rank, F.lit(digits))})
    sizes = made.groupBy(*key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy(*key).orderBy("__bucket") if key else Window.orderBy("__bucket")
    sizes = sizes.withColumn("__before", F.sum("__n").over(by) - F.col("__n")).drop("__n")
    joined = made.alias("r").join(sizes.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*key, "__bucket")])
    within = F.row_number().over(Window.partitionBy(*[F.col(f"r.{c}") for c in (*key, "__bucket")]).orderBy("__rank"))
    return joined.withColumn(out, within + F.col("__before")).select(*[F.col(f"r.{c}") for c in own], out)
