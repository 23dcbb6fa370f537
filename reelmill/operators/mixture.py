"""Splits, mixtures and pairs that keep groups whole and repeat on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.hashing import numbered, order_key


def group_split(rows: DataFrame, key: tuple[str, ...], val: float, test: float, seed: int, strata: tuple[str, ...] = ()) -> DataFrame:
    """rows with split (train, val or test): all rows of a key in one, by hash order within strata.

    Each wanted split gets a key at least, if a key is left for train.
    """
    both = list(dict.fromkeys([*strata, *key]))
    keys = rows.select(*both).distinct()
    sizes = keys.groupBy(*strata).agg(F.count(F.lit(1)).alias("__size"))
    keys = numbered(keys, strata, order_key(seed, *key), out="__nth").alias("k")
    keys = keys.join(sizes.alias("s"), [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in strata] or F.lit(True)).select(*[F.col(f"k.{c}") for c in both], "__nth", "__size")
    n, nth = F.col("__size"), F.col("__nth")
    some = lambda share: F.when(F.lit(share > 0), F.greatest(F.lit(1), F.bround(n * F.lit(share), 0).cast("int"))).otherwise(0)
    n_val = F.least(some(val), n - 1)
    n_test = F.least(some(test), n - 1 - n_val)
    split = F.when(nth <= n_val, "val").when(nth <= n_val + n_test, "test").otherwise("train")
    return rows.join(keys.withColumn("split", split).drop("__nth", "__size"), both)


def harmonised(canonical: DataFrame, other: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """other with the splits of canonical for the keys they share, and moved where that changed a row's split."""
    known = canonical.select(*key, F.col("split").alias("__split")).distinct()
    joined = other.join(known, list(key), "left")
    new = F.coalesce("__split", "split")
    return joined.withColumn("moved", new != F.col("split")).withColumn("split", new).drop("__split")


def leaks(a: DataFrame, b: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that are in train of one table and outside train of the other; must be empty."""
    side = lambda d: d.select(*key, (F.col("split") == "train").alias("t")).distinct()
    return side(a).alias("a").join(side(b).alias("b"), list(key)).where("a.t <> b.t").select(*key).distinct()


def resampled(rows: DataFrame, target: int, seed: int, *identity: str) -> DataFrame:
    """target rows with occurrence: whole cycles of all rows, then a part of one in hash order.

    The part is cut by a count of hash prefixes first, so that no task orders all rows.
    """
    n = rows.count()
    if not n or target <= 0:
        return rows.withColumn("occurrence", F.lit(0)).limit(0)
    cycles, rest = divmod(target, n)
    keyed = rows.withColumn("__k", order_key(seed, *identity)) if rest else rows
    whole = rows.withColumn("occurrence", F.explode(F.sequence(F.lit(1), F.lit(cycles)))) if cycles else None
    if not rest:
        return whole
    bucket = F.left("__k", F.lit(3))
    sums = keyed.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))  # 4,096 rows at most
    before = F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")
    part = keyed.withColumn("__b", bucket).join(F.broadcast(sums.withColumn("__before", before).where(F.col("__before") < rest)), "__b")
    nth = F.row_number().over(Window.partitionBy("__b").orderBy("__k")) + F.col("__before")
    part = part.withColumn("__nth", nth).where(F.col("__nth") <= rest).select(*rows.columns, F.lit(cycles + 1).alias("occurrence"))
    return part if whole is None else whole.unionByName(part)


def class_pairs(rows: DataFrame, key: tuple[str, ...], klass: tuple[str, ...], seed: int, both: bool = False) -> DataFrame:
    """(*klass, left, right): neighbours 1 and 2, 3 and 4 and so on of each class in hash order; an odd last one stays alone. With both, each pair also the other way round."""
    name = F.concat_ws("::", *key)
    placed = numbered(rows.select(*dict.fromkeys([*klass, *key]), name.alias("name")), klass, order_key(seed, *key))
    pair = placed.withColumn("pair", F.floor((F.col("nth") - 1) / 2))
    made = pair.groupBy(*klass, "pair").agg(F.min_by("name", "nth").alias("left"), F.max_by("name", "nth").alias("right"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n", "pair")
    return made.unionByName(made.select(*klass, F.col("right").alias("left"), F.col("left").alias("right"))) if both else made


def alias_dedupe(rows: DataFrame, alias: str, order: tuple[str, ...], klass: str) -> DataFrame:
    """One row of each alias, the smallest by order, and conflict where its rows name several classes."""
    own = Window.partitionBy(alias)
    several = F.coalesce(F.min(klass).over(own) != F.max(klass).over(own), F.lit(False))
    return rows.withColumns({"conflict": several, "__n": F.row_number().over(own.orderBy(*order))}).where("__n = 1").drop("__n")


def with_occurrence(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def duplicates(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(*key, n) of keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def zero_filled(counts: DataFrame, category: str, categories: list[str], key: tuple[str, ...] = ()) -> DataFrame:
    """counts (*key, category, n) with a row for each category, 0 where there was none."""
    spark = counts.sparkSession
    all_ = spark.createDataFrame([(c,) for c in categories], f"{category} string")
    grid = F.broadcast(all_) if not key else counts.select(*key).distinct().crossJoin(F.broadcast(all_))
    return grid.join(counts, [*key, category], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def unique_case_ratio(rows: DataFrame, key: tuple[str, ...], state: str, ratio: float) -> DataFrame:
    """One row: cases, conflicting cases, absent share and whether it is within 1/n of the ratio."""
    cases = rows.groupBy(*key).agg(F.min(state).alias("s"), F.max(state).alias("t"))
    made = cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("s") != F.col("t")).alias("conflicts"), F.avg((F.col("s") == "absent").cast("double")).alias("absent_share"))
    return made.withColumn("fits", F.abs(F.col("absent_share") - F.lit(ratio)) <= 1.0 / F.col("cases"))


def summary(rows: DataFrame, columns: tuple[str, ...], sequence: tuple[str, ...]) -> DataFrame:
    """(column, value, n, sequences): counts by each column's values, from one scan with grouping sets."""
    sets = [F.col(c).cast("string").alias(c) for c in columns]
    grouped = rows.select(*sets, F.struct(*sequence).alias("__s")).groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns])
    made = grouped.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__s").alias("sequences"), F.grouping_id().alias("__g"))
    full = (1 << len(columns)) - 1
    pick = lambda of: F.coalesce(*[F.when(F.col("__g") == full - (1 << (len(columns) - 1 - i)), of(c)) for i, c in enumerate(columns)])
    return made.select(pick(lambda c: F.lit(c)).alias("column"), pick(lambda c: F.coalesce(F.col(c), F.lit("<null>"))).alias("value"), "n", "sequences")


def disjoint(a: DataFrame, b: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys in both tables; must be empty."""
    return a.select(*key).intersect(b.select(*key))


def pending(planned: DataFrame, done: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Planned rows without a complete manifest: completed, with as many frames written as expected."""
    complete = done.where(F.col("completed") & (F.col("frames_written") == F.col("expected_frames"))).select(*key)
    return planned.join(complete, list(key), "left_anti")


def without_debug_runs(frames: DataFrame, manifests: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """frames but those of runs whose manifest says debug_limited; a missing manifest or flag keeps them."""
    cut = manifests.where(F.coalesce("debug_limited", F.lit(False))).select(*key).distinct()
    return frames.join(cut, list(key), "left_anti")


def state_case(column: Column, cases: dict[str, str]) -> Column:
    made = F.lit(None).cast("string")
    for value, name in cases.items():
        made = F.when(column == value, name).otherwise(made)
    return made


def zipped(left: DataFrame, right: DataFrame, key: tuple[str, ...], left_order: str, right_order: str) -> DataFrame:
    """Rows of both tables side by side by their place within their key; places that only one table has are left out. No list is made of a key."""
    placed = lambda d, order: d.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return placed(left, left_order).join(placed(right, right_order), [*key, "__place"]).drop("__place")
