"""Mixing sources to target weights by budgets that flow down a tree.

The tree's levels are columns, here domain, language and source. A budget of tokens
starts at the root; at each node it is shared among the children by weight. A child
whose leaves can't fill its share takes what it can, and its shortage goes to its
siblings by their weights; only what all siblings can't take is passed to the
parent's siblings, and so on upwards. Each leaf then takes the prefix of its token
stream that fits its budget: a new seeded order of its documents in every epoch.

All steps are joins, windows and sums over the leaves, which are few, and over
buckets of documents in hash order; only a leaf's last bucket is looked at document
by document, so that no task holds a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import checkpoint

#: Documents in a bucket, about; a leaf has a power of 16 buckets.
BUCKET = 256
#: Leaves whose plan is broadcast; with more, documents meet it by leaf and salt, so that no task gets a whole leaf.
BROADCAST_LEAVES, SALTS = 1 << 16, 64


@dataclass(frozen=True)
class Mix:
    """levels: columns from the root to the leaves' level; null values are a child of their own.

    weights: (path, weight) of nodes, a path being the values from the root, joined by
    "/"; nodes not listed weigh default_weight. budget is a share of all tokens, epochs
    how often a document may be taken.
    """

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: tuple[tuple[str, float], ...] = field(default=())
    default_weight: float = 1.0
    budget: float = 0.5
    epochs: int = 2
    seed: str = "mix-1"


def token_count(text: Column) -> Column:
    """Words between ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _node(levels: tuple[str, ...], depth: int) -> Column:
    """A node's path as text; a null value is written as \\N, and %, / and \\ in a value as %25, %2F and %5C."""
    plain = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("\\"), F.lit("%5C"))
    return F.concat_ws("/", *[F.coalesce(plain(c), F.lit("\\N")) for c in levels[:depth]])


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (leaf, tokens) -> (leaf, tokens, budget): each leaf's tokens to take, a whole number.

    leaf is a path with "/" between levels. What a node can take is what its leaves can,
    but for those that a weight of zero shuts off. Per level, siblings are in order of
    that by weight; the first ones are full, and the others share the rest.
    """
    spark, depth = leaves.sparkSession, len(mix.levels)
    weights = spark.createDataFrame(list(mix.weights) or [("", 0.0)], "node string, weight double")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    parents = total.select(F.lit("").alias("parent"), F.floor(F.col("all") * F.lit(mix.budget)).cast("double").alias("share"))
    open_below = F.lit(True)  # whether no weight of zero lies between a node and a leaf
    for d in range(depth, 0, -1):
        leaves = leaves.withColumn(f"open{d}", open_below).withColumn("node", F.substring_index("leaf", "/", d)).join(F.broadcast(weights), "node", "left")
        leaves = leaves.withColumn(f"weight{d}", F.coalesce("weight", F.lit(mix.default_weight))).drop("node", "weight")
        open_below = F.col(f"open{d}") & (F.col(f"weight{d}") > 0)
    for d in range(1, depth + 1):
        node = F.substring_index("leaf", "/", d)
        parent = F.substring_index("leaf", "/", d - 1) if d > 1 else F.lit("")
        nodes = leaves.groupBy(parent.alias("parent"), node.alias("node")).agg((F.sum(F.when(F.col(f"open{d}"), F.col("tokens")).otherwise(0)) * mix.epochs).cast("double").alias("most"), F.min(f"weight{d}").alias("weight"))
        nodes = nodes.join(parents, "parent")
        order = Window.partitionBy("parent").orderBy(F.when(F.col("weight") > 0, F.col("most") / F.col("weight")).otherwise(F.lit(float("inf"))), "node")
        before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("rate", F.when(F.col("weight") > 0, (F.col("share") - before) / after))
        # the first that is not full sets the rate of all after it
        full = F.coalesce(F.col("most") <= F.col("rate") * F.col("weight"), F.lit(False))
        nodes = nodes.withColumn("open", F.when(~full & (F.col("weight") > 0), F.col("rate")))
        first_open = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        share = F.when(full, F.col("most")).when(F.col("weight") > 0, F.least(F.col("most"), F.greatest(F.lit(0.0), first_open) * F.col("weight"))).otherwise(0.0)
        parents = nodes.select(F.col("node").alias("parent"), share.alias("share"))
    return leaves.join(parents.withColumnRenamed("parent", "leaf"), "leaf").select("leaf", "tokens", F.floor("share").cast("long").alias("budget"))


def mixed(df: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, n_tokens, epoch): what the mix takes of df, a row for each time that a document is taken.

    A leaf's stream is cut before the first document that does not fit its budget whole.
    Documents without a token weigh nothing and go with what stands before them. Rows
    that share an id are taken together; ids may be null. An empty df gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), _node(mix.levels, len(mix.levels)).alias("leaf"), token_count(F.col(text_col)).alias("n_tokens"))
    docs = checkpoint(docs)
    sizes = docs.groupBy("leaf").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    budgets = leaf_budgets(sizes.select("leaf", "tokens"), mix).join(sizes.select("leaf", "n"), "leaf")
    # whole epochs, and the tokens of the last, broken one
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(mix.epochs), F.floor(F.col("budget") / F.col("tokens")))).otherwise(1)
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("n") / BUCKET)))).cast("int")
    plan = checkpoint(budgets.select("leaf", whole.cast("int").alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest"), digits.alias("digits")))
    if plan.count() <= BROADCAST_LEAVES:
        known = docs.join(F.broadcast(plan), "leaf")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["leaf", "salt"]).drop("salt")
    full = known.where("whole > 0").select("doc_id", "leaf", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("epoch"))
    rank = F.sha2(F.concat_ws(":", F.lit(mix.seed), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    last = known.where((F.col("rest") > 0) & (F.col("whole") < mix.epochs)).withColumn("rank", rank)
    last = last.withColumns({"bucket": F.left("rank", F.col("digits")), "part": F.left("rank", F.floor(F.col("digits") / 2).cast("int"))})
    buckets = last.groupBy("leaf", "part", "bucket").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    # first the parts of a leaf, then the buckets of a part are put in order: a task has the root of a leaf's buckets
    parts = buckets.groupBy("leaf", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("ahead", F.sum("part_size").over(Window.partitionBy("leaf").orderBy("part")) - F.col("part_size"))
    up_to = F.col("ahead") + F.sum("size").over(Window.partitionBy("leaf", "part").orderBy("bucket"))
    buckets = checkpoint(buckets.join(parts.drop("part_size"), ["leaf", "part"]).withColumn("upto", up_to).select("leaf", "bucket", (F.col("upto") - F.col("size")).alias("before"), F.col("upto")).where(F.col("before") <= F.col("rest")))
    inside = last.join(buckets, ["leaf", "bucket"])
    taken = inside.where("upto <= rest")
    edge = inside.where("upto > rest")
    within = F.sum("n_tokens").over(Window.partitionBy("leaf", "bucket").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("within", within).where("before + within <= rest")
    columns = ["doc_id", "leaf", "n_tokens", (F.col("whole") + 1).alias("epoch")]
    return full.unionByName(taken.select(*columns)).unionByName(edge.select(*columns))


def take_mix(df: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that the mix takes, each as often as it takes them; rows that share an id are taken together.

    Rows with a null id are taken by their leaf's order too, but as one document.
    """
    own = df.columns
    taken = mixed(df, mix, id_col, text_col).groupBy("doc_id", "leaf").agg(F.countDistinct("epoch").alias("__times"))
    taken = taken.select(F.col("doc_id").alias("__taken_id"), F.col("leaf").alias("__taken_leaf"), "__times")
    joined = df.withColumn("__leaf", _node(mix.levels, len(mix.levels))).join(
        taken, F.col(id_col).eqNullSafe(F.col("__taken_id")) & (F.col("__leaf") == F.col("__taken_leaf"))
    )
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*own)
