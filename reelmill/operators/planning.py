"""Sampling plans: which frames become cases, with which reference, under which quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.hashing import numbered, order_key, stable_rank
from reelmill.operators.evaluation import KEY
from reelmill.operators.timeline import with_anchor
from reelmill.session import checkpoint


def uniform_positions(n: Column, k: Column) -> Column:
    """Array of the (from 0) positions of k of n items spread evenly, halves rounded to even; all if there are no more than k."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1)).cast("double"), 0).cast("int"))
    every = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    return F.when((k <= 0) | (n <= 0), F.array().cast("array<int>")).when(n <= k, every).otherwise(spread)


def is_spread(n: Column, at: Column, k: Column) -> Column:
    """Whether place at (from 0) of n items is among the k that uniform_positions() gives; all are if there are no more than k."""
    # of the positions round(i * (n - 1) / (k - 1)), only the values of i beside a place can round to it
    step = (n - 1) / F.greatest(k - 1, F.lit(1)).cast("double")
    near = F.floor(at / F.greatest(step, F.lit(1e-9)))
    hits = [(F.bround((near + d) * step, 0) == at) & (near + d >= 0) & (near + d <= k - 1) for d in (-1, 0, 1, 2)]
    return (k > 0) & ((n <= k) | hits[0] | hits[1] | hits[2] | hits[3])


def uniform_pick(rows: DataFrame, key: tuple[str, ...], order: str, k: Column) -> DataFrame:
    """The rows at evenly spread places of each group's order; k may differ by group."""
    by = Window.partitionBy(*key)
    numbered = rows.withColumns({"__n": F.count(F.lit(1)).over(by).cast("int"), "__at": (F.row_number().over(by.orderBy(order)) - 1).cast("int"), "__k": k.cast("int")})
    return numbered.where(is_spread(F.col("__n"), F.col("__at"), F.col("__k"))).drop("__n", "__at", "__k")


def pools(frames: DataFrame, max_cases: int = 12, stride: int = 1, caps: dict[str, int] | None = None) -> DataFrame:
    """(dataset, sequence, anchor, n_present, n_absent, target, min_absent, max_absent) under the fixed-anchor policy.

    Frames count from after the anchor, every stride-th; caps hold for single datasets.
    """
    after = with_anchor(frames).where(F.col("frame_id") > F.col("anchor")).where((F.col("frame_id") - F.col("anchor") - 1) % stride == 0)
    cap = F.lit(max_cases)
    for dataset, most in (caps or {}).items():
        cap = F.when(F.lower("dataset") == dataset, F.lit(most)).otherwise(cap)
    sizes = after.groupBy(*KEY, "anchor").agg(F.count_if(F.col("gt_presence") == "present").alias("n_present"), F.count_if(F.col("gt_presence") == "absent").alias("n_absent"))
    sizes = sizes.where("n_present + n_absent > 0").withColumn("target", F.least(cap, F.col("n_present") + F.col("n_absent")))
    return sizes.withColumns({"min_absent": F.greatest(F.lit(0), F.col("target") - F.col("n_present")), "max_absent": F.least("target", "n_absent")})


def absent_quota(pool: DataFrame, ratio: float, seed: int) -> DataFrame:
    """pool with absent: how many absent cases each sequence gives, so that each dataset has its share.

    Beyond what each must give, slots go round the dataset's sequences in hash order:
    slot numbers first, hash order within. Only slot ranges are made, no loop. The pool,
    a row a sequence, is computed once and checkpointed.
    """
    pool = checkpoint(pool)
    by = Window.partitionBy("dataset")
    targets = pool.withColumns({
        "goal": F.bround(F.sum("target").over(by) * F.lit(ratio), 0).cast("long"),
        "must": F.sum("min_absent").over(by),
        "rank": order_key(seed, F.concat_ws("::", "dataset", "sequence")),
    })
    slots = targets.where("max_absent > min_absent").withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("max_absent") - F.col("min_absent"))))
    # slots in ten digits before the hash: a bucket is a slot and a few digits of the hash
    turn = F.concat(F.lpad(F.col("slot").cast("string"), 10, "0"), F.col("rank"))
    given = numbered(slots, ("dataset",), turn, digits=12).where(F.col("nth") <= F.col("goal") - F.col("must"))
    extra = given.groupBy(*KEY).agg(F.count(F.lit(1)).alias("extra"))
    return pool.join(extra, list(KEY), "left").withColumn("absent", F.col("min_absent") + F.coalesce("extra", F.lit(0))).drop("extra")


def infeasible(pool: DataFrame, ratio: float) -> DataFrame:
    """(dataset, goal, least, most) of the datasets that can't reach the ratio."""
    rows = pool.groupBy("dataset").agg(F.bround(F.sum("target") * F.lit(ratio), 0).cast("long").alias("goal"), F.sum("min_absent").alias("least"), F.sum("max_absent").alias("most"))
    return rows.where("goal < least or goal > most")


def plan_absent(frames: DataFrame, quota: DataFrame) -> DataFrame:
    """The absent frames of a plan: run starts first, then run ends, then inner frames, each spread evenly.

    quota has anchor and absent by sequence. A sequence is one group of the windows, all
    of one order, so that frames are read and shuffled once.
    """
    own = frames.select(*KEY, "frame_id", "gt_presence").join(quota.select(*KEY, "anchor", F.col("absent").alias("k")), list(KEY))
    own = own.where((F.col("gt_presence") == "absent") & (F.col("frame_id") > F.col("anchor")) & (F.col("k") > 0)).select(*KEY, "frame_id", "k")
    by, order = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy("frame_id")
    count = lambda flag, over: F.count_if(flag).over(over)
    beside = lambda d: F.count(F.lit(1)).over(order.rangeBetween(d, d))
    # repeated frames: counts of runs and edges take the first copy only
    rows = own.withColumns({"first": F.coalesce(F.lag("frame_id").over(order) != F.col("frame_id"), F.lit(True)), "start": beside(-1) == 0, "end": beside(1) == 0})
    started = F.col("first") & F.col("start")
    rows = rows.withColumns({"run": count(started, order), "n_runs": count(started, by)})
    rows = rows.withColumn("taken", is_spread(F.col("n_runs"), F.col("run") - 1, F.col("k")))
    rows = rows.withColumns({"nth": count(started & F.col("taken"), order), "n_taken": count(started & F.col("taken"), by)})
    ends = F.col("end") & is_spread(F.col("n_taken"), F.col("nth") - 1, F.col("k") - F.col("n_taken"))
    rows = rows.withColumn("edge", F.col("taken") & (F.col("start") | ends))
    inner, each = ~F.col("edge"), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"n_edges": count(F.col("edge") & F.col("first"), by), "at": count(inner, each), "n_inner": count(inner, by)})
    more = inner & is_spread(F.col("n_inner"), F.col("at") - 1, F.col("k") - F.col("n_edges"))
    return rows.where((F.col("edge") & F.col("first")) | more).select(*KEY, "frame_id")


def plan_present(frames: DataFrame, quota: DataFrame) -> DataFrame:
    """The present frames of a plan: those beside an absent run first, then others, each spread evenly; windows of one order, as for absent ones."""
    need = quota.select(*KEY, "anchor", (F.col("target") - F.col("absent")).alias("k")).where("k > 0")
    after = frames.select(*KEY, "frame_id", "gt_presence").join(need, list(KEY)).where(F.col("frame_id") > F.col("anchor"))
    by, order = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy("frame_id")
    each = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    absent_at = lambda d: F.count_if(F.col("gt_presence") == "absent").over(order.rangeBetween(d, d))
    rows = after.withColumn("side", (absent_at(0) == 0) & ((absent_at(-1) > 0) | (absent_at(1) > 0))).where(F.col("gt_presence") == "present")
    placed = lambda flag, p: {f"{p}_at": F.count_if(flag).over(each), f"{p}_n": F.count_if(flag).over(by)}
    rows = rows.withColumns(placed(F.col("side"), "s"))
    rows = rows.withColumn("border", F.col("side") & is_spread(F.col("s_n"), F.col("s_at") - 1, F.col("k")))
    rows = rows.withColumns({"held": F.max("border").over(order.rangeBetween(0, 0)), "n_border": F.count_if("border").over(by)})
    rows = rows.withColumns(placed(~F.col("held"), "r"))
    rest = ~F.col("held") & is_spread(F.col("r_n"), F.col("r_at") - 1, F.col("k") - F.col("n_border"))
    return rows.where(F.col("border") | rest).select(*KEY, "frame_id")


def reuse_units(frames: DataFrame, count: int) -> DataFrame:
    """(dataset, sequence, frame_id, use): count uses of each sequence's absent frames, pass after pass.

    A frame can be used as often as there are present frames before it, each time with
    another reference. Sequences that can't give count give all they can.
    """
    order = Window.partitionBy(*KEY).orderBy("frame_id")
    present = F.col("gt_presence") == "present"
    units = frames.withColumn("room", F.count_if(present).over(order)).where((F.col("gt_presence") == "absent") & (F.col("room") > 0))
    # no frame is used more than count times, so longer passes need not be written out
    units = units.withColumn("use", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("room"), F.lit(count)))))
    turn = Window.partitionBy(*KEY).orderBy("use", "frame_id")
    return units.withColumn("nth", F.row_number().over(turn)).where(F.col("nth") <= count).select(*KEY, "frame_id", F.col("use").cast("int").alias("use"))


def reference_pick(cases: DataFrame, present: DataFrame, seed: int) -> DataFrame:
    """cases (dataset, sequence, frame_id, occurrence) with reference_id: an earlier present frame, by hash and occurrence.

    The earlier frames are numbered once; a case finds its one by number, and no list is made.
    """
    order = Window.partitionBy(*KEY).orderBy("frame_id")
    numbered = present.select(*KEY, F.col("frame_id").alias("reference_id")).withColumn("at", (F.row_number().over(Window.partitionBy(*KEY).orderBy("reference_id")) - 1).cast("long"))
    # how many present frames lie before each case: counted along the merged order
    merged = cases.select(*KEY, "frame_id", "occurrence", F.lit(1).alias("is_case")).unionByName(present.select(*KEY, "frame_id", F.lit(None).cast("int").alias("occurrence"), F.lit(0).alias("is_case")))
    prior = F.coalesce(F.sum(1 - F.col("is_case")).over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = merged.withColumn("prior", prior).where("is_case = 1 and prior > 0")
    rank = stable_rank(seed, F.concat(F.col("dataset"), F.lit("::"), F.col("sequence"), F.lit("::"), F.col("frame_id").cast("string"), F.lit("::reference")))
    at = ((rank % F.col("prior").cast("decimal(20,0)")).cast("long") + F.col("occurrence")) % F.col("prior")
    return counted.withColumn("at", at).join(numbered, [*KEY, "at"]).select(*KEY, "frame_id", "occurrence", "reference_id")


def diverse_cap(rows: DataFrame, most: int, key: tuple[str, ...], order: str, seed: int) -> DataFrame:
    """At most `most` rows, round after round one of each group in time order; groups in hash order.

    A larger cap gives a superset. Groups keep no more rows than rounds can need.
    """
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    ranked = rows.withColumns({"__round": turn, "__rank": order_key(seed, *key)}).where(F.col("__round") <= most)
    return ranked.orderBy("__round", "__rank").limit(most).drop("__round", "__rank")


def top_per_dataset(sequences: DataFrame, n: int, seed: int, least_frames: int = 1, limits: dict[str, int] | None = None) -> DataFrame:
    """The first n sequences of each dataset in hash order, of those with enough frames; limits holds other n for single datasets.

    A larger limit gives a superset, so that what was made of the sequences chosen before stays of use.
    """
    enough = sequences.where(F.col("n_frames") >= least_frames)
    most = F.lit(n)
    for dataset, limit in (limits or {}).items():
        most = F.when(F.col("dataset") == dataset, F.lit(limit)).otherwise(most)
    return numbered(enough, ("dataset",), order_key(seed, "dataset", "sequence"), out="place").where(F.col("place") <= most)


def candidates(frames: DataFrame, stride: int = 1, keyframes: DataFrame | None = None, planned: DataFrame | None = None, present_only: bool = False) -> DataFrame:
    """(dataset, sequence, frame_id, presence, skipped) of the frames that may become cases; skipped says why one can't, null if it can.

    frames has visible (null where no flag says) and gt. Frame 0 is the anchor and no
    candidate. The frames are those of planned (dataset, sequence, frame_id), if it is given;
    else every stride-th of keyframes; else every stride-th of all. Planned frames outside
    of their sequence are listed as out_of_range. skipped is unknown_presence,
    invalid_bbox (present without a valid box), not_present, or out_of_range.
    """
    from reelmill.functions.boxes import is_valid
    from reelmill.operators.timeline import presence_of_truth

    own = frames.select(*KEY, "frame_id", presence_of_truth(F.col("visible"), F.col("gt")).alias("presence"), F.coalesce(is_valid(F.col("gt")), F.lit(False)).alias("valid"), F.lit(True).alias("there"))
    if planned is not None:
        rows = planned.select(*KEY, "frame_id").join(own, [*KEY, "frame_id"], "left")
    elif keyframes is not None:
        nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("frame_id")) - 1
        rows = keyframes.where("frame_id > 0").select(*KEY, "frame_id").distinct().withColumn("__nth", nth).where(F.col("__nth") % stride == 0).drop("__nth").join(own, [*KEY, "frame_id"])
    else:
        rows = own.where((F.col("frame_id") > 0) & ((F.col("frame_id") - 1) % stride == 0))
    skipped = (
        F.when(F.col("there").isNull() | (F.col("frame_id") <= 0), "out_of_range")
        .when(F.col("presence").isNull(), "unknown_presence")
        .when(F.lit(present_only) & (F.col("presence") != "present"), "not_present")
        .when((F.col("presence") == "present") & ~F.col("valid"), "invalid_bbox")
    )
    return rows.select(*KEY, "frame_id", "presence", skipped.alias("skipped"))


def decision_points(plan: DataFrame, anchor: DataFrame, gap: int, stride: int, most: int) -> DataFrame:
    """Of each sequence's planned frames from anchor + gap on, every stride-th, the first `most`."""
    order = Window.partitionBy(*KEY).orderBy("frame_id")
    later = plan.join(anchor, list(KEY)).where(F.col("frame_id") >= F.col("anchor") + gap)
    numbered = later.withColumn("__at", F.row_number().over(order) - 1).where(F.col("__at") % stride == 0)
    return numbered.where(F.col("__at") / stride < most).select(*KEY, "frame_id")


def transition_priority(rows: DataFrame, state: str, stride: int) -> DataFrame:
    """rows with reason: transition where a state differs from the row before, stride for every stride-th other row; the rest goes."""
    order = Window.partitionBy(*KEY).orderBy("frame_id")
    changed = F.coalesce(F.lag(state).over(order) != F.col(state), F.lit(False))
    marked = rows.withColumns({"__changed": changed, "__at": F.row_number().over(order) - 1})
    reason = F.when(F.col("__changed"), "transition").when(F.col("__at") % stride == 0, "stride")
    return marked.withColumn("reason", reason).where("reason is not null").drop("__changed", "__at")


def balanced_sample(rows: DataFrame, per_class: int, key: tuple[str, ...], klass: str, seed: int, *identity: str) -> DataFrame:
    """Up to 2 * per_class rows of each group: per_class of either class in hash order, and others to fill up."""
    order = order_key(seed, *identity)
    first = Window.partitionBy(*key, klass).orderBy(order)
    ranked = rows.withColumn("__in_class", F.row_number().over(first))
    fill = Window.partitionBy(*key).orderBy((F.col("__in_class") > per_class).cast("int"), order)
    return ranked.withColumn("__nth", F.row_number().over(fill)).where(F.col("__nth") <= 2 * per_class).drop("__nth", "__in_class")
