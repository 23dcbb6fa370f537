"""Runs, fills and histories within one sequence: windows over frames in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.boxes import is_valid
from reelmill.operators.evaluation import KEY, ordered, with_main_masks


def runs(rows: DataFrame, key: tuple[str, ...] = KEY, frame: str = "frame_id") -> DataFrame:
    """(*key, start, end, length): maximal stretches of consecutive frame ids; repeated ids count once."""
    order = Window.partitionBy(*key).orderBy(frame)
    island = rows.select(*key, frame).distinct().withColumn("island", F.col(frame) - F.row_number().over(order))
    return island.groupBy(*key, "island").agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count(F.lit(1)).alias("length")).drop("island")


def absent_runs(frames: DataFrame) -> DataFrame:
    return runs(frames.where(F.col("gt_presence") == "absent"))


def hold_last(frames: DataFrame) -> DataFrame:
    """frames with filled: the last box before a frame that was neither observed nor predicted, and its own box elsewhere."""
    masked = with_main_masks(frames)
    return masked.withColumn("filled", F.when(F.col("non_obs") & F.col("missing"), F.col("carry")).otherwise(F.col("pred"))).drop("carry")


def absent_phase(frames: DataFrame) -> DataFrame:
    """(dataset, sequence, frame_id, phase) of absent frames: single, start, middle or end of their run of rows."""
    absent = F.coalesce(F.col("gt_presence") == "absent", F.lit(False))
    near = lambda f: F.coalesce(f(absent.cast("int")).over(ordered()), F.lit(0)) == 1
    before, after = near(F.lag), near(F.lead)
    phase = F.when(before & after, "middle").when(before, "end").when(after, "start").otherwise("single")
    return frames.withColumns({"phase": phase, "absent": absent}).where("absent").select(*KEY, "frame_id", "phase")


def anchors(frames: DataFrame) -> DataFrame:
    """(dataset, sequence, anchor): the first frame that shows the target with a valid box; sequences without one are left out."""
    present = (F.col("gt_presence") == "present") & is_valid(F.col("gt"))
    return frames.groupBy(*KEY).agg(F.min(F.when(present, F.col("frame_id"))).alias("anchor")).where("anchor is not null")


def with_anchor(frames: DataFrame) -> DataFrame:
    """frames with their sequence's anchor as anchors() has it, by a window instead of a join; sequences without one are left out."""
    present = (F.col("gt_presence") == "present") & is_valid(F.col("gt"))
    first = F.min(F.when(present, F.col("frame_id"))).over(Window.partitionBy(*KEY))
    return frames.where(F.col("dataset").isNotNull() & F.col("sequence").isNotNull()).withColumn("anchor", first).where("anchor is not null")


def last_trusted(frames: DataFrame, k: int = 3) -> DataFrame:
    """frames with history (the k latest earlier present frames with a valid box, in time order), and last_trusted, the latest.

    Only the array of k ids is kept a frame, however long the sequence.
    """
    seen = F.when((F.col("gt_presence") == "present") & is_valid(F.col("gt")), F.col("frame_id"))
    numbered = frames.withColumn("seen", seen).withColumn("nth", F.count("seen").over(ordered().rowsBetween(Window.unboundedPreceding, -1)))
    present = numbered.where("seen is not null")
    order = Window.partitionBy(*KEY).orderBy("frame_id").rowsBetween(-(k - 1), 0)
    lists = present.select(*KEY, (F.col("nth") + 1).alias("nth"), F.sort_array(F.collect_list("seen").over(order)).alias("history"))
    joined = numbered.join(lists, [*KEY, "nth"], "left")
    return joined.withColumn("history", F.coalesce("history", F.array().cast("array<int>"))).withColumn("last_trusted", F.array_max("history")).drop("seen", "nth")


def padded_history(history: Column, k: int = 3) -> Column:
    """k items: the history, its last item repeated to fill up; empty stays empty."""
    return F.when(F.size(history) == 0, history).otherwise(F.slice(F.concat(history, F.array_repeat(F.element_at(history, -1), k)), 1, k))


def completeness(history: Column) -> Column:
    """H0 to H3 by the number of different frames."""
    return F.concat(F.lit("H"), F.least(F.lit(3), F.size(F.array_distinct(history))).cast("string"))


def tracking_event(frames: DataFrame) -> DataFrame:
    """(dataset, sequence, frame_id, event): the four steps of a target's coming and going.

    A present frame is a reappearance if any frame since the last one that showed the
    target is absent; counted by prefix sums, not by looking back.
    """
    absent = F.coalesce(F.col("gt_presence") == "absent", F.lit(False)).cast("int")
    so_far = frames.withColumn("absents", F.sum(absent).over(ordered()))
    seen = (F.col("gt_presence") == "present") & is_valid(F.col("gt"))
    before = F.last(F.when(seen, F.col("absents")), ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    gone = F.coalesce(F.col("absents") - absent > before, F.lit(False))
    present, event = F.col("gt_presence") == "present", F.lit(None).cast("string")
    event = F.when(present & gone, "reappearance").when(present, "continuous_present")
    event = event.when((absent == 1) & gone, "continued_absence").when(absent == 1, "disappearance")
    return so_far.withColumn("event", event).select(*KEY, "frame_id", "event")


def order_problems(frames: DataFrame) -> DataFrame:
    """(dataset, sequence, frame_id, problem): duplicate frames, and gaps before a frame."""
    before = F.lag("frame_id").over(ordered())
    problem = F.when(F.col("frame_id") == before, "duplicate").when(F.col("frame_id") > before + 1, "gap").when(before.isNull() & (F.col("frame_id") != 0), "late_start")
    return frames.withColumn("problem", problem).where("problem is not null").select(*KEY, "frame_id", "problem")


def run_start_count(rows: DataFrame, flag: Column, key: tuple[str, ...] = KEY) -> DataFrame:
    """(*key, run_starts): how often a flag turns on along a sequence's rows."""
    order = Window.partitionBy(*key).orderBy("frame_id")
    on = F.coalesce(flag, F.lit(False))
    started = on & ~F.coalesce(F.lag(on).over(order), F.lit(False))
    return rows.withColumn("started", started).groupBy(*key).agg(F.count_if("started").alias("run_starts"))


def presence_of_plan(visible: Column, box: Column) -> Column:
    """Presence as planning sees it: a visible target needs a valid box; null where neither the flag nor the box says."""
    valid = F.coalesce(is_valid(box), F.lit(False))
    return F.when(visible.isNotNull() & ~visible, "absent").when(valid, "present")


def presence_of_truth(visible: Column, box: Column) -> Column:
    """Presence as records see it: the flag alone where there is one, else present with a valid box; null without either."""
    valid = F.coalesce(is_valid(box), F.lit(False))
    return F.when(visible, "present").when(visible.isNotNull(), "absent").when(valid, "present")


def zero_size_filled(frames: DataFrame) -> DataFrame:
    """frames with pred, where it has no width or no height and the truth is there, replaced by that of the frame before, itself filled.

    The first frame of a sequence keeps its own. A run of such frames takes the last one
    before it that isn't one, also where that has no prediction.
    """
    flat = F.coalesce((F.col("pred.w") == 0) | (F.col("pred.h") == 0), F.lit(False)) & F.col("gt").isNotNull()
    own = ~flat | (F.row_number().over(ordered()) == 1)
    source = F.last(F.when(F.col("__own"), F.struct(F.col("pred").alias("p"))), ignorenulls=True).over(ordered())
    return frames.withColumn("__own", own).withColumn("pred", source["p"]).drop("__own")
