"""Training cases mined from segments: where texts begin, where they surely hold, and where the target is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.operators import labels as lb
from reelmill.operators.evaluation import KEY
from reelmill.operators.planning import uniform_pick, uniform_positions
from reelmill.operators.timeline import runs
from reelmill.session import dealt

#: Where a mined label comes from, with an update and without one, and its origin.
UPDATE_SOURCE, NULL_SOURCE, ORIGIN = "mgit_action_segment_v1", "mgit_action_segment_stable_v1", "official_mgit_action_segment"


def first_present(frames: DataFrame) -> DataFrame:
    """(dataset, sequence, anchor): the first frame that shows the target; sequences without one are left out."""
    return frames.groupBy(*KEY).agg(F.min(F.when(F.col("gt_presence") == "present", F.col("frame_id"))).alias("anchor")).where("anchor is not null")


def probes(frames: DataFrame, segments: DataFrame, margin: int = 30, per_segment: int = 2, per_run: int = 1) -> DataFrame:
    """(dataset, sequence, frame_id, kind): update, stable and absent probes after a sequence's first present frame.

    Of each segment the first frame that shows the target under its text alone is an
    update probe, and per_segment of those at least margin away from all edges, spread
    evenly, are stable ones. Of each run of absent frames, per_run are absent probes.
    A segment's frames are a range of the numbers that its text's frames have in order;
    the range comes from one merged order of edges and frames, so that no segment meets
    a frame it doesn't cover. A frame may be a probe of several kinds and segments.
    Sequences without a segment or a present frame give none.
    """
    after = frames.select(*KEY, "frame_id", "gt_presence").join(first_present(frames), list(KEY)).where(F.col("frame_id") > F.col("anchor"))
    after = after.join(segments.select(*KEY).distinct(), list(KEY), "left_semi")
    anchored = segments.join(first_present(frames), list(KEY))
    edges = anchored.select(*KEY, "anchor", F.explode(F.array(F.col("start_frame"), F.col("end_frame") + 1)).alias("frame_id")).where("frame_id > anchor").select(*KEY, "frame_id").distinct()
    shown = lb.state_at(after.where(F.col("gt_presence") == "present").select(*KEY, "frame_id"), segments).where("state is not null").drop("ambiguous")
    shown = lb.boundary_distance(shown, edges).withColumn("stable", (F.coalesce(F.col("distance") >= margin, F.lit(True))).cast("int"))
    by_text = Window.partitionBy(*KEY, "state").orderBy("frame_id")
    shown = shown.select(*KEY, "state", "frame_id", "stable").withColumns({"nth": F.row_number().over(by_text), "nth_stable": F.sum("stable").over(by_text)})
    ranges = _ranges(shown, anchored, frames.count())
    first = ranges.where("hi > lo").select(*KEY, "state", (F.col("lo") + 1).alias("nth"))
    update = shown.join(first, [*KEY, "state", "nth"], "left_semi").select(*KEY, "frame_id", F.lit("update").alias("kind"))
    places = F.explode(uniform_positions((F.col("shi") - F.col("slo")).cast("int"), F.lit(per_segment)))
    wanted = ranges.where("shi > slo").select(*KEY, "state", "slo", places.alias("at")).select(*KEY, "state", (F.col("slo") + F.col("at") + 1).alias("nth_stable")).distinct()
    stable = shown.where("stable = 1").join(wanted, [*KEY, "state", "nth_stable"], "left_semi").select(*KEY, "frame_id", F.lit("stable").alias("kind"))
    gone = after.where(F.col("gt_presence") == "absent")
    spans = runs(gone).select(*KEY, F.col("start").alias("run"), F.explode(F.sequence("start", "end")).alias("frame_id"))
    absent = uniform_pick(spans, (*KEY, "run"), "frame_id", F.lit(per_run)).select(*KEY, "frame_id", F.lit("absent").alias("kind"))
    return update.unionByName(stable).unionByName(absent).distinct()


def _ranges(shown: DataFrame, segments: DataFrame, n_frames: int) -> DataFrame:
    """(dataset, sequence, state, lo, hi, slo, shi) of each segment: how many frames, and stable frames, of its text come before its start and up to its end."""
    # twice the frame number leaves room for a start before its frame and an end behind its
    rows = shown.select(*KEY, "state", (F.col("frame_id") * 2).alias("at"), F.lit(1).alias("n"), "stable", F.lit(None).cast("long").alias("segment"), F.lit(None).cast("int").alias("side"))
    named = segments.select(*KEY, F.col("text").alias("state"), "start_frame", "end_frame").withColumn("segment", F.xxhash64("start_frame", "end_frame"))
    ends = named.select(*KEY, "state", "segment", F.explode(F.array(F.struct((F.col("start_frame") * 2 - 1).alias("at"), F.lit(0).alias("side")), F.struct((F.col("end_frame") * 2 + 1).alias("at"), F.lit(1).alias("side")))).alias("e"))
    both = rows.unionByName(ends.select(*KEY, "state", "e.at", F.lit(0).alias("n"), F.lit(0).alias("stable"), "segment", "e.side"))
    both = dealt(both, n_frames, *KEY)
    upto = Window.partitionBy(*KEY, "state").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumns({"n": F.sum("n").over(upto), "stable": F.sum("stable").over(upto)}).where("side is not null")
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return summed.groupBy(*KEY, "state", "segment").agg(at(0, "n").alias("lo"), at(1, "n").alias("hi"), at(0, "stable").alias("slo"), at(1, "stable").alias("shi"))


def mined_labels(frames: DataFrame, segments: DataFrame, margin: int = 30, per_segment: int = 2, per_run: int = 1) -> DataFrame:
    """The verified labels of the probed frames, in the columns of a label file; masked ones are left out."""
    plan = probes(frames, segments, margin, per_segment, per_run).select(*KEY, "frame_id").distinct()
    rows = plan.join(frames.select(*KEY, "frame_id", (F.col("gt_presence") == "absent").alias("absent")), [*KEY, "frame_id"])
    made = lb.state_labels(rows, segments, margin, hard_null=True).where("state <> 'masked_unknown'")
    update = F.col("state") == "verified_update"
    made = made.join(rows, [*KEY, "frame_id"])
    return made.select(
        *KEY, "frame_id", F.when(F.col("absent"), "absent").otherwise("present").alias("target_status"), "memory_update", (~update).alias("verified_null"),
        F.when(update, UPDATE_SOURCE).otherwise(NULL_SOURCE).alias("source"), F.lit(False).alias("reviewed"), "input_state", "reason", F.lit(ORIGIN).alias("annotation_origin"),
    )


def mined_plan(mined: DataFrame, frames: DataFrame) -> DataFrame:
    """(dataset, sequence, anchor, cases, present_count, absent_count, absent_run_count) of mined labels."""
    gone = runs(mined.where("target_status = 'absent'")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("absent_run_count"))
    counts = mined.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("target_status") == "present").alias("present_count"), F.count_if(F.col("target_status") == "absent").alias("absent_count"))
    return first_present(frames).join(counts, list(KEY)).join(gone, list(KEY), "left").withColumn("absent_run_count", F.coalesce("absent_run_count", F.lit(0)))
