"""What a training case shows: the event, how much history it has and how good that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.operators.evaluation import KEY, ordered
from reelmill.operators.timeline import absent_phase

#: Events, qualities and amounts of history, and the qualities that each amount may have.
EVENTS = ("continuous_present", "absent", "reappearance")
CLEAN, JITTER, STALE = "clean", "jitter_box", "stale_box"
LEVELS = ("h0_reference_only", "h1_one_observation", "h2_two_observations", "h3_three_observations")
ALLOWED = {LEVELS[0]: (CLEAN,), LEVELS[1]: (CLEAN, JITTER), LEVELS[2]: (CLEAN, JITTER, STALE), LEVELS[3]: (CLEAN, JITTER, STALE)}


def history_level(history: Column, reference: Column) -> Column:
    """How many different frames a history has; none, or the reference alone, is the first level."""
    ids = F.array_distinct(F.coalesce(history, F.array().cast("array<int>")))
    only = (F.size(ids) == 0) | ((F.size(ids) == 1) & (F.get(ids, F.lit(0)) == reference))
    return F.when(only, LEVELS[0]).when(F.size(ids) == 1, LEVELS[1]).when(F.size(ids) == 2, LEVELS[2]).otherwise(LEVELS[3])


def scenario_columns(cases: DataFrame, frames: DataFrame) -> DataFrame:
    """cases (dataset, sequence, frame_id, reference_id, anchor_id, history, corruption) with what they show, and problem.

    A present frame is a reappearance if the target was absent after the last frame that
    the case can trust: its latest history frame between reference and current, or else
    the reference. Absent frames are counted along a sequence once, and a case looks up
    two of the counts. problem is unknown_quality, quality_not_allowed for what a
    history's amount rules out, or presence_unknown; null if there is none.
    """
    gone = F.coalesce(F.col("gt_presence") == "absent", F.lit(False)).cast("int")
    counts = frames.select(*KEY, "frame_id", F.col("gt_presence").alias("__presence"), F.sum(gone).over(ordered()).alias("__upto"))
    between = F.filter(F.coalesce("history", F.array().cast("array<int>")), lambda f: (f > F.col("reference_id")) & (f < F.col("frame_id")))
    rows = cases.withColumn("__trusted", F.coalesce(F.array_max(between), F.col("reference_id")))
    trusted = counts.select(*KEY, F.col("frame_id").alias("__trusted"), F.col("__upto").alias("__before"))
    rows = rows.join(counts, [*KEY, "frame_id"], "left").join(trusted, [*KEY, "__trusted"], "left")
    rows = rows.join(absent_phase(frames).withColumnRenamed("phase", "absent_phase"), [*KEY, "frame_id"], "left")
    p = F.col("__presence")
    event = F.when(p == "absent", EVENTS[1]).when(p == "present", F.when(F.col("__upto") > F.col("__before"), EVENTS[2]).otherwise(EVENTS[0]))
    quality, level = F.coalesce("corruption", F.lit(CLEAN)), history_level(F.col("history"), F.col("reference_id"))
    allowed = F.lit(False)
    for name, qualities in ALLOWED.items():
        allowed = F.when(F.col("history_completeness") == name, F.col("history_quality").isin(*qualities)).otherwise(allowed)
    rows = rows.withColumns({"temporal_event": event, "history_quality": quality, "history_completeness": level})
    rows = rows.withColumns({
        "tracking_scenario": F.concat(F.col("temporal_event"), F.lit("__"), F.col("history_quality")),
        "visual_combination": F.concat(F.col("temporal_event"), F.lit("__"), F.col("history_quality"), F.lit("__"), F.col("history_completeness")),
        "reference_source": F.when(F.col("reference_id") == F.col("anchor_id"), "sequence_anchor").otherwise("sampled_prior_present"),
        "reference_current_gap": F.col("frame_id") - F.col("reference_id"),
        "problem": F.when(~F.col("history_quality").isin(CLEAN, JITTER, STALE), "unknown_quality").when(~allowed, "quality_not_allowed").when(F.col("temporal_event").isNull(), "presence_unknown"),
    })
    made = ("temporal_event", "absent_phase", "history_quality", "history_completeness", "tracking_scenario", "visual_combination", "reference_source", "reference_current_gap", "problem")
    return rows.select(*cases.columns, *made)


def scenario_coverage(rows: DataFrame) -> DataFrame:
    """(visual_combination, n) of all combinations that can be, zero where no case shows one."""
    every = [f"{e}__{q}__{level}" for e in EVENTS for level, qualities in ALLOWED.items() for q in qualities]
    names = rows.sparkSession.createDataFrame([(c,) for c in every], "visual_combination string")
    counts = rows.where("problem is null").groupBy("visual_combination").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "visual_combination", "left").withColumn("n", F.coalesce("n", F.lit(0)))
