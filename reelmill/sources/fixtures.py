"""Frames and segments derived from the events table, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmill.functions.boxes import box
from reelmill.session import dealt, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt by user to as many tasks as they need: windows over a user follow."""
    events = table(spark, sf_dir, "events")
    return dealt(events.select("event_id", "user_id", "event_type", "ts"), events.count(), "user_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical frames: a user's events in time order are a sequence, one frame each."""
    eid, error = F.col("event_id"), F.col("event_type") == "error"
    d = lambda c: c.cast("double")
    numbered = (
        _events(spark, sf_dir)
        .withColumn("frame_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int"))
    )
    first = F.col("frame_id") == 0
    staged = numbered.withColumns({
        "dataset": F.when(F.col("user_id") % 3 == 0, "lasot").when(F.col("user_id") % 3 == 1, "cognitivebench").otherwise("mgit"),
        "sequence": F.concat(F.lit("u"), F.col("user_id").cast("string")),
        "gt_presence": F.when(error & ~first, "absent").otherwise("present"),
        "is_observation_frame": first | F.col("event_type").isin("click", "view", "error"),
    }).withColumn("execution_status", F.when(~F.col("is_observation_frame"), "skipped").when((eid % 41 == 0) & ~first, "parse_error").otherwise("ok"))
    has_pred = (F.col("execution_status") == "ok") & (first | (eid % 13 != 0)) & ((F.col("gt_presence") == "present") | (eid % 3 == 0))
    staged = staged.withColumn("has_pred", has_pred)
    return staged.select(
        "dataset", "sequence", "frame_id",
        F.when(F.col("gt_presence") == "present", box(d(eid % 97), d(eid % 53), d(20 + eid % 31), d(15 + eid % 17))).alias("gt"),
        F.when(F.col("has_pred"), box(d(eid % 97 + eid % 11), d(eid % 53 + eid % 7), d(20 + eid % 31), d(15 + eid % 19))).alias("pred"),
        "gt_presence",
        F.when(F.col("execution_status") == "ok", F.when((eid % 29 == 0) & ~first, "uncertain").when(F.col("has_pred"), "present").otherwise("absent")).alias("pred_presence"),
        F.when(eid % 10 == 0, F.when(eid % 20 == 0, "same").otherwise("different")).alias("gt_identity"),
        F.when(F.col("has_pred"), F.when(eid % 17 == 0, "different").otherwise("same")).alias("pred_identity"),
        "execution_status", "is_observation_frame",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, sequence, name, start_frame, end_frame, text): runs of one event type, every seventh also a frame longer, so that some overlap."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = (
        _events(spark, sf_dir)
        .withColumn("frame_id", (F.row_number().over(order) - 1).cast("int"))
        .withColumn("starts", (F.coalesce(F.lag("event_type").over(order), F.lit("")) != F.col("event_type")).cast("int"))
        .withColumn("run", F.sum("starts").over(order))
    )
    runs = rows.groupBy("user_id", "run", "event_type").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("last"))
    dataset = F.when(F.col("user_id") % 3 == 0, "lasot").when(F.col("user_id") % 3 == 1, "cognitivebench").otherwise("mgit")
    return runs.select(
        dataset.alias("dataset"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sequence"),
        F.concat(F.lit("a"), F.col("run").cast("string")).alias("name"),
        "start_frame",
        (F.col("last") + F.when(F.col("run") % 7 == 0, 1).otherwise(0)).cast("int").alias("end_frame"),
        F.col("event_type").alias("text"),
    )


#: The same frames and segments for the SQL that queries are held against; boxes are flat columns.
FRAMES_SQL = """
s as (select *, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_id from events),
o as (select *, case when user_id % 3 = 0 then 'lasot' when user_id % 3 = 1 then 'cognitivebench' else 'mgit' end as dataset,
  concat('u', user_id) as sequence, case when event_type = 'error' and frame_id > 0 then 'absent' else 'present' end as gt_presence,
  (frame_id = 0 or event_type in ('click', 'view', 'error')) as is_observation_frame from s),
e as (select *, case when not is_observation_frame then 'skipped' when event_id % 41 = 0 and frame_id > 0 then 'parse_error' else 'ok' end as execution_status from o),
p as (select *, (execution_status = 'ok' and (frame_id = 0 or event_id % 13 <> 0) and (gt_presence = 'present' or event_id % 3 = 0)) as has_pred from e),
frames as (select dataset, sequence, frame_id,
  case when gt_presence = 'present' then (event_id % 97)::double end as gx, case when gt_presence = 'present' then (event_id % 53)::double end as gy,
  case when gt_presence = 'present' then (20 + event_id % 31)::double end as gw, case when gt_presence = 'present' then (15 + event_id % 17)::double end as gh,
  case when has_pred then (event_id % 97 + event_id % 11)::double end as px, case when has_pred then (event_id % 53 + event_id % 7)::double end as py,
  case when has_pred then (20 + event_id % 31)::double end as pw, case when has_pred then (15 + event_id % 19)::double end as ph,
  gt_presence, case when execution_status <> 'ok' then null when event_id % 29 = 0 and frame_id > 0 then 'uncertain' when has_pred then 'present' else 'absent' end as pred_presence,
  case when event_id % 10 = 0 then case when event_id % 20 = 0 then 'same' else 'different' end end as gt_identity,
  case when has_pred then case when event_id % 17 = 0 then 'different' else 'same' end end as pred_identity,
  execution_status, is_observation_frame from p)"""

SEGMENTS_SQL = """
g as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_id,
  case when coalesce(lag(event_type) over (partition by user_id order by ts, event_id), '') <> event_type then 1 else 0 end as starts from events),
h as (select *, sum(starts) over (partition by user_id order by ts, event_id) as run from g),
segments as (select case when user_id % 3 = 0 then 'lasot' when user_id % 3 = 1 then 'cognitivebench' else 'mgit' end as dataset, concat('u', user_id) as sequence,
  concat('a', run) as name, min(frame_id)::int as start_frame, (max(frame_id) + case when run % 7 = 0 then 1 else 0 end)::int as end_frame, event_type as text
  from h group by user_id, run, event_type)"""
