"""Queries over runs, fills and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmill.operators import timeline as tl
from reelmill.plans.registry import query
from reelmill.sources.fixtures import FRAMES_SQL, frames

W = "over (partition by dataset, sequence order by frame_id"


@query(f"""with {FRAMES_SQL}, a as (select dataset, sequence, frame_id, frame_id - row_number() {W}) as g from frames where gt_presence = 'absent')
select dataset, sequence, min(frame_id) as start, max(frame_id) as "end", count(*) as length from a group by dataset, sequence, g""")  # fmt: skip
def absent_runs(spark, sf_dir):
    return tl.absent_runs(frames(spark, sf_dir))


@query(f"""with {FRAMES_SQL}, c as (select *, last_value(px ignore nulls) {W} rows between unbounded preceding and 1 preceding) as cx from frames)
select dataset, sequence, frame_id, px is null as missing, not is_observation_frame as non_obs, case when px is null and not is_observation_frame then cx else px end as filled_x from c""")  # fmt: skip
def hold_last_fill(spark, sf_dir):
    made = tl.hold_last(frames(spark, sf_dir))
    return made.select("dataset", "sequence", "frame_id", "missing", "non_obs", F.col("filled.x").alias("filled_x"))


@query(f"""with {FRAMES_SQL}, n as (select *, coalesce(lag(gt_presence) {W}) = 'absent', false) as b, coalesce(lead(gt_presence) {W}) = 'absent', false) as a from frames)
select dataset, sequence, frame_id, case when a and b then 'middle' when b then 'end' when a then 'start' else 'single' end as phase from n where gt_presence = 'absent'""")  # fmt: skip
def absent_phase(spark, sf_dir):
    return tl.absent_phase(frames(spark, sf_dir))


@query(f"with {FRAMES_SQL} select dataset, sequence, min(frame_id) as anchor from frames where gt_presence = 'present' group by dataset, sequence")
def anchor_pool(spark, sf_dir):
    return tl.anchors(frames(spark, sf_dir))


@query(f"""with {FRAMES_SQL}, h as (select f.dataset, f.sequence, f.frame_id, list(b.frame_id order by b.frame_id desc) filter (b.frame_id is not null) as l
  from frames f left join frames b on b.dataset = f.dataset and b.sequence = f.sequence and b.frame_id < f.frame_id and b.gt_presence = 'present' group by all),
k as (select *, list_sort(coalesce(l[1:3], [])) as history from h)
select dataset, sequence, frame_id, array_to_string(history, ',') as history, concat('H', len(history)) as completeness,
  array_to_string(case when len(history) = 0 then [] else list_concat(history, [history[-1], history[-1], history[-1]])[1:3] end, ',') as padded, list_max(history) as last_trusted from k""")  # fmt: skip
def history_topk(spark, sf_dir):
    made = tl.last_trusted(frames(spark, sf_dir), 3)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return made.select(
        "dataset", "sequence", "frame_id", text(F.col("history")).alias("history"), tl.completeness(F.col("history")).alias("completeness"),
        text(tl.padded_history(F.col("history"))).alias("padded"), "last_trusted",
    )


@query(f"""with {FRAMES_SQL}, l as (select *, max(case when gt_presence = 'present' then frame_id end) {W} rows between unbounded preceding and 1 preceding) as seen,
  max(case when gt_presence = 'absent' then frame_id end) {W} rows between unbounded preceding and 1 preceding) as gone from frames)
select dataset, sequence, frame_id, case when gt_presence = 'present' then case when gone > seen then 'reappearance' else 'continuous_present' end
  when gone > seen then 'continued_absence' else 'disappearance' end as event from l""")  # fmt: skip
def tracking_event(spark, sf_dir):
    return tl.tracking_event(frames(spark, sf_dir))


@query(f"""with {FRAMES_SQL}, k as (select *, lag(frame_id) {W}) as b from frames where frame_id % 9 <> 4 and not (frame_id = 0 and sequence like '%7'))
select dataset, sequence, frame_id, case when frame_id > b + 1 then 'gap' else 'late_start' end as problem from k where frame_id > b + 1 or (b is null and frame_id <> 0)""")  # fmt: skip
def order_problems(spark, sf_dir):
    some = frames(spark, sf_dir).where((F.col("frame_id") % 9 != 4) & ~((F.col("frame_id") == 0) & F.col("sequence").endswith("7")))
    return tl.order_problems(some)


@query(f"""with {FRAMES_SQL}, k as (select *, gt_presence = 'absent' and coalesce(lag(gt_presence) {W}) <> 'absent', true) as s from frames)
select dataset, sequence, count(*) filter (s) as run_starts from k group by dataset, sequence""")  # fmt: skip
def run_start_count(spark, sf_dir):
    return tl.run_start_count(frames(spark, sf_dir), F.col("gt_presence") == "absent")
