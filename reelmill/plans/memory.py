"""Queries over memories, re-anchored texts, mined cases, sample types, plans and backends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelmill.operators import audit, backend, integrity, memory, mining, mixture, planning, replay, samples, scenario, timeline
from reelmill.operators import labels as lb
from reelmill.operators.evaluation import KEY
from reelmill.plans.registry import query
from reelmill.session import table
from reelmill.sources.fixtures import FRAMES_SQL, SEGMENTS_SQL, frames, segments

FR = f"with {FRAMES_SQL}"
BOTH = f"{FR}, {SEGMENTS_SQL}"


def candidates(spark, sf_dir):
    """Candidates of all observed frames: every third a text, every seventh a distractor, the others positive."""
    f = frames(spark, sf_dir).where("execution_status <> 'skipped'")
    k = F.col("frame_id")
    words = F.array(*map(F.lit, ("a man in red rides a bike", "the man in red rides his bike", "no significant change", "a dog sleeps on the porch", "")))
    gone = F.coalesce(F.lag("pred_presence").over(Window.partitionBy(*KEY).orderBy("frame_id")) == "absent", F.lit(False))
    event = F.when(F.col("pred_presence") == "absent", F.when(gone, "continued_absence").otherwise("disappearance")).when(gone, "reappearance").otherwise("continuous_present")
    return f.select(
        *KEY, "frame_id", F.when(k % 7 == 3, "negative").when(k % 3 == 0, "semantic").otherwise("positive").alias("kind"), F.lit("vlm_prediction").alias("source"),
        F.col("execution_status").alias("status"), F.col("pred_presence").alias("presence"), F.col("pred_identity").alias("identity"), F.col("pred").alias("box"),
        F.get(words, (k / 3).cast("int") % 5).alias("text"), event.alias("event"),
    )


@query()
def memory_gates(spark, sf_dir):
    """Every candidate's fate and the bank after it, with texts confirmed twice and boxes that must overlap."""
    gates = memory.Gates(iou=0.05, text_confirmations=2, text_cooldown=10)
    made = memory.replayed(candidates(spark, sf_dir), gates)
    return made.withColumns({"recent": F.array_join("recent", ","), "texts": F.array_join("texts", "|")})


REANCHORED = """held as (select c.dataset, c.sequence, c.frame_id, min(x.text) as low, max(x.text) as high from c left join segments x on x.dataset = c.dataset and x.sequence = c.sequence and c.reference_id between x.start_frame and x.end_frame group by all)"""


@query(f"""{BOTH}, c as (select dataset, sequence, frame_id, (frame_id - frame_id % 5)::int as reference_id from frames), {REANCHORED}
select dataset, sequence, frame_id, reference_id, case when dataset = 'mgit' and low = high then low else 'the target' end as text,
  case when dataset = 'mgit' and low = high then 'mgit_reference_action_description' else 'dataset_initial_language' end as text_source from c join held using (dataset, sequence, frame_id)""")  # fmt: skip
def reanchored_text(spark, sf_dir):
    cases = frames(spark, sf_dir).select(*KEY, "frame_id", (F.col("frame_id") - F.col("frame_id") % 5).cast("int").alias("reference_id"), F.lit("the target").alias("text"), F.lit("dataset_initial_language").alias("text_source"))
    return lb.reanchored(cases, segments(spark, sf_dir))


#: Probes by joins of every frame with every segment that covers it; margin 2, two stable frames a segment, one absent a run.
MINED = f"""{BOTH}, an as (select dataset, sequence, min(frame_id) as anchor from frames where gt_presence = 'present' group by all),
fr as (select f.dataset, f.sequence, f.frame_id, f.gt_presence from frames f join an using (dataset, sequence) where f.frame_id > an.anchor),
st as (select f.dataset, f.sequence, f.frame_id, f.gt_presence, min(x.text) as low, max(x.text) as high from fr f join segments x on x.dataset = f.dataset and x.sequence = f.sequence and f.frame_id between x.start_frame and x.end_frame group by all),
ed as (select distinct s.dataset, s.sequence, unnest([s.start_frame, s.end_frame + 1]) as edge from segments s),
sh as (select st.*, (select min(abs(st.frame_id - ed.edge)) from ed join an using (dataset, sequence) where ed.dataset = st.dataset and ed.sequence = st.sequence and ed.edge > an.anchor) as distance from st where gt_presence = 'present' and low = high),
sg as (select x.dataset, x.sequence, x.name, s.frame_id, coalesce(s.distance >= 2, true) as stable, row_number() over (partition by x.dataset, x.sequence, x.name order by s.frame_id) as nth
  from segments x join sh s on s.dataset = x.dataset and s.sequence = x.sequence and s.low = x.text and s.frame_id between x.start_frame and x.end_frame),
sb as (select *, row_number() over (partition by dataset, sequence, name order by frame_id) as i, count(*) over (partition by dataset, sequence, name) as n from sg where stable),
ab as (select *, frame_id - row_number() over (partition by dataset, sequence order by frame_id) as run from fr where gt_presence = 'absent' and (dataset, sequence) in (select (dataset, sequence) from segments)),
pr as (select dataset, sequence, frame_id, 'update' as kind from sg where nth = 1 union select dataset, sequence, frame_id, 'stable' from sb where n <= 2 or i = 1 or i = n
  union select dataset, sequence, min(frame_id), 'absent' from ab group by dataset, sequence, run)"""


@query(f"{MINED} select * from pr")
def mined_probes(spark, sf_dir):
    return mining.probes(frames(spark, sf_dir), segments(spark, sf_dir), margin=2, per_segment=2, per_run=1)


@query(f"""{MINED}, pl as (select distinct dataset, sequence, frame_id from pr),
s2 as (select f.dataset, f.sequence, f.frame_id, f.gt_presence = 'absent' as absent, min(x.text) as low, max(x.text) as high from pl join frames f using (dataset, sequence, frame_id)
  left join segments x on x.dataset = f.dataset and x.sequence = f.sequence and f.frame_id between x.start_frame and x.end_frame group by all),
e2 as (select dataset, sequence, edge, (select min(text) from segments x where x.dataset = ed.dataset and x.sequence = ed.sequence and ed.edge between x.start_frame and x.end_frame) as l1, (select max(text) from segments x where x.dataset = ed.dataset and x.sequence = ed.sequence and ed.edge between x.start_frame and x.end_frame) as h1,
  (select min(text) from segments x where x.dataset = ed.dataset and x.sequence = ed.sequence and ed.edge - 1 between x.start_frame and x.end_frame) as l0, (select max(text) from segments x where x.dataset = ed.dataset and x.sequence = ed.sequence and ed.edge - 1 between x.start_frame and x.end_frame) as h0 from ed where edge > 0),
bo as (select * from e2 where coalesce(l1 <> h1, false) or coalesce(l0 <> h0, false) or l1 is distinct from l0),
ini as (select dataset, sequence, arg_min(text, start_frame) as initial from segments group by all),
j as (select s2.*, initial, low <> high as amb, case when low = high then low end as w, (select min(abs(bo.edge - s2.frame_id)) from bo where bo.dataset = s2.dataset and bo.sequence = s2.sequence) as distance from s2 join ini using (dataset, sequence)),
k as (select *, coalesce(last_value(case when not absent then w end ignore nulls) over (partition by dataset, sequence order by frame_id rows between unbounded preceding and 1 preceding), initial) as input_state from j),
z as (select *, case when absent then 'absent_no_new_appearance_evidence' when amb or w is null then null when w <> input_state then 'action_segment_text_changed' when distance < 2 then null else 'within_segment_state_text_unchanged' end as reason from k)
select dataset, sequence, frame_id, case when absent then 'absent' else 'present' end as target_status, case when reason like 'action%' then w end as memory_update, reason not like 'action%' as verified_null,
  case when reason like 'action%' then 'mgit_action_segment_v1' else 'mgit_action_segment_stable_v1' end as source, input_state, reason from z where reason is not null""")  # fmt: skip
def mined_labels(spark, sf_dir):
    return mining.mined_labels(frames(spark, sf_dir), segments(spark, sf_dir), margin=2, per_segment=2, per_run=1).drop("reviewed", "annotation_origin")


HASH = "sha256(concat('{seed}', chr(0), dataset, chr(0), sequence, chr(0), {what}))"


@query(f"""{FR}, q as (select dataset, sequence, count(*)::int as n from frames group by all), sm as (select dataset, sequence, n, unnest(range(n))::int as sample from q),
pl as (select *, row_number() over (partition by dataset, sequence order by {HASH.format(seed=23, what="sample")}, sample) - 1 as place from sm),
c as (select *, floor(n * 0.15::double) as a, floor(n * 0.1::double) as h, floor(n * 0.05::double) as m from pl)
select dataset, sequence, sample, case when place < a then 'current_absent' when place < a + h then 'history_noisy' when place < a + h + m then 'mixed_hard' else 'pure_positive' end as sample_type from c""")  # fmt: skip
def sample_types(spark, sf_dir):
    quota = frames(spark, sf_dir).groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("n_samples"))
    return samples.sample_types(quota, 23)


@query()
def sample_frames(spark, sf_dir):
    """The frames of as many samples as a sequence has frames, spans as short as sequences are here."""
    f = frames(spark, sf_dir)
    placed = samples.placed_samples(f, sample_types(spark, sf_dir), 23, max_span=40, history=2, interval=4)
    made = samples.sample_frames(placed, f, 23)
    return made.select(*KEY, "sample", "role", "place", "frame_id", F.round("box.x", 6).alias("x"), F.round("box.w", 6).alias("w"), "visible", "noise")


#: A plan of every frame after the first with breaks planted by numbers.
PLAN = f"""{FR}, c as (select dataset, sequence, frame_id as place, case when frame_id % 37 = 20 then frame_id - 3 else frame_id end as frame_id, case when frame_id % 11 = 5 then null when frame_id % 41 = 7 then frame_id else frame_id // 2 end as reference_id from frames where frame_id > 0),
sq as (select dataset, sequence, 0 as anchor, count(*) filter (gt_presence = 'present' and frame_id > 0) + case when sequence like '%9' then 1 else 0 end as present_count, count(*) filter (gt_presence = 'absent' and frame_id > 0) as absent_count from frames group by dataset, sequence),
n as (select *, coalesce(reference_id, 0) as reference, lag(frame_id) over (partition by dataset, sequence order by place) as last from c),
pp as (select *, row_number() over (partition by dataset, sequence, frame_id, reference order by place) as nth from n)
select 'frames_not_sorted' as rule, dataset, sequence, place::bigint as place from pp where frame_id < last
union all select 'reference_not_before', dataset, sequence, place::bigint from pp where reference >= frame_id
union all select 'pair_repeated', dataset, sequence, place::bigint from pp where nth > 1
union all select 'counts_differ', dataset, sequence, null from sq where sequence like '%9'
union all select rule, null, null, null from (values ('present_count_differs'), ('case_count_differs'), ('cases_not_present_and_absent')) v(rule) where rule <> 'present_count_differs' or exists (select 1 from sq where sequence like '%9')"""


@query(PLAN)
def plan_violations(spark, sf_dir):
    f, k = frames(spark, sf_dir), F.col("frame_id")
    rows = f.where(k > 0).select(*KEY, k.alias("place"), F.when(k % 37 == 20, k - 3).otherwise(k).alias("frame_id"), F.when(k % 11 == 5, F.lit(None).cast("int")).when(k % 41 == 7, k).otherwise(F.floor(k / 2).cast("int")).alias("reference_id"))
    shown = F.count_if((F.col("gt_presence") == "present") & (k > 0))
    sequences = f.groupBy(*KEY).agg(F.lit(0).alias("anchor"), shown.alias("shown"), F.count_if((F.col("gt_presence") == "absent") & (k > 0)).alias("absent_count"))
    sequences = sequences.withColumn("present_count", F.col("shown") + F.when(F.col("sequence").endswith("9"), 1).otherwise(0)).drop("shown")
    totals = f.agg(F.count_distinct(*KEY).alias("sequence_count"), (F.count_if(k > 0) + 1).alias("case_count"), shown.alias("present_count"), F.count_if((F.col("gt_presence") == "absent") & (k > 0)).alias("absent_count"))
    totals = totals.withColumn("actual_absent_ratio", F.col("absent_count") / F.col("case_count"))
    return integrity.plan_violations(rows, sequences, totals).drop("detail")


class _Echo:
    """A backend without a model: it fails on some requests, and with them on every batch they are in."""

    def __init__(self, settings: dict) -> None:
        self.mark = settings["mark"]

    def generate(self, requests: list[dict]) -> list[str | None]:
        if any(r["event_id"] % 23 == 7 for r in requests):
            raise ValueError("no answer to this")
        return [f"{self.mark}{r['event_type']}" for r in requests]


if "echo" not in backend.available_backends():
    backend.register_backend("echo", _Echo)


@query("""select event_id, case when event_id % 23 <> 7 then concat('>', event_type) end as answer, case when event_id % 23 = 7 then 'model_error' else 'ok' end as status, case when event_id % 23 = 7 then 'ValueError' end as error_type from events""")
def backend_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return backend.answered(rows, "echo", {"mark": ">"}, batch=8).select("event_id", "answer", "status", "error_type")


@query(f"""{FR} select dataset, sequence, frame_id, case when visible then 'present' else 'absent' end as target_presence, case when visible then gx end as x, not visible or gx is not null as annotation_valid, gt_identity as identity_match
  from (select *, case when frame_id % 5 = 0 then gx is not null when frame_id % 7 = 0 then true else gt_presence = 'present' end as visible from frames) where frame_id % 13 <> 6
union all select dataset, sequence, frame_id, null, null, null, null from frames where frame_id % 13 = 6""")  # fmt: skip
def ground_truth_attached(spark, sf_dir):
    f, k = frames(spark, sf_dir), F.col("frame_id")
    visible = F.when(k % 5 == 0, F.lit(None).cast("boolean")).when(k % 7 == 0, True).otherwise(F.col("gt_presence") == "present")
    truth = f.where(k % 13 != 6).select(*KEY, "frame_id", "gt", visible.alias("visible"), F.col("gt_identity").alias("identity"))
    g = F.col("ground_truth")
    made = replay.with_ground_truth(f.select(*KEY, "frame_id"), truth)
    return made.select(*KEY, "frame_id", g["target_presence"].alias("target_presence"), g["bbox_xywh"]["x"].alias("x"), g["annotation_valid"].alias("annotation_valid"), g["identity_match"].alias("identity_match"))


@query(f"""{FR} select dataset, sequence, frame_id, case frame_id % 5 when 0 then 'api_error' when 1 then 'ok' when 2 then 'late' else case when not is_observation_frame and px is null then 'skipped' else 'ok' end end as status from frames""")
def execution_derived(spark, sf_dir):
    f, k = frames(spark, sf_dir), F.col("frame_id") % 5
    raw = F.when(k == 0, '{"execution": {"status": "api_error"}}').when(k == 1, '{"execution": {"latency_ms": 3}}').when(k == 2, '{"execution": "late"}').when(k == 3, '{"execution": null}').otherwise("{}")
    return f.select(*KEY, "frame_id", replay.execution_of(F.parse_json(raw), F.col("pred"), F.col("is_observation_frame")).alias("status"))


@query(f"""{FR}, v as (select *, case when frame_id % 5 = 0 then null when frame_id % 11 = 3 then true else gt_presence = 'present' end as visible from frames)
select dataset, sequence, frame_id, case when not visible then 'absent' when gx is not null then 'present' end as planned, case when visible then 'present' when not visible then 'absent' when gx is not null then 'present' end as truth from v""")  # fmt: skip
def presence_rules(spark, sf_dir):
    f = _visible(spark, sf_dir)
    return f.select(*KEY, "frame_id", timeline.presence_of_plan(F.col("visible"), F.col("gt")).alias("planned"), timeline.presence_of_truth(F.col("visible"), F.col("gt")).alias("truth"))


def _visible(spark, sf_dir):
    k = F.col("frame_id")
    return frames(spark, sf_dir).withColumn("visible", F.when(k % 5 == 0, F.lit(None).cast("boolean")).when(k % 11 == 3, True).otherwise(F.col("gt_presence") == "present"))


@query(f"""{FR}, v as (select *, case when frame_id % 5 = 0 then null when frame_id % 11 = 3 then true else gt_presence = 'present' end as visible from frames),
t as (select *, case when visible then 'present' when not visible then 'absent' when gx is not null then 'present' end as presence from v), n as (select *, row_number() over (partition by dataset, sequence order by frame_id) - 1 as nth from t where is_observation_frame and frame_id > 0),
c as (select 'stride' as how, dataset, sequence, frame_id, presence, gx from t where frame_id > 0 and (frame_id - 1) % 3 = 0 union all select 'keyframes', dataset, sequence, frame_id, presence, gx from n where nth % 2 = 0)
select how, dataset, sequence, frame_id, presence, case when presence is null then 'unknown_presence' when presence = 'present' and gx is null then 'invalid_bbox' end as skipped from c
union all select 'plan', p.dataset, p.sequence, p.frame_id, t.presence, case when t.frame_id is null then 'out_of_range' when t.presence is null then 'unknown_presence' when t.presence = 'present' and gx is null then 'invalid_bbox' end
  from (select dataset, sequence, (frame_id * 7 + 1)::int as frame_id from frames where frame_id % 4 = 1) p left join t using (dataset, sequence, frame_id)""")  # fmt: skip
def candidate_frames(spark, sf_dir):
    f = _visible(spark, sf_dir)
    plan = f.where("frame_id % 4 = 1").select(*KEY, (F.col("frame_id") * 7 + 1).alias("frame_id"))
    named = lambda how, rows: rows.select(F.lit(how).alias("how"), *KEY, "frame_id", "presence", "skipped")
    both = named("stride", planning.candidates(f, 3)).unionByName(named("keyframes", planning.candidates(f, 2, f.where("is_observation_frame"))))
    return both.unionByName(named("plan", planning.candidates(f, planned=plan)))


@query(f"""{FR}, z as (select dataset, sequence, frame_id, px, case when frame_id % 4 > 1 and px is not null then 0 else pw end as pw, gx is not null as there from frames),
k as (select *, count(*) filter (not (coalesce(pw = 0, false) and there) or frame_id = 0) over (partition by dataset, sequence order by frame_id) as grp from z)
select dataset, sequence, frame_id, first_value(px) over w as x, case when px is null and first_value(px) over w is null then null else first_value(case when px is not null then pw end) over w end as w from k window w as (partition by dataset, sequence, grp order by frame_id)""")  # fmt: skip
def zero_size_fill(spark, sf_dir):
    width = F.when(F.col("frame_id") % 4 > 1, F.lit(0.0)).otherwise(F.col("pred.w"))
    flat = F.when(F.col("pred").isNotNull(), F.struct(F.col("pred.x").alias("x"), F.col("pred.y").alias("y"), width.alias("w"), F.col("pred.h").alias("h")))
    made = timeline.zero_size_filled(frames(spark, sf_dir).withColumn("pred", flat))
    return made.select(*KEY, "frame_id", F.col("pred.x").alias("x"), F.col("pred.w").alias("w"))


@query("""with f as (select min(event_id) as first from events where event_id % 7 = 5) select event_id, case when event_id > first then event_id when event_id = first then 0 else event_id + 1 end as place from events, f""")
def schema_seed_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("place"))
    return audit.schema_seeded(e, "place", F.col("event_id") % 7 == 5)


@query("""with t as (select conv_id, list({'role': role, 'content': case when conv_id % 5 = 2 and turn = 0 then concat('<image>', text) else text end} order by turn, role, text) as m from conversations group by conv_id),
p as (select *, list_position(list_transform(m, lambda x: x.role), 'user') as ux, conv_id % 3 as n from t)
select conv_id, array_to_string(list_transform(m, lambda x, i: case when ux > 0 and conv_id % 5 <> 2 and i = ux then concat(repeat('<image>', n), x.content) else x.content end), '|') as contents from p""")  # fmt: skip
def image_marks(spark, sf_dir):
    k = F.col("conv_id")
    content = F.when((k % 5 == 2) & (F.col("turn") == 0), F.concat(F.lit("<image>"), F.col("text"))).otherwise(F.col("text"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", content.alias("content")))).alias("t"))
    records = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), F.array_repeat(F.lit("a.jpg"), (k % 3).cast("int")).alias("images"))
    return audit.with_image_marks(records).select("conv_id", F.array_join(F.transform("messages", lambda x: x["content"]), "|").alias("contents"))


class _Drift:
    """A tracker without a model: the first box, moved by one a frame that it may look at; it fails on some frames."""

    def __init__(self, settings: dict) -> None:
        self.by = settings["by"]

    def initialize(self, info: dict) -> None:
        self.box = list(info["init_box"])

    def track(self, info: dict) -> dict | None:
        if info["frame_id"] % 17 == 9:
            raise RuntimeError("lost")
        if not info["observed"]:
            return None
        self.box[0] += self.by
        return {"box": self.box}


if "drift" not in backend.available_trackers():
    backend.register_tracker("drift", _Drift)


@query(f"""{FR}, mv as (select *, frame_id > 0 and frame_id % 17 <> 9 and is_observation_frame as moves from frames)
select dataset, sequence, frame_id, case when frame_id = 0 or moves then first_value(gx) over w + 2.0::double * count(*) filter (moves) over w end as x, case when frame_id > 0 and frame_id % 17 = 9 then 'internal_error' when frame_id > 0 and not is_observation_frame then 'skipped' else 'ok' end as status
from mv window w as (partition by dataset, sequence order by frame_id)""")  # fmt: skip
def tracked_frames(spark, sf_dir):
    four = F.array(*[F.col(f"gt.{c}") for c in "xywh"])
    f = frames(spark, sf_dir).withColumns({"init_box": F.when(F.col("frame_id") == 0, four), "observed": F.col("is_observation_frame")})
    return backend.tracked(f, "drift", {"by": 2.0}).select(*KEY, "frame_id", F.col("box")[0].alias("x"), "status")


@query("""with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by sha256(concat('8', chr(0), p_partkey))) as n from part), p as (select p_brand, (n - 1) // 2 as pair, arg_min(p_partkey, n)::varchar as a, arg_max(p_partkey, n)::varchar as b from r group by 1, 2 having count(*) = 2)
select p_brand, a as "left", b as "right" from p union all select p_brand, b, a from p""")  # fmt: skip
def class_pairs_both(spark, sf_dir):
    return mixture.class_pairs(table(spark, sf_dir, "part"), ("p_partkey",), ("p_brand",), 8, both=True)


#: Cases of every frame after the first: a reference, up to three earlier frames and a quality by numbers.
SCENARIO = f"""{FR}, cs as (select dataset, sequence, frame_id, (frame_id // 3)::int as reference_id, list_filter([frame_id - 4, frame_id - 2, frame_id - frame_id % 2 - 2], lambda x: x >= frame_id // 3) as history,
  case frame_id % 5 when 1 then 'jitter_box' when 2 then 'stale_box' when 3 then 'blurred' end as corruption from frames where frame_id > 0),
lv as (select *, coalesce(list_max(list_filter(history, lambda x: x > reference_id and x < frame_id)), reference_id) as trusted, case when len(history) = 0 or list_distinct(history) = [reference_id] then 'h0_reference_only' else
  (['h1_one_observation', 'h2_two_observations', 'h3_three_observations'])[len(list_distinct(history))] end as level, coalesce(corruption, 'clean') as quality from cs),
nb as (select *, coalesce(lag(gt_presence) over w = 'absent', false) as b, coalesce(lead(gt_presence) over w = 'absent', false) as a from frames window w as (partition by dataset, sequence order by frame_id)),
ev as (select lv.*, nb.gt_presence, case when nb.gt_presence = 'absent' then case when a and b then 'middle' when b then 'end' when a then 'start' else 'single' end end as absent_phase,
  case when nb.gt_presence = 'absent' then 'absent' when exists (select 1 from frames f where f.dataset = lv.dataset and f.sequence = lv.sequence and f.frame_id > lv.trusted and f.frame_id < lv.frame_id and f.gt_presence = 'absent') then 'reappearance' else 'continuous_present' end as event from lv join nb using (dataset, sequence, frame_id))
select dataset, sequence, frame_id, event as temporal_event, absent_phase, level as history_completeness, concat(event, '__', quality, '__', level) as visual_combination, case when reference_id = 0 then 'sequence_anchor' else 'sampled_prior_present' end as reference_source,
  (frame_id - reference_id)::int as reference_current_gap, case when quality = 'blurred' then 'unknown_quality' when level = 'h0_reference_only' and quality <> 'clean' or level = 'h1_one_observation' and quality = 'stale_box' then 'quality_not_allowed' end as problem from ev"""


@query(SCENARIO)
def scenario_columns(spark, sf_dir):
    made = scenario.scenario_columns(*_cases(spark, sf_dir))
    return made.select(*KEY, "frame_id", "temporal_event", "absent_phase", "history_completeness", "visual_combination", "reference_source", "reference_current_gap", "problem")


def _cases(spark, sf_dir):
    f, k = frames(spark, sf_dir), F.col("frame_id")
    reference = F.floor(k / 3).cast("int")
    history = F.filter(F.array(k - 4, k - 2, k - k % 2 - 2), lambda x: x >= reference)
    quality = F.when(k % 5 == 1, "jitter_box").when(k % 5 == 2, "stale_box").when(k % 5 == 3, "blurred")
    cases = f.where(k > 0).select(*KEY, "frame_id", reference.alias("reference_id"), F.lit(0).alias("anchor_id"), history.alias("history"), quality.alias("corruption"))
    return cases, f


@query(f"""select v.c as visual_combination, coalesce(n, 0) as n from (select unnest([e || '__clean__' || l for l in ['h0_reference_only', 'h1_one_observation', 'h2_two_observations', 'h3_three_observations']] || [e || '__jitter_box__' || l for l in ['h1_one_observation', 'h2_two_observations', 'h3_three_observations']]
  || [e || '__stale_box__' || l for l in ['h2_two_observations', 'h3_three_observations']]) as c from (values ('continuous_present'), ('absent'), ('reappearance')) t(e)) v
  left join (select visual_combination, count(*) as n from ({SCENARIO}) where problem is null group by all) s on s.visual_combination = v.c""")  # fmt: skip
def scenario_coverage(spark, sf_dir):
    """How many cases show each combination that there can be, zero included."""
    return scenario.scenario_coverage(scenario.scenario_columns(*_cases(spark, sf_dir)))


@query(f"""{FR}, q as (select *, coalesce(lag(case when execution_status = 'ok' then pred_presence end) over (partition by dataset, sequence order by frame_id), '') as last from frames),
z as (select dataset, sequence, frame_id, pred_presence, row_number() over w as rn, case when row_number() over w = 1 or (execution_status = 'ok' and pred_presence = 'present' and pred_identity = 'same' and px is not null) then 'T' when execution_status = 'ok' and pred_presence = 'absent' then 'A' else 'O' end as kind from frames window w as (partition by dataset, sequence order by frame_id)),
y as (select *, coalesce(max(case when kind = 'T' then rn end) over (partition by dataset, sequence order by frame_id rows between unbounded preceding and 1 preceding), 0) as t, coalesce(max(case when kind = 'A' then rn end) over (partition by dataset, sequence order by frame_id rows between unbounded preceding and 1 preceding), 0) as a from z)
select dataset, sequence, frame_id, case pred_presence when 'present' then case when a > t then 'reappearance' else 'continuous_present' end when 'absent' then case when a > t then 'continued_absence' else 'disappearance' end end as event from y""")  # fmt: skip
def semantic_events(spark, sf_dir):
    f = frames(spark, sf_dir)
    return replay.semantic_event(replay.cognitive_state(f), f)
