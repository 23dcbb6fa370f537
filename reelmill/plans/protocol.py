"""Queries over records as JSON, model answers, audits of plans and releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmill.functions import boxes as bx
from reelmill.functions import protocol as pr
from reelmill.functions.hashing import below_share, hash_byte, order_key, stable_rank
from reelmill.operators import audit, mixture, packing, replay
from reelmill.operators import labels as lb
from reelmill.operators.backend import rewarded
from reelmill.operators.evaluation import KEY, iou
from reelmill.operators.timeline import absent_phase, completeness, last_trusted, tracking_event
from reelmill.plans.registry import query, r9
from reelmill.session import table
from reelmill.sources import canonical, sinks
from reelmill.sources.fixtures import FRAMES_SQL, SEGMENTS_SQL, frames, segments

FR = f"with {FRAMES_SQL}"


def _records(spark, sf_dir):
    """The frames as JSON of three shapes, by frame_id modulo 3: flat, nested, and boxes by name in a context."""
    four = lambda b: F.array(b["x"], b["y"], b["w"], b["h"])
    f = frames(spark, sf_dir)
    flat = F.to_json(F.struct(F.col("sequence").alias("sequence_name"), F.col("dataset").alias("dataset_name"), F.col("frame_id").alias("frame_num"), four(F.col("gt")).alias("gt_bbox"), F.col("gt_presence").alias("gt_target_status"), four(F.col("pred")).alias("pred_bbox_xywh"), F.col("pred_presence").alias("pred_presence"), F.col("execution_status"), F.col("is_observation_frame")))
    nested = F.to_json(F.struct("sequence", "dataset", "frame_id", F.struct(F.col("execution_status").alias("status")).alias("execution"), F.struct(F.col("gt_presence").alias("target_presence"), four(F.col("gt")).alias("bbox_xywh")).alias("ground_truth"), F.struct(F.col("pred_presence").alias("target_presence"), F.col("pred").alias("bbox")).alias("prediction"), F.struct("is_observation_frame").alias("context")))
    committed = F.to_json(F.struct("sequence", "dataset", "frame_id", "execution_status", F.col("gt_presence"), F.struct(F.col("gt").alias("bbox")).alias("ground_truth"), F.struct(four(F.col("pred")).alias("bbox_xywh")).alias("prediction"), F.col("is_observation_frame").alias("is_keyframe")), {"ignoreNullFields": "true"})
    # an explicit null box is committed: what the prediction holds then doesn't count
    committed = F.concat(F.lit('{"target_bbox":null,'), F.substr(committed, F.lit(2)))
    text = F.when(F.col("frame_id") % 3 == 0, flat).when(F.col("frame_id") % 3 == 1, nested).otherwise(committed)
    return f.select(F.parse_json(text).alias("record"), F.lit("x/none.jsonl").alias("file"), F.lit(1).alias("line_no"))


@query(f"""{FR} select dataset, sequence, frame_id, gx as gt_x, gh as gt_h, case when frame_id % 3 < 2 then px end as pred_x, case when frame_id % 3 < 2 then ph end as pred_h, gt_presence,
  case when frame_id % 3 < 2 then coalesce(pred_presence, case when execution_status = 'ok' then 'absent' end) when execution_status = 'ok' then 'absent' end as pred_presence, execution_status, is_observation_frame from frames""")  # fmt: skip
def canonical_records(spark, sf_dir):
    made = canonical.canonical_frames(_records(spark, sf_dir))
    return made.select("dataset", "sequence", "frame_id", F.col("gt.x").alias("gt_x"), F.col("gt.h").alias("gt_h"), F.col("pred.x").alias("pred_x"), F.col("pred.h").alias("pred_h"), "gt_presence", "pred_presence", "execution_status", "is_observation_frame")


#: Answers of every kind, made from a frame's numbers; both engines read the text.
RAW = """case event_id % 15 when 0 then concat('{"target_status":"present","bbox_2d":[', event_id % 400, ',', event_id % 300, ',', event_id % 400 + 100, ',', event_id % 300 + 50, '],"memory_update":null}')
  when 1 then '{"target_status":"absent","bbox_2d":null,"memory_update":"gone behind a wall"}' when 2 then '{"target_status":"absent","bbox_2d":[1,2,3,4],"memory_update":null}'
  when 3 then '{"target_status":"present","bbox_2d":null,"memory_update":null}' when 4 then '{"target_status":"present","bbox_2d":[1,2,3,4],"memory_update":" ","extra":1}'
  when 5 then '{"target_status":"present","bbox_2d":[10,20,30,2000]}' when 6 then 'Here: {"target_status":"absent","bbox_2d":null}' when 7 then '{"target_status":"unsure","bbox_2d":null}'
  when 8 then '{"target_status":"present","bbox_2d":[0,0,1000,1000],"memory_update":7}' when 9 then '{"target_status":"absent"}'
  when 13 then '{"target_status":"absent","bbox_2d":null},"end"]' when 14 then '{"target_status":"absent","bbox_2d":null},"end"] and more'
  when 10 then '{"target_status":"absent","bbox_2d":null} {"more":1}' when 11 then '{"target_status":"absent","bbox_2d":null}x}' else concat('```json', chr(10), '{"target_status":"absent","bbox_2d":null}', chr(10), '```') end"""


@query("""with k as (select event_id, event_id % 15 as k from events) select event_id, case when k in (0, 8) then 'present' when k in (1, 12) then 'absent' end as presence,
  case when k in (0, 8) then 'same' when k in (1, 12) then 'not_applicable' end as identity, case when k = 1 then 'gone behind a wall' end as memory, case when k = 8 then 'memory_not_text' when k = 12 then 'memory_missing' end as memory_problem,
  case when k = 0 then round_even((event_id % 400) * 640.0::double / 1000, 2) when k = 8 then 0.0::double end as x, case when k = 0 then round_even((event_id % 400 + 100) * 640.0::double / 1000 - (event_id % 400) * 640.0::double / 1000, 2) when k = 8 then 640.0::double end as w,
  case k when 2 then 'absent_with_box' when 3 then 'present_without_box' when 4 then 'unknown_key' when 5 then 'bad_box' when 6 then 'not_one_json_object' when 10 then 'not_one_json_object' when 13 then 'not_one_json_object' when 14 then 'not_one_json_object' when 11 then 'not_one_json_object' when 7 then 'bad_status' when 9 then 'core_key_missing' end as reason from k""")  # fmt: skip
def tracking_outputs(spark, sf_dir):
    made = pr.with_tracking_output(table(spark, sf_dir, "events"), F.expr(RAW), F.lit(640.0), F.lit(480.0), "o")
    return made.select("event_id", "o.presence", "o.identity", "o.memory", "o.memory_problem", F.col("o.box.x").alias("x"), F.col("o.box.w").alias("w"), "o.reason")


@query(f"""{FR}, c as (select *, case when execution_status <> 'ok' then 'execution_not_ok' when frame_id = 0 then null when pred_presence is null then 'no_prediction' when pred_presence <> 'present' then 'not_present' when px is null then 'no_box' end as reason from frames)
select dataset, sequence, frame_id, reason, case when reason is null then 'present' when execution_status = 'ok' then case when pred_presence = 'absent' then 'absent' else 'uncertain' end end as committed from c""")  # fmt: skip
def commit_gate(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("reason", pr.commit_reason(F.col("frame_id") == 0, F.col("execution_status"), F.col("pred_presence"), F.col("pred")))
    return f.select(*KEY, "frame_id", "reason", pr.committed_presence(F.col("reason"), F.col("execution_status"), F.col("pred_presence")).alias("committed"))


@query(f"{FR} select dataset, sequence, frame_id, case when execution_status like '%error' then execution_status else coalesce(pred_presence, 'uncertain') end as decision from frames")
def decision_engine(spark, sf_dir):
    return frames(spark, sf_dir).select(*KEY, "frame_id", replay.decision_presence(F.col("execution_status"), F.col("pred_presence")).alias("decision"))


@query("""select doc_id, case when doc_id % 5 in (0, 2) then false when doc_id % 5 = 1 then true else doc_id % 3 = 0 end as unsafe from documents""")
def init_language_scope(spark, sf_dir):
    k = F.col("doc_id") % 5
    scope = F.when(k == 0, " First_Action_Description").when(k == 1, "full_video_story").when(k == 2, "Initial_Target ").when(k == 3, "class_name")
    return table(spark, sf_dir, "documents").select("doc_id", pr.is_unsafe_scope(scope, F.when(F.col("doc_id") % 3 == 0, "MGIT").otherwise("lasot")).alias("unsafe"))


EXPORT = f"""{FR}, x as (select dataset, sequence, frame_id, case when gx is null then concat('{{"target_status":"absent","bbox_2d":null,"memory_update":', case when frame_id % 5 = 0 then '"a \\"red\\" bag"' else 'null' end, '}}')
  else concat('{{"target_status":"present","bbox_2d":[', round_even(round_even(gx / 640.0::double * 1000, 2), 0)::int, ',', round_even(round_even(gy / 480.0::double * 1000, 2), 0)::int, ',', round_even(round_even((gx + gw) / 640.0::double * 1000, 2), 0)::int, ',',
    round_even(round_even((gy + gh) / 480.0::double * 1000, 2), 0)::int, '],"memory_update":', case when frame_id % 5 = 0 then '"a \\"red\\" bag"' else 'null' end, '}}') end as answer from frames)"""


def _answers(spark, sf_dir):
    memory = F.when(F.col("frame_id") % 5 == 0, 'a "red" bag')
    corners = bx.to_norm1000(F.col("gt"), F.lit(640.0), F.lit(480.0))
    return frames(spark, sf_dir).select(*KEY, "frame_id", pr.answer_text(F.col("gt_presence"), corners, memory).alias("answer"))


@query(f"{EXPORT} select * from x")
def grounding_export(spark, sf_dir):
    return _answers(spark, sf_dir)


@query(f"{EXPORT} select dataset, count(*) as records, count(*) filter (answer like '%\"present\"%') as present, sum(length(answer) - length(replace(answer, ',', '')))::bigint as commas from x group by dataset")
def export_report(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.groupBy("dataset").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("answer").contains('"present"')).alias("present"), F.sum(F.regexp_count("answer", F.lit(","))).alias("commas"))


@query(f"""{FR}, l as (select *, case frame_id % 6 when 0 then 'lost' else gt_presence end as target_status, case frame_id % 5 when 0 then '' when 1 then 'a state' end as memory_update, frame_id % 4 = 0 as verified_null, frame_id % 7 = 0 as reviewed from frames)
select dataset, sequence, frame_id, problem from (select *, case when frame_id % 6 = 0 then 'bad_status' when memory_update = '' then 'empty_update' when memory_update is null and not verified_null then 'null_without_proof'
  when memory_update is not null and verified_null then 'update_with_verified_null' when not reviewed and frame_id % 3 <> 0 then 'teacher_not_reviewed' end as problem from l) where problem is not null""")  # fmt: skip
def label_problems(spark, sf_dir):
    k = F.col("frame_id")
    rows = frames(spark, sf_dir).withColumns({
        "target_status": F.when(k % 6 == 0, "lost").otherwise(F.col("gt_presence")), "memory_update": F.when(k % 5 == 0, "").when(k % 5 == 1, "a state"), "verified_null": k % 4 == 0,
        "reviewed": k % 7 == 0, "source": F.lit("teacher_v1"), "quality_gate_passed": k % 3 == 0,
    })
    return lb.label_problems(rows)


@query(f"""{FR}, r as (select row_number() over (order by dataset, sequence, frame_id) as id, frame_id, case frame_id % 4 when 0 then 'verified_update' when 1 then 'verified_hard_null' when 2 then 'masked_unknown' else 'other' end as state,
  case when frame_id % 3 <> 0 then 1.0::double end as loss_scale, case when frame_id % 5 < 2 then '"x"' else 'null' end as memory_update from frames),
p as1 (select 1) select 1""".replace("p as1 (select 1) select 1", "q1 as (select state, case when state = 'other' then 'unknown_state' when state = 'masked_unknown' and loss_scale is not null then 'masked_with_scale' when state <> 'masked_unknown' and loss_scale is null then 'verified_without_scale' when state = 'verified_update' and memory_update = 'null' then 'update_without_text' when state <> 'verified_update' and memory_update <> 'null' then 'text_without_update' end as problem from r) select problem, count(*) as n from q1 where problem is not null group by problem"))
def supervision_audit(spark, sf_dir):
    k = F.col("frame_id")
    rows = frames(spark, sf_dir).select(
        F.concat_ws("/", *KEY, k.cast("string")).alias("id"), F.when(k % 4 == 0, "verified_update").when(k % 4 == 1, "verified_hard_null").when(k % 4 == 2, "masked_unknown").otherwise("other").alias("state"),
        F.when(k % 3 != 0, F.lit(1.0)).alias("loss_scale"), F.when(k % 5 < 2, '"x"').otherwise("null").alias("memory_update"),
    )
    return audit.supervision_problems(rows).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


W = "over (partition by dataset, sequence order by frame_id"


@query(f"""{FR}, l as (select *, max(case when gt_presence = 'present' then frame_id end) {W} rows between unbounded preceding and 1 preceding) as seen, max(case when gt_presence = 'absent' then frame_id end) {W} rows between unbounded preceding and 1 preceding) as gone,
  least(3, count(*) filter (gt_presence = 'present') {W} rows between unbounded preceding and 1 preceding)) as h from frames)
select case when gt_presence = 'present' then case when gone > seen then 'reappearance' else 'continuous_present' end when gone > seen then 'continued_absence' else 'disappearance' end as event, concat('H', h) as completeness, count(*) as n from l group by 1, 2""")  # fmt: skip
def taxonomy_coverage(spark, sf_dir):
    f = frames(spark, sf_dir)
    h = last_trusted(f).select(*KEY, "frame_id", completeness(F.col("history")).alias("completeness"))
    return tracking_event(f).join(h, [*KEY, "frame_id"]).groupBy("event", "completeness").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{FR}, n as (select *, coalesce(lag(gt_presence) {W}) = 'absent', false) as b, coalesce(lead(gt_presence) {W}) = 'absent', false) as a from frames),
t as (select dataset, sequence, frame_id, case when a and b then 'middle' when b then 'end' when a then 'start' else 'single' end as phase from n where gt_presence = 'absent')
select dataset, sequence, frame_id, 'phase' as "column", 'middle' as stored, phase as recomputed from t where frame_id % 10 = 0 and phase <> 'middle'""")  # fmt: skip
def taxonomy_audit(spark, sf_dir):
    own = absent_phase(frames(spark, sf_dir))
    stored = own.withColumn("phase", F.when(F.col("frame_id") % 10 == 0, "middle").otherwise(F.col("phase")))
    return audit.taxonomy_problems(stored, own, (*KEY, "frame_id"), ("phase",))


@query(f"{FR} select dataset, sequence, count(*) as frames, count(gx) as boxes, count(*) filter (gt_presence = 'present') as visible, count(*) filter (is_observation_frame) as keyframes, sequence like '%1' as has_text from frames group by dataset, sequence")
def dataset_inspection(spark, sf_dir):
    f = frames(spark, sf_dir)
    return audit.inspection(f, f.select(*KEY, F.when(F.col("sequence").endswith("1"), "a bag").alias("text")))


@query(f"""{FR}, c as (select dataset, sequence, frame_id, frame_id // 4 as case_no, row_number() over (partition by dataset, sequence, frame_id // 4 order by frame_id) as i from frames where execution_status = 'ok') select dataset, sequence, frame_id from c where i = 1""")
def api_bundle(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumns({"case_no": F.floor(F.col("frame_id") / 4), "clean": F.col("execution_status") == "ok"})
    return audit.bundle(rows, (*KEY, "case_no"), ("frame_id",)).select(*KEY, "frame_id")


@query("select n_nationkey as id, not (n_nationkey % 5 = 0) and n_nationkey * 100 >= 1200 and n_nationkey * 101 >= n_nationkey * 100 and n_nationkey % 3 <> 0 as verified from nation")
def report_gate(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("id"), (k % 5 == 0).alias("dry_run"), (k * 100).alias("minimum"), (k * 101).alias("written"), F.when(k % 3 == 0, "loose").otherwise("strict").alias("policy"))
    return audit.report_gate(rows).select("id", "verified")


@query("select source, lang from (select distinct source, lang, case when source = 'src3' then 'val' else 'train' end as split from documents) where split <> 'train'")
def train_only_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "lang").distinct().withColumn("split", F.when(F.col("source") == "src3", "val").otherwise(" Train"))
    return audit.not_training(rows).select("source", "lang")


@query("select case when part.p_size % 2 = 0 then 'a' else 'b' end as family, count(*) as n from part group by 1")
def family_check(spark, sf_dir):
    return audit.mixed_families(table(spark, sf_dir, "part").withColumn("family", F.when(F.col("p_size") % 2 == 0, "a").otherwise("b")))


RANK = "('0x' || substr(sha256(concat('13', chr(0), dataset, chr(0), sequence, chr(0), frame_id)), 1, 16))::ubigint"


@query(f"""{FR} select dataset, sequence, frame_id, {RANK}::double / 18446744073709551616.0::double < 0.1 as corrupted, ('0x' || substr(sha256(concat('13', chr(0), dataset, chr(0), sequence, chr(0), frame_id)), 3, 2))::int as byte1 from frames""")
def corruption_choice(spark, sf_dir):
    cols = ("dataset", "sequence", "frame_id")
    return frames(spark, sf_dir).select(*cols, below_share(stable_rank(13, *cols), 0.1).alias("corrupted"), hash_byte(order_key(13, *cols), 1).alias("byte1"))


@query(f"""{FR}, p as2 (select 1) select 1""".replace("p as2 (select 1) select 1", """jit as (select dataset, sequence, frame_id, gx, gw, (('0x' || substr(sha256(concat('17', chr(0), dataset, chr(0), sequence, chr(0), frame_id)), 1, 2))::int - 128) / 128.0::double * 0.1::double as dx from frames where gx is not null)
select dataset, sequence, frame_id, round(gx + dx * gw, 9) as x from jit"""))
def box_jitter(spark, sf_dir):
    cols = ("dataset", "sequence", "frame_id")
    shift = (hash_byte(order_key(17, *cols), 0) - 128) / F.lit(128.0) * F.lit(0.1)
    return frames(spark, sf_dir).where("gt is not null").select(*cols, r9(F.col("gt.x") + shift * F.col("gt.w")).alias("x"))


@query(f"""{FR}, b as (select dataset, sequence, frame_id, greatest(0, least(gx * 0.5::double, 40)) as x1, greatest(0, least((gx + gw) * 0.5::double, 40)) as x2, greatest(0, least(gy * 2.0::double, 90)) as y1 from frames where gx is not null) select * from b""")
def model_pixels(spark, sf_dir):
    f = frames(spark, sf_dir).where("gt is not null")
    made = bx.rescaled(bx.to_corners(F.col("gt")), F.lit(80.0), F.lit(45.0), F.lit(40.0), F.lit(90.0))
    return f.select(*KEY, "frame_id", made.alias("m")).select(*KEY, "frame_id", "m.x1", "m.x2", "m.y1")


@query(f"""{FR}, g as (select dataset, sequence, frame_id, frame_id - lag(frame_id) {W}) as gap from frames where pred_presence = 'present'), t as (select *, row_number() over (partition by dataset, sequence order by gap desc, frame_id) as place from g where gap is not null)
select dataset, sequence, frame_id, gap, place from t where place = 1""")  # fmt: skip
def top_gap(spark, sf_dir):
    from pyspark.sql import Window

    gap = F.col("frame_id") - F.lag("frame_id").over(Window.partitionBy(*KEY).orderBy("frame_id"))
    rows = frames(spark, sf_dir).where(F.col("pred_presence") == "present").select(*KEY, "frame_id").withColumn("gap", gap).where("gap is not null")
    return packing.top_per_group(rows, KEY, (F.desc("gap"), "frame_id"), 1)


@query(f"""{FR}, {SEGMENTS_SQL} select dataset, count(*) as segments, count(*) filter (start_frame = end_frame) as single, max(end_frame - start_frame + 1) as longest, count(distinct text) as texts from segments group by dataset""")
def segment_report(spark, sf_dir):
    length = F.col("end_frame") - F.col("start_frame") + 1
    return lb.clean_segments(segments(spark, sf_dir)).where("drop_reason is null").groupBy("dataset").agg(F.count(F.lit(1)).alias("segments"), F.count_if(length == 1).alias("single"), F.max(length).alias("longest"), F.count_distinct("text").alias("texts"))


@query(f"""{FR}, {SEGMENTS_SQL}, pb as (select dataset, sequence, name, start_frame + (end_frame - start_frame) // 2 as frame_id from segments where start_frame > 0) select dataset, sequence, name, frame_id::int as frame_id from pb""")
def segment_probes(spark, sf_dir):
    middle = F.col("start_frame") + F.floor((F.col("end_frame") - F.col("start_frame")) / 2)
    return segments(spark, sf_dir).where("start_frame > 0").select(*KEY, "name", middle.cast("int").alias("frame_id"))


@query(f"""{FR} select dataset, sequence, count(*) as pairs, sum(z)::bigint as total from (select dataset, sequence, unnest(list_transform(list_zip(a, b), lambda t: t[1] * 1000 + t[2])) as z from (select dataset, sequence, list(frame_id order by frame_id) as a, list(coalesce(gx, 0)::int order by frame_id) as b from frames group by dataset, sequence)) group by dataset, sequence""")
def positional_zip(spark, sf_dir):
    f = frames(spark, sf_dir)
    right = f.select(*KEY, "frame_id", F.coalesce(F.col("gt.x"), F.lit(0.0)).cast("int").alias("x"))
    zipped = mixture.zipped(f.select(*KEY, F.col("frame_id").alias("a")), right, KEY, "a", "frame_id")
    return zipped.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("a") * 1000 + F.col("x")).cast("long").alias("total"))


@query("select event_id, case when event_id % 3 = 0 then null else value end as value, case when event_id % 5 = 0 then null else value end as inner_value from events")
def json_safe(spark, sf_dir):
    k = F.col("event_id")
    value = F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    inner = F.when(k % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    made = sinks.json_safe(table(spark, sf_dir, "events").select("event_id", value.alias("value"), F.struct(inner.alias("v")).alias("s")))
    return made.select("event_id", "value", F.col("s.v").alias("inner_value"))


@query(f"""{FR}, a as (select dataset, sequence, count(*) filter (gt_presence = 'absent') as absent, count(*) as n from frames group by dataset, sequence)
select dataset, count(*) as sequences, sum(n)::bigint as frames, sum(absent)::bigint as absent, round(sum(absent) / sum(n)::double, 9) as ratio from a group by dataset""")  # fmt: skip
def merge_report(spark, sf_dir):
    a = frames(spark, sf_dir).groupBy(*KEY).agg(F.count_if(F.col("gt_presence") == "absent").alias("absent"), F.count(F.lit(1)).alias("n"))
    return a.groupBy("dataset").agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("frames"), F.sum("absent").alias("absent"), r9(F.sum("absent") / F.sum("n").cast("double")).alias("ratio"))


@query(f"""{FR}, i as (select *, greatest(0, least(gx + gw, px + pw) - greatest(gx, px)) * greatest(0, least(gy + gh, py + ph) - greatest(gy, py)) as inter from frames where gx is not null and px is not null)
select dataset, round(avg(inter / (gw * gh + pw * ph - inter)), 9) as mean_iou, round(avg((inter / (gw * gh + pw * ph - inter) > 0.5::double)::int::double), 9) as hit50 from i group by dataset""")  # fmt: skip
def protocol_summary(spark, sf_dir):
    f = frames(spark, sf_dir).where("gt is not null and pred is not null").withColumn("iou", iou(F.col("gt"), F.col("pred")))
    return f.groupBy("dataset").agg(r9(F.avg("iou")).alias("mean_iou"), r9(F.avg((F.col("iou") > 0.5).cast("double"))).alias("hit50"))


@query(f"""{FR}, k as (select distinct dataset, sequence from frames where frame_id % 2 = 0 and dataset = 'mgit' union select distinct dataset, sequence from frames where gt_identity = 'same') select dataset, count(*) as n from k group by dataset""")
def registry_concat(spark, sf_dir):
    f = frames(spark, sf_dir)
    both = f.where("frame_id % 2 = 0 and dataset = 'mgit'").select(*KEY).unionByName(f.where("gt_identity = 'same'").select(*KEY)).distinct()
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) as host, length(html) > 0 as has_html from pages")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)).alias("host"), (F.length("html") > 0).alias("has_html"))


@query("select c1.conv_id from (select conv_id, count(*) as n from conversations group by conv_id having count(*) > 3) c1")
def long_conversations(spark, sf_dir):
    return mixture.duplicates(table(spark, sf_dir, "conversations"), ("conv_id",)).where("n > 3").select("conv_id")


#: The four rewards of each frame.
REWARDS = f"""{FR} select dataset, sequence, frame_id, case when pred_presence in ('present', 'absent') and (pred_presence = 'present') = (px is not null) and frame_id % 4 <> 1 then 1.0 else 0.0 end::double as format,
  case when pred_presence = gt_presence then 1.0 else 0.0 end::double as presence,
  round(case when gt_presence = 'absent' then case when pred_presence = 'absent' and px is null then 1.0 else 0.0 end when pred_presence = 'present' and px is not null then
    greatest(0, least(px + pw, gx + gw) - greatest(px, gx)) * greatest(0, least(py + ph, gy + gh) - greatest(py, gy))
    / (pw * ph + gw * gh - greatest(0, least(px + pw, gx + gw) - greatest(px, gx)) * greatest(0, least(py + ph, gy + gh) - greatest(py, gy))) else 0.0 end::double, 9) as bbox,
  case when pred_presence in ('present', 'absent') and (pred_presence = 'present') = (px is not null) then 1.0 else 0.0 end::double as consistency from frames"""


@query(REWARDS)
def tracking_rewards(spark, sf_dir):
    made = pr.with_rewards(frames(spark, sf_dir), *_rewarded_answers(), "r")
    return made.select(*KEY, "frame_id", "r.format", "r.presence", r9(F.col("r.bbox")).alias("bbox"), "r.consistency")


def _rewarded_answers():
    """Completions and references of frames as JSON; every fourth completion is fenced."""
    corners = lambda b: F.when(b.isNotNull(), F.array(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]))
    answer = lambda p, b: F.to_json(F.struct(p.alias("target_status"), corners(b).alias("bbox_2d")), {"ignoreNullFields": "false"})
    own = answer(F.col("pred_presence"), F.col("pred"))
    own = F.when(F.col("frame_id") % 4 == 1, F.concat(F.lit("```json\n"), own, F.lit("\n```"))).otherwise(own)
    return own, answer(F.col("gt_presence"), F.col("gt"))


@query(f"select dataset, sequence, frame_id, presence as reward_presence, bbox as reward_bbox, round(0.5::double * presence + 2.0::double * bbox, 8) as reward from ({REWARDS})")
def reward_scalars(spark, sf_dir):
    """Two rewards by their names, and their weighted sum."""
    made = rewarded(frames(spark, sf_dir), *_rewarded_answers(), ("presence", "bbox"), (0.5, 2.0))
    return made.select(*KEY, "frame_id", "reward_presence", r9(F.col("reward_bbox")).alias("reward_bbox"), F.round("reward", 8).alias("reward"))
