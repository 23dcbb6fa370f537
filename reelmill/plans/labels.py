"""Queries over segments, labels, texts and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmill.functions import decisions as dc
from reelmill.functions import text as tx
from reelmill.operators import labels as lb
from reelmill.operators.evaluation import KEY
from reelmill.plans.registry import query, r9
from reelmill.session import table
from reelmill.sources.fixtures import FRAMES_SQL, SEGMENTS_SQL, frames, segments

BOTH = f"with {FRAMES_SQL}, {SEGMENTS_SQL}"
AT = """{name} as (select p.dataset, p.sequence, p.frame_id, min(x.text) as low, max(x.text) as high from {points} p left join segments x
  on x.dataset = p.dataset and x.sequence = p.sequence and p.frame_id between x.start_frame and x.end_frame group by p.dataset, p.sequence, p.frame_id)"""
BOUNDS = f"""{{both}}, {AT.format(name="st", points="frames")},
ed as (select distinct dataset, sequence, unnest([start_frame, end_frame + 1]) as frame_id from segments),
e1 as (select dataset, sequence, frame_id - 1 as frame_id from ed where frame_id > 0), {AT.format(name="s0", points="e1")},
e2 as (select * from ed where frame_id > 0), {AT.format(name="s1", points="e2")},
bounds as (select b.dataset, b.sequence, b.frame_id from s1 b join s0 a on a.dataset = b.dataset and a.sequence = b.sequence and a.frame_id = b.frame_id - 1
  where coalesce(a.low <> a.high, false) or coalesce(b.low <> b.high, false) or a.low is distinct from b.low),
ds as (select f.dataset, f.sequence, f.frame_id, min(abs(f.frame_id - b.frame_id)) as distance from frames f left join bounds b using (dataset, sequence) group by f.dataset, f.sequence, f.frame_id)"""


@query(f"{BOTH}, {AT.format(name='st', points='frames')} select dataset, sequence, frame_id, coalesce(low <> high, false) as ambiguous, case when low = high then low end as state from st")
def segment_state_at(spark, sf_dir):
    return lb.state_at(frames(spark, sf_dir).select(*KEY, "frame_id"), segments(spark, sf_dir)).select(*KEY, "frame_id", "ambiguous", "state")


@query(f"{BOUNDS.format(both=BOTH)} select dataset, sequence, frame_id, distance from ds")
def boundary_distance(spark, sf_dir):
    s = segments(spark, sf_dir)
    return lb.boundary_distance(frames(spark, sf_dir).select(*KEY, "frame_id"), lb.boundaries(s))


#: Segments of which some are as long as an update may be, in characters and in words, and some longer.
LONG = f"""with {FRAMES_SQL}, {SEGMENTS_SQL.replace("segments as (", "short_segments as (")}, segments as (select * replace (case name[-1:] when '1' then rtrim(repeat(concat(text, ' '), 30)) when '3' then rtrim(repeat(concat(text, ' '), 31))
  when '5' then concat(text, repeat('x', 256 - length(text))) when '7' then concat(text, repeat('x', 257 - length(text))) else text end as text) from short_segments)"""


@query(f"""{BOUNDS.format(both=LONG)}, ini as (select dataset, sequence, arg_min(text, start_frame) as initial from segments group by all),
j as (select f.dataset, f.sequence, f.frame_id, f.gt_presence = 'absent' as absent, coalesce(st.low <> st.high, false) as amb, case when st.low = st.high then st.low end as w, ds.distance, initial
  from frames f join st using (dataset, sequence, frame_id) join ds using (dataset, sequence, frame_id) join ini using (dataset, sequence)),
i as (select *, coalesce(last_value(case when not absent and not amb and length(w) <= 256 and len(string_split(w, ' ')) <= 30 then w end ignore nulls) over (partition by dataset, sequence order by frame_id rows between unbounded preceding and 1 preceding), initial) as input_state from j),
r as (select *, case when absent then 'absent_no_new_appearance_evidence' when amb then 'overlapping_segments_conflicting_text' when w is null then 'frame_not_covered_by_any_segment'
  when w <> input_state and length(w) <= 256 and len(string_split(w, ' ')) <= 30 then 'action_segment_text_changed' when w <> input_state then 'update_text_exceeds_label_limit' when distance < 2 then concat('within_boundary_margin(', distance, ')') else 'within_segment_state_text_unchanged' end as reason from i)
select dataset, sequence, frame_id, case when reason like 'action%' then 'verified_update' when reason like 'absent%' or reason like '%unchanged' then 'verified_hard_null' else 'masked_unknown' end as state,
  case when reason like 'action%' then w end as memory_update, input_state, reason from r""")  # fmt: skip
def state_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


def _labels(spark, sf_dir):
    plan = frames(spark, sf_dir).select(*KEY, "frame_id", (F.col("gt_presence") == "absent").alias("absent"))
    last, text = F.right("name", F.lit(1)), F.col("text")
    words = lambda n: F.rtrim(F.repeat(F.concat(text, F.lit(" ")), F.lit(n)))
    longer = F.when(last == "1", words(30)).when(last == "3", words(31)).when(last == "5", F.rpad(text, 256, "x")).when(last == "7", F.rpad(text, 257, "x")).otherwise(text)
    return lb.state_labels(plan, segments(spark, sf_dir).withColumn("text", longer), margin=2)


#: A chain of updates with wrong inputs at every 19th frame, for the check of chains and the as-of join.
CHAIN = f"""with {FRAMES_SQL}, u as (select dataset, sequence, frame_id, case when frame_id % 4 = 1 then concat('state ', frame_id % 12) end as memory_update from frames),
v as (select *, last_value(memory_update ignore nulls) over (partition by dataset, sequence order by frame_id rows between unbounded preceding and 1 preceding) as expected from u),
ch as (select *, case when frame_id % 19 = 7 then 'wrong' else expected end as input_state from v)"""


def _chain(spark, sf_dir):
    from pyspark.sql import Window

    u = frames(spark, sf_dir).select(*KEY, "frame_id").withColumn("memory_update", F.when(F.col("frame_id") % 4 == 1, F.concat(F.lit("state "), (F.col("frame_id") % 12).cast("string"))))
    before = F.last("memory_update", ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1))
    return u.withColumn("input_state", F.when(F.col("frame_id") % 19 == 7, "wrong").otherwise(before))


@query(f"{CHAIN} select dataset, sequence, frame_id, expected, input_state from ch where expected is not null and input_state is distinct from expected")
def label_chain_check(spark, sf_dir):
    return lb.chain_breaks(_chain(spark, sf_dir))


@query(f"""{CHAIN}, ca as (select dataset, sequence, frame_id, greatest(0, frame_id - frame_id % 6) as reference_id from frames where gt_presence = 'absent')
select c.dataset, c.sequence, c.frame_id, c.reference_id::int as reference_id, arg_max(u.memory_update, u.frame_id) as memory from ca c left join u on u.dataset = c.dataset and u.sequence = c.sequence
  and u.frame_id >= c.reference_id and u.frame_id < c.frame_id and u.memory_update is not null group by c.dataset, c.sequence, c.frame_id, c.reference_id""")  # fmt: skip
def asof_memory(spark, sf_dir):
    cases = frames(spark, sf_dir).where(F.col("gt_presence") == "absent").select(*KEY, "frame_id", (F.col("frame_id") - F.col("frame_id") % 6).cast("int").alias("reference_id"))
    return lb.asof_update(cases, _chain(spark, sf_dir))


@query(f"""{CHAIN}, lbl as (select dataset, sequence, frame_id, 'verified_update' as state from u where memory_update is not null)
select f.dataset, f.sequence, f.frame_id, coalesce(l.state, 'masked_unknown') as state from frames f left join lbl l using (dataset, sequence, frame_id)""")  # fmt: skip
def label_lookup_default(spark, sf_dir):
    labels = _chain(spark, sf_dir).where("memory_update is not null").withColumn("state", F.lit("verified_update"))
    return lb.with_default(labels, frames(spark, sf_dir).select(*KEY, "frame_id"), F.lit("masked_unknown"))


#: Texts of documents as states, each against the next one's.
LINES = r"""with d as (select doc_id, coalesce(text, '') as line from documents),
n as (select doc_id, line, lead(line) over (order by doc_id) as nxt from d)"""


def _hash():
    # of the text itself, so that finding neighbours makes no words of it
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _with_next(d):
    """d (doc_id, h, line, ...) with nxt: the line of the next row by id, nulls last, and by h, a hash of the text; null behind the last."""
    from pyspark.sql import Window

    # neighbours are found over ids alone, in blocks of them, so that no task orders all documents; a block's last looks at the least row of the next block that has any
    rows = d
    keys = rows.select("doc_id", "h").withColumns({"block": F.floor(F.col("doc_id") / 1024), "own": F.lit(True)})
    least = keys.groupBy("block").agg(F.min(F.struct("doc_id", "h")).alias("least"))
    before = least.withColumn("to", F.lag("block").over(Window.orderBy(F.asc_nulls_last("block")))).where("to is not null")
    ahead = before.select("least.doc_id", "least.h", F.col("to").alias("block"), F.lit(False).alias("own"))
    order = Window.partitionBy("block").orderBy(F.desc("own"), "doc_id", "h")
    after = keys.unionByName(ahead).withColumn("n", F.lead(F.struct("doc_id", "h")).over(order)).where("own and n is not null").select("doc_id", "h", F.col("n.doc_id").alias("n_id"), F.col("n.h").alias("n_h"))
    once = rows.dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("n_id"), F.col("h").alias("n_h"), F.col("line").alias("nxt"))
    # the next row's line is joined to the pair first: each text is shuffled once
    given = after.join(once, after.n_id.eqNullSafe(once.n_id) & (after.n_h == once.n_h)).select(after.doc_id, after.h, "nxt", F.row_number().over(Window.partitionBy(after.doc_id, after.h).orderBy(after.n_id, after.n_h)).alias("nth"))
    own = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("h")))
    joined = own.alias("r").join(given.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.h") == F.col("g.h")) & (F.col("r.nth") == F.col("g.nth")), "left")
    return joined.select(*[f"r.{c}" for c in d.columns], "g.nxt")


TOK = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 2))"
SENT = "trim(trim(regexp_replace(replace({x}, '`', ' '), '[\\s\\x{{00a0}}]+', ' ', 'g')), ' \"''')"


@query(LINES + f""", t as (select *, {TOK.format(x="line")} as a, {TOK.format(x="coalesce(nxt, '')")} as b from n)
select doc_id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double end, 9) as agreement from t""")  # fmt: skip
def jaccard_agreement(spark, sf_dir):
    # texts become sets of words before they meet
    d = table(spark, sf_dir, "documents").select("doc_id", _hash().alias("h"), tx.tokens(F.coalesce("text", F.lit(""))).alias("line"))
    return _with_next(d).select("doc_id", r9(tx.overlap(F.col("line"), F.col("nxt"))).alias("agreement"))


@query(LINES + f""", s as (select *, {SENT.format(x="line")} as x, {SENT.format(x="case when doc_id % 3 = 0 then lower(line) || '.' else coalesce(nxt, '') end")} as y from n),
t as (select *, {TOK.format(x="x")} as a, {TOK.format(x="y")} as b from s)
select doc_id, case when x = '' then true when y = '' then false else rtrim(lower(x), '.') = rtrim(lower(y), '.') or
  (case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double end) > 0.9 end as vacuous from t""")  # fmt: skip
def jaccard_vacuous(spark, sf_dir):
    # texts become what they say before they meet: a document's own words, and those of the text it is held against if that is made of it
    own = F.coalesce("text", F.lit(""))
    made = F.when(F.col("doc_id") % 3 == 0, tx.said(F.concat(F.lower(own), F.lit("."))))
    rows = _with_next(table(spark, sf_dir, "documents").select("doc_id", _hash().alias("h"), tx.said(own).alias("line"), made.alias("made")))
    other = F.coalesce("made", "nxt", tx.said(F.lit("")))
    return rows.withColumn("other", other).select("doc_id", tx.vacuous(F.col("line"), F.col("other")).alias("vacuous"))


@query(r"""with d as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{00a0}]+', ' ', 'g')) as flat from documents),
w as (select *, case when flat = '' then 0 else len(string_split(flat, ' ')) end as n from d)
select doc_id, n::int as n_words, case when n < 4 then 'state_too_short' when n > 40 then 'state_too_long' end as gate,
  sha256(concat(upper(flat[1:1]), flat[2:])) as capitalised from w""")  # fmt: skip
def text_gate(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", tx.n_words(text).alias("n_words"), tx.word_gate(text, 4, 40).alias("gate"), F.sha2(tx.capitalised(text), 256).alias("capitalised"))


#: What is put behind a text, by its id: phrases that lists refuse, and some close to them that none does.
PHRASES = (" no significant change", " and is still red as before", " inside the red box", " and might be late", " still on the road", " Image 2", " seems to wait", " the same man", " now also wet", " appears to be about to jump")


@query(r"""with d as (select doc_id, coalesce(text, '') || ([' no significant change', ' and is still red as before', ' inside the red box', ' and might be late', ' still on the road', ' Image 2', ' seems to wait', ' the same man', ' now also wet', ' appears to be about to jump'])[doc_id % 10 + 1] as t from documents)
select doc_id, regexp_matches(t, '(?i)\bno\s+(?:material(?:ly)?\s+|significant\s+|meaningful\s+)?change\b|\b(?:nothing\s+changed|unchanged|no\s+update|none)\b') as no_change,
  regexp_matches(t, '(?i)\bnow also\b|\bstill\b.{0,20}\bas before\b|\bsame as\b|\bpreviously\b|\bunchanged\b|\bappears to be (?:thinking|planning|trying|about to)\b|\bprobably\b|\bmight be\b|\bseems to want\b|\bimage \d\b|\bred box\b|\bbounding box\b|\bthe frame\b') as ungrounded from d""")  # fmt: skip
def text_blacklists(spark, sf_dir):
    t = F.concat(F.coalesce("text", F.lit("")), F.get(F.array(*map(F.lit, PHRASES)), F.col("doc_id") % 10))
    return table(spark, sf_dir, "documents").select("doc_id", tx.says_no_change(t).alias("no_change"), tx.is_ungrounded(t).alias("ungrounded"))


@query("""select doc_id, concat(regexp_replace(concat(source, '/', lang, ' ', doc_id), '[^A-Za-z0-9._-]+', '_', 'g'), '-', sha256(concat(source, '/', lang, ' ', doc_id))[1:8]) as name from documents""")
def safe_component(spark, sf_dir):
    name = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(" "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.safe_component(name).alias("name"))


#: Answers of every shape, made from numbers of events: SQL text that both engines read.
ANSWER = """case event_id % 9 when 0 then 'no json here' when 1 then concat('Sure: {{"state_changed": true, "reason_code": "action_changed", "new_state": "a man rides a red bike number ', event_id % 7, '"}}')
  when 2 then '{{"state_changed": false, "reason_code": "no_significant_change"}}' when 3 then '{{"state_changed": false, "reason_code": "pose_changed"}}'
  when 4 then '{{"state_changed": true, "reason_code": "insufficient_evidence", "new_state": "x"}}' when 5 then '{{"reason_code": "pose_changed"}}'
  when 6 then '{{"state_changed": true, "reason_code": "pose_changed", "new_state": "too short"}}' when 7 then concat('{{"state_changed": "TRUE", "reason_code": "Pose_Changed ", "new_state": "', case event_id div 9 % 4 when 0 then 'the person inside the red box walking on a road' when 1 then 'a man is still on the road' when 2 then 'a man who probably wants to cross the street soon' else 'the target visible in Image 2 walking along a road' end, '"}}')
  else concat('{{"state_changed": true, "reason_code": "', case event_id div 9 % 4 when 0 then 'made_up' when 1 then 'viewpoint_changed' when 2 then 'interaction_changed' else 'occlusion_recovered' end, '", "new_state": "a man walks on the road"}}') end""".replace("{{", "{").replace("}}", "}")


@query("""with k as (select event_id, event_id % 9 as k, event_id // 9 % 4 as q from events) select event_id, case when k = 1 or k = 7 and q = 1 or k = 8 and q > 1 then true when k = 2 then false end as changed,
  case when k = 1 then 'action_changed' when k = 2 then 'no_significant_change' when k = 7 and q = 1 then 'pose_changed' when k = 8 and q = 2 then 'interaction_changed' when k = 8 and q = 3 then 'occlusion_recovered' end as reason_code,
  case when k = 1 then concat('a man rides a red bike number ', event_id % 7) when k = 2 then '' when k = 7 and q = 1 then 'a man is still on the road' when k = 8 and q > 1 then 'a man walks on the road' end as new_state,
  case case when k = 7 and q = 1 or k = 8 and q > 1 then 1 else k end when 0 then 'unparseable_json' when 3 then 'keep_with_change_reason' when 4 then 'update_with_keep_reason' when 5 then 'missing_state_changed' when 6 then 'state_too_short'
    when 7 then 'ungrounded_or_relative_phrasing' when 8 then 'unknown_reason_code' end as rejection from k""")  # fmt: skip
def teacher_decisions(spark, sf_dir):
    made = dc.with_teacher(table(spark, sf_dir, "events"), F.expr(ANSWER), "d")
    return made.select("event_id", "d.*")


@query("""with k as (select user_id, event_type, count(*) filter (event_id % 9 = 1 or event_id % 9 = 7 and event_id // 9 % 4 = 1 or event_id % 9 = 8 and event_id // 9 % 4 > 1) as updates, count(*) filter (event_id % 9 = 2) as keeps, count(*) as n from events group by all) select * from k""")
def decision_counters(spark, sf_dir):
    made = dc.with_teacher(table(spark, sf_dir, "events"), F.expr(ANSWER), "d")
    return made.groupBy("user_id", "event_type").agg(F.count_if("d.changed").alias("updates"), F.count_if(~F.col("d.changed")).alias("keeps"), F.count(F.lit(1)).alias("n"))


@query("""with k as (select event_id, event_id % 9 as k, event_id // 9 % 4 as q, event_id // 9 % 3 as p, k = 7 and q = 1 or k = 8 and q > 1 as more from events) select event_id, case when k = 1 and p <> 2 or more then true when k = 2 and p <> 2 then false end as changed,
  case when more then case k when 7 then 'a man is still on the road' else 'a man walks on the road' end when k = 1 and p = 0 then concat('a man rides a red bike number ', event_id % 7) when k = 1 and p = 1 then 'man rides red bike number' when k = 2 and p <> 2 then '' end as new_state,
  case when more then 'dual_pass_agreed' when k not in (1, 2) then 'dual_pass_parse_failure' when k = 2 and p = 2 then 'dual_pass_decision_conflict' when k = 2 then 'dual_pass_keep' when p = 2 then 'dual_pass_wording_conflict' else 'dual_pass_agreed' end as reason from k""")  # fmt: skip
def dual_pass(spark, sf_dir):
    events = dc.with_teacher(table(spark, sf_dir, "events"), F.expr(ANSWER), "a")
    state = F.when(F.expr("event_id div 9 % 3 = 0"), F.lit("")).when(F.expr("event_id div 9 % 3 = 1"), "man rides red bike number").otherwise("some dog sleeps under tables")
    second = F.when(
        F.expr("event_id div 9 % 3 > 0 and event_id % 9 = 1 or event_id div 9 % 3 = 2 and event_id % 9 = 2"),
        F.struct(F.lit(True).alias("changed"), F.lit("action_changed").alias("reason_code"), state.alias("new_state"), F.lit(None).cast("string").alias("rejection")),
    ).otherwise(F.col("a"))
    made = events.withColumn("b", second).select("event_id", dc.reconciled(F.col("a"), F.col("b")).alias("d"))
    return made.select("event_id", "d.*")


@query("""select event_id, case when event_id % 5 = 0 then null when event_id % 3 = 0 then 'verified_update' when event_id % 2 = 0 then 'verified_hard_null' else 'masked_unknown' end as state,
  case when event_id % 5 <> 0 and (event_id % 3 = 0 or event_id % 2 = 0) then 1.0::double end as loss_scale from events""")  # fmt: skip
def supervision_states(spark, sf_dir):
    status = F.when(F.col("event_id") % 5 == 0, "unknown").when(F.col("event_id") % 7 == 0, " Absent").otherwise("present")
    update = F.when(F.col("event_id") % 3 == 0, "a state")
    state = dc.supervision_state(status, update, (F.col("event_id") % 2 == 0) & (F.col("event_id") % 3 != 0))
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"), dc.loss_scale(state).alias("loss_scale"))


@query("""with m as (select conv_id, turn, case when turn % 3 = 0 then concat('{"target_status":"present","memory_update":', case when turn % 2 = 0 then 'null' else '"a bike"' end, '}') when turn % 3 = 1 then '{"target_status":"absent"}' else text end as t from conversations)
select conv_id, turn, case when turn % 3 = 0 then '{"target_status":"present","memory_update":' end as prefix, case when turn % 3 = 0 then case when turn % 2 = 0 then 'null' else '"a bike"' end end as value, case when turn % 3 = 0 then '}' end as suffix from m""")  # fmt: skip
def loss_mask_split(spark, sf_dir):
    value = F.when(F.col("turn") % 2 == 0, "null").otherwise('"a bike"')
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"target_status":"present","memory_update":'), value, F.lit("}"))).when(F.col("turn") % 3 == 1, '{"target_status":"absent"}').otherwise(F.col("text"))
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.masked_response(t).alias("m"))
    return made.select("conv_id", "turn", "m.prefix", "m.value", "m.suffix")


@query("""select event_id, case when event_id % 3 = 0 then case when event_id % 2 = 0 then 'dataset_gt_disappearance_transition_v1' else 'dataset_gt_continued_absence_v1' end when event_id % 2 = 0 then 'frontier_api_teacher_v1' else 'frontier_api_teacher_hard_null_v1' end as source from events""")
def label_sources(spark, sf_dir):
    k = F.col("event_id")
    made = dc.label_source(F.when(k % 3 == 0, "absent").otherwise("present"), F.when(k % 2 == 0, "a state"))
    return table(spark, sf_dir, "events").select("event_id", made.alias("source"))


#: Answers of an API teacher: a right one, and changes that break a rule each.
API = """'{"decision":"update","changed_elements":["Action","pose","action"],"memory_update":"a man rides a red bike","confidence":0.9,"evidence_sufficiency":"sufficient","significant_change":true,"identity_consistent":true,"standalone_complete":true,"evidence":"Image 3 shows a bike"}'"""
KEEP = f"""replace(replace(replace({API}, '"update"', '"keep"'), '["Action","pose","action"]', '[]'), '"significant_change":true', '"significant_change":false')"""
EMPTY = f"""replace({KEEP}, '"a man rides a red bike"', 'null')"""
API_RAW = f"""case event_id % 16 when 0 then {API} when 1 then {EMPTY} when 2 then replace(replace({EMPTY}, '"keep"', '"uncertain"'), '"sufficient"', '"insufficient"') when 3 then 'no answer'
  when 4 then replace({API}, '"confidence"', '"sureness"') when 5 then replace({API}, '"update"', '"maybe"') when 6 then replace({API}, '"pose"', '"mood"') when 7 then replace({API}, '0.9', '1.5')
  when 8 then replace({API}, '"significant_change":true', '"significant_change":"yes"') when 9 then replace({API}, 'Image 3', 'Image 2') when 10 then {KEEP} when 11 then replace({API}, 'a man rides a red bike', 'a man')
  when 12 then replace({API}, '0.9', '0.2') when 13 then replace({API}, 'a man rides a red bike', 'a dog sleeps on the porch') when 14 then concat({API}, ' {{}}') else concat('Answer: ', replace({API}, '"sufficient"', '"Sufficient "')) end"""


@query("""with k as (select event_id, event_id % 16 as k from events)
select event_id, case when k in (0, 12, 13, 15) then 'update' when k = 1 then 'keep' when k = 2 then 'uncertain' end as decision, case when k in (0, 12, 13, 15) then 'action,pose' when k in (1, 2) then '' end as elements,
  case when k = 13 then 'a dog sleeps on the porch' when k in (0, 12, 15) then 'a man rides a red bike' end as memory_update,
  case k when 3 then 'unparseable_json' when 14 then 'unparseable_json' when 4 then 'schema_keys_mismatch' when 5 then 'invalid_decision' when 6 then 'invalid_changed_elements' when 7 then 'invalid_confidence' when 8 then 'non_boolean_audit_field'
    when 9 then 'invalid_current_evidence' when 10 then 'inconsistent_keep' when 11 then 'invalid_update_length' end as rejection,
  case when k in (0, 1, 15) then true when k in (2, 12, 13) then false end as accept,
  case when k in (0, 15) then 'verified_update' when k = 1 then 'verified_hard_null' when k = 2 then 'model_uncertain' when k = 12 then 'low_confidence' when k = 13 then 'vacuous_update' end as reason from k""")  # fmt: skip
def api_decisions(spark, sf_dir):
    made = dc.with_api_decision(table(spark, sf_dir, "events"), F.expr(API_RAW), "d")
    made = made.withColumn("g", dc.api_gate(F.col("d"), F.lit("A dog sleeps on the porch."), 0.5))
    return made.select("event_id", "d.decision", F.array_join("d.changed_elements", ",").alias("elements"), "d.memory_update", "d.rejection", "g.accept", "g.reason")


@query(r"""with x as (select doc_id, case doc_id % 5 when 0 then 'the car ' || ['seen from', 'in a side view with', 'partially occluded by', 'out of focus near'][doc_id % 4 + 1] || ' the wall' when 1 then '没有明显变化' when 2 then '无需更新' when 3 then '外观变化明显' else 'a man rides a red bike' end as t from documents)
select doc_id, doc_id % 5 = 0 as observation, doc_id % 5 in (1, 2) as no_change from x""")  # fmt: skip
def state_phrases(spark, sf_dir):
    k = F.col("doc_id") % 5
    view = F.get(F.array(*map(F.lit, ("seen from", "in a side view with", "partially occluded by", "out of focus near"))), F.col("doc_id") % 4)
    t = F.when(k == 0, F.concat(F.lit("the car "), view, F.lit(" the wall"))).when(k == 1, "没有明显变化").when(k == 2, "无需更新").when(k == 3, "外观变化明显").otherwise("a man rides a red bike")
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_observation(t).alias("observation"), tx.says_no_change(t).alias("no_change"))
