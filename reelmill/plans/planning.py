"""Queries over sampling plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmill.functions.hashing import below_share, stable_rank
from reelmill.operators import planning as pl
from reelmill.operators.evaluation import KEY
from reelmill.operators.timeline import anchors
from reelmill.plans.registry import query
from reelmill.session import table
from reelmill.sources.fixtures import FRAMES_SQL, frames

W = "over (partition by dataset, sequence order by frame_id"
RANK = "('0x' || substr(sha256(concat('{seed}', chr(0), {key})), 1, 16))::ubigint"


@query(f"select doc_id, {RANK.format(seed=11, key='doc_id')}::decimal(20, 0) as rank, {RANK.format(seed=11, key='doc_id')}::double / 18446744073709551616.0::double < 0.25::double as chosen from documents")
def stable_hash_order(spark, sf_dir):
    rank = stable_rank(11, "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", rank.alias("rank"), below_share(rank, 0.25).alias("chosen"))


@query(f"""with {FRAMES_SQL}, n as (select *, row_number() {W}) - 1 as pos, count(*) over (partition by dataset, sequence) as n from frames),
w as (select dataset, sequence, n, unnest([round_even(i * (n - 1) / 6.0::double, 0)::int for i in range(7)]) as pos from (select distinct dataset, sequence, n from n))
select n.dataset, n.sequence, n.frame_id from n join (select distinct * from w) w using (dataset, sequence, pos)""")  # fmt: skip
def uniform_pick(spark, sf_dir):
    return pl.uniform_pick(frames(spark, sf_dir), KEY, "frame_id", F.lit(7)).select(*KEY, "frame_id")


POOLS = f"""with {FRAMES_SQL}, a as (select dataset, sequence, min(frame_id) filter (gt_presence = 'present') as anchor from frames group by all),
z as (select f.dataset, f.sequence, a.anchor, count(*) filter (gt_presence = 'present') as n_present, count(*) filter (gt_presence = 'absent') as n_absent
  from frames f join a using (dataset, sequence) where frame_id > anchor group by f.dataset, f.sequence, a.anchor),
t as (select *, least(case when dataset = 'mgit' then 20 else 12 end, n_present + n_absent) as target from z),
pools as (select *, greatest(0, target - n_present) as min_absent, least(target, n_absent) as max_absent from t),
g as (select *, round_even(sum(target) over (partition by dataset) * 0.3::double, 0)::bigint as goal, sum(min_absent) over (partition by dataset) as must,
  sha256(concat('11', chr(0), dataset, '::', sequence)) as rank from pools),
sl as (select *, unnest(range(1, (max_absent - min_absent + 1)::bigint)) as slot from g),
gv as (select *, row_number() over (partition by dataset order by slot, rank) as nth from sl),
quota as (select p.*, p.min_absent + coalesce(x.extra, 0) as absent from pools p left join (select dataset, sequence, count(*) as extra from gv where nth <= goal - must group by all) x using (dataset, sequence))"""


@query(f"{POOLS} select dataset, sequence, anchor, n_present, n_absent, target::bigint as target, min_absent::bigint as min_absent, max_absent::bigint as max_absent, absent::bigint as absent from quota")
def quota_waterfill(spark, sf_dir):
    made = pl.absent_quota(pl.pools(frames(spark, sf_dir), 12, caps={"mgit": 20}), 0.3, 11)
    return made.withColumns({c: F.col(c).cast("long") for c in ("target", "min_absent", "max_absent", "absent")})


def _quota(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f, pl.absent_quota(pl.pools(f, 12, caps={"mgit": 20}), 0.3, 11)


#: A spread of k over the numbered rows of a relation with columns dataset, sequence, v, k.
SPREAD = """{name}_n as (select *, row_number() over (partition by dataset, sequence order by v) - 1 as pos, count(*) over (partition by dataset, sequence) as n from {src}),
{name}_p as (select distinct dataset, sequence, case when n <= k then i else round_even(i * (n - 1) / greatest(k - 1, 1)::double, 0)::bigint end as pos
  from (select distinct dataset, sequence, n, k, unnest(range(0, least(n, k)::bigint)) as i from {name}_n where k > 0)),
{name} as (select x.* from {name}_n x join {name}_p y using (dataset, sequence, pos))"""
ABSENT = f"""{POOLS}, own as (select f.*, q.absent, frame_id - row_number() over (partition by f.dataset, f.sequence order by frame_id) as isl from frames f join quota q using (dataset, sequence) where gt_presence = 'absent' and frame_id > anchor),
spans as (select dataset, sequence, min(frame_id) as v, max(frame_id) as last, max(absent) as k from own group by dataset, sequence, isl),
{SPREAD.format(name="st", src="spans")},
en_src as (select s.dataset, s.sequence, s.last as v, s.k - c.n as k from st s join (select dataset, sequence, count(*) as n from st group by all) c using (dataset, sequence) where s.k > c.n),
{SPREAD.format(name="en", src="en_src")},
bo as (select dataset, sequence, v from st union select dataset, sequence, v from en),
in_src as (select o.dataset, o.sequence, o.frame_id as v, o.absent - c.n as k from own o join (select dataset, sequence, count(*) as n from bo group by all) c using (dataset, sequence) where o.absent > c.n
  and not exists (select 1 from bo where bo.dataset = o.dataset and bo.sequence = o.sequence and bo.v = o.frame_id)),
{SPREAD.format(name="inn", src="in_src")},
absent_plan as (select dataset, sequence, v as frame_id from bo union all select dataset, sequence, v from inn)"""


@query(f"{ABSENT} select dataset, sequence, frame_id from absent_plan")
def plan_absent(spark, sf_dir):
    return pl.plan_absent(*_quota(spark, sf_dir))


@query(f"""{POOLS}, af as (select f.*, target - absent as k from frames f join quota using (dataset, sequence) where frame_id > anchor and target > absent),
ab as (select distinct dataset, sequence, frame_id from af where gt_presence = 'absent'),
pr as (select p.dataset, p.sequence, p.frame_id as v, p.k, exists (select 1 from ab where ab.dataset = p.dataset and ab.sequence = p.sequence and abs(ab.frame_id - p.frame_id) = 1) as side from af p where gt_presence = 'present'),
b_src as (select * from pr where side), {SPREAD.format(name="bd", src="b_src")},
r_src as (select p.dataset, p.sequence, p.v, p.k - coalesce(c.n, 0) as k from pr p left join (select dataset, sequence, count(*) as n from bd group by all) c using (dataset, sequence)
  where p.k > coalesce(c.n, 0) and not exists (select 1 from bd where bd.dataset = p.dataset and bd.sequence = p.sequence and bd.v = p.v)),
{SPREAD.format(name="rs", src="r_src")}
select dataset, sequence, v as frame_id from bd union all select dataset, sequence, v from rs""")  # fmt: skip
def plan_present(spark, sf_dir):
    return pl.plan_present(*_quota(spark, sf_dir))


@query(f"""with {FRAMES_SQL}, r as (select *, count(*) filter (gt_presence = 'present') {W}) as room from frames),
u as (select dataset, sequence, frame_id, unnest(range(1, least(room, 20)::bigint + 1)) as use from r where gt_presence = 'absent'),
n as (select *, row_number() over (partition by dataset, sequence order by use, frame_id) as nth from u)
select dataset, sequence, frame_id, use::int as use from n where nth <= 20""")  # fmt: skip
def pair_reuse(spark, sf_dir):
    return pl.reuse_units(frames(spark, sf_dir), 20)


@query(f"""with {FRAMES_SQL}, c as (select dataset, sequence, frame_id, unnest([0, 1]) as occurrence from frames where gt_presence = 'absent'),
cp as (select c.*, (select count(*) from frames f where f.dataset = c.dataset and f.sequence = c.sequence and f.gt_presence = 'present' and f.frame_id < c.frame_id) as prior from c),
k as (select *, (({RANK.format(seed=5, key="dataset, '::', sequence, '::', frame_id, '::reference'")} % prior::ubigint)::bigint + occurrence) % prior as pos from cp where prior > 0),
pr as (select dataset, sequence, frame_id as reference_id, row_number() over (partition by dataset, sequence order by frame_id) - 1 as pos from frames where gt_presence = 'present')
select k.dataset, k.sequence, k.frame_id, k.occurrence, pr.reference_id from k join pr using (dataset, sequence, pos)""")  # fmt: skip
def reference_pick(spark, sf_dir):
    f = frames(spark, sf_dir)
    cases = f.where(F.col("gt_presence") == "absent").select(*KEY, "frame_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("occurrence"))
    return pl.reference_pick(cases, f.where(F.col("gt_presence") == "present"), 5)


@query(f"""with {FRAMES_SQL}, r as (select *, row_number() {W}) as rnd, sha256(concat('3', chr(0), dataset, chr(0), sequence)) as rank from frames where gt_presence = 'absent')
select dataset, sequence, frame_id from r order by rnd, rank limit 400""")  # fmt: skip
def diverse_cap(spark, sf_dir):
    rows = frames(spark, sf_dir).where(F.col("gt_presence") == "absent")
    return pl.diverse_cap(rows, 400, KEY, "frame_id", 3).select(*KEY, "frame_id")


@query(f"""with {FRAMES_SQL}, sz as (select dataset, sequence, count(*) as n_frames from frames group by all),
r as (select *, row_number() over (partition by dataset order by sha256(concat('7', chr(0), dataset, chr(0), sequence))) as place from sz where n_frames >= 55) select dataset, sequence, n_frames, place from r where place <= 10""")  # fmt: skip
def api_plan_top(spark, sf_dir):
    sizes = frames(spark, sf_dir).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_frames"))
    return pl.top_per_dataset(sizes, 10, 7, 55)


@query(f"""with {FRAMES_SQL}, a as (select dataset, sequence, min(frame_id) as anchor from frames where gt_presence = 'present' group by all),
dp as (select f.dataset, f.sequence, f.frame_id, row_number() over (partition by f.dataset, f.sequence order by f.frame_id) - 1 as pos from frames f join a using (dataset, sequence) where is_observation_frame and frame_id >= anchor + 5)
select dataset, sequence, frame_id from dp where pos % 3 = 0 and pos / 3.0::double < 4""")  # fmt: skip
def decision_points(spark, sf_dir):
    f = frames(spark, sf_dir)
    return pl.decision_points(f.where("is_observation_frame"), anchors(f), 5, 3, 4)


@query(f"""with {FRAMES_SQL}, k as (select *, coalesce(lag(gt_presence) {W}) <> gt_presence, false) as ch, row_number() {W}) - 1 as pos from frames)
select dataset, sequence, frame_id, case when ch then 'transition' else 'stride' end as reason from k where ch or pos % 10 = 0""")  # fmt: skip
def transition_priority(spark, sf_dir):
    return pl.transition_priority(frames(spark, sf_dir), "gt_presence", 10).select(*KEY, "frame_id", "reason")


@query(f"""with {FRAMES_SQL}, oh as (select *, sha256(concat('9', chr(0), dataset, chr(0), sequence, chr(0), frame_id)) as h from frames),
c as (select *, row_number() over (partition by dataset, sequence, gt_presence order by h) as ic from oh),
n as (select *, row_number() over (partition by dataset, sequence order by (ic > 8)::int, h) as nth from c) select dataset, sequence, frame_id, gt_presence from n where nth <= 16""")  # fmt: skip
def balanced_presence_sample(spark, sf_dir):
    made = pl.balanced_sample(frames(spark, sf_dir), 8, KEY, "gt_presence", 9, "dataset", "sequence", "frame_id")
    return made.select(*KEY, "frame_id", "gt_presence")
