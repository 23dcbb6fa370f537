"""Queries over mixtures, audits, replay, packing, sinks and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmill.functions import boxes as bx
from reelmill.functions import normalise
from reelmill.functions import text as tx
from reelmill.operators import audit, mixture, packing, replay
from reelmill.operators.evaluation import KEY
from reelmill.plans.registry import query, r9
from reelmill.session import table
from reelmill.sources.fixtures import FRAMES_SQL, frames

FR = f"with {FRAMES_SQL}"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


H = lambda seed, *cols: "sha256(concat('" + str(seed) + "', " + ", ".join(f"chr(0), {c}" for c in cols) + "))"


@query(f"""with k as (select distinct lang, source from documents), n as (select *, count(*) over (partition by lang) as n, row_number() over (partition by lang order by {H(4, 'source')}) as i from k),
v as (select *, least(greatest(1, round_even(n * 0.1::double, 0)::int), n - 1) as nv from n), t as (select *, least(greatest(1, round_even(n * 0.1::double, 0)::int), n - 1 - nv) as nt from v)
select d.doc_id, d.lang, d.source, case when i <= nv then 'val' when i <= nv + nt then 'test' else 'train' end as split from documents d join t using (lang, source)""")  # fmt: skip
def group_split(spark, sf_dir):
    return mixture.group_split(_docs(spark, sf_dir), ("source",), 0.1, 0.1, 4, ("lang",)).select("doc_id", "lang", "source", "split")


HARM = """with a as (select distinct source, case when regexp_extract(source, '[0-9]+')::int % 3 = 0 then 'val' else 'train' end as split from documents where doc_id % 2 = 0 and source <> 'src5'),
b as (select doc_id, source, case when doc_id % 5 = 0 then 'val' else 'train' end as split from documents)"""


def _harm(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    a = docs.where((F.col("doc_id") % 2 == 0) & (F.col("source") != "src5")).withColumn("split", F.when(number % 3 == 0, "val").otherwise("train"))
    b = docs.select("doc_id", "source", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"))
    return a, b


@query(HARM + " select b.doc_id, b.source, coalesce(a.split, b.split) as split, coalesce(a.split, b.split) <> b.split as moved from b left join a using (source)")
def harmonise_splits(spark, sf_dir):
    return mixture.harmonised(*_harm(spark, sf_dir), ("source",)).select("doc_id", "source", "split", "moved")


@query(HARM + " select distinct a.source from a join b using (source) where (a.split = 'train') <> (b.split = 'train')")
def split_leaks(spark, sf_dir):
    return mixture.leaks(*_harm(spark, sf_dir), ("source",))


MIX = f"""with d as (select d.doc_id, case when l.toxic = 1 then 'state' when l.quality = 1 then 'track' else 'identity' end as part from documents d join labels l using (doc_id)),
t(part, target) as (values ('track', 900), ('identity', 40), ('state', 60)), n as (select *, count(*) over (partition by part) as n, row_number() over (partition by part order by {H(6, 'doc_id')}) as i from d)
select part, doc_id, unnest(generate_series(1, (target // n + case when i <= target % n then 1 else 0 end)))::int as occurrence from n join t using (part)"""


@query(MIX)
def mixture_90_4_6(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id")
    d = d.select("doc_id", F.when(F.col("toxic") == 1, "state").when(F.col("quality") == 1, "track").otherwise("identity").alias("part"))
    parts = [mixture.resampled(d.where(F.col("part") == part), n, 6, "doc_id") for part, n in (("track", 900), ("identity", 40), ("state", 60))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", "doc_id", "occurrence")


@query(f"""with n as (select p_brand, p_partkey::varchar as name, row_number() over (partition by p_brand order by {H(8, 'p_partkey')}) as i from part)
select p_brand, max(case when i % 2 = 1 then name end) as "left", max(case when i % 2 = 0 then name end) as "right" from n group by p_brand, (i - 1) // 2 having count(*) = 2""")  # fmt: skip
def class_pairs(spark, sf_dir):
    return mixture.class_pairs(table(spark, sf_dir, "part"), ("p_partkey",), ("p_brand",), 8)


@query("""with n as (select p_name as alias, p_partkey, p_brand, row_number() over (partition by p_name order by p_brand, p_partkey) as i, count(distinct p_brand) over (partition by p_name) > 1 as conflict from part)
select alias, p_partkey, p_brand, conflict from n where i = 1""")  # fmt: skip
def alias_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), "p_partkey", "p_brand")
    return mixture.alias_dedupe(rows, "alias", ("p_brand", "p_partkey"), "p_brand").select("alias", "p_partkey", "p_brand", "conflict")


@query("select doc_id, source, row_number() over (partition by source, lang order by doc_id) as occurrence from documents")
def occurrence_counter(spark, sf_dir):
    return mixture.with_occurrence(_docs(spark, sf_dir), ("source", "lang"), ("doc_id",)).select("doc_id", "source", "occurrence")


@query("select text, count(*) as n from documents group by text having count(*) > 1")
def duplicate_rows(spark, sf_dir):
    return mixture.duplicates(table(spark, sf_dir, "documents"), ("text",))


@query(f"""{FR}, c as (select unnest(['ok', 'skipped', 'parse_error', 'api_error', 'initialized']) as execution_status), ds as (select distinct dataset from frames)
select ds.dataset, c.execution_status, count(f.sequence) as n from ds cross join c left join frames f on f.dataset = ds.dataset and f.execution_status = c.execution_status group by all""")  # fmt: skip
def taxonomy_counts(spark, sf_dir):
    counts = frames(spark, sf_dir).groupBy("dataset", "execution_status").agg(F.count(F.lit(1)).alias("n"))
    return mixture.zero_filled(counts, "execution_status", ["ok", "skipped", "parse_error", "api_error", "initialized"], ("dataset",))


@query(f"""{FR}, k as (select dataset, sequence, frame_id // 2 as c, min(gt_presence) as s, max(gt_presence) as t from frames group by all)
select count(*) as cases, count(*) filter (s <> t) as conflicts, round(avg((s = 'absent')::int::double), 9) as absent_share, abs(avg((s = 'absent')::int::double) - 0.3::double) <= 1.0 / count(*) as fits from k""")  # fmt: skip
def unique_case_ratio(spark, sf_dir):
    made = mixture.unique_case_ratio(frames(spark, sf_dir).withColumn("c", F.floor(F.col("frame_id") / 2)), (*KEY, "c"), "gt_presence", 0.3)
    return made.withColumn("absent_share", r9(F.col("absent_share")))


SUMMARY = " union all ".join(f"select '{c}' as \"column\", coalesce({c}, '<null>') as value, count(*) as n, count(distinct (dataset, sequence)) as sequences from frames group by {c}" for c in ("dataset", "gt_presence", "pred_presence", "gt_identity", "execution_status"))


@query(f"{FR} {SUMMARY}")
def dataset_summary(spark, sf_dir):
    return mixture.summary(frames(spark, sf_dir), ("dataset", "gt_presence", "pred_presence", "gt_identity", "execution_status"), KEY)


@query("select o_custkey from orders where o_orderstatus = 'O' intersect select o_custkey from orders where o_orderpriority = '1-URGENT'")
def set_intersect(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return mixture.disjoint(orders.where("o_orderstatus = 'O'"), orders.where("o_orderpriority = '1-URGENT'"), ("o_custkey",))


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def set_except(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return customers.select(F.col("c_custkey").alias("k")).exceptAll(orders.select(F.col("o_custkey").alias("k")).distinct())


@query("select 'c' as side, c_nationkey as nation, count(*) as n from customer group by 2 union all select 's', s_nationkey, count(*) from supplier group by 2")
def set_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("side"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).groupBy("side", "nation").agg(F.count(F.lit(1)).alias("n"))


DONE = "select l_orderkey as k, count(*) >= 3 as completed, count(*) as frames_written, count(*) + (l_orderkey % 4 = 0)::int as expected_frames from lineitem group by l_orderkey"


@query(f"with m as ({DONE}) select o_orderkey as k from orders where o_orderkey not in (select k from m where completed and frames_written = expected_frames)")
def anti_pending(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.count(F.lit(1)) >= 3).alias("completed"), F.count(F.lit(1)).alias("frames_written"))
    done = done.withColumn("expected_frames", F.col("frames_written") + (F.col("k") % 4 == 0).cast("int"))
    return mixture.pending(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), done, ("k",))


@query(f"{FR} select dataset, count(*) as n from frames where not (sequence like '%3') group by dataset")
def debug_runs_dropped(spark, sf_dir):
    f = frames(spark, sf_dir)
    flag = F.when(F.col("sequence").endswith("3"), True).when(F.col("sequence").endswith("4"), False)
    manifests = f.select(*KEY).distinct().where(~F.col("sequence").endswith("5")).withColumn("debug_limited", flag)
    return mixture.without_debug_runs(f, manifests, KEY).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_orderpriority from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_plan(spark, sf_dir):
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(building, "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("select l_returnflag, l_linestatus, grouping(l_returnflag)::int as g1, grouping(l_linestatus)::int as g2, count(*) as n, round(sum(l_quantity), 4) as quantity from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def grouping_sets_summary(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    made = table(spark, sf_dir, "lineitem").groupingSets([[flag, status], [flag], [status], []], flag, status)
    return made.agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as quantity, round(avg(l_discount), 9) as discount, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"), r9(F.avg("l_discount")).alias("discount"), F.round(F.sum(price), 2).alias("revenue")
    )


@query("select n_name, count(o_orderkey) as orders, count(distinct c_custkey) as customers from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by n_name")
def outer_joins(spark, sf_dir):
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    joined = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_name").agg(F.count("o_orderkey").alias("orders"), F.count_distinct("c_custkey").alias("customers"))


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) select * from r where place <= 2")
def top_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return packing.top_per_group(rows, ("o_custkey",), (F.desc("o_totalprice"), "o_orderkey"), 2).drop("o_totalprice")


RECORDS = """with c as (select conv_id, list({'role': role, 'content': case when conv_id % 7 = 0 and turn = 0 then '' else case when conv_id % 5 = 0 and turn = 0 then '<image>' || text else text end end} order by turn, role, text) as m from conversations group by conv_id),
r as (select *, case when conv_id % 5 = 0 then ['a.jpg'] when conv_id % 11 = 0 then ['/abs.jpg'] when conv_id % 13 = 0 then ['../up.jpg'] else [] end as images from c)"""


def _records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k, zero = F.col("conv_id"), F.col("turn") == 0
    content = F.when((k % 7 == 0) & zero, "").when((k % 5 == 0) & zero, F.concat(F.lit("<image>"), F.col("text"))).otherwise(F.col("text"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", content.alias("content")))).alias("t"))
    images = F.when(k % 5 == 0, F.array(F.lit("a.jpg"))).when(k % 11 == 0, F.array(F.lit("/abs.jpg"))).when(k % 13 == 0, F.array(F.lit("../up.jpg"))).otherwise(F.array().cast("array<string>"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), images.alias("images"))


#: Records that break each rule somewhere, by their number; the marks, answers, objects and images are planted.
BROKEN = """with t as (select conv_id as k, turn, case when conv_id % 19 = 4 and turn = 0 then 'robot' else role end as role,
  case when conv_id % 17 = 3 and turn = 0 then null when role = 'assistant' and conv_id % 3 = 0 then '{"target_status":"absent","bbox_2d":null}' when role = 'assistant' and conv_id % 3 = 1 then '{"target_status":"absent","bbox_2d":[1,2,3,4]}'
    else concat(case when conv_id % 5 = 0 and turn = 0 then '<image>' else '' end, text, case when conv_id % 4 < 2 and turn = 0 then '<bbox>' else '' end) end as content from conversations where not (conv_id % 31 = 2 and role = 'assistant') and not (conv_id % 37 = 5 and role = 'user')),
m as (select *, row_number() over (partition by k order by turn, role, content) - 1 as place from t),
r as (select k, count(*) as n, sum(length(coalesce(content, '')) - length(replace(coalesce(content, ''), '<image>', '')))::bigint // 7 as n_image, sum(length(coalesce(content, '')) - length(replace(coalesce(content, ''), '<bbox>', '')))::bigint // 6 as n_box,
  count(*) filter (role = 'user') as users, count(*) filter (role = 'assistant') as assistants, case when k % 6 = 5 then '{"target_status":"absent","bbox_2d":null}' end as solution,
  case when k % 5 = 0 then ['a.jpg'] when k % 11 = 0 then ['/abs.jpg'] when k % 13 = 0 then ['x/../../up.jpg', 'x/../b.jpg'] when k % 23 = 0 then [' ', 'gone/c.jpg'] else [] end as images from m group by k),
i as (select k, unnest(images) as path, unnest(range(len(images))) as place from r),
x as (select k, 'message.role' as code, place from m where role not in ('system', 'user', 'assistant', 'tool') union all select k, 'message.content', place from m where content is null
  union all select k, 'messages.user_missing', -1 from r where users = 0 union all select k, 'answer.missing', -1 from r where assistants = 0 and solution is null
  union all select k, 'images.invalid', -1 from r where len(images) = 0 union all select k, 'images.token_mismatch', -1 from r where n_image <> len(images)
  union all select k, 'objects.missing', -1 from r where n_box > 0 and k % 4 = 1 union all select k, 'objects.bbox_count', -1 from r where n_box > 0 and k % 4 <> 1 and n_box <> case when k % 8 = 0 then 1 else 2 end
  union all select k, 'objects.bbox_type', -1 from r where n_box > 0 and k % 4 <> 1 and k % 3 = 2 union all select k, 'objects.image_id_count', -1 from r where n_box > 0 and k % 4 <> 1 and n_box <> 1
  union all select k, 'objects.image_id', -1 from r where n_box = 1 and k % 4 <> 1 and (case when k % 16 = 0 then 0 else 9 end) >= len(images)
  union all select k, 'image.path', place from i where path = ' ' union all select k, 'image.absolute', place from i where path = '/abs.jpg' union all select k, 'image.escape', place from i where path = 'x/../../up.jpg'
  union all select k, 'image.missing', place from i where path = 'gone/c.jpg'
  union all select k, 'answer.protocol', nth from (select k, content, row_number() over (partition by k order by place) - 1 as nth from m where role = 'assistant') where content is distinct from '{"target_status":"absent","bbox_2d":null}')
select k as conv_id, code, place::int as place from x"""


def _broken(spark, sf_dir):
    c, k, first = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn") == 0
    c = c.where(~((k % 31 == 2) & (F.col("role") == "assistant")) & ~((k % 37 == 5) & (F.col("role") == "user")))
    role = F.when((k % 19 == 4) & first, "robot").otherwise(F.col("role"))
    own = F.col("role") == "assistant"
    marked = F.concat(F.when((k % 5 == 0) & first, "<image>").otherwise(""), F.col("text"), F.when((k % 4 < 2) & first, "<bbox>").otherwise(""))
    right, wrong = '{"target_status":"absent","bbox_2d":null}', '{"target_status":"absent","bbox_2d":[1,2,3,4]}'
    content = F.when((k % 17 == 3) & first, F.lit(None).cast("string")).when(own & (k % 3 == 0), right).when(own & (k % 3 == 1), wrong).otherwise(marked)
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), content.alias("content")))).alias("t"))
    texts = lambda *p: F.array(*map(F.lit, p)) if p else F.array().cast("array<string>")
    images = F.when(k % 5 == 0, texts("a.jpg")).when(k % 11 == 0, texts("/abs.jpg")).when(k % 13 == 0, texts("x/../../up.jpg", "x/../b.jpg")).when(k % 23 == 0, texts(" ", "gone/c.jpg")).otherwise(texts())
    one = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))
    objects = F.struct(
        F.when(k % 8 == 0, F.array(one)).otherwise(F.array(one, one)).alias("bbox"), F.when(k % 3 == 0, "real").when(k % 3 == 1, "norm1").otherwise("odd").alias("bbox_type"),
        F.array(F.when(k % 16 == 0, 0).otherwise(9)).alias("image_id"),
    )
    return turns.select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), images.alias("images"),
        F.when(k % 4 != 1, objects).alias("objects"), F.when(k % 6 == 5, right).alias("solution"),
    )


@query(BROKEN)
def record_validation(spark, sf_dir):
    listing = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("other.jpg",)], "path string")
    return audit.all_issues(_broken(spark, sf_dir), "conv_id", listing)


@query(RECORDS + r""", b as (select conv_id, unnest(list_filter([case when len(list_filter(m, lambda x: trim(coalesce(x.content, '')) = '')) > 0 then 'content_empty' end,
  case when len(list_filter(m[2:], lambda x: x.role = 'system')) > 0 then 'system_not_first' end, case when m[-1].role <> 'assistant' then 'last_not_assistant' end,
  case when len(list_filter(range(2, len(m) + 1), lambda i: m[i].role = m[i - 1].role)) > 0 then 'role_repeated' end], lambda x: x is not null)) as code from r) select conv_id, code from b""")  # fmt: skip
def conversation_order(spark, sf_dir):
    return audit.issues(_records(spark, sf_dir), "conv_id", audit.message_rules())


@query(RECORDS + """ select conv_id, len(list_filter(m, lambda x: x.role <> 'assistant')) as n_left, list_filter(m, lambda x: x.role = 'assistant')[-1].content as solution from r""")
def strip_assistant(spark, sf_dir):
    return audit.to_preference_record(_records(spark, sf_dir)).select("conv_id", F.size("messages").cast("long").alias("n_left"), "solution")


@query(f"""{FR}, x as (select *, is_observation_frame and (frame_id > 0 or sequence not like '%7') as kf, max((is_observation_frame and (frame_id > 0 or sequence not like '%7'))::int) over (partition by dataset, sequence) = 1 as has from frames),
y as (select *, case when frame_id = 0 then 'initial_frame' when not has then 'missing_keyframes_fallback_dense' when kf then 'keyframe' else 'non_keyframe' end as reason from x)
select dataset, sequence, frame_id, reason <> 'non_keyframe' as observed, reason from y""")  # fmt: skip
def observation_policy(spark, sf_dir):
    f = frames(spark, sf_dir)
    return replay.observed(f, f.where("is_observation_frame and (frame_id > 0 or sequence not like '%7')"))


STATE = f"""{FR}, k as (select *, row_number() over w as rn, case when row_number() over w = 1 or (execution_status = 'ok' and pred_presence = 'present' and pred_identity = 'same' and px is not null) then 'T'
  when execution_status = 'ok' and pred_presence = 'absent' then 'A' when execution_status = 'ok' then 'U' when execution_status = 'skipped' then 'S' else 'E' end as kind from frames window w as (partition by dataset, sequence order by frame_id)),
pc as (select *, coalesce(max(case when kind = 'T' then rn end) over w, 0) as lt, coalesce(max(case when kind in ('T', 'A') then rn end) over w, 0) as lta, coalesce(max(case when kind in ('T', 'A', 'U') then rn end) over w, 0) as ltau from k window w as (partition by dataset, sequence order by frame_id)),
q as (select a.*, (select count(*) from pc b where b.dataset = a.dataset and b.sequence = a.sequence and b.rn <= a.rn and b.rn > a.lt and b.kind = 'A') as absent_duration,
  (select count(*) from pc b where b.dataset = a.dataset and b.sequence = a.sequence and b.rn <= a.rn and b.rn > a.lta and b.kind in ('U', 'E')) as uncertain_duration,
  (select count(*) from pc b where b.dataset = a.dataset and b.sequence = a.sequence and b.rn <= a.rn and b.rn > a.ltau and b.kind = 'E') as error_duration from pc a),
z as (select *, case kind when 'T' then 'confirmed' when 'A' then 'searching' when 'U' then case when uncertain_duration >= 3 then 'searching' else 'uncertain' end when 'E' then 'uncertain' end as phs from q),
st as (select *, last_value(phs ignore nulls) over (partition by dataset, sequence order by frame_id) as phase from z)"""


@query(f"{STATE} select dataset, sequence, frame_id, phase, absent_duration, uncertain_duration, error_duration from st")
def cognitive_state(spark, sf_dir):
    return replay.cognitive_state(frames(spark, sf_dir))


@query(f"""{FR}, r as (select *, case when gt_identity = 'different' then 'negative' when frame_id % 4 = 0 then 'semantic' else 'positive' end as kind, concat('r', frame_id // 2) as record_id from frames where pred_presence = 'present'),
d as (select * from (select *, row_number() over (partition by dataset, sequence, record_id order by frame_id) as i from r) where i = 1),
t as (select *, row_number() over (partition by dataset, sequence, kind order by frame_id desc, record_id desc) as place from d)
select dataset, sequence, kind, frame_id, place from t where place <= case kind when 'semantic' then 4 else 8 end""")  # fmt: skip
def memory_bank_topk(spark, sf_dir):
    f = frames(spark, sf_dir).where(F.col("pred_presence") == "present")
    kind = F.when(F.coalesce(F.col("gt_identity") == "different", F.lit(False)), "negative").when(F.col("frame_id") % 4 == 0, "semantic").otherwise("positive")
    r = f.withColumns({"kind": kind, "record_id": F.concat(F.lit("r"), F.floor(F.col("frame_id") / 2).cast("string"))})
    return replay.memory_bank(r, {"positive": 8, "negative": 8, "semantic": 4}).select(*KEY, "kind", "frame_id", "place")


@query(f"""{FR}, b as (select *, frame_id % 6 <> 5 as base_ok, coalesce(pred_identity = 'same' and pred_presence = 'present', false) as com from frames),
j as (select *, case when pred_presence = 'absent' then 'absent' when pred_identity = 'different' then 'different' when pred_presence = 'uncertain' then 'presence_refused' when pred_identity = 'uncertain' then 'identity_refused' end as rej,
  case when base_ok then 'baseline' else 'none' end as base, case when base_ok then 'present' else 'uncertain' end as pb, execution_status = 'ok' and com and px is not null as used, coalesce(case when pred_presence in ('absent', 'uncertain') then pred_presence end, 'uncertain') as own from b)
select dataset, sequence, frame_id,
  case when frame_id = 0 then case when used then 'vlm' else base end when not is_observation_frame then base when execution_status <> 'ok' then base when used then 'vlm' when rej is not null then 'suppressed' else base end as source,
  case when frame_id = 0 then case when used then 'present' else pb end when not is_observation_frame then pb when execution_status <> 'ok' then 'uncertain' when used then 'present' when rej is not null then own else case when base_ok then 'uncertain' else own end end as presence,
  case when frame_id = 0 then case when used then 'initialised' else 'initial_fallback' end when not is_observation_frame then 'not_observed' when execution_status <> 'ok' then 'vlm_error' when used then 'committed' else coalesce(rej, 'uncommitted') end as reason from j""")  # fmt: skip
def fusion_table(spark, sf_dir):
    f = frames(spark, sf_dir)
    base_ok = F.col("frame_id") % 6 != 5
    committed = F.coalesce((F.col("pred_identity") == "same") & (F.col("pred_presence") == "present"), F.lit(False))
    whole = bx.box(F.lit(0), F.lit(0), F.lit(9), F.lit(9))
    made = replay.fusion(F.col("frame_id") == 0, F.col("is_observation_frame"), F.col("execution_status"), F.col("pred"), committed, F.when(base_ok, whole), F.lit("ok"), F.col("pred_presence"), F.col("pred_identity"))
    return f.select(*KEY, "frame_id", made.alias("m")).select(*KEY, "frame_id", "m.*")


@query("""select event_id, event_type, case lower(event_type) when 'view' then null when 'visible' then 'present' else null end as presence,
  case event_id % 6 when 0 then 'present' when 1 then 'absent' when 2 then 'absent' when 3 then 'uncertain' when 4 then 'present' end as aliased,
  case event_id % 4 when 0 then 'same' when 1 then 'different' when 2 then 'not_applicable' end as identity from events""")  # fmt: skip
def presence_normalise(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in (" Visible", "not-present", "Not Found", "unsure", "EXISTS ", "maybe")])
    names = F.array(*[F.lit(w) for w in ("Matched", "negative ", "N/A", "other")])
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", normalise.presence(F.col("event_type")).alias("presence"),
        normalise.presence(F.get(words, (F.col("event_id") % 6).cast("int"))).alias("aliased"), normalise.identity(F.get(names, (F.col("event_id") % 4).cast("int"))).alias("identity"),
    )


@query("""with e as (select event_id, case event_id % 5 when 0 then 'ok' when 1 then 'api_error' when 2 then 'skipped' when 3 then 'internal_error' else 'ok' end as status from events)
select event_id, status, status in ('api_error', 'internal_error') as is_error from e""")  # fmt: skip
def exec_status_normalise(spark, sf_dir):
    k = F.col("event_id") % 5
    status = normalise.execution_status([F.when(k == 0, F.lit(" OK ")), F.when(k == 1, F.lit("API-error"))], k == 2, F.when(k == 3, F.lit("ValueError")))
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), normalise.is_error(status).alias("is_error"))


@query(f"""{FR} select dataset, sequence, frame_id, round_even(gx / 640.0::double * 1000, 2) as x1, round_even((gx + gw) / 640.0::double * 1000, 2) as x2, round_even(gy / 480.0::double * 1000, 2) as y1, round_even((gy + gh) / 480.0::double * 1000, 2) as y2 from frames where gx is not null""")
def bbox_norm1000(spark, sf_dir):
    f = frames(spark, sf_dir).where("gt is not null")
    made = bx.to_norm1000(F.col("gt"), F.lit(640.0), F.lit(480.0))
    return f.select(*KEY, "frame_id", made.alias("n")).select(*KEY, "frame_id", "n.*")


@query(f"""{FR}, c as (select dataset, sequence, frame_id, greatest(gx, 0) as x, greatest(gy, 0) as y, least(gx + gw, 90) as x2, least(gy + gh, 40) as y2 from frames where gx is not null)
select dataset, sequence, frame_id, case when x2 > x and y2 > y then x end as x, case when x2 > x and y2 > y then y end as y, case when x2 > x and y2 > y then x2 - x end as w, case when x2 > x and y2 > y then y2 - y end as h from c""")  # fmt: skip
def clip_boxes(spark, sf_dir):
    f = frames(spark, sf_dir).where("gt is not null")
    return f.select(*KEY, "frame_id", bx.clipped(F.col("gt"), F.lit(90.0), F.lit(40.0)).alias("c")).select(*KEY, "frame_id", "c.x", "c.y", "c.w", "c.h")


@query("""select doc_id, round_even(n_chars * least(1.0::double, 512.0::double / greatest(n_chars, 300)), 0)::int as width, greatest(1, round_even(300 * least(1.0::double, 512.0::double / greatest(n_chars, 300)), 0)::int) as height from documents where n_chars > 2""")
def long_side_resize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars > 2").select("doc_id", bx.long_side_size(F.col("n_chars").cast("double"), F.lit(300.0), 512).alias("s"))
    return d.select("doc_id", "s.width", "s.height")


@query(f"""{FR} select dataset, count(*) as frames, count(distinct sequence) as sequences, count(*) filter (gt_presence = 'present') as present, count(*) filter (gt_presence = 'absent') as absent,
  count(*) filter (is_observation_frame) as keyframes, 0::bigint as invalid_boxes from frames group by dataset""")  # fmt: skip
def benchmark_inventory(spark, sf_dir):
    return audit.inventory(frames(spark, sf_dir))


@query("""with b as (select source, doc_id, sha256(coalesce(text, '')) as h, (row_number() over (partition by source order by doc_id) - 1) // 4096 as b from documents),
s as (select source, b, sha256(string_agg(h, '' order by doc_id)) as hb, count(*) as nb from b group by source, b) select source, sum(nb)::bigint as n, sha256(string_agg(hb, '' order by b)) as sha256 from s group by source""")  # fmt: skip
def fingerprint(spark, sf_dir):
    return audit.fingerprint(table(spark, sf_dir, "documents"), ("source",), "doc_id", F.coalesce("text", F.lit("")))


#: Greedy rules in SQL: one row after another, by recursion over places.
RECURSIVE = f"with recursive {FRAMES_SQL}"
LEAST = "list_position({loads}, list_min({loads}))"
ADDED = "list_transform(range(1, {n}), lambda x: {loads}[x] + case when x = list_position({loads}, list_min({loads})) then {load} else 0 end)"


@query(f"""{RECURSIVE}, it as (select sequence, load, row_number() over (order by load desc, sequence) as i from (select sequence, count(*) filter (is_observation_frame) as load from frames group by sequence)),
m as (select sequence, load, i, 1::bigint as pick, [load, 0, 0, 0] as loads from it where i = 1
  union all select it.sequence, it.load, it.i, {LEAST.format(loads="m.loads")}, {ADDED.format(loads="m.loads", n=5, load="it.load")} from m join it on it.i = m.i + 1),
jt as (select sequence, load, pick as machine, row_number() over (partition by pick order by load desc, sequence) as j from m),
w as (select sequence, load, machine, j, 1::bigint as pick, [load, 0] as loads from jt where j = 1
  union all select jt.sequence, jt.load, jt.machine, jt.j, {LEAST.format(loads="w.loads")}, {ADDED.format(loads="w.loads", n=3, load="jt.load")} from w join jt on jt.machine = w.machine and jt.j = w.j + 1)
select sequence, load, (machine - 1)::int as machine, (pick - 1)::int as worker from w""")  # fmt: skip
def lpt_shards(spark, sf_dir):
    sizes = frames(spark, sf_dir).groupBy("sequence").agg(F.count_if("is_observation_frame").alias("load"))
    return packing.lpt_shards(sizes, "sequence", "load", 4, 2)


@query(f"""{RECURSIVE}, it as (select dataset, sequence, count(*) as size, row_number() over (partition by dataset order by sequence) as i from frames group by dataset, sequence),
r as (select dataset, sequence, size, i, size as used, 0 as shard from it where i = 1
  union all select it.dataset, it.sequence, it.size, it.i, case when r.used + it.size > 300 then it.size else r.used + it.size end, case when r.used > 0 and r.used + it.size > 300 then r.shard + 1 else r.shard end from r join it on it.dataset = r.dataset and it.i = r.i + 1)
select dataset, sequence, size, shard from r""")  # fmt: skip
def shard_packing(spark, sf_dir):
    sizes = frames(spark, sf_dir).groupBy("dataset", "sequence").agg(F.count(F.lit(1)).alias("size"))
    return packing.shard_packing(sizes, "sequence", ("dataset",), "size", 300)


@query(f"""{RECURSIVE}, it as (select dataset, sequence, frame_id, coalesce(pred_presence = 'present' and pred_identity = 'same', false) as eligible, row_number() over (partition by dataset, sequence order by frame_id) as i from frames where execution_status <> 'skipped'),
r as (select dataset, sequence, frame_id, eligible, i, eligible::int as streak, case when eligible then frame_id end as last, null::int as taken, false as accepted from it where i = 1
  union all select dataset, sequence, frame_id, eligible, i, streak, case when eligible then frame_id end, case when a then frame_id else taken end, a from (
    select *, coalesce(eligible and streak >= 2 and (taken is null or frame_id - taken >= 5), false) as a from (
      select it.dataset, it.sequence, it.frame_id, it.eligible, it.i, case when not it.eligible then 0 when r.last is not null and it.frame_id - r.last <= 30 then r.streak + 1 else 1 end as streak, r.taken
      from r join it on it.dataset = r.dataset and it.sequence = r.sequence and it.i = r.i + 1)))
select dataset, sequence, frame_id, eligible, accepted from r""")  # fmt: skip
def gated_memory(spark, sf_dir):
    f = frames(spark, sf_dir)
    eligible = F.coalesce((F.col("pred_presence") == "present") & (F.col("pred_identity") == "same"), F.lit(False))
    return replay.gated_updates(f.where("execution_status <> 'skipped'").withColumn("eligible", eligible))


@query(f"""{RECURSIVE}, it as (select dataset, sequence, frame_id, concat('state ', frame_id % 4) as u, frame_id % 5 <> 0 as fine, row_number() over (partition by dataset, sequence order by frame_id) as i from frames),
r as (select dataset, sequence, frame_id, i, 'state 0' as input_state, case when not fine then 'rejected' when u = 'state 0' then 'vacuous' else 'accepted' end as verdict, case when fine then u else 'state 0' end as state from it where i = 1
  union all select it.dataset, it.sequence, it.frame_id, it.i, r.state, case when not fine then 'rejected' when u = r.state then 'vacuous' else 'accepted' end, case when fine then u else r.state end
  from r join it on it.dataset = r.dataset and it.sequence = r.sequence and it.i = r.i + 1)
select dataset, sequence, frame_id, input_state, verdict from r""")  # fmt: skip
def verifier_replay(spark, sf_dir):
    f = frames(spark, sf_dir)
    update = F.concat(F.lit("state "), (F.col("frame_id") % 4).cast("string"))
    return replay.verifier_replay(f.select(*KEY, "frame_id", update.alias("update"), (F.col("frame_id") % 5 != 0).alias("accept"), F.lit("state 0").alias("initial")))


@query()
def sequence_matcher(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", "text")
    after = d.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return d.join(after, "item_id", "left").select("item_id", replay.similarity("text", "other").alias("ratio"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k, true as not_strict from events")
def json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```")).alias("t"))
    return e.select("event_id", F.try_variant_get(tx.json_in_prose(F.col("t")), "$.k", "int").alias("k"), tx.strict_json(F.col("t")).isNull().alias("not_strict"))
