"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.session import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth vector, by inner product."""
    from reelmill.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, and the least id that links of two bits or fewer reach."""
    from reelmill.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: Parameter: the key of the pseudonyms; a real run passes its own secret.
PII_KEY = "public-test-key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with pseudonyms, and how many of each kind were replaced."""
    from reelmill.llm.pii import KINDS, pseudonymised

    made = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    is_kind = lambda kind: lambda k: k == kind
    return made.select("doc_id", "text", *[F.size(F.filter("found", is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many secrets of each base kind a text holds, a digest of their places, and the places of all kinds."""
    from reelmill.llm.secret_scan import BASE, secrets

    found = secrets(table(spark, sf_dir, "documents"))
    kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(kind(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes, and each document's place in its own."""
    from reelmill.llm.sharding import shard_records

    made = shard_records(table(spark, sf_dir, "documents"), 16)
    return made.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def domain_of(source):
    """The corpus has no domains: sources are dealt over four by their number."""
    return F.concat(F.lit("d"), F.pmod(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(4)).cast("string"))


def mix_settings():
    """Domain d0, which holds the largest source, gets more than the others; English twice the other languages."""
    from reelmill.llm.mixing import Mix

    domains = (("d0", 3.0), ("d1", 2.0), ("d2", 2.0), ("d3", 1.0))
    return Mix(weights=domains + tuple((f"{d}/en", 2.0) for d, _ in domains), budget=0.6, epochs=2, seed="mix-1")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents, a row for each time."""
    from reelmill.llm.mixing import mixed

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs.withColumn("domain", domain_of(F.col("source"))), mix_settings())


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every fiftieth vector, by whole numbers."""
    from reelmill.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to."""
    from reelmill.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), with_ids=False)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each text has and loses, and a digest of those that stay."""
    from reelmill.llm.linededup import dedup_lines

    made = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("__lines.kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's score by a model of the labels that aren't held out."""
    from reelmill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words and items of the benchmark each document holds; the digest lists the items sorted as strings."""
    from reelmill.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight centroids after ten rounds, and each vector's."""
    from reelmill.llm.clusters import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn to be like the benchmark in their words."""
    from reelmill.llm.resampling import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_ann, op2_simhash, op3_pii, op4_secrets, op5_sharding, op6_mixing, op7_topk, op8_bpe, op9_line_dedup, op10_toxicity,
        op11_decontamination, op12_clusters, op13_resampling,
    )
    return {f.__name__: f for f in made}


#: Line dedup over the whole texts, as its contract says it.
OP9 = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from d),
k as (select *, translate(trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, r.last is not null and r.last <> k.doc_id as gone from k left join r using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""


#: The two searches by whole products; both add up components in order.
OP1 = """
with v as (select vec_id, embedding::double[] as x from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, r.vec_id, list_inner_product(q.x, r.x) as score from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0),
t as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from t where rank <= 20
"""
OP7 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (select q.vec_id as query_id, r.vec_id, list_sum(list_transform(list_zip(q.x, r.x), lambda z: z[1] * z[2]))::bigint as score
  from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 50 = 0),
t as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from t where rank <= 5
"""


def _level(name: str, above: str, depth: int) -> str:
    """One level of op6's budgets: siblings by what they can take for their weight, the full ones first."""
    node, parent = f"array_to_string(string_split(leaf, '/')[1:{depth}], '/')", f"array_to_string(string_split(leaf, '/')[1:{depth - 1}], '/')" if depth > 1 else "''"
    return f"""
{name}_n as (select *, (share - before) / after as rate from (
  select n.*, coalesce(w.weight, 1.0::double) as weight, p.share,
    coalesce(sum(most) over (partition by n.parent order by most / coalesce(w.weight, 1.0::double), n.node rows between unbounded preceding and 1 preceding), 0) as before,
    sum(coalesce(w.weight, 1.0::double)) over (partition by n.parent order by most / coalesce(w.weight, 1.0::double), n.node rows between current row and unbounded following) as after
  from (select {parent} as parent, {node} as node, (sum(tokens) * 2)::double as most from leaves group by 1, 2) n
  left join weights w on w.node = n.node join {above} p on p.parent = n.parent)),
{name} as (select node as parent, case when most <= rate * weight then most else least(most, greatest(0, o) * weight) end as share from (
  select *, first_value(case when most > rate * weight then rate end ignore nulls) over (partition by parent order by most / weight, node rows between unbounded preceding and unbounded following) as o from {name}_n))"""


OP6 = f"""
with docs as (select doc_id, concat('d', regexp_extract(source, '([0-9]+)$', 1)::int % 4, '/', lang, '/', source) as leaf,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
leaves as (select leaf, sum(n_tokens)::bigint as tokens from docs group by leaf),
weights(node, weight) as (values ('d0', 3.0::double), ('d1', 2.0), ('d2', 2.0), ('d3', 1.0), ('d0/en', 2.0), ('d1/en', 2.0), ('d2/en', 2.0), ('d3/en', 2.0)),
root as (select '' as parent, floor(sum(tokens)::double * 0.6::double) as share from leaves),
{_level("a", "root", 1)},
{_level("b", "a", 2)},
{_level("c", "b", 3)},
plan as (select leaf, tokens, floor(share)::bigint as budget, least(2, floor(share)::bigint // tokens)::int as whole from leaves join c on c.parent = leaf where tokens > 0),
runs as (select d.*, p.whole, p.budget, p.tokens, sum(n_tokens) over (partition by d.leaf order by sha256(concat('mix-1:', whole + 1, ':', doc_id))) as upto from docs d join plan p on p.leaf = d.leaf)
select doc_id, leaf, n_tokens, unnest(generate_series(1, whole))::int as epoch from runs
union all
select doc_id, leaf, n_tokens, whole + 1 as epoch from runs where whole < 2 and upto <= budget - whole * tokens and budget > whole * tokens
"""


_LOWERED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Windows of both sides as joined words, and the words that equal ones cover.
OP11 = f"""
with d as (select row_number() over () as n, doc_id, {_LOWERED} as w from documents),
i as (select item_id, {_LOWERED} as w from benchmark),
iw as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as win
  from (select *, least(10, len(w)) as k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as p from i where len(w) > 0)),
dw as (select n, k, p, array_to_string(w[p:p + k - 1], ' ') as win
  from (select d.n, d.w, k, unnest(generate_series(1, len(w) - k + 1)) as p from d, (select distinct k from iw) where len(w) >= k)),
m as (select n, k, p, item_id from dw join iw using (k, win)),
h as (select n, count(distinct x) as hit from (select n, unnest(generate_series(p, p + k - 1)) as x from (select distinct n, k, p from m)) group by n),
t as (select n, count(*) as items, string_agg(id, ',' order by id) as ids from (select distinct n, item_id::varchar as id from m) group by n)
select doc_id, len(w)::bigint as n_words, coalesce(hit, 0)::bigint as n_hit, coalesce(items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hit, 0) > 0 as contaminated
from d left join h using (n) left join t using (n)
"""


def _rounds(n: int) -> str:
    """Each round: every vector's nearest centroid, and the floors of the means; centroids without a vector stay."""
    parts = []
    for r in range(n + 1):
        parts.append(f"""d{r} as materialized (select x.vec_id, c.c, sum((x.v - c.v) * (x.v - c.v))::bigint as dist from x join c{r} c using (i) group by x.vec_id, c.c),
a{r} as materialized (select vec_id, min(struct_pack(dist := dist, c := c)) as best from d{r} group by vec_id)""")
        if r < n:
            parts.append(f"""s{r} as (select a.best.c as c, i, sum(v) as s, count(*) as k from a{r} a join x using (vec_id) group by 1, 2),
c{r + 1} as materialized (select c, i, case when s is null then c.v else ((s - ((s % k) + k) % k) // k)::bigint end as v from c{r} c left join s{r} using (c, i))""")
    return ",\n".join(parts)


OP12 = f"""
with kept as (select vec_id, embedding::double[] as e from embeddings
  where len(embedding) = 64 and list_count(embedding) = 64 and len(list_filter(embedding, lambda y: not isfinite(y))) = 0),
x as materialized (select vec_id, i, floor(1024 * e[i])::bigint as v from (select vec_id, e, unnest(generate_series(1, 64)) as i from kept)),
c0 as materialized (select c, i, v from x join (select vec_id, row_number() over (order by sha256('3:' || vec_id)) - 1 as c from kept qualify c < 8) using (vec_id)),
{_rounds(10)},
z as (select c, sha256(string_agg(v::varchar, ',' order by i)) as centroid_sha256 from c10 group by c)
select vec_id, best.c::int as cluster, best.dist as distance, sum(best.dist) over (partition by best.c)::bigint as cluster_inertia, sum(best.dist) over ()::bigint as inertia, centroid_sha256
from a10 join z on z.c = best.c
"""

#: CRC-32 of each distinct word from its bytes in hex, by the table of the polynomial's eight shifts.
OP13 = f"""
with t0 as (select list(list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by n) as tab from range(256) r(n)),
d as (select row_number() over () as n, doc_id, {_LOWERED} as w from documents),
b as (select {_LOWERED} as w from benchmark),
u as (select distinct word, hex(encode(word)) as x from (select unnest(w) as word from d union all select unnest(w) from b)),
k as (select word, xor(list_reduce(list_concat([4294967295::bigint], list_transform(generate_series(1, len(x), 2), lambda p: ('0x' || substr(x, p, 2))::bigint)), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) % 10000 as bucket from u, t0),
dw as (select n, bucket from (select n, unnest(w) as word from d) join k using (word)),
s as (select bucket, count(*) as s from dw group by bucket),
t as (select bucket, count(*) as t from (select unnest(w) as word from b) join k using (word) group by bucket),
g as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000)::double)
  / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint as gain from s full join t using (bucket)),
f as (select n, count(*) as n_features, sum(gain) as weight from dw join g using (bucket) group by n),
v as (select d.n, doc_id, len(w) as words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint::double + 0.5) / 4294967296.0::double)))::bigint as score from d left join f using (n)),
r as (select *, row_number() over (partition by words >= 20 order by score desc, doc_id) as place, count(*) filter (words >= 20) over () as able from v)
select doc_id, n_features, weight, score, case when words >= 20 and place <= 10 * able // 100 then place end as rank from r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ann": OP1, "op6_mixing": OP6, "op7_topk": OP7, "op9_line_dedup": OP9,
        "op11_decontamination": OP11, "op12_clusters": OP12, "op13_resampling": OP13,
    }
