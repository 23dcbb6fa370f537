"""Answers of the tracking model: strict parsing, commit decisions and export, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions import boxes as bx
from reelmill.functions.text import strict_json

#: The keys of an answer, its longest memory, and the scopes of texts that tell of a sequence's start only.
KEYS = ("target_status", "bbox_2d", "memory_update")
LONGEST_MEMORY = 300
SAFE_SCOPES = ("initial_target", "first_action_description")


def with_tracking_output(df: DataFrame, raw: Column, width: Column, height: Column, out: str, strict_memory: bool = False) -> DataFrame:
    """df with out, struct<presence, identity, box, memory, memory_problem, reason> of a raw answer; reason says why it is refused.

    The answer is one JSON object of three keys; its box is in thousandths of the image,
    and there exactly when the target is. A bad memory is dropped with its problem, and
    refuses the answer only if strict. The answer is parsed once, into a column of its own.
    """
    r = F.col("__r")
    get = lambda k, kind: F.try_variant_get(r, f"$.{k}", kind)
    text = lambda k: F.when(F.schema_of_variant(get(k, "variant")) == "STRING", get(k, "string"))
    fields = F.struct(
        r.isNotNull().alias("parsed"), F.map_keys(F.try_variant_get(r, "$", "map<string,variant>")).alias("keys"),
        *[get(k, "variant").isNotNull().alias(f"has_{k}") for k in KEYS], *[F.is_variant_null(get(k, "variant")).alias(f"null_{k}") for k in KEYS],
        text("target_status").alias("status"), get("bbox_2d", "array<double>").alias("four"), F.trim(text("memory_update")).alias("memory"),
    )
    f = F.col("__f")
    status, four, memory, no_box = f["status"], f["four"], f["memory"], f["null_bbox_2d"]
    inside = (F.size(four) == 4) & F.forall(four, lambda v: v.isNotNull() & (v >= 0) & (v <= 1000))
    fine = F.coalesce(inside & (F.get(four, F.lit(2)) > F.get(four, F.lit(0))) & (F.get(four, F.lit(3)) > F.get(four, F.lit(1))), F.lit(False))
    memory_problem = (
        F.when(~f["has_memory_update"], "memory_missing")
        .when(f["null_memory_update"], None)
        .when(memory.isNull(), "memory_not_text")
        .when(memory == "", "memory_empty")
        .when(F.length(memory) > LONGEST_MEMORY, "memory_too_long")
    )
    reason = (
        F.when(~f["parsed"], "not_one_json_object")
        .when(~f["has_target_status"] | ~f["has_bbox_2d"], "core_key_missing")
        .when(F.size(F.array_except(f["keys"], F.array(*[F.lit(k) for k in KEYS]))) > 0, "unknown_key")
        .when(status.isNull() | ~status.isin("present", "absent"), "bad_status")
        .when(~no_box & ~fine, "bad_box")
        .when((status == "absent") & ~no_box, "absent_with_box")
        .when((status == "present") & no_box, "present_without_box")
        .when(F.lit(strict_memory), F.col("__m"))
    )
    ok = F.col("__x").isNull()
    corners = F.struct(*[F.get(four, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    made = F.struct(
        F.when(ok, status).alias("presence"),
        F.when(ok, F.when(status == "present", "same").otherwise("not_applicable")).alias("identity"),
        F.when(ok & (status == "present"), bx.from_norm1000(corners, width, height)).alias("box"),
        F.when(ok & F.col("__m").isNull(), memory).alias("memory"),
        F.when(ok, F.col("__m")).alias("memory_problem"),
        F.col("__x").alias("reason"),
    )
    staged = df.withColumn("__r", strict_json(raw)).withColumn("__f", fields).withColumn("__m", memory_problem).withColumn("__x", reason)
    return staged.withColumn(out, made).drop("__r", "__f", "__m", "__x")


def commit_reason(initial: Column, status: Column, presence: Column, box: Column) -> Column:
    """Why a candidate box is not published; null if it is. The first frame's truth always is."""
    return (
        F.when(F.coalesce(status != "ok", F.lit(True)), "execution_not_ok")
        .when(initial, None)
        .when(presence.isNull(), "no_prediction")
        .when(presence != "present", "not_present")
        .when(box.isNull(), "no_box")
    )


def committed_presence(reason: Column, status: Column, presence: Column) -> Column:
    """What is claimed after the gate: present if published, absent only if said so, null after an error."""
    return F.when(reason.isNull(), "present").when(status == "ok", F.when(presence == "absent", "absent").otherwise("uncertain"))


def is_unsafe_scope(scope: Column, dataset: Column) -> Column:
    """Whether a description may tell of frames after the first; unknown scopes are unsafe for mgit only."""
    word = F.lower(F.trim(F.coalesce(scope, F.lit(""))))
    return F.when(word.isin(*SAFE_SCOPES), False).when(word == "full_video_story", True).otherwise(F.lower(F.trim(F.coalesce(dataset, F.lit("")))) == "mgit")


def answer_text(presence: Column, corners: Column, memory: Column) -> Column:
    """The compact JSON answer a model is taught, its keys in their fixed order."""
    number = lambda v: F.bround(v, 0).cast("int").cast("string")
    box = F.when(corners.isNull(), "null").otherwise(F.concat(F.lit("["), F.concat_ws(",", *[number(corners[n]) for n in ("x1", "y1", "x2", "y2")]), F.lit("]")))
    quoted = F.when(memory.isNull(), "null").otherwise(F.concat(F.lit('"'), F.replace(F.replace(memory, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit('{"target_status":"'), presence, F.lit('","bbox_2d":'), box, F.lit(',"memory_update":'), quoted, F.lit("}"))


def _with_reward_box(df: DataFrame, v: str, out: str) -> DataFrame:
    """df with out, struct<box, given> of an answer's box: under the first of its names that is there, in that name's format."""
    get = lambda k, kind="variant": F.try_variant_get(F.col(v), f"$.{k}", kind)
    names = (("bbox_xywh", "xywh"), ("bbox_xyxy", "xyxy"), ("bbox_2d", "norm1000_xyxy"), ("bbox_norm1000_xyxy", "norm1000_xyxy"))
    each = [F.when(get(k).isNotNull(), F.struct(get(k).alias("v"), F.lit(form).alias("form"))) for k, form in names]
    last = F.struct(get("bbox").alias("v"), F.lower(F.coalesce(get("bbox_format", "string"), F.lit("norm1000_xyxy"))).alias("form"))
    staged = df.withColumn("__b", F.coalesce(*each, last)).withColumn("__four", F.slice(F.try_variant_get(F.col("__b.v"), "$", "array<double>"), 1, 4))
    four, form = F.col("__four"), F.col("__b.form")
    x, y, a, b = [F.get(four, F.lit(i)) for i in range(4)]
    sized = form.contains("xywh")
    finite = F.forall(four, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    inside = sized | ~form.contains("norm1000") | F.forall(four, lambda c: (c >= 0) & (c <= 1000))
    fine = (F.size(four) == 4) & finite & inside & F.when(sized, (a > 0) & (b > 0)).otherwise((a > x) & (b > y))
    made = F.struct(*[c.alias(n) for c, n in ((x, "x"), (y, "y"), (F.when(sized, a).otherwise(a - x), "w"), (F.when(sized, b).otherwise(b - y), "h"))])
    given = F.coalesce(F.col("__b.v").isNotNull() & ~F.is_variant_null(F.col("__b.v")), F.lit(False))
    return staged.withColumn(out, F.struct(F.when(fine, made).alias("box"), given.alias("given"))).drop("__b", "__four")


def with_rewards(df: DataFrame, completion: Column, reference: Column, out: str) -> DataFrame:
    """df with out, struct<format, presence, bbox, consistency:double>: what a completion earns against its reference, both JSON texts.

    A fenced completion is read but has no format reward. An absent target earns its box
    reward by no box, a present one by intersection over union. Consistent is an answer
    that with_tracking_output takes; a memory may be left out, but not be a bad one.
    """
    fence, space = r"(?is)^```(?:json)?\s*(.*?)\s*```$", r"^\s+|\s+$"
    text = lambda c: F.regexp_replace(c, space, "")
    bare = lambda c: F.when(text(c).rlike(fence), F.regexp_replace(F.regexp_extract(text(c), fence, 1), space, "")).otherwise(text(c))
    staged = df.withColumns({"__c": bare(completion), "__strict": ~text(completion).startswith("```")})
    staged = staged.withColumns({"__p": strict_json(F.col("__c")), "__q": strict_json(bare(reference))})
    staged = with_tracking_output(staged, F.col("__c"), F.lit(1000.0), F.lit(1000.0), "__o")

    def presence(v: Column) -> Column:
        first = F.lit(None).cast("string")
        for k in ("target_status", "status", "target_presence"):
            first = F.when(F.try_variant_get(v, f"$.{k}", "variant").isNotNull(), F.try_variant_get(v, f"$.{k}", "string")).otherwise(first)
        value = F.lower(F.trim(first))
        return F.when(value.isin("present", "absent", "uncertain"), value)

    p, q = presence(F.col("__p")), presence(F.col("__q"))
    staged = _with_reward_box(_with_reward_box(staged, "__p", "__pb"), "__q", "__qb")
    staged = staged.withColumns({"__ps": p, "__qs": q})
    p, q, own, given, want = (F.col(c) for c in ("__ps", "__qs", "__pb.box", "__pb.given", "__qb.box"))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    consistent = F.col("__o.reason").isNull() & F.coalesce(F.col("__o.memory_problem") == "memory_missing", F.lit(True))
    box = F.when(q == "absent", one((p == "absent") & ~given)).when((q == "present") & (p == "present"), F.coalesce(bx.iou(own, want), F.lit(0.0))).otherwise(F.lit(0.0))
    made = F.struct(one(F.col("__strict") & consistent).alias("format"), one(p == q).alias("presence"), box.alias("bbox"), one(consistent).alias("consistency"))
    return staged.withColumn(out, made).drop("__c", "__strict", "__p", "__q", "__o", "__pb", "__qb", "__ps", "__qs")
