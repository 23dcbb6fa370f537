"""Checks of training records: each gives a table of what is wrong, and strict() raises if there is any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict(problems: DataFrame, what: str) -> None:
    """Raises with some of the problems, if there are any."""
    if some := problems.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


#: Who may speak, and the kinds of boxes in a record's objects.
ROLES, BOX_TYPES = ("system", "user", "assistant", "tool"), ("real", "norm1")
#: A box that stands for a <bbox> mark when an answer is checked.
ANY_BOX = "[100,100,200,200]"


def record_rules(allow_absolute: bool = False) -> dict[str, Column]:
    """For each code an array of the places where a record breaks that rule; -1 stands for the whole record.

    A record has messages array<struct<role, content>> (a null struct is no object, a null
    content no text), images array<string>, objects struct<bbox, bbox_type, image_id>, and
    solution, which is null where there is none. Whether images are there, and whether
    answers keep the protocol, is for missing_images() and answer_issues().
    """
    m, images, objects = F.col("messages"), F.coalesce("images", F.array().cast("array<string>")), F.col("objects")
    content = lambda x: F.coalesce(x["content"], F.lit(""))
    marks = lambda mark: F.aggregate(F.coalesce(m, F.array().cast(_MESSAGES)), F.lit(0), lambda n, x: n + F.regexp_count(content(x), F.lit(mark)))
    n_box = marks("<bbox>") + F.regexp_count(F.coalesce("solution", F.lit("")), F.lit("<bbox>"))
    roles = F.coalesce(F.transform(m, lambda x: F.coalesce(x["role"], F.lit(""))), F.array().cast("array<string>"))
    ids, n_images = objects["image_id"], F.size(images)
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    where = lambda items, test: F.filter(F.transform(items, lambda x, i: F.when(F.coalesce(test(x), F.lit(True)), i)), lambda i: i.isNotNull())
    once = lambda c: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(-1)))
    spoken = lambda test: lambda x: x.isNotNull() & test(x)
    named = lambda p: p.isNotNull() & (F.trim(p) != "")
    absolute = lambda p: p.startswith("/")
    return {
        "messages.invalid": once(m.isNull() | (F.size(m) == 0)),
        "message.invalid": where(m, lambda x: x.isNull()),
        "message.role": where(m, spoken(lambda x: ~F.coalesce(x["role"], F.lit("")).isin(*ROLES))),
        "message.content": where(m, spoken(lambda x: x["content"].isNull())),
        "messages.user_missing": once(~F.array_contains(roles, "user")),
        "answer.missing": once(~F.array_contains(roles, "assistant") & F.col("solution").isNull()),
        "images.invalid": once(n_images == 0),
        "images.token_mismatch": once(marks("<image>") != n_images),
        "objects.missing": once((n_box > 0) & objects.isNull()),
        "objects.bbox_count": once((n_box > 0) & objects.isNotNull() & (size(objects["bbox"]) != n_box)),
        "objects.bbox_type": once((n_box > 0) & objects.isNotNull() & ~F.coalesce(objects["bbox_type"], F.lit("real")).isin(*BOX_TYPES)),
        "objects.image_id_count": once((n_box > 0) & objects.isNotNull() & (size(ids) != n_box)),
        "objects.image_id": once((n_box > 0) & (size(ids) == n_box) & F.exists(ids, lambda i: F.coalesce((i < 0) | (i >= n_images), F.lit(True)))),
        "image.path": where(images, lambda p: ~named(p)),
        "image.absolute": where(images, lambda p: named(p) & absolute(p)) if not allow_absolute else F.array().cast("array<int>"),
        "image.escape": where(images, lambda p: named(p) & ~absolute(p) & escapes(p)),
    }


_MESSAGES = "array<struct<role:string,content:string>>"


def escapes(path: Column) -> Column:
    """Whether a relative path leaves its root on its way: more steps up than down at some point, as links aren't followed."""
    depth = F.transform(F.split(path, "/"), lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("least"))
    return F.aggregate(depth, start, lambda s, d: F.struct((s["at"] + d).alias("at"), F.least(s["least"], s["at"] + d).alias("least")), lambda s: s["least"]) < 0


def record_issues(records: DataFrame, key: str, allow_absolute: bool = False) -> DataFrame:
    """(key, code, place): a row for each place where a record breaks a rule; one pass over the records."""
    def coded(code: str, places: Column) -> Column:
        return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.struct(F.lit(code).alias("code"), i.alias("place")))

    places = [coded(code, c) for code, c in record_rules(allow_absolute).items()]
    return records.select(key, F.explode(F.concat(*places)).alias("i")).select(key, "i.code", "i.place")


def missing_images(records: DataFrame, key: str, listing: DataFrame, allow_absolute: bool = False) -> DataFrame:
    """(key, code, place) of the images that aren't in listing (path, relative to the image root, or absolute).

    An anti-join with a listing that Spark has made, instead of a look at each file. Only
    paths that break no other rule are sought, without steps that stay where they are.
    """
    rows = records.select(key, F.posexplode(F.coalesce("images", F.array().cast("array<string>"))).alias("place", "path")).where("trim(path) <> ''")
    rows = rows.where(F.when(F.col("path").startswith("/"), F.lit(allow_absolute)).otherwise(~escapes(F.col("path"))))
    there = listing.select(resolved(F.col("path")).alias("__path")).distinct()
    gone = rows.join(there, resolved(F.col("path")) == F.col("__path"), "left_anti")
    return gone.select(key, F.lit("image.missing").alias("code"), "place")


def resolved(path: Column) -> Column:
    """A path without empty, '.' and '..' steps."""
    step = lambda s, x: F.when(x.isin("", "."), s).when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def answer_issues(records: DataFrame, key: str) -> DataFrame:
    """(key, code, place): the answers of a record that break the answers' protocol; place counts its answers.

    Answers are the assistant's turns, or the solution where there is none. A <bbox> mark
    stands for any box. Both fields must be there, memory_update may be, and nothing else.
    """
    from reelmill.functions.protocol import with_tracking_output

    own = F.transform(F.filter("messages", lambda x: x["role"] == "assistant"), lambda x: x["content"])
    answers = F.when(F.size(own) > 0, own).when(F.col("solution").isNotNull(), F.array("solution"))
    rows = records.select(key, F.posexplode(answers).alias("place", "raw")).withColumn("raw", F.replace(F.coalesce("raw", F.lit("")), F.lit("<bbox>"), F.lit(ANY_BOX)))
    made = with_tracking_output(rows, F.col("raw"), F.lit(1000.0), F.lit(1000.0), "o")
    wrong = F.col("o.reason").isNotNull() | F.coalesce(F.col("o.memory_problem") != "memory_missing", F.lit(False))
    # a row is made or not, instead of filtered: a filter would be pushed through the parser's stages and planned for long
    found = F.when(wrong, F.array(F.struct(F.lit("answer.protocol").alias("code"), "place")))
    return made.select(key, F.explode_outer(found).alias("i")).where("i is not null").select(key, "i.code", "i.place")


def all_issues(records: DataFrame, key: str, listing: DataFrame | None = None, allow_absolute: bool = False) -> DataFrame:
    """(key, code, place): everything that is wrong with records; images are sought if there is a listing."""
    found = record_issues(records, key, allow_absolute).unionByName(answer_issues(records, key))
    return found.unionByName(missing_images(records, key, listing, allow_absolute)) if listing is not None else found


def message_rules() -> dict[str, Column]:
    """Rules on the order and the wording of a conversation, beside those of record_rules(), by codes of this library's own."""
    m = F.col("messages")
    last = F.try_element_at(m, F.lit(-1))
    return {
        "content_empty": F.exists(m, lambda x: F.trim(F.coalesce(x["content"], F.lit(""))) == ""),
        "system_not_first": F.exists(F.transform(m, lambda x, i: (x["role"] == "system") & (i > 0)), lambda b: b),
        "last_not_assistant": last["role"] != "assistant",
        "role_repeated": F.exists(F.transform(F.sequence(F.lit(1), F.greatest(F.size(m), F.lit(2)) - 1), lambda i: (i < F.size(m)) & (F.get(m, i)["role"] == F.get(m, i - 1)["role"])), lambda b: F.coalesce(b, F.lit(False))),
    }


def issues(records: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code): a row for each rule that a record breaks; one pass over the records."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items()]))
    return records.select(key, F.explode(broken).alias("code"))


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def to_preference_record(records: DataFrame) -> DataFrame:
    """Records without their assistant turns, whose last one becomes the solution."""
    own = F.filter("messages", lambda x: x["role"] == "assistant")
    return records.withColumns({"solution": F.try_element_at(own, F.lit(-1))["content"], "messages": F.filter("messages", lambda x: x["role"] != "assistant")})


def with_image_marks(records: DataFrame) -> DataFrame:
    """Records whose first user turn begins with one <image> for each image, if no turn has any."""
    none = ~F.exists("messages", lambda x: x["content"].contains("<image>"))
    marks = F.repeat(F.lit("<image>"), F.size(F.coalesce("images", F.array().cast("array<string>"))))
    at = F.array_position(F.transform("messages", lambda x: x["role"]), "user")
    marked = F.transform("messages", lambda x, i: F.when(i == at - 1, F.struct(x["role"].alias("role"), F.concat(marks, x["content"]).alias("content"))).otherwise(F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    return records.withColumn("messages", F.when(none & (at > 0), marked).otherwise(F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))))


def supervision_problems(records: DataFrame) -> DataFrame:
    """(id, problem) where a record's state, loss_scale and literal update don't go together."""
    state, scale, update = F.col("state"), F.col("loss_scale"), F.col("memory_update")
    problem = (
        F.when(~state.isin("verified_update", "verified_hard_null", "masked_unknown"), "unknown_state")
        .when((state == "masked_unknown") & scale.isNotNull(), "masked_with_scale")
        .when((state != "masked_unknown") & ~F.coalesce(scale == 1.0, F.lit(False)), "verified_without_scale")
        .when((state == "verified_update") & (F.coalesce(update, F.lit("null")) == "null"), "update_without_text")
        .when((state != "verified_update") & (F.coalesce(update, F.lit("null")) != "null"), "text_without_update")
    )
    return records.withColumn("problem", problem).where("problem is not null").select("id", "problem")


def taxonomy_problems(stored: DataFrame, recomputed: DataFrame, key: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """(*key, column, stored, recomputed) where a stored value isn't what its rows give."""
    joined = stored.select(*key, *[F.col(c).alias(f"s_{c}") for c in columns]).join(recomputed.select(*key, *columns), list(key))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").cast("string").alias("stored"), F.col(c).cast("string").alias("recomputed")) for c in columns])
    return joined.select(*key, F.explode(F.filter(pairs, lambda p: ~p["stored"].eqNullSafe(p["recomputed"]))).alias("p")).select(*key, "p.*")


def inventory(frames: DataFrame) -> DataFrame:
    """(dataset, frames, sequences, present, absent, keyframes, invalid_boxes) of annotations."""
    from reelmill.functions.boxes import is_valid

    present = F.col("gt_presence") == "present"
    return frames.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("frames"), F.count_distinct("sequence").alias("sequences"), F.count_if(present).alias("present"),
        F.count_if(F.col("gt_presence") == "absent").alias("absent"), F.count_if("is_observation_frame").alias("keyframes"),
        F.count_if(present & ~is_valid(F.col("gt"))).alias("invalid_boxes"),
    )


def fingerprint(rows: DataFrame, key: tuple[str, ...], order: str, content: Column, block: int = 4096) -> DataFrame:
    """(*key, n, sha256): the hash of a group's content hashes in order, by blocks of rows so that no list grows with the group."""
    from pyspark.sql import Window

    hashed = rows.select(*key, F.col(order).alias("o"), F.sha2(content, 256).alias("h"))
    place = F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("o", "h")) - 1) / block)
    blocks = hashed.withColumn("b", place).groupBy(*key, "b").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256).alias("hb"), F.count(F.lit(1)).alias("nb"))
    return blocks.groupBy(*key).agg(F.sum("nb").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "hb"))), lambda x: x["hb"]), ""), 256).alias("sha256"))


def inspection(frames: DataFrame, texts: DataFrame) -> DataFrame:
    """(dataset, sequence, frames, boxes, visible, keyframes, has_text): what a data set's sequences hold; visible is null if no frame says."""
    from reelmill.operators.evaluation import KEY

    rows = frames.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("frames"), F.count("gt").alias("boxes"),
        F.when(F.count("gt_presence") > 0, F.count_if(F.col("gt_presence") == "present")).alias("visible"), F.count_if("is_observation_frame").alias("keyframes"),
    )
    named = texts.where("text is not null").select(*KEY).distinct().withColumn("__t", F.lit(True))
    return rows.join(named, list(KEY), "left").withColumn("has_text", F.coalesce("__t", F.lit(False))).drop("__t")


def bundle(rows: DataFrame, case: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Clean rows once a case, the first by order, in the order of a manifest."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*case).orderBy(*order))
    return rows.where("clean").withColumn("__n", nth).where("__n = 1").drop("__n")


def report_gate(reports: DataFrame, least: int = 1200, policy: str = "strict") -> DataFrame:
    """reports with verified: no dry run, a demanded minimum that is high enough and reached, under the policy."""
    ok = ~F.col("dry_run") & (F.col("minimum") >= least) & (F.col("written") >= F.col("minimum")) & (F.col("policy") == policy)
    return reports.withColumn("verified", F.coalesce(ok, F.lit(False)))


def not_training(sources: DataFrame) -> DataFrame:
    """Sources of a training build that aren't of the train split; must be empty."""
    return sources.where(~F.coalesce(F.lower(F.trim("split")) == "train", F.lit(False)))


def mixed_families(records: DataFrame, family: str = "family") -> DataFrame:
    """The families of a data set's records if there is more than one; must be empty."""
    from pyspark.sql import Window

    seen = records.groupBy(family).agg(F.count(F.lit(1)).alias("n"))
    # a row a family
    return seen.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where("__all > 1").drop("__all")


def schema_seeded(records: DataFrame, position: str, has: Column) -> DataFrame:
    """records with position changed so that the first one that has an optional field comes first, and the others after it as before.

    For readers that take a column's type from the first rows; Spark's own schemas need no such order.
    """
    first = records.where(has).agg(F.min(position).alias("__first"))
    at, seed = F.col(position), F.col("__first")
    made = F.when(seed.isNull() | (at > seed), at).when(at == seed, F.lit(0)).otherwise(at + 1)
    return records.join(F.broadcast(first), F.lit(True), "left").withColumn(position, made.cast(records.schema[position].dataType)).drop("__first")
