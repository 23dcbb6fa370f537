"""States over time: which text holds at a frame, where it changes, and the labels made of that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions import text as tx
from reelmill.operators.evaluation import KEY

#: The longest text, in characters and in words, that may become an update.
MAX_UPDATE, MAX_UPDATE_WORDS = 256, 30


def clean_segments(raw: DataFrame) -> DataFrame:
    """raw segments with drop_reason (null if kept), numbers and text cleaned; sort by start, end, name where order counts."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[\s ]", "").try_cast("int")
    made = raw.withColumn("__missing", F.col("start_frame").isNull() | F.col("end_frame").isNull()).withColumns({"start_frame": number("start_frame"), "end_frame": number("end_frame"), "text": tx.capitalised(F.coalesce("text", F.lit("")))})
    start, end = F.col("start_frame"), F.col("end_frame")
    reason = (
        F.when(F.col("__missing"), "missing_frame_bounds")
        .when(start.isNull() | end.isNull() | (start < 0) | (end < 0), "unparsable_frame_number")
        .when(end < start, F.concat(F.lit("end_lt_start("), start.cast("string"), F.lit(">"), end.cast("string"), F.lit(")")))
        .when(F.col("text") == "", "empty_description")
    )
    return made.withColumn("drop_reason", reason).drop("__missing")


def may_update(text: Column) -> Column:
    """Whether a text is short enough to become an update; no text is cut to fit."""
    return (F.length(text) <= MAX_UPDATE) & (tx.n_words(text) <= MAX_UPDATE_WORDS)


def _steps(segments: DataFrame) -> DataFrame:
    """(dataset, sequence, frame_id, open, number): where texts begin and stop to hold.

    Segments of one text that meet or overlap are one interval first, so that the sum of
    open up to a frame is how many different texts hold there; number is the text's place
    among its sequence's, and summed likewise says which one, if it is alone.
    """
    spans = segments.select(*KEY, F.col("start_frame").cast("long").alias("a"), F.col("end_frame").cast("long").alias("b"), "text").where("a <= b")
    own = Window.partitionBy(*KEY, "text").orderBy("a", "b")
    before = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("piece", F.when(F.coalesce(F.col("a") > before, F.lit(False)), 1).otherwise(0)).withColumn("piece", F.sum("piece").over(own))
    whole = spans.groupBy(*KEY, "text", "piece").agg(F.min("a").alias("a"), (F.max("b") + 1).alias("b"))
    whole = whole.withColumn("number", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("text")).cast("long"))
    ends = F.array(F.struct(F.col("a").alias("frame_id"), F.lit(1).alias("open")), F.struct(F.col("b").alias("frame_id"), F.lit(-1).alias("open")))
    return whole.select(*KEY, "text", "number", F.explode(ends).alias("e")).select(*KEY, "e.frame_id", "e.open", "text", "number")


def _swept(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """rows (dataset, sequence, frame_id, ...) with n_open and number, summed over the steps up to their frame; one merged order, no join."""
    marked = rows.withColumns({"open": F.lit(0), "number": F.lit(0).cast("long"), "__row": F.lit(True)})
    both = marked.unionByName(steps.select(*KEY, "frame_id", "open", (F.col("open") * F.col("number")).alias("number"), F.lit(False).alias("__row")), allowMissingColumns=True)
    upto = Window.partitionBy(*KEY).orderBy("frame_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumns({"n_open": F.sum("open").over(upto), "number": F.sum("number").over(upto)})
    return summed.where("__row").drop("open", "__row")


def state_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points with state (the text of the segments that cover frame_id) and ambiguous (several texts do).

    A sweep: steps and points in one order, so that the work is that of sorting points and
    edges, however many segments a sequence has. A point comes back once; one without a
    segment has no state. Segments that end before they begin cover nothing.
    """
    own, steps = points.columns, _steps(segments)
    swept = _swept(points, steps)
    texts = steps.select(*KEY, F.col("number").alias("__number"), F.col("text").alias("__text")).distinct()
    alone = F.when(F.col("n_open") == 1, F.col("number"))
    joined = swept.withColumn("__alone", alone).alias("p").join(
        texts.select(*[F.col(c).alias(f"__{c}") for c in KEY], "__number", "__text"),
        (F.col("p.dataset") == F.col("__dataset")) & (F.col("p.sequence") == F.col("__sequence")) & (F.col("__alone") == F.col("__number")), "left",
    )
    kinds = {f.name: f.dataType for f in points.schema}
    return joined.select(*[F.col(f"p.{c}").cast(kinds[c]).alias(c) for c in own], F.col("__text").alias("state"), (F.col("n_open") > 1).alias("ambiguous"))


def boundaries(segments: DataFrame) -> DataFrame:
    """(dataset, sequence, frame_id) where the text changes or is ambiguous; only segment edges are looked at.

    Nothing changes between two edges, and so what held before an edge is what held at
    the edge before it.
    """
    steps = _steps(segments)
    edges = segments.select(*KEY, F.explode(F.array(F.col("start_frame").cast("long"), F.col("end_frame").cast("long") + 1)).alias("frame_id")).distinct()
    order = Window.partitionBy(*KEY).orderBy("frame_id")
    alone = F.when(F.col("n_open") == 1, F.col("number"))
    swept = _swept(edges, steps).select(*KEY, "frame_id", "n_open", alone.alias("alone"))
    pairs = swept.withColumns({"before": F.lag("alone").over(order), "n_before": F.coalesce(F.lag("n_open").over(order), F.lit(0))})
    changed = (F.col("n_open") > 1) | (F.col("n_before") > 1) | ~F.col("alone").eqNullSafe(F.col("before"))
    return pairs.where((F.col("frame_id") > 0) & changed).select(*KEY, F.col("frame_id").cast("int").alias("frame_id"))


#: The data set whose texts hold for a part of a sequence, and where a re-anchored text is from.
SEGMENTED, ANCHORED = "mgit", "mgit_reference_action_description"


def reanchored(cases: DataFrame, segments: DataFrame) -> DataFrame:
    """cases (dataset, sequence, reference_id, text, text_source) with the text that holds at the reference frame.

    Only of the data set whose texts tell of a part of a sequence; where no segment or
    several texts cover the reference frame, and of other data sets, text and
    text_source stay what they are. Cases come back as often as they are there.
    """
    own = cases.columns
    kept = cases.withColumnsRenamed({"frame_id": "__frame_id"})
    at = state_at(kept.withColumn("frame_id", F.col("reference_id")), segments.where(F.lower(F.trim("dataset")) == SEGMENTED))
    held = F.coalesce((F.lower(F.trim("dataset")) == SEGMENTED) & ~F.col("ambiguous") & (F.col("state") != ""), F.lit(False))
    made = at.withColumns({"text": F.when(held, F.col("state")).otherwise(F.col("text")), "text_source": F.when(held, F.lit(ANCHORED)).otherwise(F.col("text_source"))})
    return made.drop("frame_id").withColumnsRenamed({"__frame_id": "frame_id"}).select(*own)


def boundary_distance(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """points with distance to the nearest boundary on either side, null without any; one merged order, no join."""
    marked = points.withColumn("__b", F.lit(None).cast("int")).unionByName(bounds.select(*KEY, "frame_id", F.col("frame_id").cast("int").alias("__b")), allowMissingColumns=True)
    order = Window.partitionBy(*KEY).orderBy("frame_id")
    before = F.last("__b", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("__b", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("frame_id") - before, after - F.col("frame_id"))
    return marked.withColumn("distance", near).where("__b is null").drop("__b")


def state_labels(plan: DataFrame, segments: DataFrame, margin: int = 30, hard_null: bool = True) -> DataFrame:
    """plan (dataset, sequence, frame_id, absent) with state, memory_update, input_state and reason.

    The text in memory before a frame is that of the last earlier frame whose text could
    become a label, or else the sequence's first text: a window, as storing a text that
    is there already changes nothing.
    """
    first = segments.groupBy(*KEY).agg(F.min_by("text", F.struct("start_frame", "end_frame", "name")).alias("initial"))
    at = boundary_distance(state_at(plan, segments).join(first, list(KEY), "left"), boundaries(segments))
    words = F.col("state")
    storable = ~F.col("absent") & ~F.col("ambiguous") & words.isNotNull() & may_update(words) & F.col("initial").isNotNull()
    order = Window.partitionBy(*KEY).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("input_state", F.coalesce(F.last(F.when(storable, words), ignorenulls=True).over(order), F.col("initial")))
    held, near = F.col("input_state"), F.coalesce(F.col("distance") < margin, F.lit(False))
    reason = (
        F.when(F.col("absent"), "absent_no_new_appearance_evidence")
        .when(F.col("ambiguous"), "overlapping_segments_conflicting_text")
        .when(words.isNull(), "frame_not_covered_by_any_segment")
        .when(held.isNull(), "no_prior_state_snapshot")
        .when((words != held) & may_update(words), "action_segment_text_changed")
        .when(words != held, "update_text_exceeds_label_limit")
        .when(F.lit(not hard_null), "within_segment_hard_null_disabled")
        .when(near, F.concat(F.lit("within_boundary_margin("), F.col("distance").cast("string"), F.lit(")")))
        .otherwise("within_segment_state_text_unchanged")
    )
    made = at.withColumn("reason", reason)
    sure = F.col("reason").isin("absent_no_new_appearance_evidence", "within_segment_state_text_unchanged")
    changed = F.col("reason") == "action_segment_text_changed"
    label = F.when(changed, "verified_update").when(sure, "verified_hard_null").otherwise("masked_unknown")
    return made.select(*KEY, "frame_id", label.alias("state"), F.when(changed, words).alias("memory_update"), "input_state", "reason")


def chain_breaks(labels: DataFrame) -> DataFrame:
    """Labels whose input_state isn't the last update before them; the first of a sequence may start from anything."""
    order = Window.partitionBy(*KEY).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)
    held = labels.withColumn("expected", F.last("memory_update", ignorenulls=True).over(order))
    return held.where("expected is not null and not (input_state <=> expected)").select(*KEY, "frame_id", "expected", "input_state")


def asof_update(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """cases (dataset, sequence, frame_id, reference_id) with memory: the last update in [reference_id, frame_id), null if none.

    One merged order instead of a theta join: the last update and its frame are carried
    forward, and count if they aren't older than the reference.
    """
    own = cases.columns
    rows = cases.withColumns({"__u": F.lit(None).cast("struct<f:int,t:string>"), "__case": F.lit(1)}).unionByName(
        labels.where("memory_update is not null").select(*KEY, "frame_id", F.struct(F.col("frame_id").cast("int").alias("f"), F.col("memory_update").alias("t")).alias("__u"), F.lit(0).alias("__case")),
        allowMissingColumns=True,
    )
    before = Window.partitionBy(*KEY).orderBy("frame_id").rangeBetween(Window.unboundedPreceding, -1)
    last = rows.withColumn("__last", F.last("__u", ignorenulls=True).over(before)).where("__case = 1")
    return last.withColumn("memory", F.when(F.col("__last.f") >= F.col("reference_id"), F.col("__last.t"))).select(*own, "memory")


def with_default(labels: DataFrame, cases: DataFrame, default: Column) -> DataFrame:
    """cases with their label's state, or a placeholder where there is none."""
    return cases.join(labels.select(*KEY, "frame_id", "state"), [*KEY, "frame_id"], "left").withColumn("state", F.coalesce("state", default))


def label_problems(labels: DataFrame) -> DataFrame:
    """(dataset, sequence, frame_id, problem) of label rows that must not be trained on."""
    text, sure = F.trim("memory_update"), F.coalesce("verified_null", F.lit(False))
    problem = (
        F.when(~F.coalesce(F.col("target_status").isin("present", "absent"), F.lit(False)), "bad_status")
        .when(F.col("memory_update").isNotNull() & (text == ""), "empty_update")
        .when(F.col("memory_update").isNull() & ~sure, "null_without_proof")
        .when(F.col("memory_update").isNotNull() & sure, "update_with_verified_null")
        .when(F.col("source").startswith("teacher") & ~F.coalesce(F.col("reviewed"), F.lit(False)) & ~F.coalesce(F.col("quality_gate_passed"), F.lit(False)), "teacher_not_reviewed")
    )
    return labels.withColumn("problem", problem).where("problem is not null").select(*KEY, "frame_id", "problem")


def read_label_lines(lines: DataFrame) -> DataFrame:
    """lines (record variant, file, line_no) of a label file -> (dataset, sequence, frame_id, memory_update, source, reviewed, verified_null, file, line_no, problem).

    dataset and sequence may stand under source_dataset and source_sequence. problem says
    why a line is no label: not_an_object, missing_field, bad_frame_id, or
    duplicate_label for all but the first of a frame; null for the others.
    audit.strict() raises where one must stop at them.
    """
    r = F.col("record")
    get = lambda k, kind="string": F.try_variant_get(r, f"$.{k}", kind)
    there = lambda k: get(k, "variant").isNotNull()
    name = lambda k: F.trim(F.when(there(k), F.coalesce(get(k), F.lit(""))).otherwise(F.coalesce(get(f"source_{k}"), F.lit(""))))
    made = lines.select(
        name("dataset").alias("dataset"), name("sequence").alias("sequence"), get("frame_id", "int").alias("frame_id"), get("memory_update").alias("memory_update"),
        F.coalesce(get("source"), F.lit("")).alias("source"), F.coalesce(get("reviewed", "boolean"), F.lit(False)).alias("reviewed"), F.coalesce(get("verified_null", "boolean"), F.lit(False)).alias("verified_null"),
        "file", "line_no", r.isNull().alias("__no"), (there("frame_id") & there("memory_update")).alias("__there"),
    )
    problem = (
        F.when(F.col("__no"), "not_an_object")
        .when((F.col("dataset") == "") | (F.col("sequence") == "") | ~F.coalesce("__there", F.lit(False)), "missing_field")
        .when(F.col("frame_id").isNull() | (F.col("frame_id") < 0), "bad_frame_id")
    )
    made = made.withColumn("problem", problem).drop("__no", "__there")
    nth = F.row_number().over(Window.partitionBy(*KEY, "frame_id", F.col("problem").isNull()).orderBy("file", "line_no"))
    return made.withColumn("problem", F.when(F.col("problem").isNull() & (nth > 1), "duplicate_label").otherwise(F.col("problem")))
