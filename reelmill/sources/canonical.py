"""Per-frame JSON of any known shape to canonical frames.

A record is read once as VARIANT; every canonical column is an expression over its
paths. Explicit null and absence differ, and so paths are tested by an untyped get.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions import normalise
from reelmill.functions.boxes import is_valid
from reelmill.functions.text import one_object

#: The paths of each canonical column, the first that holds something counts.
SEQUENCE = ("sequence", "sequence_name", "video", "video_name")
DATASET = ("dataset", "dataset_name")
FRAME = ("frame_id", "frame_index", "frame_num")
STATUS = ("execution.status", "execution_status", "vlm_output.execution.status", "vlm_output.execution_status")
SKIPPED = ("skipped", "vlm_output.skipped")
ERROR_TYPE = ("execution.error_type", "error_type", "vlm_output.error_type")
GT_PRESENCE = ("ground_truth.target_presence", "ground_truth.presence", "gt_target_presence", "gt_target_status", "gt_presence", "target_visible")
PRED_PRESENCE = (
    "committed_target_presence", "tracker_output.committed_target_presence", "prediction.target_presence",
    "tracker_output.prediction.target_presence", "tracker_output.cognitive_output.target_presence",
    "tracker_output.frame_result.prediction.target_presence", "prediction.presence", "pred_target_presence",
    "pred_target_status", "pred_presence", "vlm_output.target_presence", "vlm_output.target_status",
)
GT_IDENTITY = ("ground_truth.identity_match", "gt_identity_match", "gt_identity")
PRED_IDENTITY = (
    "prediction.identity_match", "tracker_output.prediction.identity_match", "tracker_output.cognitive_output.identity_match",
    "tracker_output.frame_result.prediction.identity_match", "pred_identity_match", "pred_identity", "vlm_output.identity_match",
)
OBSERVED = ("is_observation_frame", "context.is_observation_frame", "is_keyframe")
COMMITTED_BOX = ("target_bbox", "tracker_output.target_bbox")
PRED_BOX = (
    ("prediction.bbox_xywh", "xywh"), ("tracker_output.prediction.bbox_xywh", "xywh"), ("tracker_output.cognitive_output.bbox_xywh", "xywh"),
    ("tracker_output.frame_result.prediction.bbox_xywh", "xywh"), ("pred_bbox_xywh", "xywh"), ("prediction.bbox_xyxy", "xyxy"),
    ("tracker_output.prediction.bbox_xyxy", "xyxy"), ("pred_bbox_xyxy", "xyxy"), ("prediction.bbox", None), ("tracker_output.prediction.bbox", None),
    ("tracker_output.cognitive_output.bbox", None), ("pred_bbox", None), ("vlm_output.bbox_xywh", "xywh"), ("vlm_output.bbox", None),
)
PRED_FORMAT = (
    "prediction.bbox_format", "tracker_output.prediction.bbox_format", "tracker_output.cognitive_output.bbox_format",
    "pred_bbox_format", "bbox_format", "vlm_output.bbox_format",
)
GT_BOX = (
    ("ground_truth.bbox_xywh", "xywh"), ("gt_bbox_xywh", "xywh"), ("ground_truth.bbox_xyxy", "xyxy"), ("gt_bbox_xyxy", "xyxy"),
    ("ground_truth.bbox", None), ("gt_bbox", None), ("ground_truth_rect", None),
)
GT_FORMAT = ("ground_truth.bbox_format", "gt_bbox_format")
IMAGE_SIZE = ("image_size", "current_image_size", "context.image_size", "prediction.image_size")
IMAGE_WIDTH, IMAGE_HEIGHT = ("image_width", "context.image_width"), ("image_height", "context.image_height")


def path_value(record: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path, null if it is missing, null or of another kind."""
    return F.try_variant_get(record, f"$.{path}", kind)


def has_path(record: Column, path: str) -> Column:
    """Whether a path exists; a path that holds null does."""
    return F.try_variant_get(record, f"$.{path}", "variant").isNotNull()


def holds(record: Column, path: str) -> Column:
    """Whether a path exists and holds something but null."""
    found = F.try_variant_get(record, f"$.{path}", "variant")
    return found.isNotNull() & ~F.is_variant_null(found)


def first_value(record: Column, paths: tuple[str, ...], kind: str = "string") -> Column:
    return F.coalesce(*[path_value(record, p, kind) for p in paths])


def _numbers(raw: Column) -> Column:
    """Four numbers of a VARIANT: a list, or a struct in one of three namings."""
    named = [F.array(*[F.try_variant_get(raw, f"$.{k}", "double") for k in keys]) for keys in (("x", "y", "w", "h"), ("x", "y", "width", "height"), ("x1", "y1", "x2", "y2"))]
    return F.coalesce(F.try_variant_get(raw, "$", "array<double>"), *[F.when(F.forall(n, lambda v: v.isNotNull()), n) for n in named])


def _finite(four: Column) -> Column:
    """The first four of some numbers, null if they are fewer or not all finite."""
    fine = (F.size(four) >= 4) & F.forall(F.slice(four, 1, 4), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.slice(four, 1, 4))


def _size(record: Column, at: int, single: tuple[str, ...]) -> Column:
    size = F.coalesce(*[F.get(path_value(record, p, "array<double>"), F.lit(at)) for p in IMAGE_SIZE], first_value(record, single, "double"))
    return F.when(size > 0, size)


def as_xywh(four: Column, form: Column, width: Column, height: Column) -> Column:
    """Four numbers in a declared format to pixels; no format means xywh, and none is guessed."""
    word = F.translate(F.lower(F.trim(F.coalesce(form, F.lit("xywh")))), "-", "_")
    norm, corners = word.contains("norm") | word.contains("1000"), word.contains("xyxy")
    at = lambda i, size: F.when(norm, four[i] / 1000.0 * size).otherwise(four[i])
    x, y, c, d = at(0, width), at(1, height), at(2, width), at(3, height)
    made = F.struct(x.alias("x"), y.alias("y"), F.when(corners, c - x).otherwise(c).alias("w"), F.when(corners, d - y).otherwise(d).alias("h"))
    return F.when(four.isNotNull() & is_valid(made), made)


def _raw(record: Column, paths: tuple[str, ...]) -> Column:
    """The first VARIANT at the paths that holds something."""
    return F.coalesce(*[F.when(holds(record, p), F.try_variant_get(record, f"$.{p}", "variant")) for p in paths])


def _form(record: Column, paths, formats: tuple[str, ...]) -> Column:
    """The format that goes with the first path that holds something: its own, or the one declared."""
    form, declared = F.lit(None).cast("string"), first_value(record, formats)
    for path, own in reversed(paths):
        form = F.when(holds(record, path), F.lit(own) if own else declared).otherwise(form)
    return form


def _presence(raw: Column) -> Column:
    kind, text = F.schema_of_variant(raw), F.try_variant_get(raw, "$", "string")
    number = F.try_variant_get(raw, "$", "double")
    yes_no = F.when(number == 1.0, "present").when(number == 0.0, "absent")
    return F.when(kind == "BOOLEAN", normalise.flag(F.try_variant_get(raw, "$", "boolean"), "present", "absent")).when(kind == "STRING", normalise.presence(text)).otherwise(yes_no)


def _identity(raw: Column) -> Column:
    same = normalise.flag(F.try_variant_get(raw, "$", "boolean"), "same", "different")
    return F.when(F.schema_of_variant(raw) == "BOOLEAN", same).otherwise(normalise.identity(F.try_variant_get(raw, "$", "string")))


#: Rows of the table of file blocks that are broadcast at most; beyond, lines are joined with it by shuffle.
MOST_BLOCKS = 1 << 17


def result_files(spark, path: str, pattern: str = "*_frames.jsonl") -> str:
    """The file name pattern to read below path: the given one, or all JSON lines where the usual one has no file.

    Only names are listed. An error if there is none, or if path is a file of another kind.
    """
    def any_file(glob: str) -> bool:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        return bool(found.select("path").limit(1).collect())

    name = path.rstrip("/").rsplit("/", 1)[-1]
    if any_file(name) and not path.endswith("/"):  # path is a file
        if not name.lower().endswith(".jsonl"):
            raise ValueError(f"frames are read from JSON lines, not from {path}")
        return name
    for glob in (pattern, "*.jsonl") if pattern == "*_frames.jsonl" else (pattern,):
        if any_file(glob):
            return glob
    raise FileNotFoundError(f"no JSON lines below {path} (pattern {pattern})")


def numbered_lines(spark, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(text, file, line_no, row_no) of the lines below path that aren't blank.

    line_no counts all lines of a file from 1, row_no those that aren't blank. Files are
    read in blocks of any size: a task numbers the lines of its blocks, and how many lines
    come before a block is a sum over the blocks of its file, a small table.
    """
    lines = spark.read.text(path, pathGlobFilter=glob, recursiveFileLookup=True)
    lines = lines.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # rows of a block are neighbours in their task: its numbers say which line of the block a row is
    lines = lines.withColumn("__line", F.monotonically_increasing_id())
    full = lines.where(F.col("text").rlike(r"\S")).withColumn("__row", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.min("__line").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))
    rows = full.groupBy("file", "block").agg(F.min("__row").alias("first_row"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    blocks = blocks.join(rows, ["file", "block"], "left").withColumns({"lines_before": before("n_lines"), "rows_before": before("n_rows")}).where("n_rows > 0")
    blocks = blocks.drop("n_lines", "n_rows")
    if blocks.count() <= MOST_BLOCKS:
        blocks = F.broadcast(blocks)
    made = full.join(blocks, ["file", "block"])
    return made.select("text", "file", (F.col("lines_before") + F.col("__line") - F.col("first_line") + 1).cast("int").alias("line_no"), (F.col("rows_before") + F.col("__row") - F.col("first_row") + 1).cast("int").alias("row_no"))


def read_json_lines(spark, path: str, pattern: str = "*_frames.jsonl") -> DataFrame:
    """(record variant, file, line_no, row_no, text) of JSON lines below a path; blank lines are skipped.

    Files named like pattern are read, or all JSON lines if none is; no file is an error.
    record is null where a line isn't one JSON object and nothing else: bad_lines() lists
    those.
    """
    lines = numbered_lines(spark, path, result_files(spark, path, pattern))
    return lines.select(one_object(F.col("text")).alias("record"), "file", "line_no", "row_no", "text")


def bad_lines(lines: DataFrame) -> DataFrame:
    return lines.where("record is null").select("file", "line_no", "text")


def canonical_frames(lines: DataFrame) -> DataFrame:
    """One row a record (record variant, file, line_no): the columns every metric works on.

    A sequence without a name is called by its file, a dataset default, and a frame by
    its place among the file's records. Presence is taken from boxes only where no label says it: a ground truth
    that has a box path is absent without a valid box; a prediction without a box is
    absent only if the frame ran well.
    """
    r = F.col("record")
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.coalesce("file", F.lit("")), "/"), -1), r"\.jsonl$", ""), r"[_.]frames$", "")
    status = normalise.execution_status([path_value(r, p) for p in STATUS], first_value(r, SKIPPED, "boolean"), F.nullif(first_value(r, ERROR_TYPE), F.lit("")))
    # what paths hold is found first, a column each: an expression that others repeat would be worked out for each of them
    committed = F.array_max(F.array(*[has_path(r, p) for p in COMMITTED_BOX]))
    found = lines.select(
        F.coalesce(first_value(r, SEQUENCE), stem).alias("sequence"),
        F.coalesce(first_value(r, DATASET), F.lit("default")).alias("dataset"),
        F.coalesce(first_value(r, FRAME, "int"), F.col("row_no" if "row_no" in lines.columns else "line_no") - 1).cast("int").alias("frame_id"),
        _raw(r, tuple(p for p, _ in GT_BOX)).alias("gt_raw"), _form(r, GT_BOX, GT_FORMAT).alias("gt_form"),
        F.when(committed, F.coalesce(*[F.try_variant_get(r, f"$.{p}", "variant") for p in COMMITTED_BOX])).otherwise(_raw(r, tuple(p for p, _ in PRED_BOX))).alias("pred_raw"),
        F.when(committed, "xywh").otherwise(_form(r, PRED_BOX, PRED_FORMAT)).alias("pred_form"),
        _size(r, 0, IMAGE_WIDTH).alias("width"), _size(r, 1, IMAGE_HEIGHT).alias("height"),
        _raw(r, GT_PRESENCE).alias("gt_said"), _raw(r, PRED_PRESENCE).alias("pred_said"),
        _raw(r, GT_IDENTITY).alias("gt_same"), _raw(r, PRED_IDENTITY).alias("pred_same"),
        status.alias("execution_status"),
        first_value(r, OBSERVED, "boolean").alias("is_observation_frame"),
        F.array_max(F.array(*[has_path(r, p) for p, _ in GT_BOX])).alias("has_gt_path"),
    )
    read = found.withColumns({
        "gt_raw": _numbers(F.col("gt_raw")), "pred_raw": _numbers(F.col("pred_raw")),
        "gt_said": _presence(F.col("gt_said")), "pred_said": _presence(F.col("pred_said")),
        "gt_identity": _identity(F.col("gt_same")), "pred_identity": _identity(F.col("pred_same")),
    }).withColumns({"gt_raw": _finite(F.col("gt_raw")), "pred_raw": _finite(F.col("pred_raw"))})
    base = read.withColumns({k: as_xywh(F.col(f"{k}_raw"), F.col(f"{k}_form"), F.col("width"), F.col("height")) for k in ("gt", "pred")})
    gt_presence = F.coalesce("gt_said", F.when(F.col("has_gt_path"), F.when(F.col("gt").isNotNull(), "present").otherwise("absent")))
    well = F.col("execution_status").isin("ok", "initialized")
    pred_presence = F.coalesce(
        "pred_said", F.when(F.col("pred").isNotNull() & ~normalise.is_error(F.col("execution_status")), "present").when(well, "absent")
    )
    return base.withColumns({"gt_presence": gt_presence, "pred_presence": pred_presence}).select(
        "sequence", "dataset", "frame_id", "gt", "pred", "gt_presence", "pred_presence", "gt_identity", "pred_identity", "execution_status", "is_observation_frame"
    )
