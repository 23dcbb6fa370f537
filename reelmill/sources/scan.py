"""Annotation folders, lists and JSON files as tables.

Files are small and many, a handful a sequence: each is read whole as one row and
split, so that the order of its lines is kept and no file is split between tasks.
Problems are rows of a table, not exceptions; operators.audit.strict() raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions.boxes import box, is_valid

#: The folders of each layout, the splits by their other names.
SPLITS = {"train": "train", "training": "train", "val": "val", "validation": "val", "test": "test", "testing": "test"}


def whole_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, folder, text) of the files called name anywhere below path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=name, recursiveFileLookup=True)
    place = F.col("_metadata.file_path")
    return files.select(place.alias("file"), F.element_at(F.split(place, "/"), -2).alias("folder"), F.regexp_replace("value", "^﻿", "").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: files' columns but text, at (from 0) and line."""
    split = F.filter(F.transform(F.split("text", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return files.select(*[c for c in files.columns if c != "text"], F.posexplode(split).alias("at", "line"))


def numeric_rows(files: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Lines as doubles: the delimiter is a comma where the file's first line has one, else white space; nan becomes null."""
    first = F.regexp_extract("text", r"\A\s*([^\r\n]*)", 1)
    marked = files.withColumn("comma", F.instr(first, ",") > 0)
    parts = F.when(F.col("comma"), F.split("line", r"\s*,\s*")).otherwise(F.split("line", r"\s+"))
    number = lambda i: F.nanvl(F.get(parts, F.lit(i)).try_cast("double"), F.lit(None).cast("double"))
    return lines(marked).select(*[c for c in files.columns if c != "text"], "at", *[number(i).alias(c) for i, c in enumerate(columns)])


def index_rows(files: DataFrame) -> DataFrame:
    """One whole number a line; what follows # is a comment."""
    value = F.trim(F.element_at(F.split("line", "#"), 1)).try_cast("int")
    return lines(files).withColumn("value", value).where("value is not null").drop("line")


def optional_text(text: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(F.btrim(text, F.lit(" \t\r\n")), F.lit(""))


def subset_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, problem) of a frozen list: blank lines and comments are skipped; unsafe and repeated names are problems."""
    from pyspark.sql import Window

    rows = lines(spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))).where("not startswith(line, '#')")
    again = F.row_number().over(Window.partitionBy("line").orderBy("at")) > 1
    problem = F.when(F.col("line").rlike(r"[/\\]|^\.\.?$"), "unsafe").when(again, "duplicate")
    return rows.select("at", F.col("line").alias("name"), problem.alias("problem"))


def natural_key(name: Column) -> Column:
    """Array of a name's parts in which numbers compare as numbers: 2 before 10."""
    return F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p)))


def image_files(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,bmp}") -> DataFrame:
    """(file, folder, name, at): a folder's images in natural order; contents are not read."""
    from pyspark.sql import Window

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    named = found.select("file", F.element_at(F.split("file", "/"), -2).alias("folder"), F.element_at(F.split("file", "/"), -1).alias("name"))
    return named.withColumn("at", F.row_number().over(Window.partitionBy("folder").orderBy(natural_key(F.col("name")), "name")) - 1)


def _boxes(spark: SparkSession, path: str, name: str) -> DataFrame:
    return numeric_rows(whole_files(spark, path, name), ("x", "y", "w", "h")).select(F.col("folder").alias("sequence"), F.col("at").alias("frame_id"), box("x", "y", "w", "h").alias("gt"))


def scan_flagged(spark: SparkSession, path: str, names: DataFrame, dataset: str = "lasot") -> DataFrame:
    """Frames of a layout with full_occlusion.txt and out_of_view.txt beside groundtruth.txt; only listed sequences count.

    A frame shows its target where neither flag is set; the class is the name before its last hyphen.
    """
    flag = lambda name: numeric_flags(spark, path, name)
    frames = _boxes(spark, path, "groundtruth.txt").join(names.select(F.col("name").alias("sequence")), "sequence", "left_semi")
    both = frames.join(flag("full_occlusion.txt").withColumnRenamed("flag", "a"), ["sequence", "frame_id"], "left").join(flag("out_of_view.txt").withColumnRenamed("flag", "b"), ["sequence", "frame_id"], "left")
    return both.select(
        F.lit(dataset).alias("dataset"), "sequence", "frame_id", "gt", F.regexp_extract("sequence", r"^(.*)-[^-]*$", 1).alias("object_class"),
        F.when((F.col("a") == 0) & (F.col("b") == 0), "present").when(F.col("a").isNotNull() | F.col("b").isNotNull(), "absent").alias("gt_presence"),
    )


def numeric_flags(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(sequence, frame_id, flag) of files that hold numbers in one line or one a line."""
    files = whole_files(spark, path, name)
    values = F.filter(F.split(F.trim("text"), r"[\s,]+"), lambda x: x != "")
    return files.select(F.col("folder").alias("sequence"), F.posexplode(values).alias("frame_id", "flag")).withColumn("flag", F.col("flag").try_cast("int"))


def scan_discovered(spark: SparkSession, path: str, dataset: str = "tnl2k") -> DataFrame:
    """Frames of all folders that hold groundtruth.txt; a frame shows its target where the box is valid."""
    frames = _boxes(spark, path, "groundtruth.txt")
    return frames.select(F.lit(dataset).alias("dataset"), "sequence", "frame_id", "gt", F.when(is_valid(F.col("gt")), "present").otherwise("absent").alias("gt_presence"))


def scan_absent_files(spark: SparkSession, path: str, names: DataFrame, dataset: str = "mgit") -> DataFrame:
    """Frames with absent.txt beside groundtruth.txt; without that file presence is null and never guessed."""
    frames = _boxes(spark, path, "groundtruth.txt").join(names.select(F.col("name").alias("sequence")), "sequence", "left_semi")
    both = frames.join(numeric_flags(spark, path, "absent.txt"), ["sequence", "frame_id"], "left")
    return both.select(F.lit(dataset).alias("dataset"), "sequence", "frame_id", "gt", F.when(F.col("flag") == 0, "present").when(F.col("flag").isNotNull(), "absent").alias("gt_presence"))


def scan_benchmark(spark: SparkSession, path: str, dataset: str = "cognitivebench") -> DataFrame:
    """Frames with target_status.txt and keyframes.txt: presence from the status, observation from the list."""
    status = numeric_flags(spark, path, "target_status.txt")
    keys = index_rows(whole_files(spark, path, "keyframes.txt")).select(F.col("folder").alias("sequence"), F.col("value").alias("frame_id"), F.lit(True).alias("is_observation_frame")).distinct()
    both = _boxes(spark, path, "groundtruth.txt").join(status, ["sequence", "frame_id"], "left").join(keys, ["sequence", "frame_id"], "left")
    presence = F.when(F.col("flag") == 1, "present").when(F.col("flag") == 0, "absent")
    return both.select(F.lit(dataset).alias("dataset"), "sequence", "frame_id", "gt", presence.alias("gt_presence"), F.coalesce("is_observation_frame", F.lit(False)).alias("is_observation_frame"), "flag")


def benchmark_problems(frames: DataFrame) -> DataFrame:
    """(sequence, frame_id, problem, severity) of scan_benchmark()'s frames."""
    valid = is_valid(F.col("gt"))
    problem = (
        F.when(F.col("flag").isNull(), "status_missing").when(~F.col("flag").isin(0, 1), "status_unknown")
        .when((F.col("frame_id") == 0) & (F.col("flag") != 1), "first_frame_absent").when((F.col("flag") == 1) & ~valid, "present_without_valid_box")
    )
    severity = F.when(F.col("problem") == "present_without_valid_box", "warning").otherwise("error")
    return frames.withColumn("problem", problem).where("problem is not null").select("sequence", "frame_id", "problem", severity.alias("severity"))


def action_segments(files: DataFrame) -> DataFrame:
    """Raw segments of JSON files whose actions are an object of objects: (sequence, name, start_frame, end_frame, text)."""
    action = F.from_json(F.get_json_object("text", "$.action"), "map<string,struct<start_frame:string,end_frame:string,description:string>>")
    rows = files.select(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "").alias("sequence"), F.explode(action).alias("name", "a"))
    return rows.select("sequence", "name", "a.start_frame", "a.end_frame", F.col("a.description").alias("text"))


def training_log(records: DataFrame) -> DataFrame:
    """(step, loss) of log records (record variant) that have both a loss and a step of so many."""
    step = F.split_part(F.try_variant_get("record", "$['global_step/max_steps']", "string"), F.lit("/"), F.lit(1)).try_cast("int")
    return records.select(step.alias("step"), F.try_variant_get("record", "$.loss", "double").alias("loss")).where("step is not null and loss is not null")


#: Datasets by name: what reads their frames. Readers with a list take it as their third argument.
READERS = {"lasot": scan_flagged, "tnl2k": scan_discovered, "mgit": scan_absent_files, "cognitivebench": scan_benchmark}


def load_dataset(spark: SparkSession, name: str, path: str, names: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """A dataset's frames by its registered name, of some sequences if they are named."""
    reader = READERS[name]
    frames = reader(spark, path, names) if names is not None else reader(spark, path)
    return frames.where(F.col("sequence").isin(only)) if only is not None else frames


def together(*frames: DataFrame) -> DataFrame:
    """Datasets one after another; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
