"""Results as files: frames by dataset and sequence, scores, reports, checksums.

Spark's commit protocol publishes a write whole or not at all; a path that is there
already is an error unless a run resumes, and then only what is pending is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.operators.evaluation import KEY


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities in double columns, nested ones too, become null."""

    def safe(column, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)
        if isinstance(kind, T.StructType):
            return F.when(column.isNotNull(), F.struct(*[safe(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: safe(x, kind.elementType))
        return column

    return df.select(*[safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def write_frames(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Frames as JSON lines, a folder for each dataset; a sequence's frames are together and in order."""
    rows = json_safe(frames).repartition("dataset", "sequence").sortWithinPartitions(*KEY, "frame_id")
    rows.write.mode(mode).partitionBy("dataset").json(path)


def manifests(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """(dataset, sequence, expected_frames, frames_written, completed) of what was written."""
    written = frames.groupBy(*KEY).agg(F.count(F.lit(1)).alias("frames_written"))
    joined = expected.join(written, list(KEY), "left").withColumn("frames_written", F.coalesce("frames_written", F.lit(0)))
    return joined.withColumn("completed", F.col("frames_written") == F.col("expected_frames"))


def flattened(df: DataFrame) -> DataFrame:
    """Scalars of nested structs as columns with dotted names; arrays and maps are left out."""
    found = []

    def walk(column, name, kind):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column[f.name], f"{name}.{f.name}", f.dataType)
        elif not isinstance(kind, (T.ArrayType, T.MapType, T.VariantType)):
            found.append(column.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*found)


def write_scores(summary: DataFrame, sequences: DataFrame, path: str) -> str:
    """summary as JSON, sequences as CSV and a short report in Markdown; returns the report."""
    json_safe(summary).coalesce(1).write.mode("errorifexists").json(f"{path}/summary")
    flattened(json_safe(sequences)).write.mode("errorifexists").option("header", "true").csv(f"{path}/sequence_metrics")
    report = markdown(summary)
    spark = summary.sparkSession
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/report")
    return report


def markdown(summary: DataFrame, digits: int = 4) -> str:
    """A table of a summary, which has a few rows by nature."""
    head = summary.columns
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "-" if v is None else str(v)
    rows = [" | ".join(cell(v) for v in r) for r in summary.orderBy(*head[:1]).collect()]
    return "\n".join([" | ".join(head), " | ".join("-" for _ in head), *rows])


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Training records as JSON lines, without the columns that say where they came from."""
    json_safe(records.drop(*[c for c in records.columns if c.startswith("_")])).write.mode(mode).json(path)


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, size, sha256) of the files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
