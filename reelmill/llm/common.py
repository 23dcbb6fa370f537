"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.session import checkpoint, checkpoint_dir, freed

#: Bytes of text that a Python task turns into objects at once, unless one row has more.
SLICE = 2 << 20


#: Rows of a few numbers that a task gets at least, where a table's size is known.
TASK_ROWS = 1 << 17


def fitted(df: DataFrame, n: int) -> DataFrame:
    """df in no more tasks than n rows need: a small table in hundreds of tasks costs more in files than in work."""
    return df.coalesce(n // TASK_ROWS + 1)


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed, in as many tasks as it has rows for."""
    held = checkpoint(df)
    return fitted(held, held.count())


#: Buckets of keys that may_match() broadcasts at most.
BUCKETS = 1 << 20


def may_match(df: DataFrame, col: str, keys: DataFrame, key_col: str) -> DataFrame:
    """The rows of df whose long column col may be among keys' key_col, for a join that then shuffles no others.

    Only the numbers of the keys' buckets are broadcast, BUCKETS at most, however many
    keys there are: with very many, few rows are left out, but none that matches.
    """
    bucket = lambda c: F.pmod(F.col(c), F.lit(BUCKETS)).cast("int")
    held = keys.select(bucket(key_col).alias("__bucket")).distinct()
    return df.join(F.broadcast(held), bucket(col) == F.col("__bucket"), "left_semi")


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: for tables with whole texts, which checkpoints don't compress."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def empty_as_null_safe(col: str):
    """The text column as a string, null taken as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text string) of df, so that no other column of it can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), empty_as_null_safe(text_col).alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], col: str | int = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about most bytes of text, so that a task's memory doesn't follow the size of batches."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


#: Bytes of a batch that Spark hands to a Python task at once, where the session names no other size.
BATCH = "4m"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes, whose tasks leave no freed memory behind.

    Sets spark.sql.execution.arrow.maxBytesPerBatch where the session doesn't. Python
    workers outlive their tasks, and what they keep for later is missing elsewhere.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(size, None) is None:
        df.sparkSession.conf.set(size, BATCH)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(task, schema)


def _give_back() -> None:
    """Freed memory goes back to the system, as far as the allocators can tell it from the rest."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(df: DataFrame, each: Callable[[str], tuple], schema: str) -> DataFrame:
    """Rows of (doc_id, *each(text)) for every row of df, which texts() has made."""
    arrow = _arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [each(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], arrow.field(i + 1).type) for i in range(len(arrow) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=arrow)

    return map_batches(df, run, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))
