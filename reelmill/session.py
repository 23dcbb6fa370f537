"""How the library meets Spark: sessions for local work, the input tables, and checkpoints."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "reelmill") -> SparkSession:
    """A session for tests and benchmarks; on a cluster spark-submit makes the session."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("REELMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir, by a path that may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where the session names none, a folder of this machine does for a local master, as
    in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp("-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Whether a query's shuffle files go as soon as it has run.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files behind.

    Else those stay until the driver happens to collect its garbage, and a chain of
    steps takes the disk of all of them together. It is for steps whose rows are kept
    elsewhere: a query that runs once more has to shuffle once more.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and kept in the cluster's checkpoint folder, with its lineage cut and its shuffle files gone."""
    checkpoint_dir(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # as a query of its own, so that df may still be run


#: Frames, and about as many rows made of them, that one task of a chain of windows gets.
TASK_FRAMES = 1 << 17


def dealt(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """rows dealt by key to as many tasks as n frames need, or run at once, so that a task's memory doesn't follow the input.

    Windows over key and more then shuffle nothing again, and small bytes don't make tasks
    of many rows, as they do where Spark joins partitions by their compressed size.
    """
    return rows.repartition(max(n // TASK_FRAMES + 1, rows.sparkSession.sparkContext.defaultParallelism), *key)
