"""Session helpers: a local session for tests, durable materialisation, and
joins and broadcasts that stay safe at scale."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-JVM session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortsmith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one is made up only where driver and tasks are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        shared = tempfile.mkdtemp(prefix="cohortsmith-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


#: Makes Spark delete the shuffle files of a job when it ends; a written table needs them no more.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_writers = 0
_found: str | None = None
_notes: list[list[str]] = []


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """CLEAN holds as long as any thread is inside."""
    global _writers, _found
    with _lock:
        if not _writers:
            _found = spark.conf.get(CLEAN, "false")
            spark.conf.set(CLEAN, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.set(CLEAN, _found)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that are made inside, so that they can be released when nobody reads them any more."""
    mine: list[str] = []
    _notes.append(mine)
    try:
        yield mine
    finally:
        _notes.remove(mine)


def release(spark: SparkSession, folders: Sequence[str], in_use: DataFrame | None = None) -> list[str]:
    """Deletes folders of the shared one, but for those that `in_use` still reads; returns these."""
    reads = in_use.inputFiles() if in_use is not None else []
    kept = []
    for folder in folders:
        if any(folder.rsplit("/", 1)[-1] in f for f in reads):
            kept.append(folder)
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return kept


def fresh_folder(spark: SparkSession) -> str:
    """A name for a new folder inside the shared one."""
    folder = f"{shared_dir(spark).rstrip('/')}/cohortsmith/{uuid.uuid4().hex}"
    for notes in _notes:
        notes.append(folder)
    return folder


def durable(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the table once to the shared folder and go on from the copy.

    Unlike checkpoint() this computes the plan a single time, and the copy's size is
    known to the planner. A lost executor costs no recompute. Shuffle files of the job
    go when it ends. `folder` is a name from fresh_folder, for whoever releases the copy.
    """
    path = folder or fresh_folder(df.sparkSession)
    with _clean_shuffles(df.sparkSession):
        df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Partitions for work whose cost its bytes do not show, so AQE must not merge it."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join that keeps one copy of the keys.

    Without a hint Spark chooses: a side is broadcast only while its measured size
    is under the session's threshold, and AQE splits skewed partitions otherwise.
    """
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    cond = None
    for k in keys:
        c = left[f"`{k}`"].eqNullSafe(renamed[f"`__r_{k}`"])
        cond = c if cond is None else cond & c
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys])
