"""Session builder for the CLI, the tests and the bench; staging of intermediate tables."""

from __future__ import annotations

import os
import re
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Where a session on one machine stages its tables if no folder is named.
ONE_MACHINE_DIR = "file:///tmp/checkpoints"


def get_session(app: str = "lanternfold", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution and UTC. On a cluster, spark-submit's values win."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Without that setting there is one only where driver and executors are one process
    (master local); anywhere else a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return ONE_MACHINE_DIR
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def stage(df: DataFrame, name: str, **observed: Column) -> DataFrame:
    """Write a table several later steps read, and read it back.

    Costs one write; saves its work for every reader, also after lost executors. The
    files are removed by ``release``, at the latest when the application ends. Aggregates named in
    ``observed`` are taken while the rows are written and are in the frame's ``observed``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lanternfold/{name}-{uuid.uuid4().hex}"
    found = Observation() if observed else None
    (df.observe(found, *[c.alias(n) for n, c in observed.items()]) if observed else df).write.parquet(path)
    files, folder = _files(spark, path)
    files.deleteOnExit(folder)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    staged.observed = found.get if found else {}
    for tables in _OPEN:
        tables.append(staged)
    return staged


_OPEN: list[list[DataFrame]] = []


@contextmanager
def short_lived():
    """Tables staged in this block are removed at its end: for work that is over by then."""
    tables: list[DataFrame] = []
    _OPEN.append(tables)
    try:
        yield
    finally:
        _OPEN.remove(tables)
        release(*tables)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for tables that have their own files. Removed when the application ends."""
    path = f"{checkpoint_dir(spark)}/lanternfold/{name}-{uuid.uuid4().hex}"
    files, folder = _files(spark, path)
    files.mkdirs(folder)  # only what exists can be marked
    files.deleteOnExit(folder)
    return path


class OutOfTime(TimeoutError):
    """Work was stopped because its time was over."""


@contextmanager
def time_limit(spark: SparkSession, seconds: float, message: str = "out of time"):
    """Spark jobs that this thread still runs after so many seconds are cancelled, and the block ends
    with ``OutOfTime``. 0: no limit. Threads started in the block take part if they are ``InheritableThread``s."""
    if not seconds:
        yield
        return
    context, tag, over, done = spark.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch():
        done.wait(max(0.0, seconds))
        while not done.is_set():  # a job that begins after the end is stopped as well
            over.set()
            context.cancelJobsWithTag(tag)
            done.wait(0.2)

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as exc:
        if over.is_set():
            raise OutOfTime(message) from exc
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    if over.is_set():
        raise OutOfTime(message)


def release(*staged: DataFrame) -> None:
    """Remove the files of staged tables. Nothing that reads them may run afterwards."""
    for df in staged:
        files, folder = _files(df.sparkSession, df.staged_at)
        files.delete(folder, True)


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder
