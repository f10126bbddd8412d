"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in ``spark.checkpoint.dir``; a session that names none must be local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or '/tmp/checkpoints').rstrip('/')}/marlstone-{label}-{uuid.uuid4().hex}"


#: A writer of Parquet holds a row group in memory, which Spark does not count, so what each task holds has a bound of its own.
ROW_GROUP = {"parquet.block.size": 16 << 20}

#: The folders that the innermost ``scratch`` removes.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written and read again: computed once, and a join on their keys can be split where it is skewed."""
    path = new_folder(df.sparkSession, label)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    df.write.options(**ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """The folder goes if it can: where it cannot, what else happened counts."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` in this thread inside the block goes when it ends, also where it raises; nothing may read it later."""
    paths: list[str] = []
    before = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(before)
        for path in paths:
            removed(spark, path)


#: Of documents of some KB a task reads and hands to Python a few MB at a time, which Spark does not count either.
_MOST = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the session's batches inside the block."""
    before = {key: spark.conf.get(key) for key in _MOST}
    for key, most in _MOST.items():
        now = before[key].removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_KEPT: dict[tuple[str, str, str], str] = {}


def kept_folder(spark: SparkSession, label: str, of: str, build) -> str:
    """A folder that ``build(path)`` filled from ``of`` in this application, built again if it is gone."""
    key = (spark.sparkContext.applicationId, label, of)
    if key in _KEPT:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_KEPT[key])
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return _KEPT[key]
    path = new_folder(spark, label)
    try:
        build(path)
    except BaseException:
        removed(spark, path)  # half a folder serves nobody, and the next caller builds a new one
        raise
    _KEPT[key] = path
    return path
