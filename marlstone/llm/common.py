"""Shared helpers: intermediate tables, row keys, connected components."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where the session names no shared folder and runs in one process (local tests).
FALLBACK_DIR = "/tmp/checkpoints"
#: Rows and bytes of an Arrow batch at most, where whole texts go to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; raises where a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, so a task's memory follows the longest text and not the batch."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def lean(run):
    """A batch function that gives memory back when its task ends, since workers live on for other tasks."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return task


class Scratch:
    """Tables of one operator call in the shared folder.

    Writing a table cuts the lineage: when an executor is lost, later stages
    read the files again instead of repeating earlier work.  ``drop`` frees a
    table that nothing reads any more; what the returned DataFrame still reads
    stays until the caller removes ``path``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/marlstone-{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_position(docs: DataFrame, run: Callable[..., DataFrame], **roles: str) -> DataFrame:
    """What ``run`` keeps of the rows, with the input's columns, whatever their names.

    ``run`` gets the rows with columns c0, c1, ... and the new names of the columns in
    ``roles``, so names like internal ones, with dots or different only by case never meet
    its own.  It returns at least all these columns.
    """
    names = docs.columns
    exact = {r: c if c in names else next(n for n in names if n.lower() == c.lower()) for r, c in roles.items()}
    plain = [f"c{k}" for k in range(len(names))]
    out = run(docs.toDF(*plain), **{r: plain[names.index(c)] for r, c in exact.items()})
    return out.select(*plain).toDF(*names)


def exactly(docs: DataFrame, *names: str) -> DataFrame:
    """These columns alone, found by their exact names where others differ only by case."""
    have = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(have))])
    at = [have.index(n) if n in have else [c.lower() for c in have].index(n.lower()) for n in names]
    return plain.select(*[F.col(f"c{k}").alias(n) for k, n in zip(at, names, strict=True)])


def words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a row, 16 bytes: rows with equal id and text share it.

    Joins back to the input go by this key, so a row that is repeated, an id
    that two texts share and a null id all keep exactly their own rows.
    """
    parts = (F.col(id_col).cast("string"), F.col(text_col), F.isnull(id_col), F.isnull(text_col))
    half = lambda salt: F.lpad(F.hex(F.xxhash64(F.lit(salt), *parts)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(v, root): the smallest vertex that each vertex with an edge reaches.

    Alternating large-star and small-star rounds.  Each round groups by vertex
    with map-side minima, writes the minima and joins them back.  Written, they come
    to the join through an exchange of their own, so adaptive execution splits a
    vertex with very many neighbours.
    Raises when components still change after ``most_rounds``.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = scratch.write(now, "cc0")
    before, size = None, now.count()
    for n in range(1, most_rounds + 1):
        narrow = lambda x, parts=1 + size // 250_000: x.coalesce(parts)  # few files where there are few edges
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(narrow(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))), f"least{n}")
        # large star: each larger neighbour goes to the least of the neighbourhood
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.write(narrow(large), f"large{n}")
        # small star: smaller neighbours and the vertex itself go to the least smaller one
        low = scratch.write(narrow(large.groupBy("u").agg(F.min("v").alias("m"))), f"low{n}")
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = scratch.write(narrow(small.filter("u <> v").distinct()), f"cc{n}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for name in (f"cc{n - 1}", f"least{n}", f"large{n}", f"low{n}"):
            scratch.drop(name)
        if mark == before:
            break
        before, size = mark, mark[0]
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v").alias("root")).distinct())
