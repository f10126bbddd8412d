"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Documents of a source stand in one line, shortest first.  Each stands for
``target / source_size`` expected copies; the running sum of these, shifted by one
random offset for the source, emits a document once for each integer that it
crosses.  As the line is sorted by size, what a source takes differs from its
target by little more than one long document.

The running sum is the rank times a constant, so it needs ranks only.  A rank
is the sum of three bounded parts: documents of smaller sizes (a window over one
row per size), documents in earlier hash buckets of the same size (a window over
at most 256 rows, or 65,536 of rows without an id), and the place within the
bucket.  No window holds a source.  Cells of size and bucket are written, so texts are
counted twice: for the cells, and where a row gets its place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_position, words


def _name(source: Column) -> Column:
    """A key that is never null: null sorts after every name."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), source))


def targets(sizes: DataFrame, weights: Sequence[float] | Mapping[str, float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size).

    Sources by code point, null last, weigh ``weights`` in turn (or by name, 0 if
    absent) and share the sum of all sizes.  A target stops at ``most`` times its
    source's size and the excess is shared again by weight until none is above.
    In order of ``cap / weight`` a source is capped as long as the level left for
    it and those after it is no lower than its own.  One row per source.
    """
    line = Window.orderBy("_src")
    if isinstance(weights, Mapping):
        by_name = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("=" + k, float(v))])
        w = F.coalesce(F.element_at(by_name, F.col("_src")), F.lit(0.0))
    else:
        turn = F.array(*[F.lit(float(x)) for x in weights])
        w = F.element_at(turn, ((F.row_number().over(line) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = Window.orderBy(F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(F.lit(float("inf"))), "_src")
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    x = x.select(
        "*",
        F.row_number().over(level).alias("_at"),
        (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_left"),
        F.sum("_w").over(after).alias("_rest"),
    )
    x = x.withColumn("_lam", F.when(F.col("_rest") > 0, F.col("_left") / F.col("_rest")).otherwise(F.lit(0.0)))
    x = x.withColumn("_capped", (F.col("_w") > 0) & (F.col("_lam") * F.col("_w") >= F.col("_cap")))
    lam = F.min(F.when(~F.col("_capped"), F.struct("_at", "_lam"))).over(every)["_lam"]
    return x.select("_src", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.coalesce(lam, F.lit(0.0)) * F.col("_w")).alias("target"))


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] | Mapping[str, float] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 42,
) -> DataFrame:
    """The input's columns and _size, source_size, target, copies for every row.

    Null texts have size 0; a source without words has target 0 and no copies.
    Ties of size stand by a hash of their id, then by id, then by a hash of the text
    (rows without an id by longer hashes of the text), so reruns agree; rows that
    repeat id and text are separate items, any of which is as good as another.  A
    null source is a source of its own.  A very long text is one item, which may
    pass its source's target by its own size.  Internal names begin with ``_``.  An
    empty table gives no rows.
    """
    x = docs.withColumns({"_src": _name(F.col(source_col)), "_size": words(F.col(text_col)), "_text_hash": F.xxhash64(text_col)})
    by_text = F.substring(F.md5(F.col("_text_hash").cast("string")), 1, 4)
    x = x.withColumn("_bucket", F.when(F.col(id_col).isNull(), by_text).otherwise(F.substring(F.md5(F.col(id_col).cast("string")), 1, 2)))
    cells = x.groupBy("_src", "_size", "_bucket").agg(F.count("*").alias("_n"))
    cells = Scratch(docs.sparkSession, "mix").write(cells, "cells")
    by_size = cells.groupBy("_src", "_size").agg(F.sum("_n").alias("_n"))
    smaller = by_size.select("_src", "_size", F.coalesce(F.sum("_n").over(Window.partitionBy("_src").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_smaller"))
    earlier = cells.select("_src", "_size", "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy("_src", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    share = targets(by_size.groupBy("_src").agg(F.sum(F.col("_n") * F.col("_size")).alias("source_size")), weights, most)
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_src"))), 1, 4), 16, 10).cast("double") / 65536.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    starts = earlier.join(smaller, ["_src", "_size"]).join(share, "_src").select("_src", "_size", "_bucket", (F.col("_smaller") + F.col("_earlier")).alias("_start"), "source_size", "target", rate.alias("_rate"), offset.alias("_offset"))
    clash = [c for c in ("source_size", "target", "copies") if c in docs.columns]
    x = x.drop(*clash).join(starts, ["_src", "_size", "_bucket"])
    place = F.row_number().over(Window.partitionBy("_src", "_size", "_bucket").orderBy(id_col, "_text_hash")).cast("long")
    rank = F.col("_start") + F.col("_place")
    passed = lambda r: F.floor(F.col("_offset") + F.col("_rate") * r)
    x = x.withColumn("_place", place).withColumn("copies", (passed(rank) - passed(rank - 1)).cast("int"))
    return x.drop("_src", "_bucket", "_text_hash", "_start", "_place", "_rate", "_offset")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed rows with the input's columns, whatever their names: each document as often as it is taken.

    Takes what ``plan`` takes.
    """

    def run(x: DataFrame, **roles: str) -> DataFrame:
        return plan(x, **roles, **how).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    return by_position(docs, run, id_col=id_col, text_col=text_col, source_col=source_col)
