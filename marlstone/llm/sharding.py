"""Shards of near-equal bytes by sampled splitters, in DataFrame functions only.

Records are ordered by a hash of their text.  A size-weighted sample of keys (each
record has priority ``-ln(u) / size`` for a hash ``u``; priorities below a bound win) gives
the splitters of many ranges for each shard.  Ranges are then measured exactly and
overfull ones are subdivided by value, so no task sorts more than a small share.
Exact running sums over the ranges place every record on the byte line, which the
shards cut where their room ends.

Equal texts are a group and stay in one shard.  Groups too large for the line (half
a range or more; at most a few for each range) are placed first, largest first, each
whole in the emptiest shard; only one for which no shard has room is cut, at a
row, and one with very many rows is numbered in parts by a hash of id and row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _edges_below(key: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are at most the key: a two-level search in literals."""
    if not edges:
        return F.lit(0)
    step = max(1, math.isqrt(len(edges)))
    blocks = [edges[i : i + step] for i in range(0, len(edges), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda e: e <= key))
    block = below(longs([b[0] for b in blocks]))
    inside = below(F.element_at(F.array(*[longs(b) for b in blocks]), F.greatest(block, F.lit(1))))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)


def _literal_map(pairs: list[tuple[int, int]]) -> Column:
    return F.create_map(*[F.lit(int(x)) for p in pairs for x in p])


def _room(large: list, total: int, n_shards: int, slack: float) -> tuple[list[tuple[list[int], list[int]]], list[float]]:
    """For each large group (bytes, rows) its shards and the rows before each next one; the bytes that shards have."""
    share, fill, out = total / n_shards, [0.0] * n_shards, [([], [])] * len(large)
    for k in sorted(range(len(large)), key=lambda k: (-large[k][0], k)):
        size, left = large[k][0] / large[k][1], large[k][1]
        cuts: list[int] = []
        shards: list[int] = []
        while left:
            s = min(range(n_shards), key=lambda s: (fill[s], s))
            room = int((share * (1 + slack) - fill[s]) // size)
            take = left if room >= left else max(1, min(left, int((share - fill[s]) // size)))
            fill[s] += take * size
            left -= take
            if shards and shards[-1] == s:
                cuts.pop()
                shards.pop()
            shards.append(s)
            cuts.append(large[k][1] - left)
        out[k] = (shards, cuts[:-1])
    return out, fill


def shard(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_range: int = 100_000,
    samples_per_range: int = 16,
    most_ranges: int = 4096,
    slack: float = 0.01,
    seed: int = 42,
) -> DataFrame:
    """id, size, text_crc32, shard, slot for every row; sizes of shards are near equal.

    Size is UTF-8 bytes plus 1, so null and empty texts count 1 and are one group.
    Equal texts share a shard unless no shard has room for them (``slack`` beyond an
    equal share).  Slots are gapless from 0 in each shard.  Repeated rows are separate
    records; ties of id stand by row; a null id has a hash like any other.  A very
    long text is a group of its own.  Other columns are ignored; an empty table gives
    no rows.  The driver sees samples, range sums and large groups only, at most
    ``samples_per_range * most_ranges`` numbers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_k1"),
        F.xxhash64(key).alias("_k2"),
        F.monotonically_increasing_id().alias("_k3"),
    )
    rows = scratch.write(rows, "rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 1
    ranges = min(most_ranges, max(64 * n_shards, -(-n // rows_per_range)))
    # at most 4 * ranges groups can be so large
    groups = rows.groupBy("_k1").agg(F.sum("size").alias("b"), F.count("*").alias("c")).filter((F.col("b") >= total / (2 * ranges)) | (F.col("c") >= max(2, n / (2 * ranges))))
    large = [tuple(r) for r in groups.orderBy("_k1").collect()]
    placed, fill = _room([(b, c) for _, b, c in large], total, n_shards, slack)
    cells = [(k1, -1 - i, -(-c // rows_per_range), *placed[i]) for i, (k1, _, c) in enumerate(large)]
    known = spark.createDataFrame(cells, "_k1 long, _large int, _parts int, _shards array<int>, _cuts array<long>")
    rows = rows.join(F.broadcast(known), "_k1", "left")  # 4 * ranges rows at most
    unit = (F.pmod(F.xxhash64("_k1", "_k2", F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    # so many priorities are expected to stay below this, so the driver gets no best of every partition
    wanted = samples_per_range * ranges
    drawn = rows.filter("_large is null").select("_k1", (-F.ln(unit) / F.col("size")).alias("_priority")).filter(F.col("_priority") < F.lit(wanted / total))
    sample = sorted(r[0] for r in drawn.select("_k1").collect())
    edges = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    rows = rows.withColumn("_range", F.coalesce("_large", _edges_below(F.col("_k1"), edges)))
    measured = rows.filter("_large is null").groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("c"), F.min("_k1").alias("lo"), F.max("_k1").alias("hi")).collect()
    overfull = [r for r in measured if r["b"] > 2 * total / ranges or r["c"] > 2 * n / ranges]
    sub = F.lit(0)
    if overfull:
        cuts = [(r["_range"], math.ceil(max(r["b"] / total, r["c"] / n) * ranges)) for r in overfull]
        n_sub = F.element_at(_literal_map(cuts), F.col("_range"))
        lo = F.element_at(_literal_map([(r["_range"], r["lo"]) for r in overfull]), F.col("_range")).cast("double")
        hi = F.element_at(_literal_map([(r["_range"], r["hi"]) for r in overfull]), F.col("_range")).cast("double")
        part = (F.col("_k1").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0))
        sub = F.coalesce(F.least(F.floor(part * n_sub), n_sub - 1).cast("int"), F.lit(0))
    own = F.pmod(F.xxhash64("_k2", "_k3"), F.col("_parts")).cast("int")
    rows = rows.withColumn("_sub", F.when(F.col("_large").isNull(), sub).otherwise(own))
    # at most a few rows for each range; a large group's rows are numbered from its own first
    sums = rows.groupBy("_range", "_sub").agg(F.sum("size").alias("_b"), F.count("*").alias("_c"))
    line = Window.partitionBy(F.least(F.col("_range"), F.lit(0))).orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", "_sub", F.coalesce(F.sum("_b").over(line), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_c").over(line), F.lit(0)).alias("_c0"))
    inside = Window.partitionBy("_range", "_sub").orderBy("_k1", "_k2", "_k3")
    group = Window.partitionBy("_range", "_sub", "_k1")
    x = rows.select("*", F.row_number().over(inside).alias("_rn"), F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    x = x.select("*", F.sum("size").over(group).alias("_gb"), F.max("_upto").over(group).alias("_g1"))
    x = x.join(F.broadcast(starts), ["_range", "_sub"])
    # the line of small groups is cut where the shards' room ends; a group lies where its middle does
    room = [max(0.0, total / n_shards - f) for f in fill]
    scale = max(0.0, total - sum(b for _, b, _ in large)) / (sum(room) or 1.0)
    ends = [sum(room[: s + 1]) * scale for s in range(n_shards - 1)]
    last = max((s for s in range(n_shards) if room[s] > 0), default=n_shards - 1)
    passed = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e <= F.col("_b0") + F.col("_g1") - F.col("_gb") / 2)) if ends else F.lit(0)
    ordinal = F.col("_c0") + F.col("_rn") - 1
    of_large = F.element_at("_shards", F.size(F.filter("_cuts", lambda c: c <= ordinal)) + 1)
    x = x.withColumn("shard", F.when(F.col("_large").isNull(), F.least(passed, F.lit(last))).otherwise(of_large).cast("int"))
    x = x.select("*", F.row_number().over(Window.partitionBy("_range", "_sub", "shard").orderBy("_rn")).alias("_place"))
    x = scratch.write(x.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "_range", "_sub", "_place"), "placed")
    count = x.groupBy("shard", "_range", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    first = count.select("shard", "_range", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # a few rows for each range
    return x.join(F.broadcast(first), ["shard", "_range", "_sub"]).select(id_col, "size", "text_crc32", "shard", (F.col("_first") + F.col("_place") - 1).alias("slot"))
