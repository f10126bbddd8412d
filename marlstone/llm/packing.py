"""Best-fit packing of token pieces into fixed-length sequences.

Hierarchical residual packing.  Every partition packs its own pieces best-fit
decreasing.  Bins that are nearly full are final, and so are bins that do not fit with
the least of the others; the rest become items of the next round, where ``fan_in``
partitions' worth meet in one.  A bin that is far from full is taken apart again first, so the
next round can fit its parts one by one.  Only (bin, fill) pairs travel between rounds, and
every task of every round holds some ``items_per_partition`` of them: rounds end when
one partition is left, or with one round more after one that saved less than
``least_saving`` of all sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, exactly, lean, small_batches

_PIECES = "{id} {kind}, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the fill of each bin: best-fit decreasing.

    Every item goes to the open bin whose free space exceeds it least; ties go
    to the bin that got there last.  Free spaces are kept as the bits of an
    integer, so one item costs a few machine operations.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = open_at[free].pop()
            if not open_at[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if free > n:
            open_at[free - n].append(b)
            mask |= 1 << (free - n)
    return bins, offsets, np.array(fills, np.int64)


def apart(sizes: np.ndarray, bins: np.ndarray, offsets: np.ndarray, fills: np.ndarray, below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and fill of each item after bins filled below ``below`` gave every item a bin of its own."""
    fill = fills[bins] if len(fills) else sizes
    alone = fill < below
    return np.where(alone, len(fills) + np.cumsum(alone) - 1, bins), np.where(alone, 0, offsets), np.where(alone, sizes, fill)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str | None, end_id: int) -> DataFrame:
    """Pieces of each document's ids and the end id: the first one may be shorter, the others are full."""
    small_batches(docs.sparkSession)
    path = tokenizer or tokens.default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        enc = tokens.encoder(path)
        for batch in batches:
            ids_of, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = enc.ids(text) if text else tokens.array("I")
                ids.append(end_id)
                raw, n = memoryview(ids).cast("B"), len(ids)
                a, p = 0, 0
                while a < n:
                    b = a + ((n % capacity or capacity) if p == 0 else capacity)
                    ids_of.append(i), piece.append(p), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    a, p = b, p + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids_of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_id", "piece", "start", "length", "ids_crc32"],
            )
        del enc
        tokens.forget()

    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return plain.mapInArrow(lean(cut), _PIECES.format(id="_id", kind=kind))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    tokenizer: str | None = None,
    end_id: int = 2,
    nearly_full: float = 0.995,
    take_apart: float = 0.9,
    items_per_partition: int = 400_000,
    fan_in: int = 16,
    least_saving: float = 0.001,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts hold the end id alone.  Repeated rows are packed as
    often as they occur; a null id stays null.  Pieces of equal length go in any
    order.  A very long text is encoded whole by one task and cut into full pieces.
    Other columns are ignored.  An empty table gives an empty result.  Sequences are
    gapless from offset 0.
    """
    spark, docs = docs.sparkSession, exactly(docs, id_col, text_col)
    scratch = Scratch(spark, "pack")
    pieces = scratch.write(token_pieces(docs, id_col, text_col, capacity, tokenizer, end_id), "pieces")
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    full = full.select("_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    loose = pieces.filter(F.col("length") < capacity)
    parts = max(1, -(-loose.count() // items_per_partition))

    def first(batches):
        import pandas as pd
        from pyspark import TaskContext

        frames = list(batches)
        if not frames:
            return
        x = pd.concat(frames, ignore_index=True)
        sizes = x["length"].to_numpy()
        got = best_fit(sizes, capacity)
        bins, offsets, fill = apart(sizes, *got, capacity * take_apart)
        base = TaskContext.get().partitionId() << 36
        yield x.assign(bin=base + bins, at=offsets, fill=fill, share=len(got[2]) / len(x))

    kind = docs.schema[id_col].dataType.simpleString()
    # dealt by the row's own hash, so a partition holds about items_per_partition
    packed = loose.repartition(parts, "ids_crc32", "length", "start", "_id").mapInPandas(first, _PIECES.format(id="_id", kind=kind) + ", bin long, at long, fill long, share double")
    packed = scratch.write(packed, "packed")
    least = int(capacity * nearly_full)
    # where each open bin of a round goes: (bin, into, shift)
    moves, k, final = [], 0, False
    bins = scratch.write(packed.groupBy("bin").agg(F.first("fill").alias("fill"), F.sum("share").alias("share")), "bins0")
    closed, now = 0, bins.agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0]
    while True:
        open_bins = bins.filter(F.col("fill") < least).select("bin", "fill")
        n, low = open_bins.agg(F.count("*"), F.min("fill")).first()
        # a bin fits with no other if it does not fit with the least
        fits = open_bins.filter(F.col("fill") <= capacity - (low or 0))
        m = fits.count() if n else 0
        if m < 2:
            break
        k += 1
        parts = max(1, -(-parts // fan_in), -(-m // items_per_partition))
        final = final or parts == 1
        closed += bins.count() - m

        def merge(batches, k=k, below=0 if final else capacity * take_apart):
            import pandas as pd
            from pyspark import TaskContext

            frames = list(batches)
            if not frames:
                return
            x = pd.concat(frames, ignore_index=True).sort_values("bin", ignore_index=True)
            sizes = x["fill"].to_numpy()
            got = best_fit(sizes, capacity)
            into, offsets, fill = apart(sizes, *got, below)
            base = (k << 56) + (TaskContext.get().partitionId() << 36)
            yield pd.DataFrame({"bin": x["bin"], "into": base + into, "shift": offsets, "fill": fill, "share": len(got[2]) / len(x)})

        # dealt by another hash in each round, so bins meet others than before
        dealt = fits.repartition(parts, F.xxhash64("bin", F.lit(k))) if parts > 1 else fits.coalesce(1)
        moves.append(scratch.write(dealt.mapInPandas(merge, "bin long, into long, shift long, fill long, share double"), f"moves{k}"))
        if final:
            break
        bins = scratch.write(moves[-1].groupBy(F.col("into").alias("bin")).agg(F.first("fill").alias("fill"), F.sum("share").alias("share")), f"bins{k}")
        # sequences if all stayed as this round packed them; when that saves nothing, one round more puts what was taken apart together
        before, now = now, closed + bins.agg(F.sum("share")).first()[0]
        final = now > before * (1 - least_saving)
    out = packed.select("_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    if moves:
        # the rounds' moves are joined with each other first, so the pieces are joined once
        ways = moves[0].select("bin", "into", "shift")
        for m in moves[1:]:
            onward = m.select(F.col("bin").alias("into"), F.col("into").alias("_next"), F.col("shift").alias("_more"))
            ways = ways.join(onward, "into", "left").select("bin", F.coalesce("_next", "into").alias("into"), (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift"))
        out = out.join(ways.withColumnRenamed("bin", "sequence_id"), "sequence_id", "left").select(
            "_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
    return out.union(full).withColumnRenamed("_id", id_col)
