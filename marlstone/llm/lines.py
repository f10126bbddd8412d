"""Line dedup by overlapping three-line windows.

A line is what stands between line feeds; lines without a word do not count and
are neither hashed nor removed.  Every three consecutive counted lines form a
window, hashed to 128 bits with white space at line ends ignored.  A window's first
occurrence is the one of the least (doc_id, row key, place), null ids last; all
later ones mark their three lines, marks merge, and marked lines go.

Texts take part in two narrow passes and one join by row key.  The windows
travel as 40-byte rows with map-side minima, so a window that a third of all
documents share is one row for each task.  Both joins are merge joins at every size,
since what they bring in grows with the input; their smaller sides are written
first, so that adaptive execution can split a skewed partition.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_position, lean, row_key, small_batches

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def _counted(text: str) -> tuple[list[str], list[int]]:
    """All lines with their line feeds, and which of them hold a word."""
    parts = _LINE.findall(text)
    return parts, [i for i, x in enumerate(parts) if _WORD.search(x)]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """The input's columns with the text deduplicated, and n_lines, n_removed, n_runs.

    n_lines counts lines with a word, n_runs the maximal removed runs of such
    lines.  Removing a line takes its line feed along.  Null texts stay null with
    zero counts, as do empty ones; texts of fewer than ``window`` counted lines have
    no window and stay whole.  Rows that repeat both id and text are one document
    and both get its result.  Ties of ids stand by row key.  Result columns that clash replace the input's.
    An empty table gives no rows.  No text is cut short: a very long one is held
    whole by one task.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    small_batches(docs.sparkSession)
    keyed = docs.withColumn("_row", row_key(id_col, text_col))

    def windows(batches):
        import xxhash

        for batch in batches:
            rows, at, hi, lo = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                parts, counted = _counted(text)
                if len(counted) < window:
                    continue
                clean = [parts[k].strip(" \t\n\r\x0b\x0c") for k in counted]
                for k in range(len(clean) - window + 1):
                    h = xxhash.xxh3_128_intdigest("\n".join(clean[k : k + window]))
                    rows.append(i), at.append(k)
                    hi.append((h >> 64) - (1 << 63)), lo.append((h & ((1 << 64) - 1)) - (1 << 63))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int64()) for x in (at, hi, lo))], names=["_row", "_id", "_at", "_h1", "_h2"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = keyed.select("_row", F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(windows), f"_row binary, _id {kind}, _at long, _h1 long, _h2 long")
    found = scratch.write(found, "windows")
    # the row key stands in the order, so repeated rows are one occurrence
    place = F.struct(F.isnull("_id").alias("a"), F.col("_id").alias("b"), F.col("_row").alias("c"), F.col("_at").alias("d"))
    ends = found.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first <> _last")
    # written, it comes to the join through an exchange of its own, so a window that very many documents share is split
    ends = scratch.write(ends.select("_h1", "_h2", F.col("_first.c").alias("_c"), F.col("_first.d").alias("_d")), "ends")
    later = found.join(ends.hint("merge"), ["_h1", "_h2"]).filter("_row <> _c or _at <> _d")
    # of one document only: bounded by its own lines
    marks = later.groupBy("_row").agg(F.collect_set("_at").alias("_starts"))
    marks = scratch.write(marks, "marks")
    scratch.drop("windows")
    scratch.drop("ends")

    def cut(batches):
        for batch in batches:
            texts, lines, removed, runs = [], [], [], []
            for text, starts in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                parts, counted = _counted(text) if text else ([], [])
                gone = np.zeros(len(counted) + 1, bool)
                if starts.is_valid:
                    s = starts.values.to_numpy()
                    for k in range(window):
                        gone[s + k] = True
                out = {counted[k] for k in np.flatnonzero(gone[:-1])} if gone.any() else ()
                texts.append("".join(x for i, x in enumerate(parts) if i not in out) if out else text)
                lines.append(len(counted)), removed.append(len(out))
                runs.append(int(np.count_nonzero(gone[:-1] & ~np.r_[False, gone[:-2]])))
            arrays = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (lines, removed, runs))], names=[*batch.schema.names[:-2], "_text", "n_lines", "n_removed", "n_runs"])

    own = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed", "n_runs")]
    joined = keyed.join(marks.hint("merge"), "_row", "left").select(*own, F.col(text_col).alias("_text"), "_starts")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own), "_text string, n_lines long, n_removed long, n_runs long"])
    out = joined.mapInArrow(lean(cut), schema)
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(c) for c in [c for c in docs.columns if c in own or c == text_col]], "n_lines", "n_removed", "n_runs")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **how) -> DataFrame:
    """The input with its texts deduplicated and all its columns, whatever their names.

    Takes what ``dedup_lines`` takes and treats nulls, empty texts, repeats and ties alike.  ``length_col``
    gets the number of code points that are left, where there is such a column.
    """
    roles = {"id_col": id_col, "text_col": text_col} | ({"length_col": length_col} if length_col in docs.columns else {})

    def run(x: DataFrame, id_col: str, text_col: str, length_col: str | None = None) -> DataFrame:
        out = dedup_lines(x, id_col, text_col, **how)
        if length_col:
            out = out.withColumn(length_col, F.coalesce(F.length(text_col), F.lit(0)).cast(x.schema[length_col].dataType))
        return out

    return by_position(docs, run, **roles)
