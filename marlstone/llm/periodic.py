"""Periodic runs of words by a harmonic grid.

A run is a stretch of words with smallest period q that holds at least two periods
and ``min_length`` words and that no neighbouring word extends.  Such a stretch
holds the grid points k*q and (k+1)*q for some k, so the pairs (p, k*p) over all
periods p, n ln n of them for n words, find every run.  NumPy prefix hashes give
the longest common extensions of all pairs to both sides in one binary search;
a pair whose own words differ has none and leaves at once.  Words then confirm
what the hashes said, and pairs that found the same stretch become one run of the
least period.

The work is per document and narrow.  Pairs are handled in blocks, so memory
follows the longest text and not its number of pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lean, small_batches

_WORD = re.compile(WORD)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Pairs in one block.
BLOCK = 1 << 18
#: Runs of so many words spare the pairs of their multiple periods a search.
LONG = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)


def prefix_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of mixed ids times powers of an odd base modulo 2^64 before each place, and the powers."""
    power = np.ones(len(ids) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(ids), _BASE), out=power[1:])
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mixed * power[:-1], out=sums[1:])
    return sums, power


def grid(n: int, first: int, block: int = BLOCK):
    """(period, grid point) pairs with point + period < n in blocks, periods from ``first`` to half of n."""
    p = first
    while p <= n // 2:
        # so many periods that their pairs fill a block
        size, q = 0, p
        counts = []
        while q <= n // 2 and (not counts or size < block):
            step = min(n // 2, q + 1023)
            c = -(-(n - np.arange(q, step + 1)) // np.arange(q, step + 1))
            fits = max(1 if not counts else 0, int(np.searchsorted(np.cumsum(c) + size, block, side="right")))
            if not fits:
                break
            counts.append(c[:fits])
            size += int(c[:fits].sum())
            q += min(fits, len(c))
            if fits < len(c):
                break
        c = np.concatenate(counts)
        period = np.repeat(np.arange(p, q), c)
        yield period, (np.arange(size) - np.repeat(np.cumsum(c) - c, c)) * period
        p = q


def extensions(sums: np.ndarray, power: np.ndarray, a: np.ndarray, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs (a, a + p): equal words from there on, and equal words just before."""
    shift = power[p]

    def same(lo, hi):
        return (sums[hi] - sums[lo]) * shift == sums[hi + p] - sums[lo + p]

    def search(most, bounds):
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (going := low < high).any():
            mid = (low + high + 1) >> 1
            good = same(*bounds(mid)) & going
            low = np.where(good, mid, low)
            high = np.where(good | ~going, high, mid - 1)
        return low

    return search(n - p - a, lambda m: (a, a + m)), search(a, lambda m: (a - m, a))


def find_runs(ids: np.ndarray, min_length: int = 12) -> np.ndarray:
    """start, length, period of every run, by start and then period."""
    n = len(ids)
    if n < max(2, min_length):
        return np.zeros((0, 3), np.int64)
    sums, power = prefix_hashes(ids)
    found, known = [np.zeros((0, 3), np.int64)], {}
    for p, a in grid(n, 1):
        look = ids[a] == ids[a + p]
        for (s, e), q in known.items():
            look &= (a < s) | (a + p >= e) | (p % q != 0)
        p, a = p[look], a[look]
        if not len(p):
            continue
        ahead, behind = extensions(sums, power, a, p, n)
        start, end = a - behind, a + p + ahead
        keep = end - start >= np.maximum(min_length, 2 * p)
        got = np.unique(np.stack([start[keep], end[keep], p[keep]], 1), axis=0)
        found.append(got)
        # inside a run of period q, multiples of q find the same stretch again: such pairs need no search
        for s, e, q in got[got[:, 1] - got[:, 0] >= LONG].tolist():
            if (s, e) not in known and np.array_equal(ids[s : e - q], ids[s + q : e]):
                known[s, e] = q
    got = np.concatenate(found)
    return confirmed(ids, got, min_length)


def confirmed(ids: np.ndarray, got: np.ndarray, min_length: int) -> np.ndarray:
    """Runs whose words were compared; of the same stretch the one of the least period.

    Hashes can only make a stretch too long.  One that fails is replaced by what
    the words themselves give for its period inside it.
    """
    n, good = len(ids), []
    for s, e, p in got.tolist():
        same = ids[s : e - p] == ids[s + p : e]
        if same.all():
            good.append((s, e, p))
            continue
        wall = np.concatenate([[-1], np.flatnonzero(ids[: n - p] != ids[p:]), [n - p]])
        good += [(int(x) + 1, int(y) + p, p) for x, y in zip(wall[:-1], wall[1:], strict=True) if y - x - 1 + p >= max(min_length, 2 * p)]
    if not good:
        return np.zeros((0, 3), np.int64)
    x = np.unique(np.array(good, np.int64), axis=0)  # by start, end, period
    first = np.r_[True, (x[1:, :2] != x[:-1, :2]).any(1)]
    x = x[first]
    x = np.stack([x[:, 0], x[:, 1] - x[:, 0], x[:, 2]], 1)
    return x[np.lexsort((x[:, 2], x[:, 0]))]


def collapse(words: list[str], runs: np.ndarray) -> list[str]:
    """The words without those that a run contains after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 12,
    prepare: Callable[[object, list[str]], list[str]] | None = None,
) -> DataFrame:
    """id, n_words, runs (array of start, length, period in words) and collapsed text of every row.

    ``prepare`` may change a row's words, given its id, before the search.  Runs stand
    by start, then period.  Null, empty and blank texts have no words, no runs and an
    empty collapsed text.  Repeated rows, shared and null ids keep their own rows; other
    columns are ignored; an empty table gives no rows.  A very long text is searched
    whole by one task.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def search(batches):
        for batch in batches:
            counts, runs, ends, kept = [], [], [0], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text) if text else []
                words = prepare(key, words) if prepare else words
                number: dict[str, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                got = find_runs(ids, min_length)
                counts.append(len(words))
                runs.append(got)
                ends.append(ends[-1] + len(got))
                kept.append(" ".join(collapse(words, got)))
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            values = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(kept, pa.string())], names=["_id", "n_words", "runs", "collapsed"])

    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return plain.mapInArrow(lean(search), f"_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("_id", id_col)
