"""Suffix-array dedup of repeated byte strings across all texts.

Every byte that lies in a string of ``length`` bytes which also starts anywhere
else is removed.

Sharding.  Equal strings must meet in one task.  Of the k-grams inside a string
(k is a third of its length) the one of least hash (leftmost if equal) is its anchor, so equal strings have equal
anchors at equal offsets.  The starts that share an anchor occurrence form a run, and
a run's bytes are an item: every start of a document lies in exactly one item, an
item's full-length strings are those of its own starts, and two equal strings always
lie in items of the same anchor hash.  Anchors seen once are set aside; equal
items are one item with a weight.

Detection.  A task concatenates its items, sorts their suffixes to the needed
depth, forms the Burrows-Wheeler transform and expands intervals breadth-first: from
the intervals of strings of l characters, one backward extension gives those of
l + 1, and each sets the common-prefix entry at its right end to l unless that entry
is set, in which case it is not expanded.  Entries thus appear by increasing value;
after ``length`` levels the expansion stops, and what is unset is at least
``length``.  Runs of unset entries whose items' weights sum to two or more are the
repeats.

A transform takes the items of whole anchors, about ``transform_bytes`` of them.  An
anchor whose different items have more than ``group_bytes`` (a frequent phrase in ever
new surroundings) is subdivided: its items are texts themselves, so other hashes give
their strings a second anchor, and equal strings agree in both.  This goes on until
all fits; strings that share ``most_levels`` anchors are transformed together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, row_key, small_batches

_GRAM = 32  # at least
_SEP = 0xFF  # never a byte of UTF-8, and larger than all of them
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WIDE = 2048  # rows from which on an interval's characters are found by rank instead of one by one
_CHUNK = 1 << 21  # bytes of texts that are hashed together
_PLACES = 1 << 24  # places that the low bits of a hash can tell apart


def gram_hashes(data: np.ndarray, gram: int = _GRAM, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes at every place: differences of a running polynomial; each salt orders grams anew."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    down = np.full(len(data), _INVERSE)
    down[0] = 1
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * np.cumprod(down), out=run[1:])
    up = np.full(n, _ODD)
    up[0] = 1
    h = (run[gram:] - run[:n]) * np.cumprod(up)
    h += np.uint64(salt) * _ODD
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int = _GRAM, salt: int = 0) -> tuple[np.ndarray, ...]:
    """(place of the anchor, its hash, first start, last start) of every run of starts.

    ``data`` holds texts one after the other that end at ``ends``.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    w = length - gram + 1
    h = gram_hashes(data, gram, salt)
    if len(h) < w:
        return none
    low = np.uint64(_PLACES - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, ~np.uint64(0))
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(grid, axis=1).ravel()
    n = len(key) - w + 1
    at = (np.minimum(left[:n], right[w - 1 : w - 1 + n]) & low).astype(np.int64)
    valid = np.ones(n, bool)
    for e in ends.tolist():
        valid[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none
    at = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(starts) - 1]
    return at[first], h[at[first]], starts[first], starts[last]


_PLACE = 21  # bits of a place that can travel inside a key


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the keys, and the keys in it.

    Up to two million keys of 42 bits carry their place in the low bits and are sorted
    as plain integers, several times faster than sorting places by key.
    """
    if len(key) >> _PLACE:
        by = np.argsort(key)
        return by, key[by]
    packed = (key << _PLACE) | np.arange(len(key))
    packed.sort()
    return packed & ((1 << _PLACE) - 1), packed >> _PLACE


def suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes (at least), by doubling from five; only ties are sorted again."""
    n = len(data)
    bits = 32 if n >> _PLACE else _PLACE
    padded = np.full(n + 4, _SEP, np.int64)
    padded[:n] = data
    first = padded[:n].copy()
    for k in range(1, 5):
        first <<= 8
        first |= padded[k : n + k]
    order, first = _sorted(first)
    order = order.astype(np.int32)
    fresh = np.r_[True, first[1:] != first[:-1]]
    del padded, first
    place = np.arange(n, dtype=np.int32)
    rank = np.full(n + 1, n, np.int32)  # past the end: after everything
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True])).astype(np.int32)
    h = 5
    while h < depth and len(tied):
        suffix = order[tied]
        pair = (rank[suffix].astype(np.int64) << bits) | rank[np.minimum(suffix + h, n)]
        by, pair = _sorted(pair)
        suffix = suffix[by]
        new = np.r_[True, pair[1:] != pair[:-1]]
        order[tied] = suffix
        rank[suffix] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


def _first_levels(data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefixes of neighbours in the order, up to 8 bytes, and whether 8 bytes from each suffix on hold no separator."""
    n = len(data)
    padded = np.full(n + 8, _SEP, np.uint8)
    padded[:n] = data
    same, clean = np.zeros(n, np.int8), np.ones(n, bool)
    at, before = order.astype(np.int64), np.r_[order[:1], order[:-1]].astype(np.int64)
    alive = np.ones(n, bool)
    alive[0] = False
    for k in range(8):
        mine = padded[at + k]
        clean &= mine != _SEP
        alive &= mine == padded[before + k]
        same += alive
    return same, clean


def common_prefix_below(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the order, whether the suffix there and the one before share fewer than ``depth`` bytes.

    Breadth-first backward extension on the Burrows-Wheeler transform.  The sort
    compares eight bytes at a time, so the entries below 8 are read off its keys and
    the expansion begins with the intervals of strings of eight bytes.
    """
    n = len(data)
    bwt = np.where(order > 0, data[order - 1], _SEP).astype(np.uint8)
    by_char = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int32)  # from a row to the row of the suffix one longer
    step[by_char] = np.arange(n, dtype=np.int32)
    count = np.bincount(bwt, minlength=256)
    start = np.cumsum(count) - count
    chars = [c for c in np.flatnonzero(count).tolist() if c != _SEP]
    places = {c: by_char[start[c] : start[c] + count[c]] for c in chars}
    base = {c: int(start[c]) for c in chars}
    same, clean = _first_levels(data, order)
    known = np.ones(n + 1, bool)
    known[:n] = same < 8
    # intervals of eight bytes whose right end was found last, at 7; the others were not expanded
    begin = np.flatnonzero(known[:n]).astype(np.int32)
    end = np.r_[begin[1:], n].astype(np.int32)
    at_end = np.full(n + 1, -1, np.int8)
    at_end[:n] = same
    keep = clean[begin] & (at_end[end] == 7)
    lo, hi = begin[keep], end[keep] - 1
    del same, clean, begin, end, at_end
    for _ in range(8, depth):
        if not len(lo):
            break
        width = hi - lo
        found_lo, found_hi = [], []
        one = lo[width == 0]
        one = step[one[bwt[one] != _SEP]]
        found_lo.append(one), found_hi.append(one)
        two = lo[width == 1]
        c, d = bwt[two], bwt[two + 1]
        pair = step[two[(c == d) & (c != _SEP)]]
        left, right = step[two[(c != d) & (c != _SEP)]], step[two[(c != d) & (d != _SEP)] + 1]
        found_lo += [pair, left, right]
        found_hi += [pair + 1, left, right]
        few = np.flatnonzero((width > 1) & (width < _WIDE))
        for a in range(0, len(few), 1 << 16):
            some = few[a : a + (1 << 16)]
            w = width[some] + 1
            owner = np.repeat(np.arange(len(some)), w)
            row = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w) + lo[some][owner]
            c = bwt[row]
            keep = c != _SEP
            key = (owner[keep] << 8) | c[keep]
            by = np.argsort(key)
            key, row = key[by], row[keep][by]
            if len(key):
                # rows of an interval with the same character go to neighbouring rows
                head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                first = np.minimum.reduceat(step[row], head)
                found_lo.append(first), found_hi.append(first + np.diff(np.r_[head, len(key)]).astype(np.int32) - 1)
        wide = width >= _WIDE
        if wide.any():
            l, r = lo[wide], hi[wide]
            for c in chars:
                i, j = np.searchsorted(places[c], l), np.searchsorted(places[c], r, side="right")
                some = j > i
                found_lo.append((base[c] + i[some]).astype(np.int32)), found_hi.append((base[c] + j[some] - 1).astype(np.int32))
        lo, hi = np.concatenate(found_lo), np.concatenate(found_hi)
        fresh = ~known[hi + 1]
        lo, hi = lo[fresh], hi[fresh]
        known[hi + 1] = True
    return known[:n]


def repeated_starts(items: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each item, which of its starts open a string whose occurrences weigh two or more."""
    sep = bytes([_SEP])
    data = np.frombuffer(sep.join(items) + sep, np.uint8)
    sizes = np.array([len(x) for x in items])
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    order = suffixes(data, length)
    below = common_prefix_below(data, order, length)
    owner = np.repeat(np.arange(len(items)), sizes + 1)
    full = np.arange(len(data)) - begin[owner] <= sizes[owner] - length
    weight = np.where(full, np.asarray(weights)[owner], 0)
    group = np.cumsum(below) - 1
    total = np.bincount(group, weight[order])
    repeated = np.zeros(len(data), bool)
    repeated[order] = total[group] >= 2
    repeated &= full
    return [repeated[b : b + s - length + 1] for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _ranges(flags: np.ndarray) -> list[int]:
    """First and last of every run, one after the other."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    edge[1::2] -= 1
    return edge.tolist()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, group_bytes: int = 4_000_000, transform_bytes: int = 1_000_000, most_levels: int = 8) -> DataFrame:
    """The input's id and n_bytes, n_removed, n_spans, spans, kept, n_shared of every row.

    spans are (start, end) of the maximal removed runs in UTF-8 bytes, kept the
    remaining bytes.  n_shared counts the anchors, strings of a third of ``length``, that
    also occur elsewhere: what repeats but is too short to be removed mostly shows there.  Matches never cross documents; a string that overlaps its
    other occurrence counts; all is judged on the input.  Null texts count as empty.
    Texts shorter than ``length`` stay whole.  Every row is a document of its own: rows
    that repeat a text, with the same id or without one, repeat its strings.  Ties do
    not matter, as all occurrences go.  A text of 16 MB or more is looked at in
    overlapping parts; it is held whole by one task.  Other columns are ignored; an
    empty table gives no rows.
    """
    import xxhash

    if length < _GRAM:
        raise ValueError(f"length must be at least {_GRAM}")
    gram = max(_GRAM, length // 3)  # long enough that little is lifted that shares an anchor only
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(row_key(id_col, text_col).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def cut(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                raws, size, b = [], 0, a
                while b < len(texts) and (not raws or size + 4 * len(texts[b] or "") < _CHUNK):
                    raws.append((texts[b] or "").encode())
                    size += len(raws[-1])
                    b += 1
                yield chunk(keys.slice(a, b - a), raws)
                a = b

    def chunk(keys, raws):
        doc, hashes, item, start, runs = [], [], [], [], []
        ends = np.cumsum([len(r) for r in raws])
        joined = b"".join(raws)
        # a text beyond what 24 bits can place is cut into overlapping parts
        parts = [(0, ends, joined)] if len(joined) < _PLACES else _parts(ends, joined, length)
        for shift, e, raw in parts:
            at, h, first, last = anchors(np.frombuffer(raw, np.uint8), e, length, gram)
            d = np.searchsorted(ends, first + shift, side="right")
            begin = np.r_[0, ends[:-1]][d] if len(d) else d
            doc.append(d), hashes.append(h.astype(np.int64)), start.append(first + shift - begin), runs.append(last - first + 1)
            item += [xxhash.xxh3_64_intdigest(raw[f : la + length], q - f) - (1 << 63) for q, f, la in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(np.concatenate(doc), pa.int64())), pa.array(np.concatenate(hashes), pa.int64()), pa.array(item, pa.int64()), pa.array(np.concatenate(start), pa.int64()), pa.array(np.concatenate(runs), pa.int32())],
            names=["_row", "_h", "_item", "_start", "_runs"],
        )

    found = scratch.write(plain.select("_row", "_text").mapInArrow(lean(cut), "_row binary, _h long, _item long, _start long, _runs int"), "anchors")
    several = found.groupBy("_h").agg(F.count("*").alias("c")).filter("c > 1").select("_h")
    # written, it comes to the join through an exchange of its own, so adaptive execution can split an anchor in very many documents
    several = scratch.write(several, "several")
    shared = scratch.write(found.join(several.hint("merge"), "_h", "left_semi"), "shared")
    scratch.drop("anchors")
    scratch.drop("several")
    items = scratch.write(shared.groupBy("_h", "_item").agg(F.count("*").alias("_n"), F.min(F.struct("_row", "_start", "_runs")).alias("_at")), "items")
    # one list for each document: bounded by its own length
    asked = items.groupBy(F.col("_at._row").alias("_row")).agg(F.collect_list(F.struct("_h", "_item", "_n", F.col("_at._start").alias("_start"), F.col("_at._runs").alias("_runs"))).alias("_asked"))

    def lift(batches):
        for batch in batches:
            out = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for x in asked:
                    out.append((x["_h"], x["_item"], x["_n"], raw[x["_start"] : x["_start"] + x["_runs"] - 1 + length]))
                    if len(out) >= 4096:
                        yield _table(out)
                        out = []
            if out:
                yield _table(out)

    def _table(out):
        h, i, n, raw = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["_h", "_item", "_n", "_bytes"])

    lifted = plain.select("_row", "_text").join(asked.hint("merge"), "_row").dropDuplicates(["_row"]).select("_text", "_asked").mapInArrow(lean(lift), "_h long, _item long, _n long, _bytes binary")
    lifted = scratch.write(lifted, "lifted")

    def expand(batches):
        h, item, n, raw = [], [], [], []
        held = 0

        def flush():
            flags = repeated_starts(raw, np.array(n), length)
            got = [_ranges(f) for f in flags]
            keep = [k for k, g in enumerate(got) if g]
            return pa.RecordBatch.from_arrays([pa.array([h[k] for k in keep], pa.int64()), pa.array([item[k] for k in keep], pa.int64()), pa.array([got[k] for k in keep], pa.list_(pa.int32()))], names=["_h", "_item", "_ranges"])

        # rows come sorted by anchor; an anchor's items stay together
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if h and a != h[-1] and held > transform_bytes:
                    yield flush()
                    h, item, n, raw, held = [], [], [], [], 0
                h.append(a), item.append(b), n.append(c), raw.append(d)
                held += len(d) + 1
        if raw:
            yield flush()

    def subdivide(batches, level):
        """Items of an anchor as texts with anchors of their own."""
        for batch in batches:
            out = []
            for h, i, n, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                at, found, first, last = anchors(np.frombuffer(raw, np.uint8), np.array([len(raw)]), length, gram, level)
                for q, x, f, la in zip(at.tolist(), found.tolist(), first.tolist(), last.tolist(), strict=True):
                    piece = raw[f : la + length]
                    both = xxhash.xxh3_64_intdigest(x.to_bytes(8, "little"), h & ((1 << 64) - 1)) - (1 << 63)
                    out.append((h, i, f, both, xxhash.xxh3_64_intdigest(piece, q - f) - (1 << 63), n, piece))
                if len(out) >= 4096:
                    yield _divided(out)
                    out = []
            if out:
                yield _divided(out)

    def _divided(out):
        columns = zip(*out, strict=True)
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_h0", "_item0", "_shift", "_h", "_item", "_n", "_bytes"])

    def settled(items: DataFrame, level: int) -> DataFrame:
        """(_h, _item, _ranges) of different items, whose weights are known."""
        load = scratch.write(items.groupBy("_h").agg(F.sum(F.length("_bytes") + 1).alias("_s")), f"load{level}")
        crowd = load.filter(F.col("_s") > group_bytes).select("_h")
        hot = level < most_levels and not crowd.isEmpty()
        cool = items.join(load.filter(F.col("_s") <= group_bytes).select("_h").hint("merge"), "_h", "left_semi") if hot else items
        size = load.filter(F.col("_s") <= group_bytes if hot else F.lit(True)).agg(F.sum("_s")).first()[0]
        tasks = max(1, -(-(size or 0) // (8 * transform_bytes)))
        done = cool.select("_h", "_item", "_n", "_bytes").repartition(tasks, "_h").sortWithinPartitions("_h", "_item").mapInArrow(lean(expand), "_h long, _item long, _ranges array<int>")
        done = scratch.write(done, f"ranges{level}")
        if not hot:
            return done
        crowded = items.join(crowd.hint("merge"), "_h", "left_semi").select("_h", "_item", "_n", "_bytes")
        parts = scratch.write(crowded.mapInArrow(lean(lambda batches: subdivide(batches, level + 1)), "_h0 long, _item0 long, _shift long, _h long, _item long, _n long, _bytes binary"), f"parts{level}")
        # a second anchor that occurs once has no repeated string; equal parts are one with the sum of their weights
        often = scratch.write(parts.groupBy("_h").agg(F.sum("_n").alias("c")).filter("c > 1").select("_h"), f"often{level}")
        parts = parts.join(often.hint("merge"), "_h", "left_semi")
        one = scratch.write(parts.groupBy("_h", "_item").agg(F.sum("_n").alias("_n"), F.min("_bytes").alias("_bytes")), f"divided{level}")
        found = settled(one, level + 1)
        places = parts.select("_h0", "_item0", "_shift", "_h", "_item").join(found.hint("merge"), ["_h", "_item"])
        moved = places.select(F.col("_h0").alias("_h"), F.col("_item0").alias("_item"), F.transform("_ranges", lambda r: (r + F.col("_shift")).cast("int")).alias("_ranges"))
        return done.unionByName(scratch.write(moved, f"moved{level}"))

    ranges = settled(lifted, 0)
    # of a document: its repeated starts, and how many of its anchors occur elsewhere
    both = shared.join(ranges.hint("merge"), ["_h", "_item"], "left")
    hits = both.groupBy("_row").agg(F.collect_set(F.when(F.col("_ranges").isNotNull(), F.struct("_start", "_ranges"))).alias("_hits"), F.size(F.collect_set("_start")).cast("long").alias("_shared"))

    def remove(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                runs: list[list[int]] = []
                for a, b in sorted((x["_start"] + x["_ranges"][k], x["_start"] + x["_ranges"][k + 1] + length) for x in hits or () for k in range(0, len(x["_ranges"]), 2)):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(e for r in runs for e in r), len(raw)]
                n_bytes.append(len(raw)), n_removed.append(sum(b - a for a, b in runs))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if runs else raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), batch.column(3)], names=["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "n_shared"])

    done = plain.join(hits.hint("merge"), "_row", "left").select("_id", "_text", "_hits", F.coalesce("_shared", F.lit(0).cast("long")).alias("_shared"))
    schema = f"_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: bigint, end: bigint>>, kept binary, n_shared long"
    return done.mapInArrow(lean(remove), schema).withColumnRenamed("_id", id_col)


def _parts(ends: np.ndarray, joined: bytes, length: int):
    """Parts of a single very long text; neighbours share ``length`` - 1 bytes, so each start is in one part.

    The run that a cut splits becomes two items; their anchors are those of the
    whole text, since an anchor depends on its own string only.
    """
    step = _PLACES - 2 * length
    for a in range(0, max(1, len(joined) - length + 1), step):
        raw = joined[a : a + step + length - 1]
        inside = ends[(ends > a) & (ends < a + len(raw))] - a
        yield a, np.r_[inside, len(raw)], raw
