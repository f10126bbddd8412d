"""SimHash near-duplicates through vantage-point trees over fingerprints.

1. Every text gets a 64-bit fingerprint of its word shingles.  Equal fingerprints
   (with a similarity bound: equal shingle sets) form a class; from there on only
   classes travel, so thousands of copies are one row.
2. Without a similarity bound the radius is small and vantage-point trees shard the
   fingerprints: a node sends what lies within ``mu`` of its vantage point inside,
   the rest outside.  A fingerprint is resident in one leaf and a guest in every
   other leaf that its ball overlaps by the triangle inequality, so a pair within the
   radius meets in the leaf of one of them.  Trees grow level by level, each from a
   sample of its own of a shard that is still too large; vantage point and boundary
   are those of many tried that fewest balls cross.
3. With a similarity bound the balls are so wide that they cross every boundary.
   Classes then meet in buckets of two shared minima of their shingle sets, in so many
   bands that a pair at the bound is missed with less than ``chance``.
4. Inside a shard or bucket a local vantage-point tree prunes the same way down to
   small blocks, which are compared bit by bit.  A task returns a spanning forest of
   the links it finds, never the pairs.
5. Forests are joined by distributed connected components.
6. With a similarity bound, a pair that its sketches do not settle is left open and
   its two classes are marked.  Marked ones meet again with their whole texts, where
   their components still differ, and whole shingle sets decide.

Nothing that grows with the input reaches the driver but one tree node for each
``shard_rows`` fingerprints.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_position, connected_components, lean, row_key, small_batches

_PAD = np.uint32(0xFFFFFFFF)


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; fewer words give one shingle, none give none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - k + 1)
    h = xxhash.xxh64_intdigest
    last = (ends[k - 1 :] if len(words) >= k else ends[-1:]) - 1
    return np.fromiter([h(line[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64, n)


def fingerprint(h: np.ndarray) -> np.uint64:
    """Bit i is set if it is set in over half of the hashes; no hashes give zero."""
    if not len(h):
        return np.uint64(0)
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return np.packbits(total * 2 > len(h)).view(">u8")[0].astype(np.uint64)


def sketch(h: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct hashes, by their upper half."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:k]


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of padded sketches, row by row: exact if both sets fit, else by the smallest of the union."""
    k = a.shape[1]
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != _PAD
    fresh = np.ones(both.shape, bool)
    fresh[:, 1:] = both[:, 1:] != both[:, :-1]
    rank = np.cumsum(fresh & real, axis=1)
    whole = (a[:, -1] == _PAD) & (b[:, -1] == _PAD)
    use = real & (whole[:, None] | (rank <= k))
    return (use & ~fresh).sum(1) / np.maximum((use & fresh).sum(1), 1)


@cache
def limits(k: int, p: float, chance: float = 1e-9) -> tuple[int, int]:
    """Of k draws of a union: up to how many shared ones rule out similarity p, and from how many on they prove it.

    Either is wrong with less than ``chance`` at p itself and less beyond (binomial
    law; draws without replacement stray less).  -1 and k + 1 settle nothing.
    """
    law = [math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(k + 1)]
    below, above = np.cumsum(law), np.cumsum(law[::-1])[::-1]
    return int((below < chance).sum()) - 1, k + 1 - int((above < chance).sum())


def settle(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """(similar, open) of padded sketches, row by row: which are at least p alike and which need the whole sets."""
    yes, unsure = np.zeros(len(a), bool), np.ones(len(a), bool)
    for k in sorted({min(16, a.shape[1]), a.shape[1]}):  # most pairs share nothing in 16
        at = np.flatnonzero(unsure)
        x, y = a[at, :k], b[at, :k]
        s, whole = similar(x, y), (x[:, -1] == _PAD) & (y[:, -1] == _PAD)
        low, high = limits(k, p)
        shared = np.rint(s * k)
        yes[at] = np.where(whole, s >= p, shared >= high)
        unsure[at] = ~whole & (shared > low) & (shared < high)
    return yes, unsure


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two whole sets, each sorted and without repeats."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(both) - shared)


class Links:
    """Disjoint sets over positions, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent[i]
            self.parent = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            keep = lo != hi
            a, b = lo[keep], hi[keep]
            np.minimum.at(self.parent, b, a)


def search(fps: np.ndarray, residents: np.ndarray, queries: np.ndarray, radius: int, found, rng, small: int = 1 << 18) -> None:
    """Calls ``found(i, j)`` with arrays of positions of near pairs (resident, query)."""
    stack = [(residents, queries)]
    while stack:
        x, q = stack.pop()
        if not len(x) or not len(q):
            continue
        if len(x) * len(q) > small and len(x) > 64:
            v = fps[x[rng.integers(len(x))]]
            dx, dq = np.bitwise_count(fps[x] ^ v).astype(int), np.bitwise_count(fps[q] ^ v).astype(int)
            mu = int(np.median(dx))
            inner, outer = q[dq <= mu + radius], q[dq > mu - radius]
            n_in = int((dx <= mu).sum())
            if n_in < len(x) and n_in * len(inner) + (len(x) - n_in) * len(outer) < 0.9 * len(x) * len(q):
                stack += [(x[dx <= mu], inner), (x[dx > mu], outer)]
                continue
        step = max(1, small // max(1, len(q)))
        for a in range(0, len(x), step):
            block = x[a : a + step]
            i, j = np.nonzero(np.bitwise_count(fps[block][:, None] ^ fps[q][None, :]) <= radius)
            i, j = block[i], q[j]
            keep = i != j
            if keep.any():
                found(i[keep], j[keep])


def vantage_tree(sample: np.ndarray, n: int, shard_rows: int, radius: int, tries: int = 24, least: float = 0.15) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, mu, inside, outside); a negative child -1 - k is leaf k.

    ``n`` is what the sample stands for.  Of ``tries`` vantage points and all their
    distances the boundary that fewest balls cross for what it splits off is taken.
    A leaf stands for ``shard_rows`` or fewer, unless its sample is too small to
    choose or cannot be split.
    """
    rng = np.random.default_rng(0)
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0
    todo = [(sample, float(n), None)]
    while todo:
        s, share, slot = todo.pop(0)
        best = None
        if share > shard_rows and len(s) >= 32:
            some = s[rng.choice(len(s), min(len(s), 2048), replace=False)]
            for v in s[rng.choice(len(s), min(len(s), tries), replace=False)]:
                upto = np.cumsum(np.bincount(np.bitwise_count(some ^ v), minlength=65)) / len(some)
                small = np.minimum(upto, 1 - upto)
                cross = upto - np.r_[np.zeros(min(radius, 65)), upto[: max(0, 65 - radius)]]
                cost = np.where(small >= least, cross / np.maximum(small, 1e-9), np.inf)
                if not np.isfinite(cost).any():
                    cost = np.where(small > 0, 65 + cross / np.maximum(small, 1e-9), np.inf)
                mu = int(np.argmin(cost))
                if np.isfinite(cost[mu]) and (best is None or cost[mu] < best[0]):
                    best = (cost[mu], v, mu)
        if best is None:
            here, leaves = -1 - leaves, leaves + 1
        else:
            _, v, mu = best
            inside = np.bitwise_count(s ^ v) <= mu
            here = len(nodes)
            nodes.append((int(v), mu, 0, 0))
            todo += [(s[inside], share * inside.mean(), (here, 2)), (s[~inside], share * (~inside).mean(), (here, 3))]
        if slot:
            at, side = slot
            nodes[at] = tuple(here if k == side else x for k, x in enumerate(nodes[at]))
    return nodes


def shards_of(fps: np.ndarray, nodes: np.ndarray | list[tuple[int, int, int, int]], radius: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, leaf, resident): the home of every fingerprint and the leaves where it is a guest.

    Pairs whose ways part at a node meet on its outside, so residents send guests
    outwards only; a guest (``home`` says who comes as one) must follow both sides.
    """
    out: list[tuple[np.ndarray, int, bool]] = []
    every, root = np.arange(len(fps)), 0 if len(nodes) else -1
    home = np.ones(len(fps), bool) if home is None else home
    stack = [(every[home], root, True), (every[~home], root, False)]
    while stack:
        at, node, own = stack.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((at, -1 - node, own))
            continue
        v, mu, inside, outside = map(int, nodes[node])
        d = np.bitwise_count(fps[at] ^ np.uint64(v % (1 << 64))).astype(int)
        if own:
            stack += [(at[d <= mu], inside, True), (at[d > mu], outside, True), (at[(d <= mu) & (d > mu - radius)], outside, False)]
        else:
            stack += [(at[d <= mu + radius], inside, False), (at[d > mu - radius], outside, False)]
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return np.concatenate([a for a, _, _ in out]), np.concatenate([np.full(len(a), k) for a, k, _ in out]), np.concatenate([np.full(len(a), h) for a, _, h in out])


def _dealt(classes: DataFrame, scratch: Scratch, radius: int, shard_rows: int, sample_rows: int, least_sample: int = 2048) -> DataFrame:
    """(_key, _shard, _home) of fingerprints (the key), residents and guests, by trees that are grown level by level.

    At each level every shard above ``shard_rows`` has a sample of its own, drawn by hash: a share of
    ``sample_rows``, ``least_sample`` at least, so it is large enough at any size of the input.  The shards'
    trees are grown side by side, one task group for each sample, and their nodes alone reach the
    driver, about one for each ``shard_rows`` fingerprints.  The rows are then written under the
    leaves.  It ends when no shard is above; fingerprints of a shard all differ, so each can be split.
    """
    spark = scratch.spark
    done: list[DataFrame] = []
    now = classes.select("_key", F.lit(0).cast("long").alias("_shard"), F.lit(True).alias("_home"))
    free, limit = 1, shard_rows
    for level in range(64):
        counts = now.filter("_home").groupBy("_shard").agg(F.count("*").alias("_c")).filter(F.col("_c") > limit)
        wide = scratch.write(counts, f"wide{level}")
        n = wide.count()
        if not n:
            break
        if level:
            row = ("_key", "_shard", "_home")
            done.append(now.join(wide.hint("merge"), "_shard", "left_anti").select(*row))
            now = now.join(wide.hint("merge"), "_shard", "left_semi").select(*row)
        each = max(least_sample, sample_rows // n)
        part = F.least(F.lit(1 << 30).cast("long"), F.ceil(F.lit(float(each << 30)) / F.col("_c")))
        drawn = now.filter("_home").join(F.broadcast(wide), "_shard") if n <= 10_000 else now.filter("_home").join(wide.hint("merge"), "_shard")
        drawn = drawn.filter(F.pmod(F.xxhash64("_key", F.lit(level)), F.lit(1 << 30)) < part).select("_shard", "_key", "_c")

        def grow(table: pa.Table) -> pa.Table:
            keys = np.sort(table["_key"].to_numpy()).astype(np.uint64)
            nodes = vantage_tree(keys, table["_c"][0].as_py(), shard_rows, radius)
            packed = np.array([(np.uint64(v).astype(np.int64), mu, a, b) for v, mu, a, b in nodes], np.int64).reshape(-1, 4)
            return pa.table({"_shard": table["_shard"].slice(0, 1), "nodes": pa.array([packed.tobytes()], pa.binary())})

        grown = scratch.write(drawn.groupBy("_shard").applyInArrow(grow, "_shard long, nodes binary"), f"trees{level}")
        trees = {}
        for r in sorted(grown.collect(), key=lambda r: r["_shard"]):
            nodes = np.frombuffer(r["nodes"], np.int64).reshape(-1, 4)
            trees[r["_shard"]] = (nodes, free)
            free += len(nodes) + 1
        shipped = spark.sparkContext.broadcast(trees)  # a node for every shard_rows of the overfull shards, 32 bytes each

        def deal(batches, shipped=shipped):
            for batch in batches:
                key, shard, home = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                for s in np.unique(shard).tolist():
                    nodes, base = shipped.value[s]
                    mine = np.flatnonzero(shard == s)
                    at, leaf, own = shards_of(key[mine].astype(np.uint64), nodes, radius, home[mine])
                    yield pa.RecordBatch.from_arrays([pa.array(key[mine[at]]), pa.array(leaf + base, pa.int64()), pa.array(own)], names=["_key", "_shard", "_home"])

        now = scratch.write(now.mapInArrow(deal, "_key long, _shard long, _home boolean"), f"level{level}")
        limit = shard_rows * 3 // 2
    for x in done:
        now = now.union(x)
    return now


def _minima(u: np.ndarray, bands: int) -> np.ndarray:
    """For each band two minima of 32 bits over the set, as one number; two sets agree in one with the square of their similarity."""
    low = np.full((bands, 2), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(u), 4096):
        x = (u[None, a : a + 4096] ^ _SALT[:bands, None]) * _M1
        x ^= x >> np.uint64(29)
        x *= _M2
        x ^= x >> np.uint64(32)
        low = np.minimum(low, x.view(np.uint32).reshape(bands, -1, 2).min(1))
    return low.view(np.uint64).ravel()


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SALT = np.random.default_rng(9).integers(0, 1 << 63, 64, dtype=np.uint64)


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    radius: int = 32,
    min_similarity: float | None = 0.8,
    seed: int = 42,
    sketch_size: int = 128,
    shard_rows: int = 16_384,
    sample_rows: int = 65_536,
    chance: float = 1e-9,
    shard_shingles: int = 1 << 22,
) -> DataFrame:
    """_row, id, fingerprint, n_shingles, component_id for every row.

    Two texts link when their fingerprints differ in at most ``radius`` bits and,
    unless ``min_similarity`` is None, their shingle sets are at least that similar.
    With a similarity, candidates share a pair of minima, which misses a pair at the
    bound with less than ``chance``; sketches of ``sketch_size`` hashes settle only
    pairs so far from the bound that they err in less than one of 10^9 (``limits``),
    whole sets decide the others.  The fingerprint and n_shingles are then of
    distinct shingles, else repeats count.  component_id is the least id that links
    reach, the row's own included; ids that are null take no part in the least and a
    component of them alone has null.

    Null texts count as empty.  Texts without a word have fingerprint zero and link
    like any other.  Repeated rows and shared ids keep a row each; equal texts are
    one class, so ties cost nothing; a very long text is held whole by one task.
    Other columns are ignored; an empty table gives no rows.  ``sample_rows`` is shared by the
    samples that shape a level of the trees (2,048 fingerprints a shard at least); it does not
    bound what is compared.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    kind = docs.schema[id_col].dataType.simpleString()
    verify = min_similarity is not None
    bands = min(len(_SALT), math.ceil(math.log(chance) / math.log(1 - min_similarity**2))) if verify else 0
    small_batches(spark)

    def hashed(batches):
        import xxhash

        for batch in batches:
            key, fp, n, sk, low = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                h = shingle_hashes(text, shingle, seed)
                u = np.unique(h) if verify else h  # similarity is of sets, so repeats have no vote
                fp.append(int(fingerprint(u).astype(np.int64)))
                n.append(len(u))
                if verify:
                    sk.append(sketch(u, sketch_size).tobytes())
                    low.append(_minima(u, bands).tobytes())
                    key.append(xxhash.xxh3_128_digest(u.tobytes()))
            arrays = [batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(n, pa.int64())]
            arrays += [pa.array(x, pa.binary()) for x in (key, sk, low)] if verify else []
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "_id", "_fp", "_n", "_key", "_sk", "_low"][: len(arrays)])

    rows = docs.select(row_key(id_col, text_col).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.mapInArrow(lean(hashed), f"_row binary, _id {kind}, _fp long, _n long" + ", _key binary, _sk binary, _low binary" * verify)
    rows = scratch.write(rows if verify else rows.withColumn("_key", F.col("_fp")), "rows")
    if verify:
        classes = scratch.write(rows.groupBy("_key").agg(F.min("_id").alias("_least"), F.min("_row").alias("_row"), *(F.first(c).alias(c) for c in ("_fp", "_n", "_sk", "_low"))), "classes")
        labels = _by_similarity(docs, classes, scratch, id_col, text_col, shingle, seed, radius, min_similarity, sketch_size, bands, shard_rows, shard_shingles)
    else:
        classes = scratch.write(rows.groupBy("_key").agg(F.min("_id").alias("_least")), "classes")

        def forest(table: pa.Table) -> pa.Table:
            fps = table["_key"].to_numpy().astype(np.uint64)
            links, every = Links(len(fps)), np.arange(len(fps))
            search(fps, every[table["_home"].to_numpy(zero_copy_only=False)], every, radius, links.add, np.random.default_rng(1))
            root = links.roots(every)
            keep = np.flatnonzero(root != every)
            return pa.table({"a": table["_key"].take(pa.array(keep)), "b": table["_key"].take(pa.array(root[keep]))})

        edges = _dealt(classes, scratch, radius, shard_rows, sample_rows).groupBy("_shard").applyInArrow(forest, "a long, b long")
        labels = scratch.write(connected_components(edges, scratch), "labels")
    whole = classes.select("_key", "_least").join(labels.withColumnRenamed("v", "_key"), "_key", "left").withColumn("_root", F.coalesce("root", "_key"))
    whole = scratch.write(whole.select("_key", "_least", "_root"), "rooted")
    least = scratch.write(whole.groupBy("_root").agg(F.min("_least").alias("component_id")), "least")
    member = scratch.write(whole.join(least.hint("merge"), "_root").select("_key", "component_id", "_root"), "members")
    out = rows.select("_row", "_id", "_key", "_fp", "_n").join(member.hint("merge"), "_key")
    hexed = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return out.select("_row", F.col("_id").alias(id_col), hexed.alias("fingerprint"), F.col("_n").alias("n_shingles"), "component_id", "_root")


def _pairs_within(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of all pairs inside each of the consecutive groups of these sizes."""
    end = np.repeat(np.cumsum(size), size)
    more = end - np.arange(len(end)) - 1
    i = np.repeat(np.arange(len(end)), more)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)


def _by_similarity(docs, classes, scratch, id_col, text_col, shingle, seed, radius, p, sketch_size, bands, shard_rows, shard_shingles) -> DataFrame:
    """(v, root) of classes that link at similarity ``p``.

    A ball wide enough for that similarity crosses every boundary of a tree over
    64-bit fingerprints, so shards come first: classes that share a band meet in its
    bucket, and a pair is looked at in the first band that it shares.  Inside a
    bucket a vantage-point tree, the counts of shingles and the Hamming radius prune.
    A bucket above ``shard_rows`` goes to its chunk pairs.
    """
    spark = scratch.spark
    # by the hash of its number and minima a band's bucket is one long
    number = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring(F.col("_low"), k * 8 + 1, 8)))).alias("_band", "_bucket")
    banded = scratch.write(classes.filter("_n > 0").select("_key", number), "banded")
    several = banded.groupBy("_bucket").agg(F.min("_key").alias("a"), F.max("_key").alias("b"), F.count("*").alias("_c")).filter("a <> b").select("_bucket", "_c")
    several = scratch.write(several, "several")
    meet = _chunked(banded.join(several.hint("merge"), "_bucket"), F.ceil(F.col("_c") / shard_rows))
    meet = scratch.write(meet.select("_key", "_band", "_task", "_own", "_other"), "meet")
    scratch.drop("banded")
    load = meet.count()
    rich = meet.join(classes.select("_key", "_fp", "_n", "_sk", "_low").hint("merge"), "_key")
    rich = rich.repartition(max(1, -(-load // 20_000)), "_task").sortWithinPartitions("_task")

    def decide(table: pa.Table, links: Links, key, sets=None) -> np.ndarray:
        """Adds the links of the rows of whole tasks; which rows are in a pair that is left open."""
        fps, size = table["_fp"].to_numpy().astype(np.uint64), table["_n"].to_numpy()
        own, other = table["_own"].to_numpy(), table["_other"].to_numpy()
        marked = np.zeros(len(fps), bool)
        if sets is None:
            sks = _padded([np.frombuffer(x, np.uint32) for x in table["_sk"].to_pylist()], sketch_size)
            low = np.frombuffer(b"".join(table["_low"].to_pylist()), np.uint64).reshape(len(fps), -1)
            band = table["_band"].to_numpy()
        else:
            sks = _padded([sketch(x, sketch_size) for x in sets], sketch_size)

        def found(i, j):
            lo, hi = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            keep = lo >= p * hi
            i, j = i[keep], j[keep]
            for s in range(0, len(i), 4096):
                a, b = i[s : s + 4096], j[s : s + 4096]
                keep = links.roots(a) != links.roots(b)
                a, b = a[keep], b[keep]
                if sets is None:  # another task has the pair if they share an earlier band
                    first = (low[a] == low[b]).argmax(1) == band[a]
                    a, b = a[first], b[first]
                ok, unsure = settle(sks[a], sks[b], p)
                links.add(a[ok], b[ok])
                a, b = a[unsure], b[unsure]
                if sets is None:
                    keep = links.roots(a) != links.roots(b)
                    marked[a[keep]] = marked[b[keep]] = True
                    continue
                while len(a):
                    keep = links.roots(a) != links.roots(b)
                    a, b = a[keep], b[keep]
                    ok = np.array([jaccard(sets[x], sets[y]) >= p for x, y in zip(a[:64].tolist(), b[:64].tolist(), strict=True)], bool)
                    links.add(a[:64][ok], b[:64][ok])
                    a, b = a[64:], b[64:]

        task = table["_task"].to_numpy()
        edge = np.r_[0, np.flatnonzero(np.diff(task)) + 1, len(task)]
        n = np.diff(edge)
        same = own == other
        few = np.repeat((n <= 64), n) & same
        at = np.flatnonzero(few)
        i, j = _pairs_within(np.bincount(np.repeat(np.arange(len(n)), n)[at], minlength=len(n)))
        i, j = at[i], at[j]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        found(i[near], j[near])
        rng = np.random.default_rng(1)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if few[a]:
                continue
            rows = np.arange(a, b)
            if same[a]:
                search(fps, rows, rows, radius, lambda x, y: found(x[x < y], y[x < y]), rng)
            else:
                search(fps, rows[own[a:b] < other[a:b]], rows[own[a:b] > other[a:b]], radius, found, rng)
        return marked

    def tasks(batches, most_rows):
        """Tables of whole tasks from batches sorted by task."""
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= most_rows:
                table = pa.Table.from_batches(held)
                task = table["_task"].to_numpy()
                cut = int(np.searchsorted(task, task[-1]))
                if cut:
                    yield table.slice(0, cut).combine_chunks()
                    held, n = table.slice(cut).to_batches(), n - cut
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def by_sketch(batches):
        for table in tasks(batches, 4096):
            key, task = table["_key"], table["_task"]
            _, first, inverse = np.unique(np.array(key.to_pylist(), object), return_index=True, return_inverse=True)
            links = Links(len(table))
            links.add(np.arange(len(table)), first[inverse])  # a class in several tasks
            marked = np.flatnonzero(decide(table, links, key))
            root = links.roots(np.arange(len(table)))
            keep = np.flatnonzero((root != np.arange(len(table))) & (first[inverse] != first[inverse][root]))
            a, b = pa.array(np.r_[keep, marked]), pa.array(np.r_[root[keep], marked])
            asked = pa.array(np.r_[np.zeros(len(keep), np.int64), task.to_numpy()[marked]], mask=np.r_[np.ones(len(keep), bool), np.zeros(len(marked), bool)])
            for batch in pa.table({"a": key.take(a), "b": key.take(b), "_asked": asked}).combine_chunks().to_batches():
                yield batch

    edges = scratch.write(rich.select("_task", "_key", "_fp", "_n", "_sk", "_low", "_band", "_own", "_other").mapInArrow(lean(by_sketch), "a binary, b binary, _asked long"), "edges")
    labels = scratch.write(connected_components(edges.filter("_asked is null").select("a", "b"), scratch), "labels")
    # pairs left open, if their classes are not in one component by now
    asked = edges.filter("_asked is not null").select(F.col("a").alias("_key"), F.col("_asked").alias("_task")).distinct()
    asked = asked.join(labels.withColumnRenamed("v", "_key").hint("merge"), "_key", "left").withColumn("_root", F.coalesce("root", "_key")).drop("root")
    asked = scratch.write(asked.join(classes.select("_key", "_row", "_fp", "_n").hint("merge"), "_key"), "asked")
    open_ = asked.groupBy("_task").agg(F.min("_root").alias("a"), F.max("_root").alias("b"), F.sum("_n").alias("_s"), F.count("*").alias("_c")).filter("a <> b").select("_task", "_s", "_c")
    open_ = scratch.write(open_, "open")
    doubt = asked.join(open_.hint("merge"), "_task")
    parts = F.greatest(F.ceil(F.col("_s") / shard_shingles), F.ceil(F.col("_c") / shard_rows))
    doubt = scratch.write(_chunked(doubt.withColumnRenamed("_task", "_bucket"), parts).select("_key", "_row", "_root", "_fp", "_n", "_task", "_own", "_other"), "doubt")
    total, n = doubt.agg(F.sum("_n"), F.count("*")).first()
    if not n:
        return labels
    one = doubt.select("_row", "_key").distinct()
    texts = docs.select(row_key(id_col, text_col).alias("_row"), F.col(text_col).alias("_text")).join(one.hint("merge"), "_row").drop("_row").dropDuplicates(["_key"])
    rich = doubt.join(texts.hint("merge"), "_key").select("_task", "_root", "_fp", "_n", "_own", "_other", "_text")
    rich = rich.repartition(max(1, -(-total // (shard_shingles // 4))), "_task").sortWithinPartitions("_task")

    def by_set(batches):
        for table in tasks(batches, 512):
            root = table["_root"]
            _, first, inverse = np.unique(np.array(root.to_pylist(), object), return_index=True, return_inverse=True)
            links = Links(len(table))
            links.add(np.arange(len(table)), first[inverse])
            decide(table, links, root, [np.unique(shingle_hashes(t, shingle, seed)) for t in table["_text"].to_pylist()])
            up = links.roots(np.arange(len(table)))
            keep = np.flatnonzero(first[inverse] != first[inverse][up])
            for batch in pa.table({"a": root.take(pa.array(keep)), "b": root.take(pa.array(up[keep]))}).combine_chunks().to_batches():
                yield batch

    more = rich.mapInArrow(lean(by_set), "a binary, b binary")
    joined = connected_components(more, Scratch(spark, "simhash")).select(F.col("v").alias("root"), F.col("root").alias("_to"))
    joined = scratch.write(joined, "joined")
    both = labels.select("v", "root").unionByName(joined.select(F.col("root").alias("v"), "root").join(labels.select("v"), "v", "left_anti").select("v", F.col("v").alias("root")))
    return scratch.write(both.join(joined.hint("merge"), "root", "left").select("v", F.coalesce("_to", "root").alias("root")), "relabelled")


def _padded(rows: list[np.ndarray], k: int) -> np.ndarray:
    out = np.full((len(rows), k), _PAD, np.uint32)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _chunked(x: DataFrame, parts) -> DataFrame:
    """Rows with _task, _own, _other: a bucket's own number, or for each pair of its ``parts`` chunks another one."""
    x = x.withColumn("_parts", F.greatest(parts.cast("int"), F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("_key"), F.col("_parts")).cast("int"))
    x = x.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    pair = F.xxhash64("_bucket", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return x.withColumn("_task", F.when(F.col("_parts") == 1, F.col("_bucket")).otherwise(pair))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input without near-duplicates, its columns kept whatever their names: of each component the row of the least id stays.

    Takes what ``near_groups`` takes.  Rows that repeat both id and text leave one
    row; of rows of one component that share the least id, one stays.
    """

    def run(x: DataFrame, id_col: str, text_col: str) -> DataFrame:
        groups = near_groups(x, id_col, text_col, **how)
        best = groups.groupBy("_root").agg(F.min(F.struct(F.isnull(id_col).alias("a"), F.col(id_col).alias("b"), F.col("_row").alias("c"))).alias("_best"))
        chosen = best.select(F.col("_best.c").alias("_row")).distinct()
        return x.withColumn("_row", row_key(id_col, text_col)).join(chosen.hint("merge"), "_row", "left_semi").dropDuplicates(["_row"])

    return by_position(docs, run, id_col=id_col, text_col=text_col)
