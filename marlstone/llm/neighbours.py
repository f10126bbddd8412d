"""Approximate nearest neighbours by additive quantisation.

A vector is a sum of full-dimensional codewords, one from each codebook.
Codebooks start as k-means of residuals and are refined by least squares for
fixed codes; codes come from a beam search.  An index row stores the codes and the
squared norm of the sum, so a query's distance to it is a norm less sums looked
up in one small table for each query.  The best by that distance are reranked by
the exact cosine in double precision.

How deep the rerank must go depends on the rows, so it is measured on them: up to 128 of the
queries are compared with every row, and the places that their true neighbours have by the
codes tell the depth.  Where it exceeds ``rerank``, sixteen more codebooks are fitted on what the others
leave, three times at most and while that helps; then the rerank goes as deep as the measure says, to every row if need be.

Equal vectors are one index row with its least ids, so a vector that a third of
all rows share is encoded, scored and reranked once.  Queries and index are dealt
in blocks; each (query block, index block) is a task of bounded memory that sees codes
and norms, 24 bytes a row and 16 more for each further sixteen codebooks, and the queries.  Its nearest ``rerank`` keys of each query
compete with those of other blocks, and the winners go back to the blocks that hold
their vectors: a vector travels once for the rerank, a query once to each block that
holds candidates of its.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean


#: Groups of sixteen codebooks at most, and keys that one task of the rerank gets.
MOST_GROUPS, KEYS_A_TASK = 4, 4_000_000


@dataclass
class Codebooks:
    words: np.ndarray  # (books, size, dimension)

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes of unit vectors: the ``beam`` best partial sums go on at every codebook."""
        books, size, dim = self.words.shape
        n = len(x)
        codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
        for c in self.words:
            near = (c**2).sum(1)[None, None, :] - 2 * (rest.reshape(-1, dim) @ c.T).reshape(n, -1, size) + (rest**2).sum(2)[:, :, None]
            near = near.reshape(n, -1)
            keep = min(beam, near.shape[1])
            best = np.argpartition(near, keep - 1, axis=1)[:, :keep]
            from_, word = best // size, best % size
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, from_], word[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[rows, from_] - c[word]
        best = (rest**2).sum(2).argmin(1)
        return codes[np.arange(n), best]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def train_codebooks(x: np.ndarray, books: int = 16, size: int = 256, rounds: int = 6, refine: int = 2, beam: int = 4) -> Codebooks:
    """Codebooks of unit vectors ``x``, at most 256 words each."""
    rng = np.random.default_rng(0)
    size = max(1, min(size, 256, len(x)))
    rest, words = x.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), size, replace=False)].copy()
        for _ in range(rounds):
            a = ((c**2).sum(1)[None] - 2 * rest @ c.T).argmin(1)
            n = np.bincount(a, minlength=size)
            total = np.zeros_like(c)
            np.add.at(total, a, rest)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.integers(len(rest), size=size)])
        a = ((c**2).sum(1)[None] - 2 * rest @ c.T).argmin(1)
        words.append(c)
        rest = rest - c[a]
    out = Codebooks(np.stack(words))
    for _ in range(refine):
        codes = np.concatenate([out.encode(x[a : a + 1024], beam) for a in range(0, len(x), 1024)]) + np.arange(books) * size
        gram, cross = np.zeros((books * size, books * size), np.float32), np.zeros((books * size, x.shape[1]), np.float32)
        for m in range(books):
            np.add.at(cross, codes[:, m], x)
            for k in range(books):
                np.add.at(gram, (codes[:, m], codes[:, k]), 1.0)
        gram.ravel()[:: len(gram) + 1] += 0.1
        solved = np.linalg.solve(gram, cross + np.float32(0.1) * out.words.reshape(-1, x.shape[1]).astype(np.float32)).astype(float)
        del gram
        out = Codebooks(solved.reshape(books, size, -1))
    return out


def extended(books: Codebooks, x: np.ndarray) -> Codebooks:
    """As many codebooks as ``train_codebooks`` gives besides, fitted on what these leave of ``x``."""
    rest = np.concatenate([part - books.decode(books.encode(part)) for part in (x[a : a + 1024] for a in range(0, len(x), 1024))])
    return Codebooks(np.concatenate([books.words, train_codebooks(rest).words]))


def tables_of(books: Codebooks, q: np.ndarray) -> np.ndarray:
    """(books, size, queries): dot products of every codeword with every query."""
    return np.einsum("mkd,qd->mkq", books.words, q).astype(np.float32)


def distances(table: np.ndarray, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(rows, queries) from the lookup tables, but for a constant of the query."""
    far = np.repeat(norm.astype(np.float32)[:, None], table.shape[2], axis=1)
    for m in range(codes.shape[1]):
        far -= 2 * table[m][codes[:, m]]
    return far


def true_neighbours(index: DataFrame, probes: list, k: int) -> list[list[bytes]]:
    """For each of a few (id, vector): keys of the rows of largest cosine that hold ``k`` other ids; every row is compared."""
    q = np.array([v for _, v in probes], float)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    shipped = index.sparkSession.sparkContext.broadcast(q)

    def compare(batches):
        best = [[] for _ in shipped.value]
        for batch in batches:
            if not len(batch):
                continue
            v = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(batch), -1)
            cosine = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ shipped.value.T
            top = np.argpartition(-cosine, min(k, len(v) - 1), axis=0)[: k + 1]
            for j, rows in enumerate(top.T):
                best[j] = sorted(best[j] + [(-cosine[i, j], batch.column(0)[int(i)].as_py()) for i in rows])[: k + 1]
        flat = [(j, key, -c) for j, found in enumerate(best) for c, key in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], t) for n, t in enumerate((pa.int32(), pa.binary(), pa.float64()))], names=["_j", "_key", "_s"])

    found = index.select("_key", "_v").mapInArrow(lean(compare), "_j int, _key binary, _s double")
    line = Window.partitionBy("_j").orderBy(F.col("_s").desc(), "_key")
    found = found.withColumn("_rn", F.row_number().over(line)).filter(F.col("_rn") <= k + 1)
    told: list[list] = [[] for _ in probes]
    for r in sorted(found.join(index.select("_key", "_ids"), "_key").collect(), key=lambda r: r["_rn"]):  # k + 1 of each probe
        others = [i for i in r["_ids"] if i != probes[r["_j"]][0]]
        if others and sum(n for _, n in told[r["_j"]]) < k:
            told[r["_j"]].append((bytes(r["_key"]), len(others)))
    shipped.unpersist()
    return [[key for key, _ in x] for x in told]


def depth_needed(coded: DataFrame, books: Codebooks, probes: list, wanted: list[list[bytes]], share: float) -> int:
    """The depth of a rerank that holds ``share`` of the wanted keys: their places by the codes among all rows."""
    spark = coded.sparkSession
    pairs = [(j, key) for j, keys in enumerate(wanted) for key in keys]
    if not pairs:
        return 0
    q = np.array([v for _, v in probes], float)
    table = tables_of(books, q / np.linalg.norm(q, axis=1, keepdims=True))
    some = F.broadcast(spark.createDataFrame([(bytearray(key),) for key in sorted({key for _, key in pairs})], "_key binary"))
    held = {bytes(r["_key"]): r for r in coded.join(some, "_key").collect()}  # k of each probe
    codes = np.array([np.frombuffer(held[key]["_codes"], np.uint8) for _, key in pairs])
    norm = np.array([held[key]["_norm"] for _, key in pairs], np.float32)
    line = np.array([j for j, _ in pairs])
    far = norm - 2 * sum(table[m][codes[:, m], line] for m in range(codes.shape[1]))
    shipped = spark.sparkContext.broadcast((table, line, far + 1e-5))

    def count(batches):
        table, line, far = shipped.value
        before = np.zeros(len(far), np.int64)
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                codes = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(len(part), -1)
                d = distances(table, codes, part.column(1).to_numpy(zero_copy_only=False))
                for j in range(table.shape[2]):
                    at = np.flatnonzero(line == j)
                    if len(at):
                        before[at] += np.searchsorted(np.sort(d[:, j]), far[at], side="right")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(far)), pa.int32()), pa.array(before, pa.int64())], names=["_p", "_n"])

    places = coded.select("_codes", "_norm").mapInArrow(lean(count), "_p int, _n long").groupBy("_p").agg(F.sum("_n").alias("n")).collect()
    shipped.unpersist()
    return int(np.quantile([r["n"] for r in places], share, method="higher"))


def valid(vector: str) -> F.Column:
    """Not null, not zero and every component a finite number."""
    v = F.col(vector)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0)


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 8192,
    rerank: int = 512,
    index_block: int = 32_768,
    query_block: int = 2048,
    probes: int = 128,
    share: float = 0.98,
) -> DataFrame:
    """query_id, rank, id, score: the ``k`` rows of largest cosine found for every query but its own id.

    Nearest first, ties to the smaller id; fewer rows if there are fewer candidates.
    Vectors that are null, zero, or hold null or non-finite components take no part on
    either side; neither do null ids.  Vectors of different lengths raise.  Rows that
    repeat an id and a vector count once; of an id with several vectors each is a
    candidate, and as a query the least counts.  Other columns are ignored; empty
    tables give no rows.  Codebooks are fitted on about ``sample_rows`` distinct vectors by
    hash; every row is indexed.  The ``rerank`` nearest of the whole index by the codes
    are compared exactly, so tables of fewer vectors than that are searched exactly.
    For others ``probes`` queries are compared with every row, and codebooks are added or more rows
    reranked until ``share`` of their true neighbours are among those.
    """
    if rerank <= k:
        raise ValueError("rerank must exceed k")
    spark = rows.sparkSession
    scratch = Scratch(spark, "aq")
    kind = rows.schema[id_col].dataType.simpleString()
    take = lambda df: df.filter(valid(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    half = lambda salt: F.lpad(F.hex(F.xxhash64(F.lit(salt), "_v")), 16, "0")
    keyed = take(rows).withColumn("_key", F.unhex(F.concat(half(1), half(2))))
    # at most k + 1 ids of a vector matter; the rank limit applies before the shuffle
    order = Window.partitionBy("_key").orderBy("_id")
    few = keyed.withColumn("_rn", F.dense_rank().over(order)).filter(F.col("_rn") <= k + 1)
    index = few.groupBy("_key").agg(F.sort_array(F.collect_set("_id")).alias("_ids"), F.first("_v").alias("_v"))
    index = scratch.write(index, "index")
    asked = scratch.write(take(queries).groupBy("_id").agg(F.min("_v").alias("_v")), "asked")
    total, least, most = index.agg(F.count("*"), F.min(F.size("_v")), F.max(F.size("_v"))).first()
    n_asked, low, high = asked.agg(F.count("*"), F.min(F.size("_v")), F.max(F.size("_v"))).first()
    if not total or not n_asked:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    if len({least, most, low, high}) > 1:
        raise ValueError(f"vectors have {min(least, low)} to {max(most, high)} components")
    dim = most
    part = F.lit(min(1 << 30, -(-(1 << 30) * sample_rows // total)))
    drawn = index.filter(F.pmod(F.xxhash64("_key", F.lit(3)), F.lit(1 << 30)) < part).select("_key", "_v").collect()  # about sample_rows
    x = np.array([r["_v"] for r in sorted(drawn, key=lambda r: bytes(r["_key"]))] or [index.first()["_v"]], float)
    del drawn
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = train_codebooks(x)
    n_index = -(-total // index_block)

    def encode(batches):
        for batch in batches:
            v = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            codes = np.concatenate([shipped.value.encode(unit[a : a + 1024]) for a in range(0, len(unit), 1024)]) if len(unit) else np.zeros((0, 1), np.uint8)
            norm = (shipped.value.decode(codes) ** 2).sum(1) if len(unit) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float32())], names=["_key", "_codes", "_norm"])

    home = F.pmod(F.xxhash64("_key"), F.lit(n_index)).cast("int").alias("_i")
    tried = sorted(asked.orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(probes).collect(), key=lambda r: r["_id"]) if total > rerank else []
    tried = [(r["_id"], r["_v"]) for r in tried]
    near_ones = true_neighbours(index, tried, k) if tried else []
    deep = total
    for more in range(MOST_GROUPS):
        if more:
            shipped.unpersist()
            scratch.drop("codes")
            books = extended(books, x)
        shipped = spark.sparkContext.broadcast(books)  # books * size * dimension numbers
        coded = scratch.write(index.select("_key", "_v").mapInArrow(lean(encode), "_key binary, _codes binary, _norm float"), "codes")
        before, deep = deep, depth_needed(coded, books, tried, near_ones, share) if tried else 0
        if deep <= rerank or more and deep > 0.7 * before:
            break
    del x
    depth = max(rerank, deep)
    query_block = max(1, query_block * rerank // depth)  # what a task gives stays the same
    n_query = -(-n_asked // query_block)
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.select("*", home).withColumn("_q", blocks(n_query))
    right = asked.withColumn("_q", F.pmod(F.xxhash64("_id"), F.lit(n_query)).cast("int")).withColumn("_i", blocks(n_index))

    def score(index: pa.Table, asked: pa.Table) -> pa.Table:
        """The nearest keys of each query by lookup tables."""
        empty = pa.table({"query_id": asked["_id"].slice(0, 0), "_i": pa.array([], pa.int32()), "_key": pa.array([], pa.binary()), "_far": pa.array([], pa.float32())})
        if not len(index) or not len(asked):
            return empty
        codes = np.frombuffer(b"".join(index["_codes"].to_pylist()), np.uint8).reshape(len(index), -1)
        q = np.array(asked["_v"].combine_chunks().flatten().to_numpy(), float).reshape(-1, dim)
        q /= np.sqrt((q * q).sum(1))[:, None]
        norm, keep = index["_norm"].to_numpy(), min(depth, len(index))
        who, which, how_far = [], [], []
        for a in range(0, len(q), 128):
            far = distances(tables_of(shipped.value, q[a : a + 128]), codes, norm)
            best = np.argpartition(far, keep - 1, axis=0)[:keep]
            who.append(np.tile(np.arange(a, a + far.shape[1]), keep)), which.append(best.ravel()), how_far.append(np.take_along_axis(far, best, 0).ravel())
        pick = lambda xs: pa.array(np.concatenate(xs))
        return pa.table({"query_id": asked["_id"].take(pick(who)), "_i": pa.array(np.full(len(q) * keep, index["_i"][0].as_py(), np.int32)), "_key": index["_key"].take(pick(which)), "_far": pick(how_far)})

    near = left.groupBy("_i", "_q").cogroup(right.groupBy("_i", "_q")).applyInArrow(score, f"query_id {kind}, _i int, _key binary, _far float")
    line = Window.partitionBy("query_id").orderBy("_far", "_key")
    near = near.withColumn("_rn", F.row_number().over(line)).filter(F.col("_rn") <= depth)
    # at most ``depth`` keys of a query
    near = scratch.write(near.groupBy("_i", "query_id").agg(F.collect_list("_key").alias("_keys")), "near")
    wanted = near.join(asked.select(F.col("_id").alias("query_id"), "_v").hint("merge"), "query_id")
    n_deal = -(-n_asked * min(depth, total) // (n_index * KEYS_A_TASK))  # 1 but for a deep rerank
    wanted = wanted.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(n_deal)).cast("int"))
    held = index.select("_key", "_ids", "_v", home).withColumn("_q", blocks(n_deal))

    def compare(held: pa.Table, wanted: pa.Table) -> pa.Table:
        """Exact cosines of the wanted pairs; of each query the nearest k here, ties included."""
        out_q, out_id, out_s = [], [], []
        if len(held) and len(wanted):
            at = {key: i for i, key in enumerate(held["_key"].to_pylist())}
            v = np.array(held["_v"].combine_chunks().flatten().to_numpy(), float).reshape(-1, dim)
            length, ids = np.sqrt((v * v).sum(1)), held["_ids"].to_pylist()
            for mine, keys, q in zip(wanted["query_id"].to_pylist(), wanted["_keys"].to_pylist(), wanted["_v"].to_pylist(), strict=True):
                q = np.array(q, float)
                rows_ = np.array([at[key] for key in keys])
                cosine = (v[rows_] * q).sum(1) / (length[rows_] * np.sqrt((q * q).sum()))
                top = np.argsort(-cosine, kind="stable")
                floor = cosine[top[min(k, len(top) - 1)]]  # k + 1 vectors, ties included
                got = sorted((-float(cosine[t]), i) for t in top if cosine[t] >= floor for i in ids[rows_[t]] if i != mine)[:k]
                out_q += [mine] * len(got)
                out_id += [i for _, i in got]
                out_s += [-s for s, _ in got]
        kind_of = wanted["query_id"].type
        return pa.table({"query_id": pa.array(out_q, kind_of), "_id": pa.array(out_id, kind_of), "score": pa.array(out_s, pa.float64())})

    found = held.groupBy("_i", "_q").cogroup(wanted.groupBy("_i", "_q")).applyInArrow(compare, f"query_id {kind}, _id {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")
