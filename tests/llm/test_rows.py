"""op4, op10."""

import zlib
from collections import Counter, defaultdict

import pytest
from compare import duck, rows
from compare import DATA
from pyspark.sql import functions as F

from marlstone.llm import mixing, registry, sharding


def test_mix_equals_sql(spark):
    assert rows(registry.op4(spark, DATA).toPandas()) == rows(duck(registry.OP4_SQL, DATA))


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in out]
        if not free:
            return out
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) >= most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1000, "d": 3}, {"a": 0, "b": 7}, {None: 50, "z": 1, "é": 9, "Z": 100}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "s string, source_size long").select(mixing._name(F.col("s")).alias("_src"), "source_size")
    got = {r["_src"]: r["target"] for r in mixing.targets(df).collect()}
    want = {("n" if s is None else "=" + s): v for s, v in plain_targets(sizes, (1, 2, 3), 3.0).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * (1 + want[k]) for k in want)


def test_mix_of_edge_cases(edge_df, clashing, edge):
    rows_ = mixing.plan(edge_df).collect()
    assert len(rows_) == len(edge) and all(0 <= r["copies"] <= 3 for r in rows_)
    by = defaultdict(list)
    for r in rows_:
        by[r["source"]].append(r)
    for rs in by.values():
        size, target = rs[0]["source_size"], rs[0]["target"]
        assert sum(r["_size"] for r in rs) == size
        assert abs(sum(r["copies"] for r in rs) - len(rs) * (target / size if size else 0)) < 1
        assert abs(sum(r["copies"] * r["_size"] for r in rs) - target) <= max(r["_size"] for r in rs)
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.filter("copies <> 'x' or target <> 'x'").count() == 0
    count = lambda rs: Counter((r["doc_id"], r["text"]) for r in rs)
    assert count(mixing.mix(edge_df).collect()) == count(mixed.collect()) == sum((Counter({(r["doc_id"], r["text"]): r["copies"]}) for r in rows_), Counter())
    assert mixing.plan(edge_df.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.repeat(F.lit("w "), (1 + F.pmod(F.hash("id"), F.lit(200))).cast("int")).alias("text"))
    r = mixing.plan(docs, weights={"s0": 5.0, "s1": 1.0}).groupBy("source").agg(F.sum(F.col("_size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(x["taken"] - x["target"]) <= 0.01 * x["target"] + 200 for x in r)
    assert {x["source"]: x["target"] for x in r}["s2"] == 0


def check_shards(got, docs, n):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values()) and by.keys() <= set(range(n))
    return {k: sum(r["size"] for r in rs) for k, rs in by.items()}


def test_shards_of_edge_cases(edge_df, clashing, edge):
    docs = [(i, t) for i, t, *_ in edge]
    check_shards(sharding.shard(edge_df).collect(), docs, 8)
    check_shards(sharding.shard(clashing).collect(), docs, 8)
    assert sharding.shard(edge_df.limit(0)).count() == 0


@pytest.mark.parametrize("rows_per_range", [100_000, 20])
def test_shards_are_near_equal_with_a_hot_text(spark, rows_per_range):
    docs = [(k, "hot text " * 5 if k % 3 == 0 else f"text {k} " * (1 + k % 17)) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (sharding.shard(df, rows_per_range=rows_per_range).orderBy("doc_id").collect() for _ in range(2))
    assert a == b
    sizes = check_shards(a, docs, 8)
    assert max(sizes.values()) <= 1.03 * sum(sizes.values()) / 8 and min(sizes.values()) >= 0.97 * sum(sizes.values()) / 8
    # small groups of equal texts stay together
    homes = defaultdict(set)
    for r in a:
        homes[r["text_crc32"]].add(r["shard"])
    hot = zlib.crc32(("hot text " * 5).encode())
    assert len(homes[hot]) > 1 and all(len(s) == 1 for k, s in homes.items() if k != hot)


def test_splitters_do_not_change_the_result(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = (sharding.shard(df, rows_per_range=n, seed=s).orderBy("doc_id").collect() for n, s in ((100_000, 1), (3, 2)))
    assert a == b


def test_groups_of_equal_texts_stay_whole(spark):
    docs = [(k, "x" * 90 if k < 900 else "y" * 50 if k < 1500 else f"own {k} " * 9) for k in range(9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for frame, texts in ((df, docs), (spark.read.parquet(f"{DATA}/documents.parquet"), None)):
        texts = texts or [tuple(r) for r in frame.select("doc_id", "text").collect()]
        got = sharding.shard(frame).collect()
        sizes = check_shards(got, texts, 8)
        homes = defaultdict(set)
        for r in got:
            homes[r["text_crc32"]].add(r["shard"])
        assert all(len(s) == 1 for s in homes.values())
        assert max(sizes.values()) - min(sizes.values()) <= max(0.02 * sum(sizes.values()) / 8, max(r["size"] for r in got))


def test_rows_without_id_are_mixed_alike_again(spark):
    docs = [(None, f"{w} " * 5, "s") for w in range(400)] + [(1, f"{w} " * 5, "s") for w in range(400)] + [(k, "b " * 50, "t") for k in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    taken = lambda d: sorted((r["doc_id"] or 0, r["text"], r["copies"]) for r in mixing.plan(d).collect())
    assert taken(df) == taken(df.repartition(7).orderBy(F.rand(3)))
