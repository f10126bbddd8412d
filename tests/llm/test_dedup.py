"""op3, op5, op9."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import duck, rows
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import lines, registry, simhash, substrings
from marlstone.llm.common import Scratch


def plain_substrings(docs, length):
    """Every string of every row."""
    raws = [(t or "").encode() for _, t in docs]
    count = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(docs, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if count[r[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((i, len(r), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(r) else 0, kept))
    return sorted(out, key=str)


def got_substrings(df, **how):
    r = substrings.dedup_substrings(df, **how).collect()
    assert all(sum(s["end"] - s["start"] for s in x["spans"]) == x["n_removed"] and len(x["spans"]) == x["n_spans"] for x in r)
    return sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in r), key=str)


@pytest.mark.parametrize("how", [{}, {"group_bytes": 600}, {"group_bytes": 5000}, {"group_bytes": 1, "most_levels": 3}])
def test_substrings_of_edge_cases(edge_df, clashing, edge, how):
    want = plain_substrings([(i, t) for i, t, *_ in edge], 400)
    assert sum(x[2] for x in want) > 0
    assert got_substrings(edge_df, **how) == want
    if not how:
        assert got_substrings(clashing) == want
        assert substrings.dedup_substrings(edge_df.limit(0)).count() == 0


def test_texts_beyond_the_places_of_a_hash_are_cut_into_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    raw = "".join(chr(c) for c in rng.integers(97, 101, 9000))
    docs = [(1, raw[:7000] + raw[500:1400]), (2, raw[6000:] + "é" * 700), (3, "short"), (4, raw[2000:2399])]
    monkeypatch.setattr(substrings, "_PLACES", 2048)
    made = []
    whole = b"".join((t or "").encode() for _, t in docs[:1])
    for shift, ends, part in substrings._parts(np.array([len(whole)]), whole, 400):
        assert len(part) < 2048
        _, h, first, last = substrings.anchors(np.frombuffer(part, np.uint8), ends, 400, 133)
        made += [s for f, la in zip(first + shift, last + shift, strict=True) for s in range(f, la + 1)]
    assert sorted(made) == list(range(len(whole) - 399))


def test_a_text_above_16_mb(spark):
    """Two such texts that share a passage across the cut, through the whole operator."""
    rng = np.random.default_rng(9)
    a = rng.integers(97, 123, (1 << 24) + 5000, dtype=np.uint8).tobytes().decode()
    passage = a[(1 << 24) - 1200 : (1 << 24) + 300]
    docs = [(1, a), (2, "x" * 30 + passage + "y" * 30)]
    got = {r["doc_id"]: r for r in substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [((1 << 24) - 1200, (1 << 24) + 300)] and [(s["start"], s["end"]) for s in got[2]["spans"]] == [(30, 1530)]


def test_shared_anchors_are_counted(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    own = {}
    for i, t in docs:
        raw = (t or "").encode()
        own[i] = substrings.anchors(np.frombuffer(raw, np.uint8), np.array([len(raw)]), 400, 133)[1].tolist()
    seen = Counter(h for hs in own.values() for h in hs)
    got = {r["doc_id"]: r["n_shared_anchors"] for r in registry.op3(spark, DATA).collect()}
    assert got == {i: sum(seen[h] > 1 for h in hs) for i, hs in own.items()} and any(got.values()) and not all(got.values())


def test_repeated_rows_repeat_their_strings(spark):
    long = " ".join(f"w{k}" for k in range(200))
    docs = [(1, long), (1, long), (None, long + " tail"), (2, "other " * 90), (3, " ".join(f"v{k}" for k in range(300)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got_substrings(df) == plain_substrings(docs, 400)
    assert got_substrings(df.filter("doc_id = 1")) == plain_substrings(docs[:2], 400)


def test_substrings_of_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert got_substrings(df, length=400) == plain_substrings(docs, 400)
    assert got_substrings(df, length=50, group_bytes=150) == plain_substrings(docs, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab", "abab", "c" * 9, "xyz", "a", "q" * 40]), max_size=30).map("".join), min_size=1, max_size=6), st.integers(33, 60))
def test_expansion_equals_counting(parts, length):
    items = [p.encode() for p in parts if len(p) >= length]
    if not items:
        return
    weights = np.array([1 + k % 2 for k in range(len(items))])
    count = Counter()
    for x, w in zip(items, weights, strict=True):
        for k in range(len(x) - length + 1):
            count[x[k : k + length]] += w
    for x, flags in zip(items, substrings.repeated_starts(items, weights, length), strict=True):
        assert flags.tolist() == [count[x[k : k + length]] >= 2 for k in range(len(x) - length + 1)]


def test_large_and_small_sorts_agree(monkeypatch):
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 102, 40, dtype=np.uint8)) for _ in range(20)]
    data = np.frombuffer(b"\xff".join(b"".join(words[k] for k in rng.integers(0, 20, 9)) for _ in range(20)) + b"\xff", np.uint8)
    a = substrings.common_prefix_below(data, substrings.suffixes(data, 100), 100)
    monkeypatch.setattr(substrings, "_PLACE", 5)
    b = substrings.common_prefix_below(data, substrings.suffixes(data, 100), 100)
    assert (a == b).all() and not a.all()


def test_every_start_is_in_one_item_and_parts_of_long_texts_agree():
    rng = np.random.default_rng(0)
    raw = bytes(rng.integers(97, 101, 5000, dtype=np.uint8))
    at, h, first, last = substrings.anchors(np.frombuffer(raw, np.uint8), np.array([2000, 5000]), 100)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert starts.tolist() == [*range(0, 1901), *range(2000, 4901)]
    assert all(f <= q <= la + 100 - 32 and q >= la for q, f, la in zip(at, first, last, strict=True))


# --- SimHash


def plain_fingerprint(text, k):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    w = raw.split()
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(docs, k, radius):
    fp = [plain_fingerprint(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fp[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def got_groups(df, **how):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(df, min_similarity=None, **how).collect()), key=str)


def test_simhash_of_edge_cases(edge_df, clashing, edge):
    want = plain_groups([(i, t) for i, t, *_ in edge], 3, 2)
    assert got_groups(edge_df, shingle=3, radius=2) == want
    assert got_groups(clashing, shingle=3, radius=2) == want
    assert simhash.near_groups(edge_df.limit(0), shingle=3).count() == 0


@pytest.mark.parametrize("how", [{"radius": 2}, {"radius": 2, "shard_rows": 16}, {"radius": 12, "shard_rows": 24}, {"radius": 2, "shard_rows": 8, "sample_rows": 64}])
def test_simhash_of_documents(spark, how):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert got_groups(df, shingle=3, **how) == plain_groups(docs, 3, how["radius"])


def test_pairs_meet_in_a_shard():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = fps[:500] ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64))
    every = np.concatenate([fps, near])
    nodes = simhash.vantage_tree(every, len(every), 100, 2)
    assert len(nodes) > 10
    at, shard, home = simhash.shards_of(every, nodes, 2)
    assert np.bincount(at[home], minlength=len(every)).tolist() == [1] * len(every)
    lives = dict(zip(at[home].tolist(), shard[home].tolist(), strict=True))
    visits = set(zip(at.tolist(), shard.tolist(), strict=True))
    assert all((3000 + i, lives[i]) in visits or (i, lives[3000 + i]) in visits for i in range(500))


@pytest.mark.parametrize("times", [1, 8])
def test_shards_keep_their_bound_as_the_input_grows(spark, times):
    n = 4000 * times
    classes = spark.range(n).select(F.xxhash64("id").alias("_key"))
    got = simhash._dealt(classes, Scratch(spark, "test"), 2, 256, 1024, 512)
    size = [r["count"] for r in got.filter("_home").groupBy("_shard").count().collect()]
    assert sum(size) == n and max(size) <= 2 * 256


def test_similarity_is_exact_for_small_sets():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, 40)).astype(np.uint32) for _ in range(2))
        pad = lambda x: np.r_[x, np.full(64 - len(x), simhash._PAD, np.uint32)][None]
        assert simhash.similar(pad(a), pad(b))[0] == len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_near_copies_leave_one(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    docs = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base[:20]):
        w = t.split()
        w[int(rng.integers(300))] = "changed"
        docs.append((100 + k, " ".join(w)))
    docs += [(200 + k, base[0]) for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = simhash.keep_one(df, shard_rows=32)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30)) and kept.columns == df.columns


def spoiled(words, cut):
    """The words with their last ``cut`` replaced, so that cut five-word shingles go and as many come."""
    return words[:-cut] + [f"{w}x" for w in words[-cut:]]


@pytest.mark.parametrize("how", [{}, {"shard_rows": 48, "shard_shingles": 9000}])
def test_links_at_the_bound(spark, how):
    """Pairs around 0.8, of 300 shingles and of 50, link as their whole sets say."""
    docs, want = [], []
    for k in range(90):
        n = 300 if k % 3 else 50
        base = [f"d{k}w{i}" for i in range(n + 4)]
        cut = 20 + k // 2 % 28 if k % 3 else 3 + k // 3 % 5
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(spoiled(base, cut)))]
        want += [2 * k, 2 * k if (n - cut) / (n + cut) >= 0.8 else 2 * k + 1]
    assert 20 < sum(a != k for k, a in enumerate(want)) < 70
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_groups(df, **how).orderBy("doc_id").collect()] == want


def test_repeats_have_no_vote_on_similarity(spark):
    """A copy with some sentences many times over has the same set of shingles."""
    docs = []
    for k in range(12):
        base = [f"d{k}w{i}" for i in range(500)]
        again = [w for j in range(8) for w in base[j * 50 : j * 50 + 5] * (60 + 40 * j)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + again))]
    got = simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_components_are_whole_or_fail(spark):
    from marlstone.llm.common import Scratch, connected_components

    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(path, Scratch(spark, "test"), most_rounds=2)
    assert {r["root"] for r in connected_components(path, Scratch(spark, "test")).collect()} == {0}


def test_sketches_settle_only_what_is_far():
    low, high = simhash.limits(128, 0.8)
    assert 70 < low < 80 and 124 <= high <= 127 and simhash.limits(8, 0.8) == (-1, 9)


def test_keep_one_of_edge_cases(edge_df, clashing, any_names):
    rows_ = [(r["doc_id"], r["text"]) for r in simhash.keep_one(edge_df).collect()]
    assert len(rows_) == len(set(rows_)) and (1, edge_df.first()["text"]) in rows_ and 2 not in {i for i, _ in rows_}
    assert simhash.keep_one(clashing).columns == clashing.columns
    odd = simhash.keep_one(any_names)
    assert odd.columns == any_names.columns and sorted(((r[0], r[1]) for r in odd.collect()), key=str) == sorted(rows_, key=str) and all(r[5:] == any_names.first()[5:] for r in odd.collect())


# --- lines


def plain_lines(docs, window=3):
    seen, out = {}, {}
    order = sorted({(i is None, i or 0, t) for i, t in docs if t}, key=lambda x: x[:2])
    parts = {x: x[2].split("\n") for x in order}
    counted = {x: [k for k, l in enumerate(p) if l.strip(" \t\r\x0b\x0c")] for x, p in parts.items()}
    for x in order:
        for k in range(len(counted[x]) - window + 1):
            key = tuple(parts[x][n].strip(" \t\r\x0b\x0c") for n in counted[x][k : k + window])
            seen.setdefault(key, (x, k))
            if seen[key] != (x, k):
                out.setdefault(x, set()).update(counted[x][k : k + window])
    return {(None if x[0] else x[1], x[2]): "".join(l + ("\n" if n < len(parts[x]) - 1 else "") for n, l in enumerate(parts[x]) if n not in out.get(x, ())) for x in order}


def test_lines_of_edge_cases(edge_df, clashing, edge):
    want = plain_lines([(i, t) for i, t, *_ in edge if i != 7])
    for df in (edge_df, clashing):
        got = lines.dedup_lines(df.withColumn("was", df["text"])).collect()
        assert len(got) == len(edge)
        for r in got:
            assert r["text"] == (want.get((r["doc_id"], r["was"]), r["was"]) if r["was"] else r["was"]), r["doc_id"]
    assert lines.dedup_lines(edge_df.limit(0)).count() == 0
    assert {r["n_removed"] for r in lines.dedup_lines(edge_df).filter("doc_id = 2").collect()} == {12}


def test_repeated_lines_go_whatever_the_columns_are_called(edge_df, any_names):
    want = sorted(((r[0], r[1]) for r in lines.drop_repeats(edge_df).collect()), key=str)
    got = lines.drop_repeats(any_names, length_col="n_chars")
    assert got.columns == any_names.columns and sorted(((r[0], r[1]) for r in got.collect()), key=str) == want
    assert all(r[5:] == any_names.first()[5:] and r[4] == len(r[1] or "") for r in got.collect())


def test_lines_equal_sql(spark):
    got = registry.op9(spark, DATA).toPandas()
    assert rows(got) == rows(duck(registry.OP9_SQL, DATA))
    digest = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in lines.dedup_lines(registry.documents(spark, DATA)).collect()}
    assert digest == dict(zip(got["doc_id"], got["kept_sha256"], strict=True))
