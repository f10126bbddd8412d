"""op1, op8."""

import zlib
from collections import Counter

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from marlstone.llm import attribution, packing, tokens


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_ids_and_spans_are_those_of_tokenizers(whole, spark):
    enc = tokens.encoder(tokens.default_path())
    texts = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    rng = np.random.default_rng(1)
    pool = list("aZ09 .,'\n\t\r\x0b\x1c\x85   éßñçœЖא中한😀‍·’“$€²½_-") + ["'s", "'LL", "  ", "<|endoftext|>", "\n\n "]
    texts += ["".join(rng.choice(pool, 60)) for _ in range(400)]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False)
        assert enc.ids(t).tolist() == want.ids
        ids, s, e = enc.spans(t)
        assert ids.tolist() == want.ids
        raw = t.encode()
        if "<|endoftext|>" not in t:
            ends = np.cumsum(enc.n_bytes[ids]) if len(ids) else np.zeros(0, int)
            assert (ends[-1] if len(ends) else 0) == len(raw)
            place = [len(raw[:k].decode(errors="ignore")) for k in ends]
            assert all(a <= p for a, p in zip(s, place, strict=True)) and all(p <= b for p, b in zip(place, e, strict=True))


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_against_brute_force(rule):
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(5, 40))
        bounds = np.unique(np.r_[0, rng.integers(1, n, 4), n])
        cuts = np.unique(np.r_[0, rng.integers(1, n, 9), n])
        s, e = cuts[:-1], cuts[1:]
        given, touch, cross = attribution.attribute(s, e, bounds, rule)
        want, wt, wc = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
        for a, b in zip(s, e, strict=True):
            share = np.array([max(0, min(b, bounds[k + 1]) - max(a, bounds[k])) for k in range(len(bounds) - 1)])
            hit = np.flatnonzero(share)
            wt[hit] += 1
            wc[hit] += len(hit) > 1
            if rule == "proportional":
                want += share / share.sum()
            else:
                want[{"first": hit[0], "last": hit[-1], "majority": int(np.argmax(share))}[rule]] += 1
        assert np.allclose(given, want) and (touch == wt).all() and (cross == wc).all()


def test_sections_add_up(edge_df, clashing, whole, edge):
    for df in (edge_df, clashing):
        got = Counter()
        for r in attribution.token_counts(df, rule="proportional").collect():
            got[r["doc_id"]] += r["n_tokens"]
        want = Counter()
        for i, t, *_ in edge:
            want[i] += len(whole.encode(t or "", add_special_tokens=False).ids)
        assert {k: round(v, 6) for k, v in got.items()} == dict(want)
    assert attribution.token_counts(edge_df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        attribution.token_counts(edge_df, rule="other")


def check_packing(rows, docs, whole, capacity):
    seen = Counter()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = Counter()
    for i, t in docs:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    for r in rows:
        seen[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    assert seen == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_round_trip(spark, edge_df, clashing, edge, whole):
    docs = [(i, t) for i, t, *_ in edge]
    for df in (edge_df, clashing):
        check_packing(packing.pack(df).collect(), docs, whole, 1024)
    check_packing(packing.pack(edge_df, capacity=16, items_per_partition=7, fan_in=2).collect(), docs, whole, 16)
    assert packing.pack(edge_df.limit(0)).count() == 0


def test_packing_is_tight_however_it_is_split(spark, whole):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    one = check_packing(packing.pack(df).collect(), docs, whole, 1024)
    many = check_packing(packing.pack(df, items_per_partition=20, fan_in=3).collect(), docs, whole, 1024)
    least = -(-sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for _, t in docs) // 1024)
    assert one <= least * 1.02 + 1 and many <= least * 1.03 + 1


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 3, 4, 1]), 10)
    assert bins.tolist() == [0, 1, 1, 0, 1] and fills.tolist() == [10, 9] and offsets.tolist() == [0, 0, 5, 6, 8]


def test_token_counts_of_documents_equal_plain_majority(whole, spark):
    """Bytes of every token by the vocabulary's stand-ins, each character to the token of its first byte: counted line by line."""
    from marlstone.llm import registry

    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter()
    for r in registry.op1(spark, DATA).collect():
        got[r["doc_id"], r["start"], r["end"]] = r["n_tokens"]
    for i, text in docs:
        text = text or ""
        line_of, at = [], 0
        lines = [x + "\n" for x in text.split("\n")]
        lines[-1] = lines[-1][:-1]
        lines = [x for x in lines if x]
        bounds = []
        for k, x in enumerate(lines):
            bounds.append((at, at + len(x)))
            at += len(x)
            line_of += [k] * len(x)
        char_of = [k for k, c in enumerate(text) for _ in range(len(c.encode()))]
        want, b = Counter(), 0
        for t in whole.encode(text, add_special_tokens=False).tokens:
            touched = Counter(line_of[c] for c in sorted(set(char_of[b : b + len(t)])))
            b += len(t)
            want[max(touched, key=lambda k: (touched[k], -k))] += 1
        assert b == len(char_of)
        for k, (lo, hi) in enumerate(bounds):
            assert got[i, lo, hi] == want[k], (i, k)
        assert sum(want.values()) == sum(v for (d, _, _), v in got.items() if d == i)


def test_pieces_that_fit_with_no_other_stay_out_of_the_rounds(spark, monkeypatch):
    """Pieces of over half a sequence: nothing merges, and no task sees more than it may."""
    seen = []
    write = packing.Scratch.write

    def watched(self, df, name):
        out = write(self, df, name)
        if name.startswith(("moves", "packed")):
            task = F.shiftright(F.col("bin" if name == "packed" else "into"), 36)
            seen.append((name, max(r["count"] for r in out.groupBy(task.alias("task")).count().collect())))
        return out

    monkeypatch.setattr(packing.Scratch, "write", watched)
    monkeypatch.setattr(packing, "token_pieces", lambda docs, *a: docs.select(F.col("doc_id").alias("_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("text").cast("long").alias("length"), F.xxhash64("doc_id").alias("ids_crc32")))
    x = spark.range(8000).select(F.col("id").alias("doc_id"), (535 + F.col("id") % 174).cast("string").alias("text"))
    got = packing.pack(x, items_per_partition=1000, fan_in=4)
    assert got.select("sequence_id").distinct().count() == 8000 and [name for name, _ in seen] == ["packed"]
    # some small ones among them: rounds go on in tasks of bounded size, and the small ones find places
    seen.clear()
    y = x.withColumn("text", F.when(F.col("doc_id") % 8 == 0, (100 + F.col("doc_id") % 300).cast("string")).otherwise(F.col("text")))
    rows = packing.pack(y, items_per_partition=1000, fan_in=4).collect()
    bins = Counter()
    for r in rows:
        bins[r["sequence_id"]] += r["length"]
    assert len(rows) == 8000 and max(bins.values()) <= 1024 and 7000 <= len(bins) <= 7000 * 1.01
    assert len(seen) > 2 and all(n <= 1150 for _, n in seen), seen  # dealt by hash
