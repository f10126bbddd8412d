"""op11, op12, op13."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import DATA, duck, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import chat, periodic, registry, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=12):
    """Every period at every place."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, 2 * p) and not any(w[i : i + size - q] == w[i + q : i + size] for q in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_op11(key, words):
    words = registry.planted_period(key, words)
    got = plain_runs(words)
    gone = {i for s, n, q in got for i in range(s + q, s + n)}
    top = min(got, key=lambda r: (-r[1], r[0], r[2]), default=None)
    tail = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (key, len(got), *tail, sha("".join(f"{s},{n},{q}\n" for s, n, q in got)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 5, 100, 1 << 18]), st.sampled_from([2, 12]), st.sampled_from([3, 20, 1024]))
def test_runs_equal_those_of_every_period(seed, block, least, long):
    rng = random.Random(seed)
    n, kinds = rng.randrange(90), rng.choice([1, 2, 3, 8])
    w = [rng.randrange(kinds) for _ in range(n)]
    if n > 5 and rng.random() < 0.5:
        b, p = rng.randrange(n), rng.randrange(1, n // 2 + 1)
        w = [w[i] if i < b else w[b + (i - b) % p] for i in range(n)]
    was = periodic.LONG, periodic.grid.__defaults__
    try:
        periodic.LONG, periodic.grid.__defaults__ = long, (block,)
        assert [tuple(r) for r in periodic.find_runs(np.array(w, np.int64), least).tolist()] == plain_runs(w, least)
    finally:
        periodic.LONG, periodic.grid.__defaults__ = was


def test_runs_that_the_hashes_got_wrong():
    ids = np.array([1, 2, 3] * 5 + [9] + [1, 2, 3] * 5, np.int64)
    claimed = np.array([[0, len(ids), 3]])
    assert periodic.confirmed(ids, claimed, 12).tolist() == [[0, 15, 3], [16, 15, 3]]


def test_hashes_do_not_see_a_hard_sequence_as_periodic():
    ids = np.array([bin(i).count("1") % 2 for i in range(1 << 12)], np.int64)  # overlap-free
    assert all(n < 2 * q + 1 for _, n, q in periodic.find_runs(ids, 2).tolist())


def test_periodic_runs_of_edge_cases(edge_df, clashing, edge):
    want = Counter(plain_op11(r[0], WORD.findall(r[1] or "")) for r in edge if r[0] != 9)
    for df in (edge_df, clashing.withColumnsRenamed({"lang": "runs", "score": "_id", "spans": "a.b"})):
        got = periodic.periodic_runs(df.filter("doc_id is null or doc_id <> 9"), prepare=registry.planted_period).collect()
        plain = []
        for r in got:
            told = [tuple(x) for x in r["runs"]]
            top = min(told, key=lambda x: (-x[1], x[0]), default=None)
            plain.append((r["doc_id"], len(told), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in told)), sha(r["collapsed"])))
        assert Counter(plain) == want
    assert periodic.periodic_runs(edge_df.filter("false")).collect() == []


def test_op11_equals_plain(spark):
    docs = registry.documents(spark, DATA).filter(F.length("text") < 6000)
    want = sorted(plain_op11(r["doc_id"], WORD.findall(r["text"] or "")) for r in docs.collect())
    ids = {w[0] for w in want}
    got = sorted(tuple(r) for r in registry.op11(spark, DATA).collect() if r[0] in ids)
    assert got == want and sum(w[1] > 0 for w in want) > 5


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abé", max_size=6), st.integers(1, 9), min_size=1, max_size=60), st.text("abéz", max_size=6))
def test_trie_and_automaton(words, probe):
    told = sorted(words)
    trie = spelling.Trie.unpacked(*spelling.Trie.build(told, [words[w] for w in told]).packed())
    for w in [*told, probe]:
        assert sorted(trie.near(w)) == sorted((x, n) for x, n in words.items() if one_edit(w, x))


def plain_variants(count, ratio=5):
    form, near = {}, {}
    for w, n in count.items():
        found = [x for x in count if one_edit(w, x)]
        top = min(found, key=lambda x: (-count[x], x), default=None)
        near[w] = len(found)
        form[w] = top if top and count[top] >= ratio * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], count[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"shard_words": 7}, {"shard_words": 3, "broadcast_bytes": 1}, {"shard_words": 10, "broadcast_bytes": 2000}])
def test_variants_over_shards_and_broadcasts(spark, how):
    rng = random.Random(5)
    count = {}
    for _ in range(60):
        count["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6)))] = rng.choice([1, 2, 5, 5, 10, 24, 25, 130, 700])
    df = spark.createDataFrame([(w, n, "x") for w, n in count.items()], "word string, n int, form string")
    got = spelling.group_variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == plain_variants(count)
    assert len({r["root"] for r in got}) < len(got)


def test_variants_of_no_words(spark, edge_df):
    assert spelling.spelling_variants(registry.typed_words(edge_df.filter("false"))).collect() == []
    assert spelling.spelling_variants(registry.typed_words(edge_df.withColumns({"word": F.lit("x"), "n": F.lit(1), "run": F.lit(2), "h": F.lit(3), "a.b": F.lit(4)})), min_length=3, min_count=1).count() > 0
    with pytest.raises(ValueError):
        spelling.group_variants(edge_df, ratio=1)


def plain_words(docs, size=6, least=5):
    count = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= size and n >= least}


def test_op12_equals_plain(spark):
    docs = [tuple(r) for r in registry.documents(spark, DATA).select("doc_id", "text").collect()]
    got = registry.op12(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == plain_variants(plain_words(docs))


def test_typed_words_of_edge_cases(edge_df, edge):
    got = spelling.count_words(registry.typed_words(edge_df), 1, 1).collect()
    assert {r["word"]: r["n"] for r in got} == plain_words([r[:2] for r in edge], 1, 1)


def test_op13_equals_sql(spark):
    assert rows(registry.op13(spark, DATA).toPandas()) == rows(duck(registry.OP13_SQL, DATA))


PIECES = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "<|", "|>", "\\", "\n", "n", "im_end", "user", "<", "a", "é😀", ""]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=4).map("".join), st.lists(st.sampled_from(PIECES), max_size=7).map("".join)), max_size=5))
def test_any_turns_read_back(turns):
    told = [chat.settle(*t) for t in turns]
    text = "".join(t[0] for t in told)
    got = chat.parse(text)
    assert [x[:2] for x in got] == turns
    assert [chat.read_text(text[a:b]) for _, _, a, b in got] == [t for _, t in turns]
    for (role, body), (out, a, b, k) in zip(turns, told, strict=True):
        assert chat.read_text(out[a:b]) == body
        assert (k == 0) == (out == f"{chat.START}{role}\n{body}{chat.END}\n")


@pytest.mark.parametrize("text", ["x", "<|im_start|>user", "<|im_start|>user\ntext", "<|im_start|>user\ntext<|im_end|>", "<|im_start|>a<|im_end|>\nb<|im_end|>\n", "<|im_start|>user\na<|im_start|>b<|im_end|>\n"])
def test_what_is_not_a_conversation(text):
    with pytest.raises(chat.GrammarError):
        chat.parse(text)


CHAT = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi <|im_end|> there"), (1, 2, None, None), (1, None, "assistant", "last"), (1, 1, "assistant", "a tie"), (1, 1, "assistant", "a tie"),
    (2, 0, "odd\nrole", "<\\|im_end|>"), (None, 0, "user", "no id"), (None, 1, "assistant", ""), (3, 0, "assistant", "😀 é" * 50_000), (4, 5, "<|im_end|>", "x"),
] + [(5, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(400)]


def plain_chat(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = []
    for c, g in groups.items():
        g = [(r, x) for _, _, r, x in sorted(g)]
        loss = "".join(x for r, x in g if r == "assistant")
        out.append((c, len(g), sha("".join(f"{r}\n{x}\n" for r, x in g)), len(loss), sha(loss), sum(len(chat.settle(r, x)[0]) for r, x in g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_conversations_over_partitions(spark, parts):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumns({"conversation": F.lit("x"), "_conv": F.lit("y"), "part": F.lit(1), "a.b": F.lit(2)}).repartition(5)
        assert sorted(map(tuple, chat.round_trip(df).collect()), key=str) == plain_chat(CHAT)
        assert chat.round_trip(df.filter("false")).collect() == []
        # the text itself: turns in order, masks over what is trained on
        told = {}
        for r in sorted(chat.format_turns(df).collect(), key=lambda r: (r["part"], r["place"])):
            told.setdefault(r["conversation"], []).append(r)
        for c, g in told.items():
            want = sorted((t is None, t or 0, r or "", x or "") for k, t, r, x in CHAT if k == c)
            assert [x[:2] for x in chat.parse("".join(r["formatted"] for r in g))] == [w[2:] for w in want]
            assert all((r["loss_from"] is None) == (r["role"] != "assistant") for r in g)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
