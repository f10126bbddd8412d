"""Spelling variants: words that differ by one code point, grouped under their commonest form.

Words are counted with map-side combining.  The words in code-point order are cut
into shards of at most ``shard_words`` and each shard is written as a compact trie:
the labels of all nodes in one string, children side by side, and an array of
where they begin.  Shards are broadcast, at most ``broadcast_bytes`` of them at
a time, and every word walks through every shard depth-first together with its
distance-one Levenshtein automaton.  Neighbours that are accepted are reduced on the
spot to their number and the best form, so a word gives one row for each
broadcast and no pair of words is ever shuffled.  Forms are then followed to their roots by
pointer doubling; a form is at least ``ratio`` times as frequent as its word, so chains
are logarithmic in the largest count.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of letters in the lower-cased text.
LETTERS = r"[a-zÀ-ÿ]+"


def letter_runs(text: Column) -> Column:
    """Runs of Latin letters of a text with only A-Z lower-cased; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(0)), F.array().cast("array<string>"))


def count_words(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """word, n of a column ``word``: words of at least ``min_length`` code points that occur at least ``min_count`` times."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


class Trie:
    """Words in code-point order with their counts as three flat pieces.

    ``labels[v]`` is the code point that leads to node v, the children of v are the
    nodes ``first[v]`` to ``first[v + 1]``, and ``count[v]`` is the count of the word that ends there, or 0.
    Node 0 is the root.
    """

    def __init__(self, labels: str, first: array, count: array):
        self.labels, self.first, self.count = labels, first, count

    @classmethod
    def build(cls, words: list[str], counts: list[int]) -> Trie:
        """From distinct words in ascending order, level by level."""
        labels, first, count = [" "], array("i"), array("q", [counts[0] if words and not words[0] else 0])
        level, nodes = [(0, len(words), 0)], 1
        while level:
            below = []
            for lo, hi, depth in level:
                if lo < hi and len(words[lo]) == depth:
                    lo += 1  # the word that ends here stands first
                first.append(nodes)
                while lo < hi:
                    c, end = words[lo][depth], lo
                    while end < hi and words[end][depth] == c:
                        end += 1
                    labels.append(c)
                    count.append(counts[lo] if len(words[lo]) == depth + 1 else 0)
                    below.append((lo, end, depth + 1))
                    nodes, lo = nodes + 1, end
            level = below
        first.append(nodes)
        return cls("".join(labels), first, count)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.labels.encode("utf-8"), self.first.tobytes(), self.count.tobytes()

    @classmethod
    def unpacked(cls, labels: bytes, first: bytes, count: bytes) -> Trie:
        one, two = array("i"), array("q")
        one.frombytes(first), two.frombytes(count)
        return cls(labels.decode("utf-8"), one, two)

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words at distance exactly one with their counts, each once.

        A state is (node, place in the word, edits so far).  Without an edit the automaton
        follows the word; at each node of that path it may skip a code point of
        the word, replace it by a child's or insert a child's.  After the edit it only follows.
        """
        labels, first, count, find = self.labels, self.first, self.count, self.labels.find
        n, seen = len(word), set()
        stack = [(0, 0, 0, "")]
        while stack:
            node, i, edits, told = stack.pop()
            if edits:
                # told: how the accepted word begins
                start = i
                while i < n:
                    node = find(word[i], first[node], first[node + 1])
                    if node < 0:
                        break
                    i += 1
                else:
                    if count[node] and node not in seen:
                        seen.add(node)
                        yield told + word[start:], count[node]
                continue
            lo, hi = first[node], first[node + 1]
            if i < n:
                stack.append((node, i + 1, 1, told))
                c = word[i]
                # a child only goes on if the code point after it is there; the two edits differ in which one that is
                after, here = (word[i + 1] if i + 1 < n else None), c
                for v in range(lo, hi):
                    x = labels[v]
                    a, b = first[v], first[v + 1]
                    if x != c and (after is None or find(after, a, b) >= 0):
                        stack.append((v, i + 1, 1, told + x))
                    if find(here, a, b) >= 0:
                        stack.append((v, i, 1, told + x))
                v = find(c, lo, hi)
                if v >= 0:
                    stack.append((v, i + 1, 0, told + c))
            else:
                for v in range(lo, hi):
                    stack.append((v, i, 1, told + labels[v]))


def trie_shards(vocabulary: DataFrame, scratch: Scratch, shard_words: int) -> DataFrame:
    """shard, labels, first, count, n_bytes: tries of at most ``shard_words`` words each, in code-point order."""
    size = vocabulary.count()
    dealt = vocabulary.repartitionByRange(max(1, -(-size // shard_words)), "word").sortWithinPartitions("word")

    def build(batches):
        from pyspark import TaskContext

        part, words, counts, made = TaskContext.get().partitionId(), [], [], 0

        def out():
            x = Trie.build(words, counts).packed()
            return pa.RecordBatch.from_pylist([{"shard": (part << 32) + made, "labels": x[0], "first": x[1], "count": x[2], "n_bytes": sum(map(len, x))}], schema=_SHARD)

        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.append(w), counts.append(n)
                if len(words) == shard_words:
                    yield out()
                    words, counts, made = [], [], made + 1
        if words:
            yield out()

    return scratch.write(dealt.select("word", "n").mapInArrow(lean(build), "shard long, labels binary, first binary, count binary, n_bytes long"), "tries")


_SHARD = pa.schema([("shard", pa.int64()), ("labels", pa.binary()), ("first", pa.binary()), ("count", pa.binary()), ("n_bytes", pa.int64())])


def near_words(vocabulary: DataFrame, scratch: Scratch, shard_words: int = 100_000, broadcast_bytes: int = 48 << 20) -> DataFrame:
    """word, n, n_near, best_n, best: the number of near words and the most frequent one (ties: the smallest)."""
    spark = vocabulary.sparkSession
    shards = trie_shards(vocabulary, scratch, shard_words)
    rounds: list[list[int]] = []
    filled = broadcast_bytes
    for shard, size in sorted(tuple(r) for r in shards.select("shard", "n_bytes").collect()):
        if filled + size > broadcast_bytes:
            rounds.append([])
            filled = 0
        rounds[-1].append(shard)
        filled += size
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-vocabulary.count() // 20_000))
    dealt = vocabulary.repartition(parts, "word")  # not written: files would be read by fewer tasks
    got = None
    for k, wanted in enumerate(rounds):
        rows = shards.filter(F.col("shard").between(wanted[0], wanted[-1])).select("labels", "first", "count").collect()
        sent = spark.sparkContext.broadcast([tuple(map(bytes, r)) for r in rows])

        def walk(batches, sent=sent):
            tries = [Trie.unpacked(*x) for x in sent.value]
            for batch in batches:
                number, best_n, best = [], [], []
                for word in batch.column(0).to_pylist():
                    m, top = 0, (0, None)
                    for trie in tries:
                        for form, n in trie.near(word):
                            m += 1
                            if n > top[0] or (n == top[0] and form < top[1]):
                                top = (n, form)
                    number.append(m), best_n.append(top[0]), best.append(top[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], names=["word", "n", "n_near", "best_n", "best"])

        one = scratch.write(dealt.select("word", "n").mapInArrow(lean(walk), "word string, n long, n_near long, best_n long, best string"), f"near{k}")
        sent.unpersist()
        got = one if got is None else got.union(one)
    if got is None:
        return vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    if len(rounds) == 1:
        return got
    order = F.struct((-F.col("best_n")).alias("a"), F.col("best").alias("b"))  # the least is the most frequent, then the smallest
    least = F.min(F.when(F.col("best").isNotNull(), order))
    out = got.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), least.alias("t"))
    return out.select("word", "n", "n_near", F.coalesce(-F.col("t.a"), F.lit(0)).cast("long").alias("best_n"), F.col("t.b").alias("best"))


def roots(links: DataFrame, scratch: Scratch, most_rounds: int = 64) -> DataFrame:
    """word, root from (word, form) without cycles: forms followed to the last by pointer doubling."""
    now = scratch.write(links.select("word", F.col("form").alias("root")), "root0")
    for k in range(1, most_rounds + 1):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = scratch.write(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"root{k}")
        if nxt.filter("moved").isEmpty():
            return nxt.select("word", "root")
        now = nxt.select("word", "root")
    raise RuntimeError(f"forms still lead on after {most_rounds} rounds")


def group_variants(vocabulary: DataFrame, ratio: int = 5, shard_words: int = 100_000, broadcast_bytes: int = 48 << 20) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of (word, n).

    Words are distinct and not null.  A word's form is its near word of largest n, ties to the smallest
    in code-point order, if that n is at least ``ratio`` (2 or more) times the word's; else it is
    null and the word is its own root.  A word without near words has n_near 0.  Other columns are
    ignored; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could go in circles")
    scratch = Scratch(vocabulary.sparkSession, "spelling")
    words = scratch.write(vocabulary.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    near = near_words(words, scratch, shard_words, broadcast_bytes)
    formed = F.col("best_n") >= ratio * F.col("n")
    near = scratch.write(near.select("word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    last = roots(near.filter("form is not null").select("word", "form"), scratch)
    return near.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(words: DataFrame, min_length: int = 6, min_count: int = 5, **how) -> DataFrame:
    """Variants of a column ``word`` of occurrences; takes what ``group_variants`` takes.

    Null words do not count.  Repeated rows are occurrences.
    """
    return group_variants(count_words(words, min_length, min_count), **how)
