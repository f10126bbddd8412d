"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts come from one pass: character classes from a byte
histogram, words from a byte split, repeated five-word windows from sorted window
hashes.  Trees are grown on histograms of quantile bins, with monotonic
constraints on chosen statistics, and flattened into node arrays that score a
batch of documents level by level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

_SPACE = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = list(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT = list(range(65, 91)), list(range(97, 123)), list(range(48, 58))
_END = list(b".!?")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
INPUTS = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "end_rate", "other_rate", "distinct_rate", "words_per_line")
#: The verdict may only fall as these grow.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1}

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    return x ^ (x >> np.uint64(27))


def repeated_words(codes: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window found at least twice, the first included."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    x = (codes.astype(np.uint64) + np.uint64(1)) * _A
    for k in range(width):
        h = _mix(h + x[k : k + n]) * _A
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    # equal hashes are held against the words themselves
    a, b = order[:-1][same], order[1:][same]
    equal = np.ones(len(a), bool)
    for k in range(width):
        equal &= codes[a + k] == codes[b + k]
    edge = np.zeros(len(codes) + 1, np.int64)
    hit = np.unique(np.r_[a[equal], b[equal]])
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the trees' inputs of a text; null counts as empty."""
    raw = (text or "").encode()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(seen[0x80:0xC0].sum())
    words = raw.split()
    number: dict[bytes, int] = {}
    codes = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if raw else []
    n, word_chars = len(words), chars - int(seen[_SPACE].sum())
    base = [n, word_chars, int(seen[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(codes)]
    many, some = max(1, n), max(1, word_chars)
    letters = max(1, int(seen[_UPPER].sum() + seen[_LOWER].sum()))
    inputs = [
        float(np.log1p(n)), word_chars / many, base[2] / many, base[3] / max(1, len(lines)), base[4] / many, int(seen[_UPPER].sum()) / letters,
        int(seen[_DIGIT].sum()) / some, int(seen[_END].sum()) / many, (chars - int(seen[:0x80].sum())) / some, len(number) / many, n / max(1, len(lines)),
    ]
    return base, inputs


@dataclass
class Trees:
    """Node arrays of all trees; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


@dataclass
class _Grown:
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def node(self) -> int:
        k = len(self.value)
        self.feature.append(0), self.threshold.append(0.0), self.left.append(k), self.right.append(k), self.value.append(0.0)
        return k


def boost(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least_hessian: float = 2.0) -> Trees:
    """Logistic boosting.  A split on a constrained input must order its children's values, and the children
    then stay on their sides of the middle."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    margin, g = np.full(n, start), _Grown()
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        root = g.node()
        roots.append(root)
        todo = [(root, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            k, rows, d, lo, hi = todo.pop()
            gs, hs = grad[rows].sum(), hess[rows].sum()
            g.value[k] = float(np.clip(gs / (hs + l2), lo, hi)) * rate
            best = None
            if d < depth and hs >= 2 * least_hessian:
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, grad[rows], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], len(cuts[j]) + 1))[:-1]
                    vl, vr = np.clip(gl / (hl + l2), lo, hi), np.clip((gs - gl) / (hs - hl + l2), lo, hi)
                    ok = (hl >= least_hessian) & (hs - hl >= least_hessian)
                    if monotone.get(j):
                        ok &= monotone[j] * (vr - vl) >= 0
                    gain = np.where(ok, gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2), -1.0)
                    c = int(np.argmax(gain))
                    if gain[c] > 1e-6 and (best is None or gain[c] > best[0]):
                        best = (gain[c], j, c, vl[c], vr[c])
            if best is None:
                continue
            _, j, c, vl, vr = best
            g.feature[k], g.threshold[k] = j, float(cuts[j][c])
            g.left[k], g.right[k] = g.node(), g.node()
            goes = binned[rows, j] <= c
            mid = (vl + vr) / 2
            low, high = ((lo, mid), (mid, hi)) if monotone.get(j, 0) > 0 else ((mid, hi), (lo, mid)) if monotone.get(j, 0) < 0 else ((lo, hi), (lo, hi))
            todo += [(g.left[k], rows[goes], d + 1, *low), (g.right[k], rows[~goes], d + 1, *high)]
        one = Trees(np.array(g.feature), np.array(g.threshold), np.array(g.left), np.array(g.right), np.array(g.value), np.array([root]), depth)
        margin = margin + one.margin(x)
    return Trees(np.array(g.feature), np.array(g.threshold), np.array(g.left), np.array(g.right), np.array(g.value), np.array(roots), depth, start)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """id, the base counts, the trees' inputs and, with trees, the probability of good quality of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the number of trees

    def run(batches):
        for batch in batches:
            got = [statistics(t) for t in batch.column(1).to_pylist()]
            base = np.array([b for b, _ in got], np.int64).reshape(-1, len(BASE))
            inputs = np.array([x for _, x in got], float).reshape(-1, len(INPUTS))
            arrays = [pa.array(base[:, k]) for k in range(len(BASE))] + [pa.array(inputs[:, k]) for k in range(len(INPUTS))]
            model = shipped.value
            p = model.probability(inputs) if model is not None else np.full(len(got), np.nan)
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(p)], names=["_id", *BASE, *INPUTS, "probability"])

    schema = ", ".join([f"_id {kind}", *(f"{c} long" for c in BASE), *(f"{c} double" for c in INPUTS), "probability double"])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(run), schema).withColumnRenamed("_id", id_col)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 8000, **how) -> Trees:
    """Trees from the statistics of at most ``max_docs`` labelled rows, by least hash of the id.

    Labels that are null or contradict each other for an id take no part.  Without
    both kinds of labels the trees say what all of them say.
    """
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).filter("_y = _z")
    few = one.orderBy(F.xxhash64("_id", F.lit(13))).limit(max_docs).select("_id", "_y")
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")  # max_docs rows at most
    marked = some.withColumn("_both", F.struct("_id", "_y"))
    rows = measure(marked, "_both", "_text").select("_both", *INPUTS).collect()
    rows.sort(key=lambda r: tuple(r["_both"]))
    x = np.array([[r[c] for c in INPUTS] for r in rows], float).reshape(-1, len(INPUTS))
    y = np.array([r["_both"]["_y"] for r in rows], float)
    if not len(y):
        x, y = np.zeros((1, len(INPUTS))), np.ones(1)
    return boost(x, y, {INPUTS.index(k): v for k, v in MONOTONE.items()}, **how)


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, least_words: int = 10, most_repeat_percent: int = 20) -> DataFrame:
    """id, the base counts, base_failed, probability and kept of every row.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeat_percent``
    percent of the words in repeated windows.  Such rows are not kept; others are if
    their probability of good quality reaches ``least``.  Null and empty texts have
    no words and fail.  Repeated rows, ties of probability and null ids keep their
    rows, each with its own verdict; a very long text is measured whole by one task;
    other columns are ignored; an empty table gives no rows.
    """
    x = measure(docs, id_col, text_col, trees)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    x = x.withColumn("base_failed", failed)
    return x.select(id_col, *BASE, "base_failed", "probability", (~F.col("base_failed") & (F.col("probability") >= least)).alias("kept"))
