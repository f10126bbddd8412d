"""Toxic spans by a linear-chain conditional random field.

Labels mark whole documents, the field tags tokens, so token labels come first:
in labelled rows, a word or word beginning is marked when so many of its surroundings
(words before it) are in toxic documents and so few in clean ones that fewer than
``chance`` such cases are expected among all candidates; in toxic documents, tokens
with a mark are labelled toxic.  The field learns tag weights of words, beginnings and shapes, and
tag transitions, from these tokens.  Forward-backward marginals then give each
token of any text its probability; their sum and maximum, through a logistic curve
fitted to the document labels, give the document's score, and runs of tokens above
one half give the offending offsets.

Only ``max_docs`` labelled rows reach the driver (least hash of the id first,
toxic and clean apart); scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, exactly, lean, small_batches

_EDGE = "\"'()[]{}<>.,;:!?¡¿*_~`«»„“”‘’…-–—"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CACHE_WORDS = 200_000


def features(word: bytes) -> list[int]:
    """64-bit hashes: of the word's shape, the word without outer punctuation in lower case, and its beginnings."""
    w = word.decode("utf-8", "replace").lower().strip(_EDGE)
    out = [_hash("s=" + ("word" if w.isalpha() else "empty" if not w else "mixed")), _hash("w=" + w if len(w) > 2 else "v=" + w)]
    return out + [_hash("b=" + w[:n]) for n in range(3, 8) if len(w) > n]


_hash = xxhash.xxh3_64_intdigest
#: Features that mark no token: shapes; very short words go by another name and are few.
_SHAPES = np.array([_hash("s=" + k) for k in ("word", "empty", "mixed")], np.uint64)


def _longest_first(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order, the starts in it, and how many are longer than 0, 1, 2 ..."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    return order, starts[order], np.searchsorted(-size, -np.arange(size[0] + 1) if len(size) else np.zeros(1, int), side="left")


def chains(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of tag 1 against tag 0 at every token.

    ``e`` holds each token's log weight of tag 1 (of tag 0 it is 0), ``trans`` the
    log weights [[00, 01], [10, 11]].  Documents are cut into segments that advance
    together, so a step is one vector operation, however long a document is: the
    product of a segment's steps carries odds across it either way, then every
    segment is walked once in each direction from the odds at its ends.
    """
    x = np.exp(np.clip(e, -30, 30))
    r, b = x.copy(), np.ones(len(e))
    more = lengths > 1
    if not more.any():
        return r, b
    (a00, a01), (a10, a11) = np.exp(trans)
    head, n = starts[more], lengths[more] - 1
    per = -(-n // segment)
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(doc)) - first[doc]
    order, s, running = _longest_first(head[doc] + 1 + k * segment, np.minimum(segment, n[doc] - k * segment))
    p = np.zeros((4, len(s)))  # 00, 01, 10, 11
    p[0] = p[3] = 1
    steps = len(running) - 1
    for t in range(steps):
        m = running[t]
        xt = x[s[:m] + t]
        q00, q01, q10, q11 = p[:, :m]
        p[:, :m] = q00 * a00 + q01 * a10, (q00 * a01 + q01 * a11) * xt, q10 * a00 + q11 * a10, (q10 * a01 + q11 * a11) * xt
        if t % 4 == 3:
            p[:, :m] /= p[:, :m].max(0)
    whole = np.empty_like(p)
    whole[:, order] = p
    into, out = np.empty(len(s)), np.ones(len(s))
    docs, at, left = _longest_first(first, per)
    now = x[head[docs]]
    for t in range(len(left) - 1):
        i = at[: left[t]] + t
        now = now[: left[t]]
        into[i] = now
        now = (whole[1, i] + now * whole[3, i]) / (whole[0, i] + now * whole[2, i])
    now = np.ones(0)
    for t in range(len(left) - 2, -1, -1):
        i = at[: left[t]] + t
        now = np.r_[now, np.ones(left[t] - len(now))]
        out[i] = now
        now = (whole[2, i] + now * whole[3, i]) / (whole[0, i] + now * whole[1, i])
    now = into[order]
    for t in range(steps):
        m = running[t]
        i = s[:m] + t
        now = x[i] * (a01 + now[:m] * a11) / (a00 + now[:m] * a10)
        r[i] = now
    end, now = out[order], np.ones(0)
    for t in range(steps - 1, -1, -1):
        m = running[t]
        i = s[:m] + t
        now = np.r_[now, end[len(now) : m]]
        b[i] = now
        y = x[i] * now
        now = (a10 + y * a11) / (a00 + y * a01)
    b[head] = (whole[2, first] + out[first] * whole[3, first]) / (whole[0, first] + out[first] * whole[1, first])
    return r, b


@dataclass
class Model:
    names: np.ndarray  # hashes of the features that have a weight, ascending
    values: np.ndarray  # their weights of tag 1
    bias: float
    trans: np.ndarray
    curve: np.ndarray  # of the document: constant, log sum, logit of the maximum

    @cached_property
    def weights(self) -> dict[int, float]:
        """For looking at a model; scoring does not need it."""
        return dict(zip(self.names.tolist(), self.values.tolist(), strict=True))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """The log weight of tag 1 of each word: two arrays instead of a table of objects, as every worker holds the model."""
        if not len(words) or not len(self.names):
            return np.full(len(words), self.bias)
        flat, first = array("Q"), []
        for w in words:
            first.append(len(flat))
            flat.extend(features(w))  # at least two
        f = np.frombuffer(flat, np.uint64)
        at = np.minimum(np.searchsorted(self.names, f), len(self.names) - 1)
        return self.bias + np.add.reduceat(np.where(self.names[at] == f, self.values[at], 0.0), first)

    def emission(self, word: bytes) -> float:
        return float(self.emissions([word])[0])

    def document(self, p: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        total, most = np.zeros(len(lengths)), np.zeros(len(lengths))
        some = lengths > 0
        if some.any():
            total[some] = np.add.reduceat(p, starts[some])
            most[some] = np.maximum.reduceat(p, starts[some])
        return document_inputs(total, most) @ self.curve


def document_inputs(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    m = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(total)), np.log(total + 1e-2), np.log(m / (1 - m))], axis=1)


def supports(ids: list[np.ndarray], n_words: int) -> np.ndarray:
    """In how many surroundings each word occurs: different words before it, over all texts.

    A passage that is copied many times thus counts once.
    """
    some = [d for d in ids if len(d)]
    if not some:
        return np.zeros(n_words)
    pairs = np.unique(np.concatenate([d * (n_words + 1) + np.r_[n_words, d[:-1]] for d in some]))
    return np.bincount(pairs // (n_words + 1), minlength=n_words).astype(float)


def marks(row: np.ndarray, col: np.ndarray, n_features: int, toxic: np.ndarray, clean: np.ndarray, able: np.ndarray, chance: float, purity: float = 0.95) -> np.ndarray:
    """Which features have a share of toxic surroundings that chance does not explain.

    ``row`` and ``col`` pair words and features, ``toxic`` and ``clean`` are the
    words' surroundings, ``able`` the features that may mark at all.
    """
    bad, good = np.bincount(col, toxic[row], n_features), np.bincount(col, clean[row], n_features)
    base = min(max(toxic.sum() / max(1.0, toxic.sum() + clean.sum()), 1e-6), 1 - 1e-6)
    tried = able & (bad >= 3)
    out = np.zeros(n_features, bool)
    for f in np.flatnonzero(tried & (bad >= purity * (bad + good))):
        k, n = int(bad[f]), int(bad[f] + good[f])
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(base) + (n - i) * math.log1p(-base)) for i in range(k, n + 1))
        out[f] = tail * tried.sum() < chance
    return out


def fit(texts: list[str | None], toxic: list[int], doc_weight: list[float] | None = None, chance: float = 0.5, rounds: int = 60, l2: float = 1e-3, block_words: int = 600_000) -> Model:
    """The model from labelled texts; null texts count as empty."""
    y = np.array(toxic, float)
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in (t or "").encode().split()), np.int64) for t in texts]
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -6.0, np.zeros((2, 2)), np.array([-3.0 if not y.sum() else 3.0, 0.0, 0.0]))
    flat, of_word = array("Q"), array("q")
    for k, word in enumerate(number):
        got = features(word)
        flat.extend(got), of_word.extend([k] * len(got))
    name, every_col = np.unique(np.frombuffer(flat, np.uint64), return_inverse=True)
    every_row, n_words = np.frombuffer(of_word, np.int64), len(number)
    del number, flat
    spread = [supports([d for d, k in zip(ids, y, strict=True) if k == tag], n_words) for tag in (1, 0)]
    tags = marks(every_row, every_col, len(name), *spread, ~np.isin(name, _SHAPES), chance)
    marked = np.bincount(every_row, tags[every_col], n_words) > 0
    # the chain learns from all given rows, in blocks of documents
    blocks = []
    size = np.cumsum([len(d) for d in ids])
    for few in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(size // block_words)) + 1):
        tok = np.concatenate([ids[i] for i in few])
        lengths = np.array([len(ids[i]) for i in few])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        starts, lengths = starts[lengths > 0], lengths[lengths > 0]
        gold = np.concatenate([marked[ids[i]] & bool(y[i]) for i in few])
        follows = np.ones(len(tok), bool)
        follows[starts] = False
        blocks.append((tok.astype(np.int32), gold, starts, lengths, np.flatnonzero(follows).astype(np.int32)))
    want_t = sum(np.array([[np.sum((gold[nxt - 1] == i) & (gold[nxt] == j)) for j in (0, 1)] for i in (0, 1)], float) for _, gold, _, _, nxt in blocks)
    w, bias, trans = np.zeros(len(name)), -2.0, np.zeros((2, 2))
    # what is not marked itself may speak against a tag only: chance neighbours of marked words then add nothing
    only_against = ~tags
    moment, square = [0.0] * 3, [0.0] * 3
    n = max(1, int(size[-1]))
    for k in range(1, rounds + 1):
        e_word = bias + np.bincount(every_row, w[every_col], n_words)
        by_word, have_t = np.zeros(n_words), np.zeros((2, 2))
        for tok, gold, starts, lengths, nxt in blocks:
            e = e_word[tok]
            r, b = chains(e, starts, lengths, trans)
            odds = r * b
            by_word += np.bincount(tok, gold - odds / (1 + odds), n_words)
            # expected transitions into every token that follows another
            before, after = r[nxt - 1], np.exp(np.clip(e[nxt], -30, 30)) * b[nxt]
            (a00, a01), (a10, a11) = np.exp(trans)
            w01, w10, w11 = a01 * after, a10 * before, a11 * before * after
            whole = a00 + w01 + w10 + w11
            have_t += [[np.sum(a00 / whole), np.sum(w01 / whole)], [np.sum(w10 / whole), np.sum(w11 / whole)]]
        g_w = np.bincount(every_col, by_word[every_row], len(w)) / n - l2 * w / n
        g_b = by_word.sum() / n
        g_t = (want_t - have_t) / n
        step = 0.5 if k < rounds * 2 // 3 else 0.15
        new = []
        for q, (v, g) in enumerate(((w, g_w), (bias, g_b), (trans, g_t))):
            moment[q] = 0.9 * moment[q] + 0.1 * g
            square[q] = 0.98 * square[q] + 0.02 * g * g
            new.append(v + step * (moment[q] / (1 - 0.9**k)) / (np.sqrt(square[q] / (1 - 0.98**k)) + 1e-7))
        w, bias, trans = np.where(only_against, np.minimum(new[0], 0.0), new[0]), float(new[1]), new[2]
    heavy = np.abs(w) > 0.02
    model = Model(name[heavy], w[heavy], float(bias), trans, np.zeros(3))
    # the document's curve, on all given rows, block by block
    every = bias + np.bincount(every_row, w[every_col], n_words)
    total, most = np.zeros(len(ids)), np.zeros(len(ids))
    filled, done = np.flatnonzero([len(d) for d in ids]), 0
    for tok, _, starts, lengths, _ in blocks:
        if not len(tok):
            continue
        r, b = chains(every[tok], starts, lengths, trans)
        odds = r * b
        p, at = odds / (1 + odds), filled[done : done + len(starts)]
        total[at], most[at] = np.add.reduceat(p, starts), np.maximum.reduceat(p, starts)
        done += len(starts)
    z = document_inputs(total, most)
    dw = np.array(doc_weight, float) if doc_weight else np.ones(len(y))
    c = np.zeros(3)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        hess = (z * (dw * q * (1 - q))[:, None]).T @ z + 0.3 * np.diag([0.01, 1, 1])
        c = c + np.linalg.solve(hess, z.T @ (dw * (y - q)) - 0.3 * np.array([0.01, 1, 1]) * c)
    model.curve = c
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 4000, **how) -> Model:
    """The model from at most ``max_docs`` labelled rows, a quarter of them toxic if there are so many.

    Rows are drawn by the hash of their id, so reruns agree; labels that are null
    or repeated for an id, and labels without a document, take no part.
    """
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).filter("_y = _z")
    one = one.withColumn("_o", F.xxhash64("_id", F.lit(11)))
    drawn = [one.filter(F.col("_y") == k).orderBy("_o").limit(m) for k, m in ((1, max_docs // 4), (0, max_docs - max_docs // 4))]
    total = {r["_y"]: r["count"] for r in one.groupBy("_y").count().collect()}
    few = drawn[0].union(drawn[1]).select("_id", "_y")
    rows = exactly(docs, id_col, text_col).toDF("_id", "_text").join(F.broadcast(few), "_id").collect()  # max_docs rows at most
    rows.sort(key=lambda r: (r["_id"], r["_text"] or ""))
    texts, y = [r["_text"] for r in rows], [r["_y"] for r in rows]
    del rows
    got = Counter(y)
    weight = [total[k] / got[k] for k in y]
    scale = len(y) / sum(weight) if y else 1.0
    return fit(texts, y, [w * scale for w in weight], **how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch_words: int = 300_000) -> DataFrame:
    """The input's columns and score, n_toxic, spans of every row.

    spans are (start, end, probability) in characters of the runs of tokens whose
    marginal is above one half.  Null and empty texts have no tokens, no spans and
    the curve's value for none.  Repeated rows, ties and null ids are scored like any
    other.  Result columns that clash replace the input's; an empty table gives no
    rows.  A very long text is scored whole, in segments, and held by one task.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("score", "n_toxic", "spans")]
    # the text travels once: as a column of the input's own where it is one
    at = own.index(text_col) if text_col in own else len(own)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of max_docs documents
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def one(model, cache, docs_words, texts):
        lengths = np.array([len(d) for d in docs_words])
        e = np.empty(int(lengths.sum()))
        at = 0
        for d in docs_words:
            try:
                got = [cache[w] for w in d]
            except KeyError:
                if len(cache) > _CACHE_WORDS:
                    cache.clear()
                new = [w for w in set(d) if w not in cache]
                cache.update(zip(new, model.emissions(new).tolist(), strict=True))
                got = [cache[w] for w in d]
            e[at : at + len(d)] = got
            at += len(d)
        starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        some = lengths > 0
        r, b = chains(e, starts[some], lengths[some], model.trans)
        odds = r * b
        p = odds / (1 + odds)
        out = 1 / (1 + np.exp(-np.clip(model.document(p, starts, lengths), -30, 30)))
        spans, counts = [], []
        for text, s, n in zip(texts, starts.tolist(), lengths.tolist(), strict=True):
            hot = np.flatnonzero(p[s : s + n] > 0.5)
            counts.append(len(hot))
            spans.append(_spans(text, hot, p[s : s + n]) if len(hot) else [])
        return out, counts, spans

    def run(batches):
        model, cache = shipped.value, {}
        for batch in batches:
            out, counts, spans = [], [], []
            texts, words, n = [], [], 0

            def flush():
                s, c, sp = one(model, cache, words, texts)
                out.extend(s.tolist()), counts.extend(c), spans.extend(sp)

            for k in range(len(batch)):
                text = batch.column(at)[k].as_py()
                texts.append(text)
                words.append((text or "").encode().split())
                n += len(words[-1])
                if n >= batch_words:
                    flush()
                    texts, words, n = [], [], 0
            if texts:
                flush()
            arrays = [batch.column(i) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, span)], names=[*own, "score", "n_toxic", "spans"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own), "score double, n_toxic long, spans array<struct<start: bigint, end: bigint, probability: double>>"])
    return docs.select(*own, *([F.col(text_col)] if at == len(own) else [])).mapInArrow(lean(run), schema)


def keep_clean(docs: DataFrame, model: Model, below: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input's rows that score less than ``below``, with all its columns, whatever their names.

    Takes what ``score`` takes and treats nulls, empty texts, repeats and ties alike.
    """
    return by_position(docs, lambda x, id_col, text_col: score(x, model, id_col, text_col, **how).filter(F.col("score") < below), id_col=id_col, text_col=text_col)


def _spans(text: str, hot: np.ndarray, p: np.ndarray) -> list[dict]:
    """Runs of neighbouring hot tokens, with character offsets."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
    chars = lambda k: len(raw[:k].decode("utf-8", "replace"))
    return [{"start": chars(at[r[0]][0]), "end": chars(at[r[-1]][1]), "probability": float(p[r].max())} for r in runs]
