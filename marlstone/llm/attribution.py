"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once as a whole.  Token character spans are joined to
section intervals by binary search on the sorted bounds, and a token that
crosses a bound is given to sections by an explicit rule:

``first``         the section of its first character
``last``          the section of its last character
``majority``      the section that holds most of its characters; ties to the earlier
``proportional``  every section it touches, by share of its characters

Each rule hands out every token exactly once, so a document's sections add up to
its token count.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import lean, small_batches

RULES = ("first", "last", "majority", "proportional")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """One section for each line, its line feed included; the empty text has none."""
    return [("line", m.start(), m.end()) for m in _LINE.finditer(text)]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section, tokens that touch it and tokens that touch it but cross its bounds.

    ``bounds`` are n + 1 ascending offsets of n abutting sections that cover the text.
    """
    n = len(bounds) - 1
    a = np.clip(np.searchsorted(bounds, starts, side="right") - 1, 0, n - 1)
    z = np.clip(np.searchsorted(bounds, ends - 1, side="right") - 1, 0, n - 1)
    touch = np.cumsum(np.bincount(a, minlength=n + 1)[: n + 1] - np.bincount(z + 1, minlength=n + 1)[: n + 1])[:n]
    cross = z > a
    ca, cz = a[cross], z[cross]
    crossing = np.cumsum(np.bincount(ca, minlength=n + 1)[: n + 1] - np.bincount(cz + 1, minlength=n + 1)[: n + 1])[:n]
    given = np.bincount(a[~cross], minlength=n).astype(float)
    for s, e, i, j in zip(starts[cross], ends[cross], ca, cz, strict=True):  # few: a token is a few characters long
        share = np.minimum(bounds[i + 1 : j + 2], e) - np.maximum(bounds[i : j + 1], s)
        if rule == "proportional":
            given[i : j + 1] += share / share.sum()
        else:
            given[{"first": i, "last": j, "majority": i + int(np.argmax(share))}[rule]] += 1
    return given, touch, crossing


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections: Callable[[str], list[tuple[str, int, int]]] = line_sections,
    rule: str = "majority",
    tokenizer: str | None = None,
) -> DataFrame:
    """id, section, name, start, end, n_tokens, n_touching, n_crossing for every section of every row.

    ``sections`` maps a text to abutting (name, start, end) intervals in characters
    that cover it.  Null and empty texts give one row: section 0, named ``empty``,
    with no tokens.  Repeated rows and null ids keep their own rows; other columns
    are ignored; an empty table gives no rows.  One narrow pass without a shuffle:
    memory is that of the longest text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    path = tokenizer or tokens.default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def flush(ids, rows):
        take, section, name, lo, hi, given, touch, crossing = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(take, pa.int64())), pa.array(section, pa.int32()), pa.array(name, pa.string()), *(pa.array(x, pa.int64()) for x in (lo, hi)), pa.array(given, pa.float64()), *(pa.array(x, pa.int64()) for x in (touch, crossing))],
            names=["_id", "section", "name", "start", "end", "n_tokens", "n_touching", "n_crossing"],
        )

    def count(batches):
        enc = tokens.encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts = sections(text) if text else []
                if not parts:
                    rows.append((i, 0, "empty", 0, 0, 0.0, 0, 0))
                    continue
                bounds = np.array([parts[0][1], *(p[2] for p in parts)])
                _, s, e = enc.spans(text)
                got = [x.tolist() for x in attribute(s, e, bounds, rule)]
                rows += [(i, k, p[0], p[1], p[2], g, t, c) for k, (p, g, t, c) in enumerate(zip(parts, *got, strict=True))]
                if len(rows) > 50_000:
                    yield flush(batch.column(0), rows)
                    rows = []
            if rows:
                yield flush(batch.column(0), rows)
        del enc
        tokens.forget()

    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {kind}, section int, name string, start long, end long, n_tokens double, n_touching long, n_crossing long"
    return plain.mapInArrow(lean(count), schema).withColumnRenamed("_id", id_col)
