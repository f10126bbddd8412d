"""Scalar text functions as Columns (FN-01 .. FN-18, FTS-01/02, PRJ-13)."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: terms that match as the beginning of a word only (FN-05).
PREFIX_TERMS = ("fine-tun", "eval", "transcription")


def sha_id(value: Column, length: int = 16, prefix: str = "") -> Column:
    """FN-01, FN-10: ``prefix`` and the first hex digits of SHA-256 of the UTF-8 text."""
    digest = F.substring(F.sha2(value.cast("binary"), 256), 1, length)
    return F.concat(F.lit(prefix), digest) if prefix else digest


@F.pandas_udf(T.StringType())
def _nfkd(x: pd.Series) -> pd.Series:
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKD", s))


@F.pandas_udf(T.StringType())
def _folded(x: pd.Series) -> pd.Series:
    def fold(s):
        if s is None or s.isascii():
            return s
        return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))

    return x.map(fold)


def fold_diacritics(value: Column) -> Column:
    """FTS-02: letters of any script without their marks, for what ``tokens`` has no table for."""
    return _folded(value)


def slug(value: Column, ascii_only: bool = False) -> Column:
    """FN-02.  ``ascii_only`` skips the compatibility decomposition and stays inside the JVM."""
    x = value if ascii_only else _nfkd(value)
    x = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    x = F.substring(F.regexp_replace(x, "^-|-$", ""), 1, 64)
    return F.when(x == "", F.lit("record")).otherwise(x)


def strip_markdown(value: Column) -> Column:
    """FN-03: links become their text, emphasis and code marks go."""
    x = F.regexp_replace(value, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(x, r"[*_`]", ""))


def money_value(value: Column) -> Column:
    """FN-04: digits and points only; nothing left is 0, what is no number is null."""
    x = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9.]", "")
    return F.when(x == "", F.lit(0.0)).otherwise(x.try_cast("double"))


def money_micros(amount: Column) -> Column:
    """FN-12: exact micros; raises beyond 2**53 - 1, null stays null."""
    x = F.floor(amount * 1e6 + 0.5).cast("double")
    outside = F.raise_error(F.concat(F.lit("money amount is outside the safe range: "), amount.cast("string")))
    return F.when(x.isNull(), F.lit(None).cast("long")).when(F.abs(x) <= float((1 << 53) - 1), x.cast("long")).otherwise(outside)


def ascii_words(pattern: str) -> str:
    """Word boundaries that see ASCII letters, digits and underscores only, in every regex engine (T15)."""
    out = []
    for piece in re.split(r"(\\b)", pattern):
        out.append(r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))" if piece == r"\b" else piece)
    return "".join(out)


def term_pattern(term: str) -> str:
    """FN-05: the term between characters that are no ASCII letters or digits."""
    term = term.strip()
    return f"(?i)(?<![a-z0-9]){re.escape(term)}" + ("" if term in PREFIX_TERMS else "(?![a-z0-9])")


def contains_term(text: Column, term: str) -> Column:
    return text.rlike(term_pattern(term))


def prettify(label: Column) -> Column:
    """PRJ-13: dashes become spaces, words begin in upper case; underscores stay (T12)."""
    parts = F.split(F.regexp_replace(label, "-", " "), " ")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def collapsed(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))


def url_key(value: Column) -> Column:
    """Lower case, trimmed, without one trailing slash."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "/$", "")


def source_identity(kind: Column, url: Column, platform: Column, name: Column) -> Column:
    """FN-08: kind and url, or kind, platform and name where there is no url."""
    u = url_key(url)
    return F.when(u != "", F.concat_ws("|", kind, u)).otherwise(F.concat_ws("|", kind, collapsed(platform), collapsed(name)))


def record_identity(kind: Column, name: Column, url: Column) -> Column:
    """FN-09: the key of a record between two snapshots."""
    return F.concat_ws("|", kind, collapsed(name), url_key(url))


def _bases() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with marks, and the same without, by their decompositions."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(cp):
            pairs.append((chr(cp), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _bases()


def folded(value: Column) -> Column:
    """FTS-02: lower case without marks, all inside the JVM; tokens are its runs of letters and digits."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), _MARKED, _BARE)


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(folded(value), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def literalize(query: str, most_terms: int = 8, most_length: int = 64) -> list[list[str]]:
    """FTS-01: the query's first terms, each a phrase of tokens; an empty phrase matches nothing (FTS-04)."""
    terms = [t[:most_length] for t in unicodedata.normalize("NFKC", query or "").strip().split()]
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return [re.findall(r"[^\W_]+", fold(t).lower()) for t in terms if t][:most_terms]


def salvage_json(value: Column) -> Column:
    """FN-16: model output as JSON: without a code fence, else from the first to the last brace, else null."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    bare = trimmed(F.regexp_replace(F.regexp_replace(trimmed(value), r"(?is)^```(?:json)?\s*", ""), r"(?s)\s*```$", ""))
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.try_parse_json(x).isNotNull() & (x != "")
    return F.when(ok(bare), bare).when(ok(braces), braces)


@F.pandas_udf(T.StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """FN-11: keys sorted at every level, no white space."""
    return x.map(lambda s: None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def evidence_ids(x: pd.Series) -> pd.Series:
    """FN-15: every evidence id that some object of a JSON document lists in its support, first occurrences in order."""

    def walk(v, out):
        if isinstance(v, dict):
            support = v.get("support")
            if isinstance(support, dict) and isinstance(support.get("evidence_ids"), list):
                out.extend(i for i in support["evidence_ids"] if isinstance(i, str))
        for w in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            walk(w, out)
        return out

    return x.map(lambda s: None if s is None else list(dict.fromkeys(walk(json.loads(s), []))))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("evidence_ids", T.ArrayType(T.StringType()))]))
def cited_json(x: pd.Series) -> pd.DataFrame:
    """FN-11, and FN-15 of what it gives, of a document that is parsed once."""

    def walk(v, out):
        if isinstance(v, dict):
            support = v.get("support")
            if isinstance(support, dict) and isinstance(support.get("evidence_ids"), list):
                out.extend(i for i in support["evidence_ids"] if isinstance(i, str))
        for w in [v[k] for k in sorted(v)] if isinstance(v, dict) else v if isinstance(v, list) else ():
            walk(w, out)
        return out

    documents = [None if s is None else json.loads(s) for s in x]
    texts = [None if s is None else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for s, v in zip(x, documents, strict=True)]
    ids = [None if s is None else list(dict.fromkeys(walk(v, []))) for s, v in zip(x, documents, strict=True)]
    return pd.DataFrame({"text": pd.Series(texts, dtype=object), "evidence_ids": pd.Series(ids, dtype=object)})


def quote_offset(text: Column, quote: Column) -> Column:
    """FN-13: 0-based place of the first occurrence, -1 if there is none."""
    return F.call_function("instr", text, quote) - 1


def json_value(document: Column, path: str, kind: str = "string") -> Column:
    """FN-14: the value at a path as a type; null where it is absent, null or of another kind."""
    return F.try_variant_get(F.try_parse_json(document), path, kind)


def json_length(document: Column, path: str) -> Column:
    """FN-14: items of the array at a path, 0 where something else stands there, null where nothing does (T4)."""
    v = F.try_variant_get(F.try_parse_json(document), path, "variant")
    return F.when(v.isNotNull(), F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(0)))


def json_has(document: Column, path: str) -> Column:
    """FN-14: whether anything stands at the path, a JSON null included (T9)."""
    return F.try_variant_get(F.try_parse_json(document), path, "variant").isNotNull()


def html_escaped(value: Column) -> Column:
    """FN-21: text for a page; null is empty."""
    out = F.coalesce(value, F.lit(""))
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(c), F.lit(entity))
    return out
