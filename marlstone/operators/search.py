"""Need-first search: substring search, facet filters, containment (FLT-02, FLT-04, JON-06, JON-07, JON-17); full text is in ``index``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written



def like_all(text: Column, terms: list[str], also: dict[str, Column] | None = None) -> Column:
    """FLT-02: every one of the first 8 terms is in the text, or its flag of ``also`` holds (a linked row matched)."""
    out = F.lit(True)
    for t in [t.lower() for t in terms][:8]:
        hit = F.lower(text).contains(t)
        out = out & ((hit | also[t]) if also and t in also else hit)
    return out


def first_of(df: DataFrame, equal: dict[str, object], order: list[str], most: int) -> DataFrame:
    """FLT-01, SRT-08: the first rows by the order of those with these values."""
    hit = F.lit(True)
    for column, value in equal.items():
        hit = hit & (F.col(column) == F.lit(value))
    return df.filter(hit).orderBy(*order).limit(most)


def explorer_filter(rows: DataFrame, haystack: Column, q: str = "", needs: str = "needs", need: str = "", source: str = "", source_col: str = "source_kind") -> DataFrame:
    """FLT-18: rows with every word of the query somewhere in the haystack, the need and the source, as far as they are given."""
    hit = F.lit(True)
    for word in (q or "").lower().split():
        hit = hit & F.lower(haystack).contains(word)
    if need:
        hit = hit & F.exists(F.col(needs), lambda n: n["id"] == need)
    if source:
        hit = hit & (F.col(source_col) == source)
    return rows.filter(hit)


def with_link_flags(df: DataFrame, links: DataFrame, key: str, link_text: str, terms: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """JON-07 for OR-ed EXISTS: one grouped pass over the links gives a flag for each term."""
    terms = [t.lower() for t in terms][:8]
    flags = links.groupBy(key).agg(*[F.max(F.lower(link_text).contains(t)).alias(f"_l{i}") for i, t in enumerate(terms)])
    out = df.join(flags, key, "left")
    return out, {t: F.coalesce(F.col(f"_l{i}"), F.lit(False)) for i, t in enumerate(terms)}


def facet_and(df: DataFrame, facets: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """FLT-04: rows with every one of the first 8 distinct values.  One filtered aggregate, one semi join."""
    wanted = list(dict.fromkeys(wanted))[:8]
    if not wanted:
        return df
    have = facets.filter(F.col(value).isin(wanted)).groupBy(key).agg(F.count_distinct(value).alias("_n")).filter(F.col("_n") == len(wanted))
    return df.join(have, key, "left_semi")


def facet_counts(links: DataFrame, facet: str, target: str) -> DataFrame:
    """AGG-01: distinct targets of each facet value."""
    return links.groupBy(facet).agg(F.count_distinct(target).alias("n"))


#: Counters for grams, and slots of the filter that text places must pass.
_COUNTERS, _SLOTS = 1 << 20, 1 << 22


def _grams(value: Column, size: int, stride: int) -> Column:
    """Grams of ``size`` at every ``stride``-th place; shorter texts have none."""
    places = F.sequence(F.lit(0), F.greatest(F.length(value) - size, F.lit(0)), F.lit(stride))
    return F.when(F.length(value) >= size, F.transform(places, lambda i: F.substring(value, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def filed_quotes(texts: DataFrame, quotes: DataFrame, text: str, quote: str, size: int, stride: int) -> DataFrame:
    """(quote, _gram): each quote under ``stride`` grams behind each other, those that are rarest in the texts.

    A text that is looked at at every ``stride``-th place shows one of them wherever the quote
    stands.  Grams of texts are counted by hash with map-side combining, so what is shuffled is bounded
    by the counters; a collision makes a gram look more frequent and changes no result.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(_COUNTERS))
    counts = texts.select(F.explode(_grams(F.col(text), size, stride)).alias("g")).groupBy(slot("g").alias("_slot")).agg(F.count("*").alias("_n"))
    each = quotes.select(quote, F.posexplode(_grams(F.col(quote), size, 1)).alias("_o", "_gram"))
    each = each.withColumn("_slot", slot("_gram")).join(counts, "_slot", "left")
    along = Window.partitionBy(quote).orderBy("_o").rowsBetween(0, stride - 1)
    each = each.withColumns({"_sum": F.sum(F.coalesce("_n", F.lit(0))).over(along), "_full": F.count("*").over(along)})
    best = F.min(F.when(F.col("_full") == stride, F.struct("_sum", "_o"))).over(Window.partitionBy(quote))
    each = each.withColumn("_best", best["_o"]).filter((F.col("_o") >= F.col("_best")) & (F.col("_o") < F.col("_best") + stride))
    return each.select(quote, "_gram").distinct()


def _met(texts: DataFrame, quotes: DataFrame, text: str, quote: str, size: int, stride: int) -> DataFrame:
    """(_row, quote) for every text that holds the quote, by the quotes' rarest grams."""
    filed = written(filed_quotes(texts, quotes, text, quote, size, stride), "filed")
    slot = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.lit(_SLOTS))
    # one bit for each slot in pieces of 4 KB: one row of at most 512 KB
    pieces = filed.select(slot(F.col("_gram")).alias("s")).groupBy(F.shiftright("s", 15).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("s"))).alias("b"), F.min("s").alias("low"))
    bits = pieces.agg(F.map_from_entries(F.collect_list(F.struct("k", "b"))).alias("_bits"))
    position = F.bitmap_bit_position

    def passes(g: Column) -> Column:
        at = position(slot(g))
        byte = F.conv(F.hex(F.substring(F.element_at("_bits", F.shiftright(slot(g), 15)), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.get(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8).cast("int")).bitwiseAND(byte) != 0, F.lit(False))

    seen = texts.crossJoin(F.broadcast(bits))  # one row
    seen = seen.withColumn("_gram", F.explode(F.array_distinct(F.filter(_grams(F.col(text), size, stride), passes)))).drop("_bits")
    return seen.join(filed, "_gram").filter(F.contains(F.col(text), F.col(quote))).select("_row", quote).distinct()


def contains_join(texts: DataFrame, quotes: DataFrame, text: str, quote: str) -> DataFrame:
    """JON-17, FLT-12: rows whose text holds the quote exactly; nulls match nothing, the empty quote every text.

    A quote is filed under its rarest grams, and only those are looked for in the texts: quotes of 23
    code points and more under 16 grams of eight, for texts at every 16th place; shorter ones under one gram at every
    place, of eight or of their own length.  The exact test follows.  Only lengths that occur are looked for.
    """
    known = quotes.select(quote).filter(F.col(quote).isNotNull()).distinct()
    n = F.length(quote)
    kinds = [r[0] for r in known.select(F.when(n >= 23, 23).otherwise(F.least(n, F.lit(8))).alias("k")).distinct().collect()]  # ten kinds at most
    rows = texts.filter(F.col(text).isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "texts") if kinds else rows
    narrow, found = rows.select("_row", text), rows.select("_row", F.lit("").alias(quote)).filter(F.lit(False))
    for k in sorted(kinds):
        some = known.filter(n >= 23 if k == 23 else (n >= 8) & (n < 23) if k == 8 else n == k)
        found = found.union(narrow.select("_row", F.lit("").alias(quote)) if k == 0 else _met(narrow, some, text, quote, min(k, 8), 16 if k == 23 else 1))
    return rows.join(found, "_row").join(quotes, quote).drop("_row")
