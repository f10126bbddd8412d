"""Full text by a stored inverted index: phrases, AND, BM25 (FTS-01..05, FLT-03, AGG-13, JON-05).

The index is three tables, written with the documents.  *postings* hold a row for each term,
document and column with the term's positions; *terms* the number of documents of each term;
*totals* the number of documents and tokens.  The last two are of one batch each and are summed
when they are read.  Postings and terms lie in folders by hash bucket of the term, sorted by term, so a
query reads the buckets of its own terms.  A phrase is an intersection of shifted positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import literalize, tokens

BUCKETS = 64


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_tables(docs: DataFrame, key: str, columns: list[str]) -> dict[str, DataFrame]:
    """FTS-02: the three tables of documents with a unique key; a null text has no tokens.

    Texts are tokenised twice: for their postings and for the totals, which shuffle nothing.
    """
    spoken = docs.select(F.col(key).cast("string").alias("key"), *[tokens(F.col(f"`{c}`")).alias(f"_t{i}") for i, c in enumerate(columns)])
    length = sum((F.size(f"_t{i}").cast("long") for i in range(len(columns))), F.lit(0).cast("long"))
    spoken = spoken.withColumn("length", length)
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.col(f"_t{i}").alias("t")) for i in range(len(columns))])
    each = spoken.select("key", "length", F.explode(parts).alias("p")).select("key", "length", "p.part", F.posexplode("p.t").alias("at", "term"))
    # a document is in one task, so its terms are collected before anything is shuffled
    postings = each.groupBy("term", "key", "part", "length").agg(F.sort_array(F.collect_list("at")).alias("positions"))
    terms = spoken.select("key", F.explode(F.array_distinct(F.flatten(F.array(*[f"_t{i}" for i in range(len(columns))])))).alias("term"))
    return {
        "search_postings": postings.select("term", "key", "part", "positions", "length", bucket_of(F.col("term")).alias("bucket")),
        "search_terms": terms.groupBy("term").agg(F.count("*").alias("documents")).select("term", "documents", bucket_of(F.col("term")).alias("bucket")),
        "search_totals": spoken.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).filter("documents > 0"),
    }


class SearchIndex:
    """Searches three tables as ``index_tables`` gives them; ``key`` names the document's key in results and ``kind`` is its type."""

    def __init__(self, postings: DataFrame, terms: DataFrame, totals: DataFrame, key: str, kind: str = "string"):
        self.postings, self.terms, self.totals, self.key, self.kind = postings, terms, totals, key, kind

    @staticmethod
    def _of(table: DataFrame, wanted: list[str]) -> DataFrame:
        """Rows of the terms; the condition on the bucket alone selects folders."""
        here = reduce(lambda a, b: a | b, [F.col("bucket") == bucket_of(F.lit(t)) for t in wanted])
        return table.filter(here & F.col("term").isin(wanted))

    def _counted(self, phrases: list[list[str]]) -> DataFrame:
        """key, length and the occurrences f0, f1, ... of each phrase in every document with any of the terms."""
        wanted = sorted({t for p in phrases for t in p})
        rows = self._of(self.postings, wanted).repartition("key")  # both groupings below keep to it
        place = {t: F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{i}") for i, t in enumerate(wanted)}
        each = rows.groupBy("key", "part").agg(F.max("length").alias("length"), *place.values())

        def found(phrase: list[str]) -> Column:
            shifted = lambda t, k: F.transform(f"_p{wanted.index(t)}", lambda x: x - k)
            at = [shifted(t, k) for k, t in enumerate(phrase)]
            return F.coalesce(F.size(reduce(F.array_intersect, at)), F.lit(0)).cast("long")

        counts = each.select("key", "length", *[F.when(F.forall(F.array(*[F.col(f"_p{wanted.index(t)}").isNotNull() for t in p]), lambda x: x), found(p)).otherwise(0).alias(f"f{i}") for i, p in enumerate(phrases)])
        return counts.groupBy("key").agg(F.max("length").alias("length"), *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(phrases))])

    def _none(self, *more: Column) -> DataFrame:
        return self.totals.filter(F.lit(False)).select(F.lit(None).cast(self.kind).alias(self.key), *more)

    def matching(self, query: str | list[list[str]]) -> DataFrame:
        """FTS-01..04, FLT-03: keys of the documents with every phrase in some column; a phrase without tokens matches nothing."""
        phrases = literalize(query) if isinstance(query, str) else query
        if not phrases or not all(phrases):
            return self._none()
        hits = self._counted(phrases)
        return hits.filter(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(phrases))])).select(F.col("key").cast(self.kind).alias(self.key))

    def bm25(self, query: str | list[list[str]], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """FTS-05, AGG-13: (key, rank) of documents that match every phrase; lower is better.

        Statistics are over the whole index, whatever is filtered outside (T10).  How many documents
        hold a phrase is known for one token; of longer ones those that match are counted.
        """
        phrases = literalize(query) if isinstance(query, str) else query
        if not phrases or not all(phrases):
            return self._none(F.lit(0.0).alias("rank"))
        hits = self._counted(phrases)
        single = {i: p[0] for i, p in enumerate(phrases) if len(p) == 1}
        stats = self.totals.agg(F.sum("documents").alias("_n"), (F.sum("tokens") / F.sum("documents")).alias("_average"))
        if single:
            known = self._of(self.terms, sorted(set(single.values())))
            stats = stats.crossJoin(known.agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("documents"))), F.lit(0)).alias(f"_d{i}") for i, t in single.items()]))  # one row each
        if len(single) < len(phrases):
            stats = stats.crossJoin(hits.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"_d{i}") for i in range(len(phrases)) if i not in single]))
        every = reduce(lambda a, c: a & c, [F.col(f"f{i}") > 0 for i in range(len(phrases))])
        scored = hits.filter(every).crossJoin(F.broadcast(stats))  # one row
        total = F.lit(0.0)
        for i in range(len(phrases)):
            f, d = F.col(f"f{i}"), F.col(f"_d{i}")
            raw = F.ln((F.col("_n") - d + 0.5) / (d + 0.5))
            idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
            total = total + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / F.col("_average")))
        return scored.select(F.col("key").cast(self.kind).alias(self.key), (-total).alias("rank"))


def build(docs: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Writes the index of documents into a folder."""
    for name, df in index_tables(docs, key, columns).items():
        if "bucket" in df.columns:
            df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            df.write.parquet(f"{path}/{name}")


def open_index(spark, path: str, key: str, kind: str = "string") -> SearchIndex:
    return SearchIndex(*[spark.read.parquet(f"{path}/{n}") for n in ("search_postings", "search_terms", "search_totals")], key, kind)
