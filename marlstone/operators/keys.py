"""Keys of a batch against those that are stored (SNK-11).

Every batch leaves the keys of its tables as a bucketed set and as Bloom filters: blocks of
32,768 bits, one block for each key, in so many blocks that a key has 16 bits. A new
batch asks the filters first; only what they let through is joined, exactly, with the buckets
that it falls into. Foreign keys are looked for in the batch itself and then in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Primary keys.
KEYS = {
    "source_snapshots": ["source_snapshot_id"],
    "evidence_spans": ["source_snapshot_id", "evidence_key"],
    "products": ["product_id"],
    "product_revisions": ["product_revision_id"],
    "opportunities": ["opportunity_id"],
    "opportunity_revisions": ["opportunity_revision_id"],
    "review_events": ["review_event_id"],
}
#: (table, columns, referenced table): null columns refer to nothing.
REFERENCES = [
    ("evidence_spans", ["source_snapshot_id"], "source_snapshots"),
    ("product_revisions", ["product_id"], "products"),
    ("product_revisions", ["source_snapshot_id"], "source_snapshots"),
    ("product_revisions", ["supersedes"], "product_revisions"),
    ("opportunities", ["product_id"], "products"),
    ("opportunity_revisions", ["opportunity_id"], "opportunities"),
    ("opportunity_revisions", ["product_revision_id"], "product_revisions"),
    ("opportunity_revisions", ["source_snapshot_id"], "source_snapshots"),
    ("opportunity_revisions", ["supersedes"], "opportunity_revisions"),
    ("review_events", ["product_revision_id"], "product_revisions"),
    ("review_events", ["opportunity_revision_id"], "opportunity_revisions"),
    ("facet_index", ["product_revision_id"], "product_revisions"),
    ("entitlement_index", ["opportunity_revision_id"], "opportunity_revisions"),
    ("constraint_index", ["opportunity_revision_id"], "opportunity_revisions"),
    ("condition_index", ["opportunity_revision_id"], "opportunity_revisions"),
]
BUCKETS, BLOCK_BITS, KEYS_A_BLOCK, PROBES = 64, 32_768, 2_000, 4


def key_of(columns: list[str]) -> Column:
    return F.concat_ws("\x1f", *[F.col(c) for c in columns])


def key_rows(parts: dict[str, DataFrame]) -> DataFrame | None:
    """of, key, bucket of every row of the tables that have a key."""
    each = [df.select(F.lit(t).alias("of"), key_of(KEYS[t]).alias("key")) for t, df in parts.items() if t in KEYS]
    if not each:
        return None
    return reduce(DataFrame.union, each).withColumn("bucket", F.pmod(F.xxhash64("of", "key"), F.lit(BUCKETS)).cast("int"))


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), "of", "key"), blocks)


def _bits() -> Column:
    """The key's places in its block, from 16 bits each of one hash."""
    h = F.xxhash64(F.lit(2), "of", "key")
    return F.array(*[F.shiftrightunsigned(h, 16 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for k in range(PROBES)])


def filters(keys: DataFrame, n: int) -> DataFrame:
    """blocks, block, bits: the filter of ``n`` keys; the number of blocks is a power of two."""
    blocks = 1
    while blocks * KEYS_A_BLOCK < n:
        blocks *= 2
    each = keys.select(_block(F.lit(blocks)).cast("long").alias("block"), F.explode(_bits()).alias("at"))
    return each.groupBy("block").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits")).select(F.lit(blocks).cast("long").alias("blocks"), "block", "bits")


def known(keys: DataFrame, key_sets: DataFrame, key_filters: DataFrame) -> DataFrame:
    """The (of, key) that are stored already: filters first, an exact join with the buckets of what they let through."""
    sizes = sorted(r[0] for r in key_filters.select("blocks").distinct().collect())  # powers of two, so few
    keys = keys.select("of", "key", "bucket").distinct()
    if not sizes:
        return keys.filter(F.lit(False)).select("of", "key")
    asked = keys.withColumn("blocks", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])))
    asked = asked.withColumn("block", _block(F.col("blocks")).cast("long")).withColumn("_at", _bits())
    byte = lambda p: F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(p, 3) + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.forall("_at", lambda p: F.get(F.array(*[F.lit(1 << k) for k in range(8)]), p % 8).bitwiseAND(byte(p)) != 0)
    passed = asked.join(key_filters, ["blocks", "block"]).filter(inside).select("of", "key", "bucket").distinct()
    buckets = [r[0] for r in passed.select("bucket").distinct().collect()]  # at most BUCKETS
    if not buckets:
        return keys.filter(F.lit(False)).select("of", "key")
    stored = key_sets.filter(F.col("bucket").isin(buckets)).select("of", "key")
    return passed.join(stored, ["of", "key"], "left_semi").select("of", "key")


def problems(parts: dict[str, DataFrame], key_sets: DataFrame, key_filters: DataFrame) -> DataFrame:
    """(of, key, rule_id) of rows that repeat a key, of the batch or a stored one, or refer to a row that is nowhere.

    For tables without a key of their own ``key`` is the reference.
    """
    own = key_rows(parts)
    out = []
    if own is not None:
        twice = own.groupBy("of", "key").count().filter("count > 1").select("of", "key")
        out.append(twice.union(known(own, key_sets, key_filters)).distinct().select("of", "key", F.lit("primary_key").alias("rule_id")))
    refs = []
    for table, columns, parent in REFERENCES:
        if table in parts and set(columns) <= set(parts[table].columns):
            x = parts[table].filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
            row = key_of(KEYS.get(table, columns))
            refs.append(x.select(F.lit(table).alias("_child"), row.alias("_row"), F.lit("->".join([*columns, parent])).alias("_rule"), F.lit(parent).alias("of"), key_of(columns).alias("key")))
    if refs:
        refs = reduce(DataFrame.union, refs).distinct()
        missing = refs if own is None else refs.join(own.select("of", "key").distinct(), ["of", "key"], "left_anti")
        asked = missing.select("of", "key").distinct().withColumn("bucket", F.pmod(F.xxhash64("of", "key"), F.lit(BUCKETS)).cast("int"))
        missing = missing.join(known(asked, key_sets, key_filters), ["of", "key"], "left_anti")
        out.append(missing.select(F.col("_child").alias("of"), F.col("_row").alias("key"), F.col("_rule").alias("rule_id")))
    if not out:
        return key_sets.filter(F.lit(False)).select("of", "key", F.lit("").alias("rule_id"))
    return reduce(DataFrame.union, out)
