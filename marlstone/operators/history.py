"""Snapshots, queues, constraints and append-only sinks (DIF-*, REV-*, SNK-*, IDN-*, JON-09..13, SET-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """WIN-07, T11."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(ordinal).desc()))).filter("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """SET-02: the first occurrence of each key stays."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(ordinal)))).filter("_rn = 1").drop("_rn")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, material: str) -> DataFrame:
    """DIF-01, JON-11: change_type, key, before, after; equal material gives no row."""
    b = before.select(key, F.col(material).alias("before"), F.lit(True).alias("_b"))
    a = after.select(key, F.col(material).alias("after"), F.lit(True).alias("_a"))
    x = b.join(a, key, "full_outer")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return x.select(key, kind.alias("change_type"), "before", "after").filter(F.col("change_type").isNotNull())


def write_snapshot(df: DataFrame, path: str, key: str, material: str, buckets: int = 256) -> None:
    """A snapshot in folders by hash bucket of its key, with a digest of each bucket that does not depend on order."""
    x = df.select(key, material).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    x.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    part = lambda salt: F.sum(F.xxhash64(F.lit(salt), key, F.isnull(material), material).cast("decimal(38,0)"))
    stored.groupBy("bucket").agg(F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b")).coalesce(1).write.parquet(f"{path}/digests")


def changed_buckets(spark: SparkSession, before: str, after: str) -> list[int]:
    """Buckets whose digests differ, or that one snapshot has alone."""
    d = lambda p, n: spark.read.parquet(f"{p}/digests").select("bucket", F.struct("n", "a", "b").alias(n))
    x = d(before, "_b").join(d(after, "_a"), "bucket", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return sorted(r[0] for r in x.select("bucket").collect())  # one for each bucket at most


def diff_snapshots(spark: SparkSession, before: str, after: str, key: str, material: str) -> DataFrame:
    """DIF-01 of two written snapshots: buckets with equal digests are not read."""
    wanted = changed_buckets(spark, before, after)
    some = lambda p: spark.read.parquet(f"{p}/rows").filter(F.col("bucket").isin(wanted) if wanted else F.lit(False))
    return snapshot_diff(some(before), some(after), key, material)


def change_fingerprint(change_type: Column, key: Column, before: Column, after: Column) -> Column:
    """DIF-02."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\n", change_type, key.cast("string"), blank(before), blank(after)).cast("binary"), 256)


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """SNK-03: the rows to append: the first new row of each key that is not there yet."""
    return first_wins(new.join(existing.select(*key).distinct(), key, "left_anti"), key, ordinal)


def insert_or_replace(existing: DataFrame, new: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """SNK-04: the whole table after the new rows took their keys' places."""
    fresh = last_wins(new, key, ordinal)
    return existing.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def violations(df: DataFrame, rules: dict[str, Column], key: Column) -> DataFrame:
    """SNK-11: (rule_id, row_key) of every broken rule, in one pass; a rule that is null holds."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.select(F.explode(broken).alias("rule_id"), key.cast("string").alias("row_key"))


def unique_violations(df: DataFrame, key: list[str], rule: str) -> DataFrame:
    return df.groupBy(*key).count().filter("count > 1").select(F.lit(rule).alias("rule_id"), F.concat_ws("|", *key).alias("row_key"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """JON-09, JON-12, JON-13: child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def promotion_blockers(changes: DataFrame, decisions: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """DIF-03, AGG-14, D2: changes of the latest run whose fingerprint is not accepted; empty means promotable."""
    ok = decisions.filter(F.col("status") == "accepted").select(fingerprint).distinct()
    return changes.join(ok, fingerprint, "left_anti")


# How a decision in the queue becomes a review event.
EVENT_OF = {"accepted": "trust", "rejected": "reject", "deferred": "request_revision"}


def apply_decisions(queue: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """REV-03: one event for each revision of a decided item, with an id that follows from review, revision and decision.

    Events that are there already are left out, so a retry appends nothing.
    """
    mapping = F.create_map(*[F.lit(x) for kv in EVENT_OF.items() for x in kv])
    kind = F.element_at(mapping, F.col("decision"))
    x = queue.join(decisions, "review_id").select("review_id", F.explode(F.array_distinct("revision_ids")).alias("revision_id"), kind.alias("decision"), "decided_at")
    x = x.withColumn("review_event_id", F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat_ws("\n", "review_id", "revision_id", "decision").cast("binary"), 256), 1, 32)))
    return x.join(events.select("review_event_id"), "review_event_id", "left_anti")


def decision_conflicts(events: DataFrame, queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """REV-03: items that are decided already in another way."""
    final = events.groupBy("review_id").agg(F.max("decision").alias("_d"))
    mapping = F.create_map(*[F.lit(x) for kv in EVENT_OF.items() for x in kv])
    return queue.join(decisions, "review_id").join(final, "review_id").filter(F.element_at(mapping, F.col("decision")) != F.col("_d")).select("review_id")


def decide(queue: DataFrame, review_id: str, decision: str, note: str, at: str) -> DataFrame:
    """REV-01, REV-04, SNK-06: the queue's rows after one decision on an open or deferred item."""
    if decision not in EVENT_OF:
        raise ValueError(f"decision must be one of {sorted(EVENT_OF)}")
    hit = (F.col("review_id") == review_id) & F.col("status").isin("open", "deferred")
    return queue.withColumns({"note": F.when(hit, F.lit(note)).otherwise(F.col("note")), "decided_at": F.when(hit, F.lit(at)).otherwise(F.col("decided_at")), "status": F.when(hit, F.lit(decision)).otherwise(F.col("status"))})


def supersedes(revisions: DataFrame, keys: list[str], order: list[Column], revision_id: str) -> DataFrame:
    """WIN-05, IDN-02: each revision with the one that it replaces."""
    return revisions.withColumn("supersedes", F.lag(revision_id).over(Window.partitionBy(*keys).orderBy(*order)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
