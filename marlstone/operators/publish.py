"""Publication by ranking over append-only history (WIN-01..05, FLT-06..09, JON-02..04, AGG-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list, order: list[Column], keep: int = 1) -> DataFrame:
    """The first rows by the order within the keys; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= keep).drop("_rank")


def latest_reviews(reviews: DataFrame, keys: list, created_at: str = "created_at", event_id: str = "review_event_id", decision: str = "decision") -> DataFrame:
    """WIN-01, FLT-09: the last decision on each target; canonicalization is no decision on publication."""
    return latest(reviews.filter(F.col(decision) != "canonicalize"), keys, [F.col(created_at).desc(), F.col(event_id).desc()])


def eligible_latest(revisions: DataFrame, reviews: DataFrame, revision_id: str, keys: list[str], order: list[Column], gate: Column | None = None) -> DataFrame:
    """WIN-02, WIN-03, JON-02: revisions whose last decision is trust and that pass the gate, newest for each key.

    Filters stand before the rank, so an older trusted revision comes back when a
    newer one is rejected (T2).
    """
    more = [c for c in reviews.columns if c not in ("target", "decision")]
    trusted = reviews.filter(F.col("decision") == "trust").select(F.col("target").alias(revision_id), *more)
    rows = revisions.join(trusted, revision_id)
    return latest(rows.filter(gate) if gate is not None else rows, keys, order)


def described(description: Column, evidence: Column) -> Column:
    """FLT-06: a description that is not blank and has evidence."""
    return (F.length(F.trim(F.coalesce(description, F.lit("")))) > 0) & (F.coalesce(F.size(evidence), F.lit(0)) > 0)


def entitled(entitlements: Column) -> Column:
    """FLT-07, JON-08: at least one entitlement, none whose support lists no evidence; no support at all passes (T4)."""
    bare = F.exists(entitlements, lambda e: F.coalesce(F.size(e["support"]["evidence_ids"]) < 1, F.lit(False)) & e["support"].isNotNull() & e["support"]["evidence_ids"].isNotNull())
    return (F.coalesce(F.size(entitlements), F.lit(0)) > 0) & ~F.coalesce(bare, F.lit(False))


def uncontradicted(ambiguities: Column) -> Column:
    """FLT-08."""
    return ~F.coalesce(F.exists(ambiguities, lambda a: a["reason"] == "contradictory"), F.lit(False))


def published(opportunities: DataFrame, product_revisions: DataFrame, opportunity_revisions: DataFrame) -> DataFrame:
    """JON-03, JON-04, AGG-15: opportunities whose product and own revision are both published.

    Inputs are the ranked revisions with product_id / opportunity_id and decided_at.
    """
    p = product_revisions.withColumnRenamed("decided_at", "_p")
    o = opportunity_revisions.withColumnRenamed("decided_at", "_o")
    return opportunities.join(o, "opportunity_id").join(p, "product_id").withColumn("published_at", F.greatest("_p", "_o")).drop("_p", "_o")


def newest_first(df: DataFrame, limit: int, at: str = "published_at", tie: str = "opportunity_id") -> DataFrame:
    """SRT-02."""
    return df.orderBy(F.col(at).desc(), tie).limit(limit)
