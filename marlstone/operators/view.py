"""The published view, kept as batches come in (WIN-01..03, FLT-06..09).

Two narrow tables hold all that publication needs.  *revision_state* has a row for each revision
that is known or was decided on: its key, when it was observed, whether it passes its gate, and the
latest decision.  *key_state* has the trusted revisions that pass, by key, and marks the one
that stands.  Both lie in folders by hash bucket, and a refresh reads the new batches and
rewrites the buckets that they touch.  Merging takes the latest of all decisions, so the order in
which batches come does not matter: a decision may come before its revision.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Catalog
from .log import Conflict
from .publish import described
from .shared import scratch, written

BUCKETS = 32
SOURCES = ("product_revisions", "opportunity_revisions", "review_events")
_REVISION = "kind string, key string, observed_at string, passes boolean"
_DECISION = "decided_at string, review_event_id string, decision string"


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def news(catalog: Catalog, folders: dict[str, list[str]]) -> DataFrame:
    """revision_id, revision, decided of the rows of some folders; one of the two structs is null."""
    seen_at = F.coalesce("observed_at", "created_at")
    none = lambda ddl: F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ': ', 1) for x in ddl.split(', '))}>")
    rows = {t: catalog._load(t, folders.get(t, [])) for t in SOURCES}
    told = lambda t, kind, key, ok: rows[t].select(
        F.col(f"{kind}_revision_id").alias("revision_id"), F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), seen_at.alias("observed_at"), ok.alias("passes")).alias("revision"), none(_DECISION).alias("decided")
    )
    p = told("product_revisions", "product", "product_id", described(F.col("description"), F.col("description_evidence")))
    o = told("opportunity_revisions", "opportunity", "opportunity_id", F.coalesce(F.col("entitled") & ~F.col("contradictory"), F.lit(False)))
    e = rows["review_events"].filter("decision <> 'canonicalize'")
    e = e.select(F.coalesce("product_revision_id", "opportunity_revision_id").alias("revision_id"), none(_REVISION).alias("revision"), F.struct(F.col("created_at").alias("decided_at"), "review_event_id", "decision").alias("decided"))
    return p.union(o).union(e.filter("revision_id is not null"))


def is_fresh(catalog: Catalog) -> bool:
    meta = catalog.state.meta
    return "view" in meta and meta["view"] >= meta.get("data", 0)


def _rewritten(catalog: Catalog, table: str, rows: DataFrame, buckets: list[int]) -> tuple[dict[str, int], list[str]]:
    """Writes the buckets anew: the folders that came and those that went."""
    at = catalog.write(table, rows, uuid.uuid4().hex)
    got = [r[0] for r in catalog._load(table, [at]).select("bucket").distinct().collect()]  # at most BUCKETS
    gone = [p for p in catalog.state.live.get(table, ()) if int(p.rsplit("=", 1)[1]) in buckets]
    return {f"{at}/bucket={b}": 0 for b in got}, gone


def _of(catalog: Catalog, table: str, buckets: list[int]) -> DataFrame:
    return catalog._load(table, [p for p in catalog.state.live.get(table, ()) if int(p.rsplit("=", 1)[1]) in buckets])


def refresh(catalog: Catalog, most_tries: int = 5) -> None:
    """Folds the batches that came since the last refresh into the kept tables."""
    for _ in range(most_tries):
        version = catalog.refresh()
        if is_fresh(catalog):
            return
        folders: dict[str, list[str]] = {}
        for entry in catalog.log.entries(catalog.state.meta.get("view", 0) + 1, version):
            for t in SOURCES if entry.get("batch_id") else ():  # what is compacted has been folded, or is in its batch's own entry
                folders.setdefault(t, []).extend(entry.get("add", {}).get(t, ()))
        fresh = news(catalog, folders).withColumn("bucket", _bucket("revision_id"))
        buckets = [r[0] for r in fresh.select("bucket").distinct().collect()]
        old = _of(catalog, "revision_state", buckets)
        known = old.select("revision_id", F.when(F.col("kind").isNotNull(), F.struct("kind", "key", "observed_at", "passes")).alias("revision"), F.when(F.col("decision").isNotNull(), F.struct("decided_at", "review_event_id", "decision")).alias("decided"))
        both = known.withColumn("_new", F.lit(False)).unionByName(fresh.drop("bucket").withColumn("_new", F.lit(True)))
        merged = both.groupBy("revision_id").agg(F.max("revision").alias("r"), F.max("decided").alias("d"), F.max("_new").alias("_new"))
        with scratch(catalog.spark):
            merged = written(merged.select("revision_id", "r.*", "d.*", _bucket("revision_id").alias("bucket"), "_new"), "merged")
            add, remove = {}, {}
            add["revision_state"], remove["revision_state"] = _rewritten(catalog, "revision_state", merged.drop("_new"), buckets)
            touched = merged.filter("_new and key is not null").withColumn("bucket", _bucket("key"))
            key_buckets = [r[0] for r in touched.select("bucket").distinct().collect()]
            stands = touched.filter("decision = 'trust' and passes").select("kind", "key", "revision_id", "observed_at", "decided_at", "review_event_id", "bucket")
            rest = _of(catalog, "key_state", key_buckets).drop("best").join(touched.select("revision_id"), "revision_id", "left_anti")
            rows = rest.unionByName(stands)
            first = Window.partitionBy("bucket", "kind", "key").orderBy(F.col("observed_at").desc(), F.col("revision_id").desc())
            rows = rows.withColumn("best", F.row_number().over(first) == 1)
            add["key_state"], remove["key_state"] = _rewritten(catalog, "key_state", rows, key_buckets)
            try:
                catalog._state = catalog.log.commit(catalog.state, {"add": add, "remove": remove, "meta": {"view": version}})
                return
            except Conflict:
                continue
    raise Conflict(f"other writers came first {most_tries} times")


def standing(catalog: Catalog, kind: str) -> DataFrame:
    """The kind's revision that stands for each key, with its decision."""
    best = catalog.read("key_state").filter((F.col("kind") == kind) & F.col("best"))
    return best.select(F.col("revision_id").alias(f"{kind}_revision_id"), "decided_at", "review_event_id")
