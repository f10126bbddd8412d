"""Latest decisions from a stream of review events.  An extension: the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_decisions(events: DataFrame, target: str = "target", created_at: str = "created_at", event_id: str = "review_event_id", decision: str = "decision") -> DataFrame:
    """The last decision on each target so far, as an updating aggregate; canonicalization is ignored.

    State is one row for each target; write it with output mode ``update`` or ``complete``.
    """
    order = F.struct(F.col(created_at), F.col(event_id))
    x = events.filter(F.col(decision) != "canonicalize").groupBy(target).agg(F.max_by(F.struct(created_at, event_id, decision), order).alias("_last"))
    return x.select(target, "_last.*")
