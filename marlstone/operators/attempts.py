"""Model runs with bounded repair (LLM-01..03, FN-16): the provider is a function that the caller supplies."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha_id
from . import contract
from .contract_columns import validate_candidates
from .shared import written


def extract(text: str | None):
    """FN-16 for one answer: JSON without a code fence, else between the outermost braces, else None."""
    import re

    bare = re.sub(r"\s*```$", "", re.sub(r"(?is)^```(?:json)?\s*", "", (text or "").strip())).strip()
    for part in (bare, bare[bare.find("{") : bare.rfind("}") + 1] if "{" in bare else ""):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def run_attempts(df: DataFrame, key: str, source_text: str, complete: Callable[[str, list[str]], str], concepts: dict[str, set[str]], units: set[str], max_attempts: int = 2) -> DataFrame:
    """key, attempt, status, candidate, errors, actions: each record until it is accepted or the attempts are used up.

    ``complete`` gets the source text and the failures so far.  A call that raises
    is a provider_error and is tried again; statuses are provider_error,
    parse_error, validation_error and accepted.  One round for each attempt: answers are
    written, so a provider is asked once whatever is lost later, and checked as columns;
    records that were not accepted go into the next round with what was wrong.
    """
    kind = df.schema[key].dataType.simpleString()

    def ask(batches):
        for pdf in batches:
            rows = []
            for r, k, text, failures in zip(pdf["_r"], pdf["_k"], pdf["_s"], pdf["_f"], strict=True):
                status, candidate, errors, actions = "answered", None, [], []
                try:
                    answer = complete(text, list(failures))
                except Exception as e:  # whatever a provider raises
                    status, errors = "provider_error", [str(e)]
                else:
                    found = extract(answer)
                    if found is None:
                        status, errors = "parse_error", ["the answer holds no JSON object"]
                    else:
                        fixed, actions = contract.normalized(found)
                        candidate = json.dumps(fixed, sort_keys=True, ensure_ascii=False)
                rows.append((r, k, text, status, candidate, errors, actions))
            yield pd.DataFrame(rows, columns=["_r", "_k", "_s", "status", "candidate", "errors", "actions"])

    todo = written(df.select(F.monotonically_increasing_id().alias("_r"), F.col(key).alias("_k"), F.col(source_text).alias("_s"), F.array().cast("array<string>").alias("_f")), "records")
    out = None
    for n in range(1, max_attempts + 1):
        told = written(todo.mapInPandas(ask, f"_r long, _k {kind}, _s string, status string, candidate string, errors array<string>, actions array<string>"), "answers")
        broken = validate_candidates(told.filter("status = 'answered'"), "_r", "_s", "candidate", concepts, units)
        broken = broken.groupBy("_r").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "message"))).alias("_broken"))
        status = F.when(F.col("status") != "answered", F.col("status")).when(F.col("_broken").isNotNull(), "validation_error").otherwise("accepted")
        done = told.join(broken, "_r", "left").withColumns({"status": status, "errors": F.coalesce("_broken", "errors"), "attempt": F.lit(n)})
        done = written(done.select("_r", "_k", "_s", "attempt", "status", "candidate", "errors", "actions"), "attempt")
        out = done if out is None else out.union(done)
        todo = done.filter("status <> 'accepted'").select("_r", "_k", "_s", F.col("errors").alias("_f"))
    return out.select(F.col("_k").alias(key), "attempt", "status", "candidate", "errors", "actions")


def started_runs(df: DataFrame, snapshot: str, provider: str, model: str) -> DataFrame:
    """LLM-03: a run in state ``running`` for each observation that a model is asked about."""
    run_id = sha_id(F.concat_ws("\n", F.col(snapshot), F.lit(provider), F.lit(model)), 24, "run_")
    return df.select(run_id.alias("run_id"), F.col(snapshot).alias("source_snapshot_id"), F.lit(provider).alias("provider"), F.lit(model).alias("requested_model"), F.lit("running").alias("status"))


def finished_runs(runs: DataFrame, attempts: DataFrame, key: str = "run_id") -> DataFrame:
    """LLM-03: runs with their end: ``review_required`` if an attempt was accepted, else ``failed`` with the last error.

    A run without an attempt is still running.  AGG-12: errors are joined by `` | ``.
    """
    last = attempts.groupBy(F.col(key).alias("run_id")).agg(F.count("*").alias("attempt_count"), F.bool_or(F.col("status") == "accepted").alias("_ok"), F.max_by("status", "attempt").alias("_status"), F.max_by("errors", "attempt").alias("_errors"))
    said = F.when(F.size("_errors") > 0, F.array_join("_errors", " | ")).otherwise(F.col("_status"))
    x = runs.drop("status").join(last, "run_id", "left")
    status = F.when(F.col("_ok"), "review_required").when(F.col("attempt_count") > 0, "failed").otherwise("running")
    return x.withColumns({"status": status, "error": F.when(~F.col("_ok"), said)}).drop("_ok", "_status", "_errors")


def review_requests(runs: DataFrame, ingested: DataFrame) -> DataFrame:
    """LLM-03: the review of what an accepted run has entered.

    ingested: source_snapshot_id, product_revision_id, opportunity_revision_id (null where there is none).
    """
    made = ingested.groupBy("source_snapshot_id", "product_revision_id").agg(F.array_sort(F.collect_set("opportunity_revision_id")).alias("opportunity_revision_ids"))
    x = runs.filter(F.col("status") == "review_required").join(made, "source_snapshot_id")
    return x.select(sha_id(F.col("run_id"), 24, "rr_").alias("review_id"), "run_id", "product_revision_id", "opportunity_revision_ids", F.lit("open").alias("status"))
