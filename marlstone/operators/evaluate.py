"""Precision, recall and run folds (EVL-01, AGG-05..12, SET-03, LLM-02/03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, empty: float = 1.0) -> Column:
    """AGG-06: 1 when there is nothing to divide by."""
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def overlap(predicted: Column, expected: Column) -> tuple[Column, Column, Column]:
    """SET-03: true positives, false positives, false negatives of two id arrays."""
    return F.size(F.array_intersect(predicted, expected)), F.size(F.array_except(predicted, expected)), F.size(F.array_except(expected, predicted))


def precision_recall(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """AGG-05: one row of sums and guarded ratios."""
    s = df.agg(F.sum(tp).cast("long").alias("tp"), F.sum(fp).cast("long").alias("fp"), F.sum(fn).cast("long").alias("fn"))
    return s.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def evaluate(traces: DataFrame, labels: DataFrame, sources: DataFrame) -> DataFrame:
    """EVL-01: one row.  Sums run over labels that have a trace, rates over all labels (T14).

    traces: source_id, status, result struct(include, capabilities, user_needs,
    requirements array(evidence), possible_duplicate_names, unsupported_or_unknown);
    labels: source_id, name, include, capabilities, user_needs, duplicate_group;
    sources: source_id, raw_text.
    """
    members = labels.filter(F.col("duplicate_group").isNotNull()).select("duplicate_group", F.col("name").alias("_peer")).distinct()
    l = labels.join(members.groupBy("duplicate_group").agg(F.count("*").alias("_size")), "duplicate_group", "left")
    t = traces.filter(F.col("status") == "ok").select("source_id", "result")
    x = l.join(t, "source_id", "left").join(sources.select("source_id", "raw_text"), "source_id", "left")
    have, r = F.col("result").isNotNull(), F.col("result")
    named = F.array_distinct(r["possible_duplicate_names"])
    parts = {}
    for name, got, want in (("capability", r["capabilities"], F.col("capabilities")), ("need", r["user_needs"], F.col("user_needs"))):
        tp, fp, fn = overlap(got, want)
        parts |= {f"{name}_tp": F.sum(F.when(have, tp)), f"{name}_fp": F.sum(F.when(have, fp)), f"{name}_fn": F.sum(F.when(have, fn))}
    grounded = F.size(F.filter(r["requirements"], lambda q: F.contains(F.col("raw_text"), q["evidence"])))
    s = x.agg(
        F.count("*").alias("labels"), F.count_if(have).alias("valid"), F.count_if(have & (r["include"] == F.col("include"))).alias("include_right"),
        F.count_if(have & (F.size(r["unsupported_or_unknown"]) > 0)).alias("unknown_kept"), F.sum(F.when(have, grounded)).alias("grounded"), F.sum(F.when(have, F.size(r["requirements"]))).alias("requirements"),
        F.coalesce(F.sum(F.when(have, F.size(named))), F.lit(0)).alias("_named"), F.coalesce(F.sum(F.when(have, F.col("_size") - 1)), F.lit(0)).alias("_peers"), *[v.alias(k) for k, v in parts.items()],
    )
    # AGG-08: a member's peers are its group but itself, so their numbers come from the group's size and only named pairs are joined
    pairs = x.filter(have).select("duplicate_group", "name", F.explode(named).alias("_peer")).filter("_peer <> name").join(members, ["duplicate_group", "_peer"])
    s = s.crossJoin(pairs.agg(F.count("*").alias("duplicate_tp")))  # one row each
    s = s.withColumns({"duplicate_fp": F.col("_named") - F.col("duplicate_tp"), "duplicate_fn": F.col("_peers") - F.col("duplicate_tp")})
    out = [ratio(F.col("valid"), F.col("labels")).alias("schema_valid_rate"), ratio(F.col("include_right"), F.col("labels")).alias("inclusion_accuracy"), ratio(F.col("unknown_kept"), F.col("valid")).alias("unknown_preservation"), ratio(F.col("grounded"), F.col("requirements")).alias("grounding_rate")]
    for n in ("capability", "need", "duplicate"):
        tp, fp, fn = (F.coalesce(F.col(f"{n}_{k}"), F.lit(0)) for k in ("tp", "fp", "fn"))
        out += [ratio(tp, tp + fp).alias(f"{n}_precision"), ratio(tp, tp + fn).alias(f"{n}_recall")]
    return s.select(*out)


def final_attempts(attempts: DataFrame, run: str, attempt: str) -> DataFrame:
    """LLM-02: the last attempt of each run."""
    w = Window.partitionBy(run).orderBy(F.col(attempt).desc())
    return attempts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def run_status(attempts: DataFrame, run: str, ok: Column) -> DataFrame:
    """AGG-11: complete if every attempt is fine, partial if one is, else failed."""
    x = attempts.groupBy(run).agg(F.bool_and(ok).alias("_all"), F.bool_or(ok).alias("_any"))
    return x.select(run, F.when(F.col("_all"), "complete").when(F.col("_any"), "partial").otherwise("failed").alias("status"))
