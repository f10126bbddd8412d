"""Queries that run the catalog's own operators over documents made from ``part``, each with its SQL.

Every part is a source: its text, and a candidate as JSON that breaks rules by
arithmetic on the key, so SQL can say which.  For the read side all parts are
observed once and every third a second time, reviewed by arithmetic too, in one
catalog for each folder of tables, which the queries share.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import api, attempts, contract, contract_columns, evaluate, history, legacy, search, view
from ..operators.catalog import Catalog, ingest, observe
from ..operators.engine import CatalogEngine, bounded_params, open_catalog
from ..operators.shared import kept_folder, new_folder
from ..sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _put(spark: SparkSession, path: str, content: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content.encode()))
    out.close()
    return path


# --- candidates

CONCEPTS, UNITS = {"capability": {"standard", "economy", "promo", "large", "small"}}, {"hour"}
_JAN, _FEB = "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"
#: Parts that one task makes candidates of.
_DEALT = 5_000
_WHAT = '{"basis": "explicit", "evidence_ids": ["ev_what"]}'
_OFFER = '{"basis": "explicit", "evidence_ids": ["ev_offer"]}'


def _sources(spark: SparkSession, d: str) -> DataFrame:
    k, part = F.col("p_partkey").cast("string"), _table(spark, d, "part")
    # a candidate is a hundred times its part, which lies in few splits; so the narrow rows are dealt out before they grow
    part = part.repartition(1 + part.count() // _DEALT, "p_partkey")
    p = part.select("p_partkey", "p_name", "p_brand", F.lower("p_type").alias("t"), "p_size", "p_retailprice", F.concat_ws(" ", "p_name", k).alias("name"), F.concat(F.lit("https://parts.test/"), k).alias("url"))
    at = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit(" at "), "url")).otherwise(F.lit(""))
    p = p.withColumn("q1", F.concat("name", F.lit(" runs "), "t", F.lit(" jobs"), at))
    p = p.withColumn("q2", F.concat(F.col("p_size").cast("string"), F.lit(" hours per month"), F.when(F.col("p_partkey") % 3 != 0, F.lit(" for 3 months")).otherwise(F.lit(""))))
    return p.withColumn("source_text", F.concat("q1", F.lit(". Everyone gets "), "q2", F.lit(". Public.")))


def _mod(m: int, r: int) -> Column:
    return F.col("p_partkey") % m == r


def _if(test: Column, then: str, other: str = "") -> Column:
    return F.when(test, F.lit(then)).otherwise(F.lit(other))


def _quoted(*parts) -> Column:
    return F.concat(F.lit('"'), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit('"'))


def _json(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _doubtful() -> Column:
    """A candidate that breaks VAL-01 to VAL-17 by arithmetic on the key."""
    size = F.col("p_size").cast("string")
    each = lambda key: _json(
        f'{{"key": "{key}", "kind": "included_usage", "label": "Hours", ', F.when(_mod(13, 2), F.lit("")).otherwise(_json('"quantity": {"value": ', size, ', "comparator": "exact", "source_unit": "hours", "normalized_unit": "', _if(_mod(29, 7), "parsec", "hour"), '"}, ')),
        '"cadence": {"interval": 1, "unit": "month", "alignment": "unknown"}, "duration": {"value": 3, "unit": "month"}, "cost_scope": "usage", "applies_to": [{"target_type": "product", "source_label": ', _quoted(F.col("name")), f'}}], "support": {_OFFER}}}',
    )
    return _json(
        '{"contract_version": "', _if(_mod(11, 1), "9", "0.1.0"), '", "vocabulary_version": "0.1.0", "source_snapshot_id": "srcsnap_0001", "observed_at": "', _if(_mod(5, 4), "2026-13-01T00:00:00Z", _JAN), '", ',
        '"evidence_spans": [{"id": "ev_what", "quote": ', _quoted(F.col("q1"), _if(F.col("p_size") % 10 == 0, " zzz")), '}, {"id": "ev_offer", "quote": ', _quoted(F.col("q2")), "}], ",
        '"product": {"source_name": ', _quoted(F.col("name")), ', "proposed_canonical_name": null, "description": {"text": ', _quoted(_if(F.col("p_size") % 7 == 0, "Free "), F.col("name"), " runs ", F.col("t"), " jobs."), f', "support": {_WHAT}}}, ',
        '"organization_roles": [{"organization_name": ', _quoted(F.when(F.col("p_brand").endswith("1"), F.lit("Other Org")).otherwise(F.col("p_name"))), f', "role": "operator", "support": {_WHAT}}}], ',
        '"links": [{"role": "canonical_product", "url": ', _quoted(F.col("url")), f', "support": {_WHAT}}}], ',
        '"facets": [', F.when(_mod(19, 6), F.lit("")).otherwise(_json('{"namespace": "capability", "concept_id": ', _quoted(F.col("t")), f', "support": {_WHAT}}}')), '], "claimed_outcomes": []}, ',
        '"opportunities": [{"local_key": "', _if(_mod(31, 8), "opportunity", "hours"), '", "variant_label": null, "plan_label": null, "availability": {"value": "', _if(_mod(41, 10), "eligibility_gated", "public"), '", "support": {"basis": "inferred", "evidence_ids": ["ev_what"]}}, ',
        _if(_mod(37, 9), f'"effective_period": {{"from": "{_FEB}", "to": "{_JAN}", "support": {_WHAT}}}, '), '"entitlements": [', each("hours_each"), F.when(_mod(47, 12), _json(", ", each("again"))).otherwise(F.lit("")), "], ",
        '"constraints": [{"key": "keep", "kind": "', _if(_mod(17, 3), "other", "retention"), f'", "label": "kept", "target_key": "hours_each", "support": {_OFFER}}}], ',
        '"conditions": [{"key": "login", "family": "boolean_requirement", "kind": "login", "required": true, "target_key": "', _if(_mod(43, 11), "nothing", "opportunity"), f'", "support": {_WHAT}}}], "ambiguities": [], "links": []}}], ',
        '"possible_canonical_matches": [', F.when(_mod(23, 5), _json('{"candidate_name": ', _quoted(" ", F.upper("name"), " "), f', "candidate_url": null, "support": {_WHAT}}}')).otherwise(F.lit("")), "]}",
    )


_RULES = """p AS (SELECT *, p_partkey AS k, lower(p_type) AS t, 1 + (p_partkey % 47 = 12)::INT AS e FROM part),
st AS (SELECT k, 'VAL-01' AS rule_id, (k % 11 = 1)::INT AS n FROM p UNION ALL SELECT k, 'VAL-02', (k % 13 = 2)::INT * e FROM p UNION ALL SELECT k, 'VAL-03', (k % 17 = 3)::INT FROM p),
whole AS (SELECT * FROM p WHERE k NOT IN (SELECT k FROM st WHERE n > 0)),
se AS (SELECT k, 'VAL-04' AS rule_id, (k % 5 = 4)::INT AS n FROM whole UNION ALL SELECT k, 'VAL-05', (p_size % 10 = 0)::INT FROM whole UNION ALL SELECT k, 'VAL-06', (p_size % 7 = 0)::INT FROM whole
 UNION ALL SELECT k, 'VAL-07', (p_brand LIKE '%1')::INT FROM whole UNION ALL SELECT k, 'VAL-08', (k % 23 = 5)::INT FROM whole UNION ALL SELECT k, 'VAL-09', (k % 19 = 6)::INT FROM whole
 UNION ALL SELECT k, 'VAL-10', (k % 19 <> 6 AND t = 'medium')::INT + (k % 29 = 7)::INT * e FROM whole UNION ALL SELECT k, 'VAL-11', (k % 31 = 8)::INT FROM whole UNION ALL SELECT k, 'VAL-12', (k % 37 = 9)::INT FROM whole
 UNION ALL SELECT k, 'VAL-13', (k % 41 = 10)::INT FROM whole UNION ALL SELECT k, 'VAL-14', (k % 3 = 0)::INT * e FROM whole UNION ALL SELECT k, 'VAL-15', (k % 43 = 11)::INT FROM whole
 UNION ALL SELECT k, 'VAL-16', (k % 47 = 12)::INT FROM whole UNION ALL SELECT k, 'VAL-17', (k % 4 = 0)::INT FROM whole)"""


@query(f"WITH {_RULES} SELECT k AS p_partkey, rule_id, n::BIGINT AS n FROM (SELECT * FROM st UNION ALL SELECT * FROM se) WHERE n > 0")
def validate_candidates(spark, d):
    """VAL-01..17, FLT-13, FLT-14, FN-20, JON-14: every broken rule of every candidate, structure first."""
    x = _sources(spark, d).select("p_partkey", "source_text", _doubtful().alias("candidate"))
    found = contract_columns.validate_candidates(x, "p_partkey", "source_text", "candidate", CONCEPTS, UNITS)
    return found.groupBy("p_partkey", "rule_id").agg(F.count("*").alias("n"))


@query("""SELECT rule_id, row_key FROM (SELECT 'source_snapshot_id' AS rule_id, p_partkey::VARCHAR AS row_key FROM part WHERE p_partkey % 7 = 0 UNION ALL
 SELECT 'observed_at', p_partkey::VARCHAR FROM part WHERE p_partkey % 5 = 4 UNION ALL SELECT 'product.source_name', p_partkey::VARCHAR FROM part WHERE p_size > 40)""")
def validate_runs(spark, d):
    """VAL-18: the candidate speaks of the observation that it was asked about."""
    name = F.when(F.col("p_size") > 40, F.lit("another")).otherwise(F.col("name"))
    x = _sources(spark, d).select("p_partkey", _doubtful().alias("candidate"), _if(_mod(7, 0), "srcsnap_0002", "srcsnap_0001").alias("snapshot"), F.lit(_JAN).alias("at"), name.alias("asked"))
    return history.violations(x, contract.run_rules("candidate", "snapshot", "at", "asked"), F.col("p_partkey"))


_LOOSE = """SELECT p_partkey, (2 + (k % 5 = 0)::INT + (k % 3 = 0)::INT + 1 + (k % 7 = 0)::INT + (k % 11 = 0)::INT)::INT AS n_actions,
 CASE WHEN k % 2 = 0 THEN p_name || ' ' || k || ' runs ' || lower(p_type) || ' jobs' || CASE WHEN k % 4 <> 0 THEN ' at https://parts.test/' || k ELSE '' END END AS description,
 'inferred' AS basis, 'unknown' AS alignment, k % 3 <> 0 AS has_duration, false AS has_percentage, false AS has_maximum, false AS has_period FROM (SELECT *, p_partkey AS k FROM part)"""


@query(_LOOSE)
def normalize_candidates(spark, d):
    """NRM-01, NRM-04..09, FLT-15: what the repairs leave of loose candidates."""
    c = _json(
        '{"evidence_spans": [{"id": "ev_what", "quote": ', _quoted(F.col("q1")), '}, {"id": "ev_offer", "quote": ', _quoted(F.col("q2")), "}], ",
        '"product": {"proposed_canonical_name": null, "description": ', F.when(_mod(2, 0), _quoted(F.col("q1"))).otherwise(_quoted("nowhere ", F.col("url"))), ', "claimed_outcomes": []}, ',
        '"opportunities": [{"variant_label": null, "plan_label": null, ', _if(_mod(5, 0), '"effective_period": null, '), f'"availability": {{"value": "public", "support": {_WHAT}}}, ',
        '"entitlements": [{"kind": "included_usage", "cadence": {"interval": 1, "unit": "month", "alignment": "calendar"}, "duration": {"value": 3, "unit": "month"}, ',
        _if(_mod(7, 0), '"percentage_value": {"value": 1, "comparator": "exact"}, '), _if(_mod(11, 0), '"maximum_value": {"amount": 0, "currency": "USD", "comparator": "exact"}, '), f'"support": {_OFFER}}}]}}]}}',
    )
    x = contract.normalize_candidates(_sources(spark, d).select("p_partkey", c.alias("c")), "p_partkey", "c")
    at = lambda path: F.get_json_object("candidate", path)
    first = "$.opportunities[0].entitlements[0]"
    has = lambda path: at(path).isNotNull()
    return x.select(
        "p_partkey", F.size("actions").alias("n_actions"), at("$.product.description.text").alias("description"), at("$.opportunities[0].availability.support.basis").alias("basis"), at(f"{first}.cadence.alignment").alias("alignment"),
        has(f"{first}.duration").alias("has_duration"), has(f"{first}.percentage_value").alias("has_percentage"), has(f"{first}.maximum_value").alias("has_maximum"), has("$.opportunities[0].effective_period").alias("has_period"),
    )


# --- the catalog


def _sound(at: str) -> Column:
    """A valid candidate of all kinds of conditions, with what the gates look at by arithmetic on the key."""
    evidence = lambda test: _json('{"basis": "explicit", "evidence_ids": [', _if(test, "", '"ev_offer"'), "]}")
    return _json(
        '{"contract_version": "0.1.0", "vocabulary_version": "0.1.0", "source_snapshot_id": ', _quoted(F.col("source_snapshot_id")), f', "observed_at": "{at}", ',
        '"evidence_spans": [{"id": "ev_what", "quote": ', _quoted(F.col("q1")), '}, {"id": "ev_offer", "quote": ', _quoted(F.col("q2")), '}, {"id": "ev_public", "quote": "Public."}], ',
        '"product": {"source_name": ', _quoted(F.col("source_name")), ', "proposed_canonical_name": null, "description": ', F.when(_mod(8, 0), F.lit("null")).otherwise(_json('{"text": ', _quoted("Runs ", F.col("t"), " jobs."), f', "support": {_WHAT}}}')),
        ', "organization_roles": [], "links": [], "facets": [{"namespace": "capability", "concept_id": ', _quoted(F.col("t")), f', "support": {_WHAT}}}, {{"namespace": "interface", "concept_id": "api", "support": {{"basis": "inferred", "evidence_ids": ["ev_what"]}}}}], ',
        f'"claimed_outcomes": [{{"text": "Done sooner", "support": {_WHAT}}}]}}, ',
        '"opportunities": [{"local_key": "hours", "variant_label": null, "plan_label": null, "availability": {"value": "public", "support": {"basis": "explicit", "evidence_ids": ["ev_public"]}}, ',
        '"entitlements": [{"key": "hours_each", "kind": "included_usage", "label": "Hours", "quantity": {"value": ', F.col("p_size").cast("string"), ', "comparator": "exact", "source_unit": "hours", "normalized_unit": "hour"}, ',
        '"cadence": {"interval": 1, "unit": "month", "alignment": "unknown"}, "cost_scope": "usage", "applies_to": [{"target_type": "product", "source_label": ', _quoted(F.col("source_name")), '}, {"target_type": "plan", "source_label": "all"}], "support": ', evidence(_mod(9, 0)), "}, ",
        '{"key": "credit", "kind": "monetary_credit", "label": "Credit", "monetary_value": {"amount": ', F.col("p_retailprice").cast("string"), f', "currency": "USD", "comparator": "exact"}}, "cost_scope": "usage", "applies_to": [], "support": {_OFFER}}}], ',
        f'"constraints": [{{"key": "keep", "kind": "retention", "label": "kept", "target_key": "hours_each", "support": {_OFFER}}}, {{"key": "burst", "kind": "other", "other_kind": "burst_rate", "label": "b", "target_key": "hours_each", ',
        '"quantity": {"value": ', F.col("p_size").cast("string"), f', "comparator": "up_to", "source_unit": "h", "normalized_unit": "hour"}}, "cadence": {{"interval": 2, "unit": "day", "alignment": "rolling"}}, "support": {_OFFER}}}], ',
        '"conditions": [{"key": "login", "family": "boolean_requirement", "kind": "login", "required": ', _if(_mod(2, 0), "true", "false"), f', "target_key": "opportunity", "support": {_WHAT}}}, ',
        f'{{"key": "token", "family": "external_credential", "credential_type": "api_key", "required": true, "target_key": "opportunity", "support": {_WHAT}}}, ',
        '{"key": "who", "family": "audience", "audiences": ["student", "startup"], "source_label": "s", "verification_required": ', _if(_mod(2, 0), "true", "null"), f', "target_key": "opportunity", "support": {_WHAT}}}, ',
        '{"key": "where", "family": "geography", "mode": "', _if(_mod(3, 0), "excluded", "included"), f'", "regions": ["EU", "US"], "target_key": "opportunity", "support": {_WHAT}}}, ',
        f'{{"key": "tax", "family": "other", "normalized_key": "vat_id", "state": "conditional", "source_value": "v", "target_key": "opportunity", "support": {_WHAT}}}], ',
        '"ambiguities": [', F.when(_mod(10, 0), F.lit(f'{{"key": "amb", "target_key": "hours_each", "field": "scope", "reason": "contradictory", "note": "n", "support": {_OFFER}}}')).otherwise(F.lit("")), '], "links": []}], "possible_canonical_matches": []}',
    )




def _build_catalog(spark: SparkSession, d: str, path: str) -> None:
    c = Catalog.open(spark, path)
    for n, (at, some) in enumerate(((_JAN, F.lit(True)), (_FEB, _mod(3, 0)))):
        s = _sources(spark, d).filter(some)
        records = s.select(F.lit("readme").alias("source_kind"), F.concat(F.lit("parts:"), F.col("p_partkey").cast("string")).alias("source_locator"), F.col("name").alias("source_name"), F.col("url").alias("source_url"), F.lit("p").alias("source_platform"), F.col("source_text").alias("raw_text"), "p_partkey", "p_size", "p_retailprice", "t", "q1", "q2")
        seen = observe(records, at)
        candidates = seen.select("source_snapshot_id", _sound(at).alias("candidate"))
        ingest(c, candidates, seen.drop("p_partkey", "p_size", "p_retailprice", "t", "q1", "q2"), f"observed{n}")
    k = F.substring_index("source_url", "/", -1).cast("long")
    snaps = c.read("source_snapshots").select("source_snapshot_id", k.alias("p_partkey"))
    parts = []
    for kind, (a, b) in (("product", (_mod(5, 0), _mod(2, 0))), ("opportunity", (F.lit(False), ~_mod(4, 1)))):
        r = c.read(f"{kind}_revisions").join(snaps, "source_snapshot_id")
        first = F.col("observed_at") == _JAN
        decision = F.when(first, F.when(a, "reject").otherwise("trust")).otherwise(F.when(b, "trust").otherwise("request_revision"))
        at = F.when(first, F.lit("2026-03-01T00:00:00Z")).otherwise(F.lit("2026-02-15T00:00:00Z" if kind == "product" else "2026-02-20T00:00:00Z"))
        for other in (None, "canonicalize") if kind == "product" else (None,):
            ids = [F.col(f"{kind}_revision_id") if x == kind else F.lit(None).cast("string") for x in ("product", "opportunity")]
            d_ = F.lit(other) if other else decision
            parts.append(r.select(*[i.alias(f"{x}_revision_id") for i, x in zip(ids, ("product", "opportunity"), strict=True)], d_.alias("decision"), (F.lit("2026-04-01T00:00:00Z") if other else at).alias("created_at"), F.concat(F.lit(other or "decide"), F.lit("_"), F.col(f"{kind}_revision_id")).alias("review_event_id")))
    c.append({"review_events": history.union_all(parts)}, "reviews")
    view.refresh(c)


def _catalog(spark: SparkSession, d: str) -> Catalog:
    """The catalog over ``part`` of one folder, built by the first query that needs it."""
    return Catalog.open(spark, kept_folder(spark, "catalog", d, lambda path: _build_catalog(spark, d, path)))


_IDS = f"""obs AS (SELECT part.*, p_partkey AS k, lower(p_type) AS t, obs_at, 'readme|https://parts.test/' || p_partkey AS identity, p_name || ' ' || p_partkey AS name FROM part, (VALUES ('{_JAN}'), ('{_FEB}')) AS o(obs_at) WHERE obs_at = '{_JAN}' OR p_partkey % 3 = 0),
q AS (SELECT *, name || ' runs ' || t || ' jobs' || CASE WHEN k % 4 <> 0 THEN ' at https://parts.test/' || k ELSE '' END AS q1, p_size || ' hours per month' || CASE WHEN k % 3 <> 0 THEN ' for 3 months' ELSE '' END AS q2,
  'prod_' || left(sha256(identity), 24) AS product_id, 'srcsnap_' || left(sha256(identity || chr(10) || obs_at), 24) AS snap FROM obs),
ids AS (SELECT *, q1 || '. Everyone gets ' || q2 || '. Public.' AS txt, 'pr_' || left(sha256(snap || chr(10) || product_id), 24) AS pr, 'opp_' || left(sha256(product_id || chr(10) || 'hours'), 24) AS opp,
  'or_' || left(sha256(snap || chr(10) || 'opp_' || left(sha256(product_id || chr(10) || 'hours'), 24)), 24) AS orv FROM q)"""
_PUBLISHED = f"""{_IDS},
pp AS (SELECT * FROM (SELECT *, CASE obs_at WHEN '{_JAN}' THEN '2026-03-01T00:00:00Z' ELSE '2026-02-15T00:00:00Z' END AS decided, row_number() OVER (PARTITION BY k ORDER BY obs_at DESC) AS rn
  FROM ids WHERE k % 8 <> 0 AND CASE obs_at WHEN '{_JAN}' THEN k % 5 <> 0 ELSE k % 2 = 0 END) WHERE rn = 1),
oo AS (SELECT * FROM (SELECT *, CASE obs_at WHEN '{_JAN}' THEN '2026-03-01T00:00:00Z' ELSE '2026-02-20T00:00:00Z' END AS decided, row_number() OVER (PARTITION BY k ORDER BY obs_at DESC) AS rn
  FROM ids WHERE k % 9 <> 0 AND k % 10 <> 0 AND (obs_at = '{_JAN}' OR k % 4 <> 1)) WHERE rn = 1),
pub AS (SELECT pp.k, pp.t, pp.name, oo.opp, pp.product_id, pp.pr, oo.orv, pp.snap AS ps, oo.snap AS os, pp.obs_at AS pat, oo.obs_at AS oat, greatest(pp.decided, oo.decided) AS published_at FROM pp JOIN oo ON pp.k = oo.k)"""


@query(f"WITH {_PUBLISHED} SELECT opp AS opportunity_id, product_id, pr AS product_revision_id, orv AS opportunity_revision_id, pat AS product_observed_at, oat AS opportunity_observed_at, 'decide_' || pr AS product_review_event_id, 'decide_' || orv AS opportunity_review_event_id, published_at FROM pub")
def engine_published(spark, d):
    """PRJ-01, WIN-01..03, FLT-06..09, JON-02..04, JON-08, AGG-15, IDN-01, IDN-02, SNK-05: the published view of the stored catalog."""
    return CatalogEngine(_catalog(spark, d)).published().select("opportunity_id", "product_id", "product_revision_id", "opportunity_revision_id", "product_observed_at", "opportunity_observed_at", "product_review_event_id", "opportunity_review_event_id", "published_at")


@query(f"WITH {_PUBLISHED} SELECT opp AS opportunity_id, published_at FROM pub WHERE t = 'economy' ORDER BY published_at DESC, opp LIMIT 50")
def engine_search_facets(spark, d):
    """API-05, FLT-04, FLT-17, SRT-02, SET-05: newest first of those with the capability."""
    return CatalogEngine(_catalog(spark, d)).search(capabilities=["economy", " economy "], limit=50).select("opportunity_id", "published_at")


_BM25 = f"""WITH {_PUBLISHED},
doc AS (SELECT orv, regexp_extract_all(lower(name || ' ' || CASE WHEN k % 8 = 0 THEN '' ELSE 'Runs ' || t || ' jobs.' END || ' Done sooner ' || txt), '[a-z0-9]+') AS a FROM ids),
f AS (SELECT orv, len(a) AS l, len(list_filter(a, lambda x: x = 'ring')) AS f1, len(list_filter(a, lambda x: x = 'economy')) AS f2 FROM doc),
s AS (SELECT count(*) AS n, avg(l) AS al, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM f),
r AS (SELECT orv, -(CASE WHEN ln((n - d1 + 0.5) / (d1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d1 + 0.5) / (d1 + 0.5)) END * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / al))
 + CASE WHEN ln((n - d2 + 0.5) / (d2 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d2 + 0.5) / (d2 + 0.5)) END * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / al))) AS rank FROM f, s WHERE f1 > 0 AND f2 > 0)
SELECT opp AS opportunity_id, round(rank, 6) AS rank FROM pub JOIN r USING (orv) ORDER BY r.rank, published_at DESC, opp LIMIT 100"""


@query(_BM25)
def engine_search_text(spark, d):
    """API-05, PRJ-09, FTS-01..05, JON-05, AGG-13, SRT-03: ranks over the index of all revisions (at most 100 hits here: the API's own limit)."""
    hits = CatalogEngine(_catalog(spark, d)).search("Ring economy", limit=100)
    return hits.select("opportunity_id", F.round("rank", 6).alias("rank"))


@query(f"WITH {_PUBLISHED} SELECT t AS concept_id, upper(left(t, 1)) || substr(t, 2) AS label, count(DISTINCT opp)::BIGINT AS opportunity_count FROM pub GROUP BY t")
def engine_capabilities(spark, d):
    """API-04, AGG-01, JON-06, PRJ-13."""
    return CatalogEngine(_catalog(spark, d)).capabilities()


@query(f"""WITH {_PUBLISHED} SELECT 'ok' AS status, 'typed' AS catalog_kind, '0.1.0' AS contract_version, '0.1.0' AS vocabulary_version, (SELECT count(DISTINCT product_id) FROM ids)::BIGINT AS known_products, (SELECT count(DISTINCT opp) FROM ids)::BIGINT AS known_opportunities,
 (SELECT count(*) FROM ids)::BIGINT AS product_revisions, (SELECT count(*) FROM ids)::BIGINT AS opportunity_revisions, (SELECT count(DISTINCT product_id) FROM pub)::BIGINT AS published_products, (SELECT count(*) FROM pub)::BIGINT AS published_opportunities""")
def engine_health(spark, d):
    """API-01, API-02, AGG-02, VAL-21."""
    return CatalogEngine(_catalog(spark, d)).health()


@query(f"""WITH {_PUBLISHED} SELECT opp AS opportunity_id, 2 AS n_facets, t || ':explicit' AS capabilities, CASE WHEN ps = os THEN 1 ELSE 2 END AS n_sources,
 CASE WHEN ps = os THEN 'ev_offer,ev_public,ev_what' ELSE (CASE WHEN ps < os THEN 'ev_what,ev_offer,ev_public,ev_what' ELSE 'ev_offer,ev_public,ev_what,ev_what' END) END AS evidence,
 published_at, pr AS product_revision_id, oat AS opportunity_observed_at, name AS source_name FROM pub""")
def engine_hydrated(spark, d):
    """PRJ-02, PRJ-03, API-06, AGG-09, SRT-06, JON-12, FN-11, FN-15, SET-02: nested results with all that the documents cite."""
    e = CatalogEngine(_catalog(spark, d))
    x = e.hydrate(e.published())
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return x.select(
        "opportunity_id", F.size("facets").alias("n_facets"), joined("capabilities", lambda c: F.concat_ws(":", c["id"], c["basis"])).alias("capabilities"), F.size("sources").alias("n_sources"), joined("evidence", lambda s: s["evidence_key"]).alias("evidence"),
        F.col("publication.published_at").alias("published_at"), F.col("product.revision_id").alias("product_revision_id"), F.col("opportunity.observed_at").alias("opportunity_observed_at"), F.get_json_object("product.document", "$.source_name").alias("source_name"),
    )


def _one_snapshot(k: int) -> str:
    return "srcsnap_" + hashlib.sha256(f"readme|https://parts.test/{k}\n{_JAN}".encode()).hexdigest()[:24]


@query(f"WITH {_PUBLISHED} SELECT snap AS source_snapshot_id, 'ev_offer' AS evidence_key, q2 AS quote, (length(q1) + 16)::INT AS start_offset, (length(q1) + 16 + length(q2))::INT AS end_offset, name AS source_name FROM ids WHERE k = 1 AND obs_at = '{_JAN}' AND snap IN (SELECT ps FROM pub UNION ALL SELECT os FROM pub)")
def engine_evidence(spark, d):
    """API-07, FLT-10, FLT-11, FN-13: one cited span with its source."""
    return CatalogEngine(_catalog(spark, d)).evidence(_one_snapshot(1), "ev_offer").select("source_snapshot_id", "evidence_key", "quote", "start_offset", "end_offset", "source_name")


@query(f"WITH {_IDS} SELECT snap AS source_snapshot_id, e AS evidence_key, CASE e WHEN 'ev_what' THEN 0 WHEN 'ev_offer' THEN length(q1) + 16 ELSE length(txt) - 7 END::INT AS start_offset, CASE e WHEN 'ev_what' THEN length(q1) WHEN 'ev_offer' THEN length(q1) + 16 + length(q2) ELSE length(txt) END::INT AS end_offset FROM ids, (VALUES ('ev_what'), ('ev_offer'), ('ev_public')) AS v(e)")
def ingest_evidence(spark, d):
    """SNK-05, FN-13, JON-17, FLT-12: offsets of every quote in its source."""
    return _catalog(spark, d).read("evidence_spans").select("source_snapshot_id", "evidence_key", "start_offset", "end_offset")


@query(f"""WITH {_IDS} SELECT orv AS opportunity_revision_id, c.key AS condition_key, c.family, c.kind AS normalized_kind, CASE c.key WHEN 'login' THEN k % 2 = 0 WHEN 'token' THEN true END AS required,
 CASE WHEN c.key = 'who' AND k % 2 = 0 THEN true END AS verification_required, CASE c.key WHEN 'tax' THEN 'conditional' END AS state, 'opportunity' AS target_key
 FROM ids, (VALUES ('login', 'boolean_requirement', 'login'), ('token', 'external_credential', 'api_key'), ('who', 'audience', 'audience'), ('where', 'geography', 'geography'), ('tax', 'other', 'vat_id')) AS c(key, family, kind)""")
def ingest_conditions(spark, d):
    """PRJ-05: five families as common columns."""
    return _catalog(spark, d).read("condition_index")


@query(f"""WITH {_IDS} SELECT orv AS opportunity_revision_id, 'where' AS condition_key, CASE WHEN k % 3 = 0 THEN 'excluded' ELSE 'included' END AS mode, v AS value FROM ids, (VALUES ('EU'), ('US')) AS r(v)
 UNION ALL SELECT orv, 'who', NULL, v FROM ids, (VALUES ('student'), ('startup')) AS r(v)""")
def ingest_regions_and_audiences(spark, d):
    """PRJ-08: unnested regions with their mode, and audiences."""
    c = _catalog(spark, d)
    a = c.read("condition_geography_index").withColumnRenamed("region", "value")
    b = c.read("condition_audience_index").select("opportunity_revision_id", "condition_key", F.lit(None).cast("string").alias("mode"), F.col("audience").alias("value"))
    return a.unionByName(b)


@query(f"""WITH {_IDS} SELECT orv AS opportunity_revision_id, c.key AS constraint_key, c.kind, c.other_kind, 'hours_each' AS target_key, CASE c.key WHEN 'burst' THEN p_size::DOUBLE END AS quantity, c.cmp AS quantity_comparator, c.unit AS normalized_unit,
 c.n::BIGINT AS cadence_interval, c.per AS cadence_unit, c.alignment AS cadence_alignment FROM ids, (VALUES ('keep', 'retention', NULL, NULL, NULL, NULL, NULL, NULL), ('burst', 'other', 'burst_rate', 'up_to', 'hour', 2, 'day', 'rolling')) AS c(key, kind, other_kind, cmp, unit, n, per, alignment)""")
def ingest_constraints(spark, d):
    """PRJ-08: constraints with kind, other_kind, comparator and alignment apart."""
    return _catalog(spark, d).read("constraint_index")


@query(f"""WITH {_IDS} SELECT orv AS opportunity_revision_id, 'hours_each' AS entitlement_key, 'included_usage' AS kind, p_size::DOUBLE AS quantity, 'month' AS cadence_unit, NULL::BIGINT AS monetary_micros, NULL AS monetary_currency FROM ids
 UNION ALL SELECT orv, 'credit', 'monetary_credit', NULL, NULL, floor(p_retailprice * 1e6 + 0.5)::BIGINT, 'USD' FROM ids""")
def ingest_entitlements(spark, d):
    """PRJ-06, FN-12: entitlements flattened, money in micros."""
    return _catalog(spark, d).read("entitlement_index").select("opportunity_revision_id", "entitlement_key", "kind", "quantity", "cadence_unit", "monetary_micros", "monetary_currency")


@query(f"WITH {_IDS} SELECT orv AS opportunity_revision_id, 'hours_each' AS entitlement_key, v.o::INT AS ordinal, v.kind AS target_type, CASE v.o WHEN 0 THEN name ELSE 'all' END AS source_label FROM ids, (VALUES (0, 'product'), (1, 'plan')) AS v(o, kind)")
def ingest_applicability(spark, d):
    """PRJ-07: targets with their ordinal."""
    return _catalog(spark, d).read("entitlement_applicability_index")


@query(f"WITH {_IDS} SELECT orv AS opportunity_revision_id, name, CASE WHEN k % 8 = 0 THEN '' ELSE 'Runs ' || t || ' jobs.' END AS description, 'Done sooner' AS outcomes, txt AS source_text FROM ids")
def ingest_search_documents(spark, d):
    """PRJ-09: one search document for each opportunity revision."""
    return _catalog(spark, d).read("search_index")


@query(f"WITH {_IDS} SELECT a.pr AS revision_id, b.pr AS supersedes FROM ids a LEFT JOIN ids b ON a.k = b.k AND b.obs_at < a.obs_at UNION ALL SELECT a.orv, b.orv FROM ids a LEFT JOIN ids b ON a.k = b.k AND b.obs_at < a.obs_at")
def ingest_supersession(spark, d):
    """IDN-02, JON-16, WIN-04, WIN-05: a second observation keeps the ids and names what it replaces."""
    c = _catalog(spark, d)
    parts = [c.read(f"{kind}_revisions").select(F.col(f"{kind}_revision_id").alias("revision_id"), "supersedes") for kind in ("product", "opportunity")]
    return history.union_all(parts)


@query(f"""WITH {_IDS}, bad AS (SELECT orv, k, k % 6 = 0 OR k % 7 = 0 AS foreign_id FROM ids WHERE obs_at = '{_JAN}')
SELECT 'product_id' AS rule_id, orv AS row_key FROM bad WHERE k % 6 = 0 UNION ALL SELECT 'opportunity_owner', orv FROM bad WHERE foreign_id
UNION ALL SELECT 'product_supersedes', orv FROM bad WHERE k % 11 = 0 OR (k % 13 = 0 AND foreign_id)""")
def plan_checks(spark, d):
    """VAL-19, FN-18: id grammar, ownership of opportunities, scope of supersession."""
    c = _catalog(spark, d)
    k = F.substring_index("source_url", "/", -1).cast("long").alias("p_partkey")
    p = c.read("product_revisions").filter(F.col("observed_at") == _JAN).join(c.read("source_snapshots").select("source_snapshot_id", k), "source_snapshot_id").select("product_id", "product_revision_id", "p_partkey")
    o = c.read("opportunity_revisions").filter(F.col("observed_at") == _JAN).select("product_revision_id", "opportunity_id", "opportunity_revision_id")
    own = F.col("product_id")
    prior = F.when(_mod(11, 0), F.lit("pr_unknown0")).when(_mod(13, 0), F.col("product_revision_id"))
    plan = p.join(o, "product_revision_id").withColumns({"product_supersedes": prior, "opportunity_supersedes": F.lit(None).cast("string"), "product_id": F.when(_mod(6, 0), F.lit("prod_NO")).when(_mod(7, 0), F.lit("prod_other0")).otherwise(own)})
    return legacy.plan_problems(plan, c.read("opportunities"), c.read("product_revisions"), c.read("opportunity_revisions"))


# --- listings and the flat catalog

_LISTING_SQL = """items AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
lines AS (SELECT *, (SELECT count(*) FROM region q WHERE q.r_regionkey <= items.r) * 2 + 2 + (SELECT count(*) FROM items x WHERE x.r < items.r) + i AS line FROM items JOIN region ON r_regionkey = r)"""


def _listing(spark: SparkSession, d: str) -> tuple[str, str]:
    """A Markdown listing of the 25 nations by region and a CSV of as many offers, of the 5 regions and 25 nations only."""
    regions = _table(spark, d, "region").orderBy("r_regionkey").collect()
    nations = _table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").collect()
    out = ["# listing", ""]
    for r in regions:
        out += ["", f"## {r['r_name']}"]
        for i, n in enumerate([n for n in nations if n["n_regionkey"] == r["r_regionkey"]]):
            k = n["n_nationkey"]
            out.append(f"{'  ' if i == 0 else '    '}* [**{n['n_name']}**](https://n.test/{k}) - Hosted `model` inference and llm number {k}, [docs](https://d.test)")
    folder = new_folder(spark, "listing")
    md = _put(spark, f"{folder}/README.md", "\n".join(out) + "\n")
    head = "Brand/Product,Description,Monetary Detail,Eligibility Notes,Category,Application Link,Platform/Source,Estimated Value"
    rows = [f'{n["n_name"]},"GPU, cloud credits llm {n["n_nationkey"]}",${n["n_nationkey"]},{"startups" if n["n_nationkey"] % 2 else ""},AI,https://o.test/{n["n_nationkey"]},p,"${n["n_nationkey"]},000"' for n in sorted(nations, key=lambda n: n["n_nationkey"])]
    csv = _put(spark, f"{folder}/offers.csv", "\r\n".join([head, *rows, ""]))
    return md, csv


@query(f"""WITH {_LISTING_SQL} SELECT 'README.md:' || line AS source_locator, line::INT AS source_line, r_name AS source_category, replace(n_name, '_', '') AS source_name, 'https://n.test/' || k AS source_url,
 'Hosted model inference and llm number ' || k || ', docs' AS source_description, CASE WHEN i = 1 THEN '' ELSE replace(first_value(n_name) OVER (PARTITION BY r ORDER BY i), '_', '') END AS parent_provider FROM lines""")
def read_markdown(spark, d):
    """SRC-01, WIN-06, FN-03: sections, items and the parents of deeper items."""
    return readers.read_markdown(spark, _listing(spark, d)[0]).select("source_locator", "source_line", "source_category", "source_name", "source_url", "source_description", "parent_provider")


@query("""SELECT 'offers.csv:' || (row_number() OVER (ORDER BY n_nationkey) + 1) AS source_locator, (row_number() OVER (ORDER BY n_nationkey) + 1)::INT AS source_row, n_name AS source_name, 'GPU, cloud credits llm ' || n_nationkey AS source_description, '$' || n_nationkey AS source_offer_detail,
 CASE WHEN n_nationkey % 2 = 1 THEN 'startups' ELSE '' END AS source_eligibility, 'https://o.test/' || n_nationkey AS source_url, n_nationkey * 1000.0::DOUBLE AS estimated_value_usd FROM nation""")
def read_offers_csv(spark, d):
    """SRC-02, SRC-03, FN-04: offer rows as records, quoted commas and money included."""
    return readers.read_offers_csv(spark, _listing(spark, d)[1]).select("source_locator", "source_row", "source_name", "source_description", "source_offer_detail", "source_eligibility", "source_url", "estimated_value_usd")


@query("""SELECT count(*)::BIGINT AS n, count(DISTINCT o)::BIGINT AS places, count(*) FILTER (kind = 'startup_offers_csv')::BIGINT AS offers FROM (SELECT 'a' || n_nationkey AS o, 'free_for_dev_readme' AS kind FROM nation UNION ALL SELECT 'b' || n_nationkey, 'startup_offers_csv' FROM nation)""")
def read_both_sources(spark, d):
    """SET-01: listing rows, then offer rows, each with its place."""
    x = readers.read_records(spark, *_listing(spark, d))
    return x.agg(F.count("*").alias("n"), F.count_distinct("source_order").alias("places"), F.count_if(F.col("source_kind") == "startup_offers_csv").alias("offers"))




def _build_flat(spark: SparkSession, d: str, path: str) -> None:
    legacy.FlatCatalog(spark, path).rebuild(legacy.staged(readers.read_records(spark, *_listing(spark, d))), _JAN)


def _flat(spark: SparkSession, d: str) -> legacy.FlatCatalog:
    return legacy.FlatCatalog(spark, kept_folder(spark, "flat", d, lambda path: _build_flat(spark, d, path)))


_RECORDS = """rec AS (SELECT n_nationkey AS k, replace(n_name, '_', '') AS n_name, 'free_for_dev_readme' AS kind FROM nation UNION ALL SELECT n_nationkey, n_name, 'startup_offers_csv' FROM nation)"""


@query(f"WITH {_RECORDS} SELECT kind AS source_kind, n_name AS source_name, count(*)::BIGINT AS n FROM rec GROUP BY ALL")
def flat_search(spark, d):
    """FLT-02, JON-01, JON-07, SRT-04, SRT-07, SNK-01: text or linked labels hold every term (all records do)."""
    rows = _flat(spark, d).search("inference", limit=100).union(_flat(spark, d).search("gpu credits", limit="100"))
    return rows.groupBy("source_kind", "source_name").agg(F.count("*").alias("n"))


@query(f"WITH {_RECORDS} SELECT n_name AS name, kind AS source_kind, CASE WHEN kind = 'startup_offers_csv' THEN 'startup_offer' ELSE 'public_free_tier' END AS opportunity_type, CASE WHEN kind = 'startup_offers_csv' AND k % 2 = 1 THEN 'startups' END AS eligibility FROM rec")
def flat_details(spark, d):
    """PRJ-04, PRJ-10, PRJ-11, SNK-01: records with their type and requirements."""
    c = _flat(spark, d)
    rows = c.search("", limit=100)
    return c.details(rows).select("name", "source_kind", "opportunity_type", F.get(F.col("requirements"), 0)["value"].alias("eligibility"))


@query("SELECT (SELECT 2 * count(*) FROM nation)::BIGINT AS records, (SELECT count(*) FROM nation)::BIGINT AS offers, 0::BIGINT AS review_items")
def flat_stats(spark, d):
    """AGG-03, SNK-01, SNK-02: counts of the build."""
    return _flat(spark, d).stats().select("records", "offers", "review_items")


def _refreshed(spark: SparkSession, d: str) -> tuple[legacy.Refresh, list[dict]]:
    """Two snapshots: without the first region's nations of even key, then all with some descriptions changed."""
    md, csv = _listing(spark, d)
    full = spark.read.text(md, wholetext=True).first()[0]
    first = "\n".join(x for x in full.split("\n") if not re.search(r"/n\.test/\d*[02468]\)", x))
    second = re.sub(r"llm number (\d*[5])\b", r"llm again \1", "\n".join(x for x in full.split("\n") if not re.search(r"/n\.test/\d*[3]\)", x)))
    folder = new_folder(spark, "refresh")
    r = legacy.Refresh(spark, f"{folder}/state")
    told = [r.run(run, _put(spark, f"{folder}/{run}/README.md", content), csv, at) for run, content, at in (("one", first, _JAN), ("two", second, _FEB))]
    return r, told


_REFRESH_SQL = """d AS (SELECT n_nationkey AS k, n_nationkey % 2 = 1 AS was, n_nationkey % 10 <> 3 AS now FROM nation),
c AS (SELECT k, CASE WHEN now AND NOT was THEN 'added' WHEN was AND NOT now THEN 'removed' WHEN was AND now AND k % 10 = 5 THEN 'changed' END AS change_type FROM d)"""


@query(f"WITH {_REFRESH_SQL} SELECT change_type, 'free_for_dev_readme|nation' || k || '|https://n.test/' || k AS identity_key FROM c WHERE change_type IS NOT NULL")
def refresh_changes(spark, d):
    """DIF-01, PRJ-12, WIN-07, FN-09, SNK-08, SRC-09, JON-11: what differs from the trusted snapshot."""
    r, _ = _refreshed(spark, d)
    return r.changes("two").select("change_type", "identity_key")


@query(f"WITH {_REFRESH_SQL} SELECT 'catalog_' || change_type AS item_type, 'open' AS status, count(*)::BIGINT AS n, true AS promoted FROM c WHERE change_type IS NOT NULL GROUP BY change_type")
def refresh_queue(spark, d):
    """DIF-02, DIF-03, SNK-03, AGG-04, AGG-14: changes queue once, and promotion waits for every one of them."""
    r, told = _refreshed(spark, d)
    queued = r.queue()
    try:
        r.promote(queued.filter("item_type = 'catalog_added'").withColumn("status", F.lit("accepted")))
        early = True
    except ValueError:
        early = False
    r.promote(queued.withColumn("status", F.lit("accepted")))
    ok = not early and r.pointer("current") == "two" and told[0]["review_items_added"] == 0 and told[1]["review_items_added"] == queued.count()
    return queued.groupBy("item_type", "status").agg(F.count("*").alias("n")).withColumn("promoted", F.lit(ok))


# --- model runs and evaluation

@query("""SELECT conv_id, turn, CASE WHEN turn % 5 < 4 THEN '{"turn":' || turn || '}' END AS json FROM conversations""")
def salvage_model_json(spark, d):
    """FN-16: JSON out of a fence, out of prose, bare, or none."""
    t = F.col("turn").cast("string")
    doc = _json('{"turn":', t, "}")
    said = F.when(F.col("turn") % 5 == 0, _json("```json\n", doc, "\n```")).when(F.col("turn") % 5 == 1, _json("Here it is: ", doc, " as asked")).when(F.col("turn") % 5 == 2, doc).when(F.col("turn") % 5 == 3, _json("  ", doc, "\n")).otherwise(F.lit("I cannot say { no"))
    return _table(spark, d, "conversations").select("conv_id", "turn", text.salvage_json(said).alias("json"))


@query("""SELECT p_partkey, a.n::INT AS attempt, CASE WHEN p_size > 45 THEN 'provider_error' WHEN p_size > 30 AND (a.n = 1 OR p_size > 40) THEN 'parse_error' WHEN p_size > 15 AND (a.n = 1 OR p_size > 25) THEN 'validation_error' ELSE 'accepted' END AS status
FROM part, (VALUES (1), (2)) AS a(n) WHERE a.n = 1 OR p_size > 15""")
def attempt_loop(spark, d):
    """LLM-01, LLM-02: at most two attempts, the second one told what was wrong."""

    def complete(source, failures):
        size = int(re.search(r"gets (\d+) hours", source)[1])
        if size > 45:
            raise RuntimeError("down")
        if size > 30 and (not failures or size > 40):
            return "no json"
        if size > 15 and (not failures or size > 25):
            return "{}"
        quote = source.split(". ")[0]
        product = {"source_name": quote, "proposed_canonical_name": None, "description": None} | {x: [] for x in ("organization_roles", "links", "facets", "claimed_outcomes")}
        sound = {"contract_version": "0.1.0", "vocabulary_version": "0.1.0", "source_snapshot_id": "srcsnap_0001", "observed_at": _JAN, "evidence_spans": [{"id": "ev_what", "quote": quote}], "product": product, "opportunities": [], "possible_canonical_matches": []}
        return f"```json\n{json.dumps(sound)}\n```"

    return attempts.run_attempts(_sources(spark, d), "p_partkey", "source_text", complete, CONCEPTS, UNITS).select("p_partkey", "attempt", "status")


def _traces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, z = F.col("p_partkey"), F.col("p_size")
    p = _sources(spark, d)
    ids = lambda *xs: F.filter(F.array(*xs), lambda v: v.isNotNull())
    result = F.struct(
        (z > 10).alias("include"), ids(F.lit("a"), F.when(k % 2 == 0, F.lit("b"))).alias("capabilities"), ids(F.when(k % 5 != 0, F.lit("n"))).alias("user_needs"),
        F.array(F.struct(F.lit("f").alias("field"), F.lit("v").alias("value"), F.when(k % 3 == 0, F.lit("Public.")).otherwise(F.lit("elsewhere")).alias("evidence"))).alias("requirements"),
        ids(F.when(k % 10 == 1, F.concat(F.lit("part "), (k - 1).cast("string")))).alias("possible_duplicate_names"), F.when(k % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("unsupported_or_unknown"),
    )
    traces = p.filter(k % 13 != 0).select(k.cast("string").alias("source_id"), F.when(k % 11 == 0, "error").otherwise("ok").alias("status"), result.alias("result"))
    group = F.when(k % 10 < 2, F.floor(k / 10).cast("string"))
    labels = p.select(k.cast("string").alias("source_id"), F.concat(F.lit("part "), k.cast("string")).alias("name"), (z > 20).alias("include"), ids(F.lit("a"), F.when(k % 3 == 0, F.lit("c"))).alias("capabilities"), ids(F.lit("n")).alias("user_needs"), group.alias("duplicate_group"))
    return traces, labels, p.select(k.cast("string").alias("source_id"), F.col("source_text").alias("raw_text"))


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 13 <> 0 AND p_partkey % 11 <> 0 AS have, (SELECT max(p_partkey) FROM part) AS top FROM part),
s AS (SELECT count(*)::DOUBLE AS labels, count(*) FILTER (have)::DOUBLE AS valid, count(*) FILTER (have AND (z > 10) = (z > 20))::DOUBLE AS right_, count(*) FILTER (have AND k % 7 = 0)::DOUBLE AS kept, count(*) FILTER (have AND k % 3 = 0)::DOUBLE AS grounded,
 count(*) FILTER (have)::DOUBLE AS ctp, count(*) FILTER (have AND k % 2 = 0)::DOUBLE AS cfp, count(*) FILTER (have AND k % 3 = 0)::DOUBLE AS cfn, count(*) FILTER (have AND k % 5 <> 0)::DOUBLE AS ntp, count(*) FILTER (have AND k % 5 = 0)::DOUBLE AS nfn,
 count(*) FILTER (have AND k % 10 = 1)::DOUBLE AS dtp, count(*) FILTER (have AND k % 10 = 0 AND k < top)::DOUBLE AS dfn FROM x)
SELECT round(valid / labels, 9) AS schema_valid_rate, round(right_ / labels, 9) AS inclusion_accuracy, round(kept / valid, 9) AS unknown_preservation, round(grounded / valid, 9) AS grounding_rate,
 round(ctp / (ctp + cfp), 9) AS capability_precision, round(ctp / (ctp + cfn), 9) AS capability_recall, 1.0::DOUBLE AS need_precision, round(ntp / (ntp + nfn), 9) AS need_recall, 1.0::DOUBLE AS duplicate_precision, round(dtp / (dtp + dfn), 9) AS duplicate_recall FROM s""")
def evaluate_report(spark, d):
    """EVL-01, AGG-05..08, SET-03, JON-15, FN-19: the whole evaluation as one row."""
    r = evaluate.evaluate(*_traces(spark, d))
    names = ["schema_valid_rate", "inclusion_accuracy", "unknown_preservation", "grounding_rate", "capability_precision", "capability_recall", "need_precision", "need_recall", "duplicate_precision", "duplicate_recall"]
    return r.select(*[F.round(n, 9).alias(n) for n in names])


@query("""SELECT rule_id, row_key FROM (SELECT 'source_id' AS rule_id, p_partkey::VARCHAR AS row_key FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'capabilities', p_partkey::VARCHAR FROM part WHERE p_partkey % 5 = 0
 UNION ALL SELECT 'confidence', p_partkey::VARCHAR FROM part WHERE p_size > 40 UNION ALL SELECT 'user_needs', p_partkey::VARCHAR FROM part WHERE p_partkey % 9 = 0)""")
def model_result_check(spark, d):
    """VAL-20: rules of a flat model answer."""
    k = F.col("p_partkey")
    some = F.array().cast("array<string>")
    result = F.struct(
        F.when(k % 6 == 0, F.lit("other")).otherwise(k.cast("string")).alias("source_id"), F.lit(True).alias("include"), F.array(F.when(k % 5 == 0, F.lit("unknown")).otherwise(F.lit("model-api"))).alias("capabilities"),
        F.when(k % 9 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("build-agent"))).alias("user_needs"), (F.col("p_size") / 40.0).alias("confidence"), F.lit("because").alias("explanation"),
        some.alias("requirements"), some.alias("possible_duplicate_names"), some.alias("unsupported_or_unknown"),
    )
    x = _table(spark, d, "part").select(k.cast("string").alias("source_id"), result.alias("r"))
    rules = legacy.check_result(x, "r", [i for i, _ in legacy.CAPABILITIES], [i for i, _ in legacy.USER_NEEDS])
    return history.violations(x, rules, F.col("source_id"))


@query("""SELECT p_partkey, '{"a":' || p_size || ',"b":{"x":"' || p_name || '","y":[' || p_partkey || ',null]}}' AS canonical, CASE WHEN p_partkey % 2 = 0 THEN 'ev_' || p_size || ',ev_b' ELSE 'ev_' || p_size END AS ids, upper(left(p_name, 1)) || lower(substr(p_name, 2, instr(p_name, ' ') - 1)) || upper(substr(p_name, instr(p_name, ' ') + 1, 1)) || substr(p_name, instr(p_name, ' ') + 2) AS label FROM part""")
def document_functions(spark, d):
    """FN-11, FN-15, PRJ-13: sorted keys, cited evidence, labels."""
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    doc = _json('{"b": {"y": [', k, ', null], "x": ', _quoted(F.col("p_name")), '}, "a": ', z, "}")
    cited = _json('{"evidence_ids": ["ev_no"], "support": {"evidence_ids": ["ev_', z, '"]}, "list": [{"support": {"evidence_ids": [', F.when(_mod(2, 0), _json('"ev_', z, '", "ev_b"')).otherwise(F.lit("")), "]}}]}")
    return _table(spark, d, "part").select("p_partkey", text.canonical_json(doc).alias("canonical"), F.array_join(text.evidence_ids(cited), ",").alias("ids"), text.prettify(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("label"))


# --- runs, reviews, files


def _run_id_sql(snapshot: str) -> str:
    return f"'run_' || left(sha256({snapshot} || chr(10) || 'p' || chr(10) || 'm'), 24)"


_RUNS = f"""r AS (SELECT {_run_id_sql("'srcsnap_' || p_partkey")} AS run_id, p_size FROM part)"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = _table(spark, d, "part").select(F.concat(F.lit("srcsnap_"), F.col("p_partkey").cast("string")).alias("snapshot"), "p_size")
    runs = attempts.started_runs(x, "snapshot", "p", "m")
    z = F.col("p_size")
    tried = x.join(runs.withColumnRenamed("source_snapshot_id", "snapshot").select("snapshot", "run_id"), "snapshot").filter(z % 7 != 0).withColumn("attempt", F.explode(F.when(z < 20, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
    ok = (z < 20) | ((z < 35) & (F.col("attempt") == 2))
    status = F.when(ok, "accepted").when(z % 2 == 0, "validation_error").otherwise("provider_error")
    errors = F.when(status == "validation_error", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return runs, tried.select("run_id", "attempt", status.alias("status"), errors.alias("errors"))


@query(f"""WITH {_RUNS} SELECT run_id, CASE WHEN p_size % 7 = 0 THEN 'running' WHEN p_size < 35 THEN 'review_required' ELSE 'failed' END AS status, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size < 20 THEN 1 ELSE 2 END::BIGINT AS attempt_count,
 CASE WHEN p_size % 7 <> 0 AND p_size >= 35 THEN CASE WHEN p_size % 2 = 0 THEN 'a | b' ELSE 'provider_error' END END AS error FROM r""")
def run_lifecycle(spark, d):
    """LLM-03, AGG-10, AGG-12: runs from running to review_required or failed."""
    return attempts.finished_runs(*_runs(spark, d)).select("run_id", "status", "attempt_count", "error")


@query(f"""WITH {_IDS}, m AS (SELECT DISTINCT {_run_id_sql("snap")} AS run_id, pr, orv FROM ids WHERE k % 2 = 0) SELECT 'rr_' || left(sha256(run_id), 24) AS review_id, run_id, pr AS product_revision_id, orv AS opportunities, 'open' AS status FROM m""")
def review_after_run(spark, d):
    """LLM-03: an accepted run asks for the review of the revisions that it entered."""
    c = _catalog(spark, d)
    o = c.read("opportunity_revisions").select("source_snapshot_id", "product_revision_id", "opportunity_revision_id")
    k = F.substring_index("source_url", "/", -1).cast("long").alias("p_partkey")
    x = c.read("source_snapshots").select("source_snapshot_id", k)
    runs = attempts.started_runs(x, "source_snapshot_id", "p", "m")
    tried = runs.join(x, "source_snapshot_id").select("run_id", F.lit(1).alias("attempt"), F.when(_mod(2, 0), "accepted").otherwise("parse_error").alias("status"), F.array().cast("array<string>").alias("errors"))
    asked = attempts.review_requests(attempts.finished_runs(runs, tried), o)
    return asked.select("review_id", "run_id", "product_revision_id", F.array_join("opportunity_revision_ids", ",").alias("opportunities"), "status")


@query("SELECT o_orderkey::VARCHAR AS review_id, o_orderstatus AS status FROM orders WHERE o_orderkey = 7")
def queue_show(spark, d):
    """REV-02: one item of the queue."""
    q = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("review_id"), F.col("o_orderstatus").alias("status"))
    return CatalogEngine.review(q, "7")


@query("""SELECT o_orderkey::VARCHAR AS review_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey::VARCHAR LIMIT 40""")
def engine_reviews(spark, d):
    """API-08, SRT-05: open items, oldest first, at most as many as asked for."""
    q = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("review_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"))
    return CatalogEngine(Catalog(spark, "unused")).reviews(q, "open", 40).select("review_id", "created_at")


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring') AND contains(lower(p_name || ' ' || p_type), 'eco') AND p_partkey % 3 = 0 AND p_brand = 'Brand#2'
 UNION ALL SELECT p_partkey FROM part WHERE p_size = 7""")
def explorer_filters(spark, d):
    """FLT-18: words, need and source as far as they are given."""
    p = _table(spark, d, "part").withColumn("needs", F.when(_mod(3, 0), F.array(F.struct(F.lit("n").alias("id")))).otherwise(F.array().cast("array<struct<id:string>>")))
    hay = F.concat_ws(" ", "p_name", "p_type")
    a = search.explorer_filter(p, hay, "Ring  eco", need="n", source="Brand#2", source_col="p_brand")
    return a.select("p_partkey").unionByName(search.explorer_filter(p.filter("p_size = 7"), hay).select("p_partkey"))


@query(f"SELECT (SELECT 2 * count(*) FROM nation)::BIGINT AS records, (SELECT count(*) FROM nation)::BIGINT AS offers, 0::BIGINT AS review_items, '{_JAN}' AS generated_at")
def flat_summary(spark, d):
    """SNK-02: what the build wrote about itself."""
    return _flat(spark, d).summary().select("records", "offers", "review_items", "generated_at")


@query("SELECT 'typed' AS kind, (SELECT count(*) FROM part)::BIGINT AS products UNION ALL SELECT 'legacy', NULL")
def open_kinds(spark, d):
    """SRC-06, VAL-21: which generation lies in a folder."""
    kind, c = open_catalog(spark, _catalog(spark, d).path)
    other, none = open_catalog(spark, _flat(spark, d).path)
    a = c.read("products").agg(F.count("*").alias("products")).select(F.lit(kind).alias("kind"), "products")
    return a.unionByName(spark.createDataFrame([(other, None)], "kind string, products long")) if none is None else a


@query("SELECT 'capability' AS namespace, lower(r_name) AS id FROM region UNION ALL SELECT 'unit', lower(n_name) FROM nation")
def read_vocabulary(spark, d):
    """SRC-04: a versioned JSON vocabulary as dimension rows."""
    concepts = [r[0].lower() for r in _table(spark, d, "region").select("r_name").collect()]  # 5 regions and 25 nations
    units = [r[0].lower() for r in _table(spark, d, "nation").select("n_name").collect()]
    path = _put(spark, f"{new_folder(spark, 'vocabulary')}/vocabulary.json", json.dumps({"facet_namespaces": {"capability": concepts}, "normalized_units": units}))
    a, b = readers.read_vocabulary(spark, path)
    return a.select("namespace", F.col("concept_id").alias("id")).unionByName(b.select(F.lit("unit").alias("namespace"), F.col("unit_id").alias("id")))


@query("SELECT 'src_' || n_nationkey AS source_id, n_name AS source_name FROM nation WHERE n_nationkey = 3")
def read_record(spark, d):
    """SRC-05: one record of a staging file by its id."""
    rows = _table(spark, d, "nation").collect()  # 25 nations
    path = _put(spark, f"{new_folder(spark, 'record')}/staging.json", json.dumps([{"source_id": f"src_{r['n_nationkey']}", "source_name": r["n_name"]} for r in rows]))
    return readers.read_record(spark, path, "src_3")


@query("SELECT 's' || n_nationkey AS source_id, n_nationkey % 2 = 0 AS include, 'text ' || n_nationkey AS raw_text, 'run_' || n_regionkey AS run_id FROM nation")
def read_evaluation_files(spark, d):
    """SRC-07, SRC-08: traces, labels and staged records of a run, and the reports of a folder."""
    rows = _table(spark, d, "nation").collect()  # 25 nations
    folder, dump = new_folder(spark, "evaluation"), json.dumps
    traces = _put(spark, f"{folder}/traces.json", dump({"run_id": "r", "traces": [{"source_id": f"s{r['n_nationkey']}", "status": "ok"} for r in rows]}))
    labels = _put(spark, f"{folder}/labels.json", dump({"labels": [{"source_id": f"s{r['n_nationkey']}", "include": r["n_nationkey"] % 2 == 0} for r in rows]}))
    staging = _put(spark, f"{folder}/staging.json", dump([{"source_id": f"s{r['n_nationkey']}", "raw_text": f"text {r['n_nationkey']}", "region": r["n_regionkey"]} for r in rows]))
    for k in {r["n_regionkey"] for r in rows}:
        _put(spark, f"{folder}/reports/{k}.evaluation.json", dump({"run_id": f"run_{k}", "region": k}))
        _put(spark, f"{folder}/reports/{k}.other.json", dump({"run_id": "no", "region": k}))
    t, l, s = readers.read_evaluation_inputs(spark, traces, labels, staging)
    reports = readers.read_evaluations(spark, f"{folder}/reports")
    return t.filter("status = 'ok'").join(l, "source_id").join(s, "source_id").join(reports, "region").select("source_id", "include", "raw_text", "run_id")


@query("SELECT 'one' AS run_id, 0 AS exit_code, true AS held UNION ALL SELECT 'two', 1, true")
def refresh_job(spark, d):
    """SNK-09, DIF-04: a refresh under its lock leaves a line in the log, failed ones too; a second one is refused."""
    md, csv = _listing(spark, d)
    r = legacy.Refresh(spark, f"{new_folder(spark, 'job')}/state")
    r.job("one", md, csv, _JAN)
    with contextlib.suppress(Exception):
        r.job("two", f"{md}.missing", None, _FEB)
    with r.lock():
        try:
            r.job("three", md, csv, _FEB)
            held = False
        except legacy.RefreshRunning as e:
            held = e.exit_code == 75
    return spark.read.json(f"{r.path}/logs", schema="run_id string, exit_code int").withColumn("held", F.lit(held))


# --- scores, annotations, requests


_SAID = ("Run a GPU notebook", "embedding store", "call our llm by API", "clinical sales tools")
_CATEGORY = ("Generative AI", "AI & Automation", "Cloud Programs", "Cloud Computing & Infrastructure", "Other")


def _records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", F.lit("Fixture").alias("source_name"), pick(_SAID).alias("source_description"), F.lit("").alias("source_offer_detail"), pick(_CATEGORY).alias("source_category"))


@query("""SELECT k AS p_partkey, (CASE k % 4 WHEN 0 THEN 6 WHEN 3 THEN -10 ELSE 3 END + CASE k % 5 WHEN 0 THEN 6 WHEN 1 THEN 1 WHEN 2 THEN 6 WHEN 3 THEN 1 ELSE 0 END)::INT AS score,
 (CASE k % 4 WHEN 0 THEN 2 WHEN 3 THEN 2 ELSE 1 END + CASE WHEN k % 5 < 4 THEN 1 ELSE 0 END)::INT AS n_reasons FROM (SELECT p_partkey AS k FROM part)""")
def score_records(spark, d):
    """FN-05, FN-06: the catalog's own relevance rules with their reasons."""
    x = rules.with_score(_records(spark, d), legacy.TEXT, "source_category")
    return x.select("p_partkey", "score", F.size("reasons").alias("n_reasons"))


@query("""SELECT k AS p_partkey, CASE WHEN k % 5 = 2 THEN 'cloud-credit' || CASE k % 4 WHEN 3 THEN '' ELSE ',' END ELSE '' END || CASE k % 4 WHEN 0 THEN 'gpu-compute,notebook' WHEN 1 THEN 'embeddings' WHEN 2 THEN 'model-inference,model-api' ELSE '' END AS capabilities,
 CASE WHEN k % 5 = 2 THEN 'source category: Cloud Programs' WHEN k % 4 = 0 THEN 'gpu notebook' WHEN k % 4 = 1 THEN 'embedding' WHEN k % 4 = 2 THEN 'source describes access to or calls to models' END AS first_evidence,
 CASE WHEN k % 5 = 2 THEN 'cloud-credits' WHEN k % 4 = 0 THEN 'gpu-accelerator' WHEN k % 4 = 1 THEN 'embeddings-search' WHEN k % 4 = 2 THEN 'free-inference' END AS first_need FROM (SELECT p_partkey AS k FROM part)""")
def annotate_records(spark, d):
    """FN-07: all rule groups in order, first evidence kept."""
    x = rules.annotate(_records(spark, d), legacy.TEXT, "source_category")
    ids = F.array_join(F.transform("capabilities", lambda c: c["id"]), ",")
    return x.select("p_partkey", ids.alias("capabilities"), F.get(F.col("capabilities"), 0)["evidence"].alias("first_evidence"), F.get(F.col("needs"), 0)["id"].alias("first_need"))


@query("SELECT 'n' || n_nationkey AS source_id, n_name AS name, (SELECT count(*) FROM nation)::INT - 1 AS n_peers, false AS names_itself, 18 AS n_capabilities FROM nation")
def model_requests(spark, d):
    """PRJ-14, JON-10: a request for each selected record, with every peer but itself."""
    n = _table(spark, d, "nation")
    blank = F.lit("")
    rows = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), F.col("n_name").alias("source_name"), *[blank.alias(c) for c in ("source_category", "source_description", "source_offer_detail", "source_eligibility", "parent_provider")])
    x = legacy.model_requests(rows)
    peers = F.from_json(F.get_json_object("request", "$.comparison_candidate_names"), "array<string>")
    name = F.get_json_object("request", "$.record.name")
    known = F.from_json(F.get_json_object("request", "$.controlled_capabilities"), "map<string,string>")
    return x.select("source_id", name.alias("name"), F.size(peers).alias("n_peers"), F.array_contains(peers, name).alias("names_itself"), F.size(known).alias("n_capabilities"))


_REQUESTS = {
    "plain": {"q": ["gpu"], "limit": ["7"]}, "nothing": {}, "needs count": {"capability": ["a"] * 4, "need": ["b"] * 4}, "blank ones do not": {"capability": ["a"] * 8, "need": [" "]}, "too many": {"capability": ["a"] * 5, "need": ["b"] * 4},
    "long query": {"q": ["x" * 513]}, "trimmed query": {"q": [" " * 99 + "x" * 512]}, "long capability": {"capability": ["x" * 129]}, "no number": {"limit": ["ten"]}, "zero": {"limit": ["0"]}, "above": {"limit": ["101"]}, "twice": {"q": ["a", "b"]}, "unknown": {"page": ["2"]},
}


@query("SELECT * FROM (VALUES ('plain', true), ('nothing', true), ('needs count', true), ('blank ones do not', true), ('too many', false), ('long query', false), ('trimmed query', true), ('long capability', false), ('no number', false), ('zero', false), ('above', false), ('twice', false), ('unknown', false)) AS t(request, served)")
def request_bounds(spark, d):
    """FLT-17: which requests are served."""

    def served(params) -> bool:
        try:
            bounded_params(params)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(name, served(p)) for name, p in _REQUESTS.items()], "request string, served boolean")


@query("SELECT 25::BIGINT AS products, 25::BIGINT AS after_a_retry, 26::BIGINT AS with_older_files, 1::BIGINT AS without_time, true AS refused")
def catalog_rules(spark, d):
    """SNK-07, SNK-10: a retry appends nothing, a batch in the making is not seen, older files lack a column, unknown columns are refused."""
    c = Catalog.open(spark, new_folder(spark, "rules"))
    n = _table(spark, d, "nation").select(F.concat(F.lit("prod_"), F.col("n_nationkey").cast("string")).alias("product_id"), F.lit(_JAN).alias("created_at"))
    c.append({"products": n}, "one")
    n.limit(3).write.parquet(f"{c.path}/products/batch_id=half")
    first = c.read("products").count()
    c.append({"products": n}, "one")
    again = c.read("products").count()
    c.append({"products": n.select("product_id").limit(1)}, "older")
    last = c.read("products")
    try:
        c.append({"products": n.withColumn("extra", F.lit(1))}, "bad")
        refused = False
    except ValueError:
        refused = True
    return last.agg(F.count("*").alias("with_older_files"), F.count_if(F.col("created_at").isNull()).alias("without_time")).withColumns({"products": F.lit(first).cast("long"), "after_a_retry": F.lit(again).cast("long"), "refused": F.lit(refused)})


_URLS = ["/", "/health", "/v1/coverage", "/v1/needs", "/v1/capabilities", "/v1/opportunities?capability=economy&limit=100", "/v1/opportunities?limit=0", "/v1/opportunities?page=1", "/v1/opportunities/none", "/v1/evidence/none/ev_what", "/v1/reviews?limit=5", "/v2", "/v1/opportunities?q=" + "x" * 4096]


@query(f"""WITH {_PUBLISHED} SELECT 'GET' AS method, * FROM (VALUES ('/', 200, NULL), ('/health', 200, 1), ('/v1/coverage', 200, 1), ('/v1/needs', 200, 0), ('/v1/opportunities?limit=0', 400, NULL), ('/v1/opportunities?page=1', 400, NULL), ('/v1/opportunities/none', 404, NULL),
 ('/v1/evidence/none/ev_what', 404, NULL), ('/v1/reviews?limit=5', 200, 5), ('/v2', 404, NULL), ('/v1/opportunities?q=xxxxxxxxxx', 414, NULL)) AS t(url, status, n)
 UNION ALL SELECT 'GET', '/v1/capabilities', 200, count(DISTINCT t)::INT FROM pub UNION ALL SELECT 'GET', '/v1/opportunities?capability=e', 200, least(100, count(*))::INT FROM pub WHERE t = 'economy' UNION ALL SELECT 'POST', '/health', 405, NULL""")
def api_responses(spark, d):
    """API-01..10: the status of every kind of request and how many rows it gives; answers have the shape of the contract."""
    e = CatalogEngine(_catalog(spark, d))
    queue = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("review_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), F.col("o_orderdate").cast("string").alias("created_at"))
    shapes, out = api.contract()["paths"], []
    for method, url in [("GET", u) for u in _URLS] + [("POST", "/health")]:
        status, answer = api.respond(e, url, method, queue)
        rows = isinstance(answer, DataFrame)
        if rows:
            want = [(f["name"], f["type"]) for f in shapes[url.split("?")[0]]["get"]["row"]["fields"]]
            assert [(f["name"], str(f["type"]).replace("'containsNull': False", "'containsNull': True").replace("'nullable': False", "'nullable': True")) for f in answer.schema.jsonValue()["fields"]] == [(n, str(t)) for n, t in want], url
        out.append((method, url[:30], status, answer.count() if rows else None))
    return spark.createDataFrame(out, "method string, url string, status int, n int")


@query(f"""WITH {_PUBLISHED} SELECT opp AS opportunity_id, 'included usage · monetary credit' AS kinds, name, 'Runs ' || t || ' jobs.' AS description, t AS labels, '' AS url FROM pub""")
def engine_cards(spark, d):
    """FN-21: hydrated rows as cards (the query leaves out the quotes, whose order over two sources is that of the ids)."""
    e = CatalogEngine(_catalog(spark, d))
    return e.cards(e.hydrate(e.published())).drop("quotes")


@query("""SELECT item_id, replace(replace(replace(replace(replace('<b title="' || text || '">' || chr(39) || '&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM benchmark""")
def escaped_text(spark, d):
    """FN-21: escaping."""
    t = F.concat(F.lit('<b title="'), "text", F.lit('">'), F.lit("'&"))
    return _table(spark, d, "benchmark").select("item_id", text.html_escaped(t).alias("escaped"))
