import copy
import json
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from marlstone.operators import attempts, contract, contract_columns, evaluate, history, keys, view
from marlstone.operators.catalog import TABLES, Catalog, index_tables, ingest, observe, plan_identity
from marlstone.operators.engine import CatalogEngine, bounded, bounded_params, catalog_kind, clamped
from marlstone.operators.log import CHECKPOINT_EVERY, Conflict, Log, State
from marlstone.operators.shared import kept_folder, scratch, written

CONCEPTS, UNITS = {"capability": {"gpu_compute", "model_api"}}, {"hour", "request"}
TEXT = "Acme runs GPU jobs for builders. Everyone gets 10 GPU hours per month for 3 months. Public sign-up. https://acme.test"


def support(*ids, basis="explicit"):
    return {"basis": basis, "evidence_ids": list(ids)}


def candidate(snapshot="srcsnap_0001", at="2026-01-01T00:00:00Z", name="Acme"):
    return {
        "contract_version": "0.1.0", "vocabulary_version": "0.1.0", "source_snapshot_id": snapshot, "observed_at": at,
        "evidence_spans": [{"id": "ev_what", "quote": "Acme runs GPU jobs for builders."}, {"id": "ev_offer", "quote": "10 GPU hours per month for 3 months"}, {"id": "ev_url", "quote": "https://acme.test"}],
        "product": {
            "source_name": name, "proposed_canonical_name": None, "description": {"text": "Runs GPU jobs for builders.", "support": support("ev_what")},
            "organization_roles": [{"organization_name": "Acme", "role": "operator", "support": support("ev_what")}], "links": [{"role": "canonical_product", "url": "https://acme.test", "support": support("ev_url")}],
            "facets": [{"namespace": "capability", "concept_id": "gpu_compute", "support": support("ev_what")}], "claimed_outcomes": [],
        },
        "opportunities": [{
            "local_key": "free_hours", "variant_label": None, "plan_label": None, "availability": {"value": "public", "support": support("ev_what", basis="inferred")},
            "entitlements": [{
                "key": "hours", "kind": "included_usage", "label": "GPU hours", "quantity": {"value": 10, "comparator": "exact", "source_unit": "GPU hours", "normalized_unit": "hour"},
                "cadence": {"interval": 1, "unit": "month", "alignment": "unknown"}, "duration": {"value": 3, "unit": "month"}, "cost_scope": "usage", "monetary_value": {"amount": 30, "currency": "USD", "comparator": "exact"},
                "applies_to": [{"target_type": "product", "source_label": "Acme"}], "support": support("ev_offer"),
            }],
            "constraints": [{"key": "keep", "kind": "retention", "label": "kept", "target_key": "hours", "support": support("ev_offer")}],
            "conditions": [{"key": "login", "family": "boolean_requirement", "kind": "login", "required": True, "target_key": "opportunity", "support": support("ev_what")}, {"key": "geo", "family": "geography", "mode": "included", "regions": ["EU"], "target_key": "opportunity", "support": support("ev_what")}],
            "ambiguities": [], "links": [],
        }],
        "possible_canonical_matches": [],
    }


def rules_of(c, text=TEXT):
    return {r for r, _, _ in contract.problems(text, c, CONCEPTS, UNITS)}


def test_valid_candidate():
    assert contract.problems(TEXT, candidate(), CONCEPTS, UNITS) == []


def change(path, value):
    c = candidate()
    at = c
    for k in path[:-1]:
        at = at[k]
    if value is KeyError:
        del at[path[-1]]
    elif callable(value):
        at[path[-1]] = value(at.get(path[-1]) if isinstance(at, dict) else at[path[-1]])
    else:
        at[path[-1]] = value
    return c


O, E = ["opportunities", 0], ["opportunities", 0, "entitlements", 0]


@pytest.mark.parametrize(
    "path,value,rule",
    [
        (["contract_version"], "9", "VAL-01"), (["product", "extra"], 1, "VAL-01"), (["product", "facets"], KeyError, "VAL-01"), (["observed_at"], "2026-01-01", "VAL-01"), (["observed_at"], "2026-13-01T00:00:00Z", "VAL-04"),
        ([*E, "quantity"], KeyError, "VAL-02"), ([*E, "quantity", "value"], KeyError, "VAL-02"), ([*E, "percentage_value"], {"value": 5, "comparator": "exact"}, "VAL-02"), ([*E, "cost_scope"], KeyError, "VAL-02"),
        ([*O, "constraints", 0, "kind"], "other", "VAL-03"), (["evidence_spans", 1, "id"], "ev_what", "VAL-05"), (["evidence_spans", 0, "quote"], "not in there", "VAL-05"),
        (["product", "description", "text"], "Free GPU jobs", "VAL-06"), (["product", "organization_roles", 0, "organization_name"], "Other", "VAL-07"),
        (["possible_canonical_matches"], [{"candidate_name": " acme", "candidate_url": None, "support": support("ev_what")}], "VAL-08"), (["product", "facets"], [], "VAL-09"),
        (["product", "facets", 0, "concept_id"], "unknown_one", "VAL-10"), ([*E, "support"], support("ev_gone"), "VAL-10"), ([*E, "quantity", "normalized_unit"], "parsec", "VAL-10"), ([*E, "key"], "product", "VAL-11"),
        ([*O, "local_key"], "opportunity", "VAL-11"), ([*O, "constraints", 0, "key"], "hours", "VAL-11"), ([*O, "effective_period"], {"from": None, "to": None, "support": support("ev_what")}, "VAL-12"),
        ([*O, "effective_period"], {"from": "2026-02-01T00:00:00Z", "to": "2026-01-01T00:00:00Z", "support": support("ev_what")}, "VAL-12"), ([*O, "availability", "value"], "eligibility_gated", "VAL-13"),
        ([*O, "availability", "value"], "application_required", "VAL-13"), ([*E, "kind"], "no_cost_access", "VAL-14"), ([*E, "support"], support("ev_what"), "VAL-14"), ([*O, "conditions", 0, "target_key"], "nothing", "VAL-15"),
        ([*O, "entitlements"], lambda e: [e[0], e[0] | {"key": "again"}], "VAL-16"), (["product", "links", 0, "url"], "https://other.test", "VAL-17"),
    ],
)
def test_broken_rules_are_named(path, value, rule):
    assert rule in rules_of(change(path, value))


def mutated(rng):
    """A candidate with one to three places changed at random."""
    c = candidate()
    c["opportunities"][0]["ambiguities"] = [{"key": "amb", "target_key": "hours", "field": "scope", "reason": "ambiguous", "note": "n", "support": support("ev_offer")}]
    c["possible_canonical_matches"] = [{"candidate_name": "Other", "candidate_url": "https://o.test", "support": support("ev_what")}]
    c["product"]["claimed_outcomes"] = [{"text": "Done sooner", "support": support("ev_what")}]
    for _ in range(rng.choice([1, 1, 2, 3])):
        places = []

        def walk(v):
            for k in v if isinstance(v, dict) else range(len(v)) if isinstance(v, list) else ():
                places.append((v, k))
                walk(v[k])

        walk(c)
        owner, k = rng.choice(places)
        v = owner[k]
        new = rng.choice([None, 3, -1, 0.5, "", "x", "product", "ev_gone", "ev_what", "free", True, [], {}, [v], [v, v], {"a": v}, "other", "audience", "unlimited", "2026-13-01T00:00:00Z", KeyError, KeyError, "twice", "more"])
        if new is KeyError and isinstance(owner, dict):
            del owner[k]
        elif new == "twice" and isinstance(owner, list):
            owner.append(copy.deepcopy(v))
        elif new == "more" and isinstance(v, dict):
            v["surplus"] = 1
        elif new is not KeyError:
            owner[k] = copy.deepcopy(new)
    return c


def test_columns_find_what_the_plain_checks_find(spark):
    rng = random.Random(8)
    docs = [mutated(rng) for _ in range(300)] + [change(path, value) for path, value, _ in test_broken_rules_are_named.pytestmark[0].args[1]]
    x = spark.createDataFrame([(k, TEXT if k % 50 else None, json.dumps(c)) for k, c in enumerate(docs)], "k int, t string, j string")
    found = contract_columns.validate_candidates(x, "k", "t", "j", CONCEPTS, UNITS)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = Counter(tuple(r) for r in found.collect())
    want = Counter((k, *p) for k, c in enumerate(docs) for p in contract.problems(TEXT if k % 50 else None, c, CONCEPTS, UNITS))
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])
    assert len({r for _, r, _, _ in want}) >= 13


ODD = [
    (["product", "claimed_outcomes"], [7, "x", {"text": ["free"]}]), (["product", "description", "support", "evidence_ids"], [["ev_what"], 3, None]), (["evidence_spans", 0, "quote"], None), (["evidence_spans", 0, "id"], ["a"]),
    ([*O, "availability"], {"value": "public", "support": ["explicit"]}), (["product", "description"], {"text": "Free GPU jobs with credits", "support": "ev_what"}), ([*E, "support"], {"basis": "explicit", "evidence_ids": [["x"]]}),
    ([*E, "cadence", "alignment"], ["calendar"]), (["evidence_spans"], 5), (["opportunities"], {"a": 1}), (["product"], None),
]


@pytest.mark.parametrize("path,value", ODD)
def test_repairs_skip_what_has_another_shape(path, value):
    fixed, log = contract.normalized(change(path, value))
    assert isinstance(log, list) and rules_of(fixed) >= {"VAL-01"}


def test_odd_answers_end_no_job(spark):
    told = [json.dumps(change(p, v)) for p, v in ODD] + ["{", "[1]", "7", "null"]
    df = spark.createDataFrame([(str(k), j) for k, j in enumerate(told)] + [("none", None)], "k string, j string")
    got = {r["k"]: r for r in contract.normalize_candidates(df, "k", "j").collect()}
    assert len(got) == len(told) + 1 and got["none"]["candidate"] is None and got[str(len(ODD))]["candidate"] == "{" and got[str(len(ODD))]["actions"] == []
    asked = df.filter("j is not null").withColumnRenamed("j", "t")
    rows = attempts.run_attempts(asked, "k", "t", lambda text, failures: text, CONCEPTS, UNITS).collect()
    assert {r["k"] for r in rows if r["status"] == "accepted"} == set() and {r["attempt"] for r in rows} == {1, 2}


def test_run_rules():
    assert {m[1] for m in contract.run_problems(candidate(), "srcsnap_0002", "2026-01-01T00:00:00Z", "Other")} == {"source_snapshot_id", "product.source_name"}


def test_normalization():
    c = candidate()
    c["product"]["description"] = "Acme runs GPU jobs for builders."
    c["product"]["proposed_canonical_name"] = "Nowhere"
    c["product"]["claimed_outcomes"] = ["10 GPU hours per month for 3 months"]
    o = c["opportunities"][0]
    o["effective_period"] = None
    o["availability"]["support"]["basis"] = "explicit"
    e = o["entitlements"][0]
    e |= {"duration": {"value": None, "unit": ""}, "maximum_value": {"amount": 0, "currency": "USD", "comparator": "exact"}, "percentage_value": {"value": 1, "comparator": "exact"}}
    e["cadence"]["alignment"] = "calendar"
    given = copy.deepcopy(c)
    fixed, log = contract.normalized(c)
    assert c == given and len(log) >= 9
    assert fixed["product"]["description"]["support"]["evidence_ids"] == ["ev_what"] and fixed["product"]["proposed_canonical_name"] is None
    assert fixed["product"]["claimed_outcomes"] == [] and "effective_period" not in fixed["opportunities"][0]
    assert contract.problems(TEXT, fixed, CONCEPTS, UNITS) == []
    d = candidate()
    d["product"]["description"]["text"] = "Free GPU jobs with 10 hours per month"
    fixed, log = contract.normalized(d)
    assert fixed["product"]["description"] == {"text": "GPU jobs.", "support": support("ev_what", basis="inferred")} and len(log) == 1


def test_over_dataframes(spark):
    df = spark.createDataFrame([("a", TEXT, json.dumps(candidate())), ("b", TEXT, "no json"), ("c", TEXT, json.dumps(change([*E, "quantity"], KeyError)))], "k string, t string, j string")
    found = contract_columns.validate_candidates(df, "k", "t", "j", CONCEPTS, UNITS)
    assert {(r["k"], r["rule_id"]) for r in found.collect()} == {("b", "VAL-01"), ("c", "VAL-02")}
    with pytest.raises(ValueError, match="2 contract"):
        contract.assert_valid(found)
    assert contract.normalize_candidates(df.filter("k <> 'b'"), "k", "j").count() == 2


def test_attempts_repair_once(spark):
    good = json.dumps(candidate())

    def complete(text, failures):
        if text.startswith("fail"):
            raise RuntimeError("down")
        return "```json\n" + good + "\n```" if failures else "no json"

    df = spark.createDataFrame([("a", TEXT), ("b", "fail")], "k string, t string")
    got = {(r["k"], r["attempt"], r["status"]) for r in attempts.run_attempts(df, "k", "t", complete, CONCEPTS, UNITS).collect()}
    assert got == {("a", 1, "parse_error"), ("a", 2, "accepted"), ("b", 1, "provider_error"), ("b", 2, "provider_error")}


RECORD = "source_kind string, source_locator string, source_name string, source_url string, source_platform string, raw_text string"


def observed(spark, at, rows=(("startup_offers_csv", "f:2", "Acme", "https://acme.test/", "p", TEXT),)):
    return observe(spark.createDataFrame(list(rows), RECORD), at)


def put(spark, catalog, at, batch):
    obs = observed(spark, at)
    sid = obs.first()["source_snapshot_id"]
    ingest(catalog, spark.createDataFrame([(sid, json.dumps(candidate(sid, at)))], "source_snapshot_id string, candidate string"), obs, batch)
    return sid


def trust(spark, catalog, batch, at, decision="trust"):
    p, o = catalog.read("product_revisions"), catalog.read("opportunity_revisions")
    e = p.select("product_revision_id", F.lit(None).cast("string").alias("opportunity_revision_id")).union(o.select(F.lit(None).cast("string"), "opportunity_revision_id"))
    e = e.select("*", F.lit(decision).alias("decision"), F.lit(at).alias("created_at"), F.concat(F.lit(batch), F.coalesce("product_revision_id", "opportunity_revision_id")).alias("review_event_id"))
    catalog.append({"review_events": e}, batch)


def test_catalog_end_to_end(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    engine = CatalogEngine(catalog)
    sid = put(spark, catalog, "2026-01-01T00:00:00Z", "b1")
    assert observed(spark, "x").first()["source_kind"] == "startup_offer_csv"
    assert engine.published().count() == 0 and engine.coverage().first()["known_products"] == 1
    assert catalog.read("entitlement_index").first()["monetary_micros"] == 30_000_000
    span = catalog.read("evidence_spans").filter("evidence_key = 'ev_offer'").first()
    assert TEXT[span["start_offset"] : span["end_offset"]] == span["quote"]
    assert {r["normalized_kind"] for r in catalog.read("condition_index").collect()} == {"login", "geography"}
    assert {r["mode"] for r in catalog.read("condition_geography_index").collect()} == {"included"}
    assert engine.evidence(sid, "ev_what").count() == 0  # not published yet
    trust(spark, catalog, "r1", "2026-01-02T00:00:00Z")
    assert engine.published().count() == 1 and engine.evidence(sid, "ev_what").count() == 1
    assert engine.search("gpu-jobs").count() == 1 and engine.search("gpu zzz").count() == 0
    assert engine.search(capabilities=["gpu_compute"]).count() == 1 and engine.search(capabilities=["gpu_compute", "model_api"]).count() == 0
    row = engine.opportunity(engine.published().first()["opportunity_id"]).first()
    assert [(c["id"], c["basis"]) for c in row["capabilities"]] == [("gpu_compute", "explicit")] and row["sources"][0]["source_name"] == "Acme"
    assert {e["evidence_key"] for e in row["evidence"]} == {"ev_what", "ev_offer", "ev_url"}  # links and facets cite too
    assert row["publication"]["product_review_event_id"] == "r1" + row["product_revision_id"] and row["product"]["observed_at"] == "2026-01-01T00:00:00Z"
    assert json.loads(row["product"]["document"]) == candidate(sid)["product"] and json.loads(row["opportunity"]["document"]) == candidate(sid)["opportunities"][0]
    assert engine.evidence(sid, "ev_url").first()["source_name"] == "Acme" and engine.evidence(sid, "ev_none").count() == 0
    assert engine.coverage().first()["known_opportunities"] == 1 and engine.health().first()["contract_version"] == "0.1.0"
    cap = engine.capabilities().first()
    assert (cap["concept_id"], cap["label"], cap["opportunity_count"]) == ("gpu_compute", "Gpu_compute", 1)
    assert engine.health().first()["published_opportunities"] == 1 and engine.needs().count() == 0
    # a second observation keeps the ids and supersedes
    put(spark, catalog, "2026-02-01T00:00:00Z", "b2")
    assert catalog.read("opportunity_revisions").select("opportunity_id").distinct().count() == 1
    assert catalog.read("product_revisions").filter("supersedes is not null").count() == 1
    assert catalog.read("products").count() == catalog.read("opportunities").count() == 1 and engine.published().count() == 1
    assert catalog.append({"review_events": catalog.read("review_events")}, "r1") == "r1"  # a retry appends nothing
    assert catalog.read("review_events").count() == 2
    trust(spark, catalog, "r2", "2026-03-01T00:00:00Z", "reject")
    assert engine.published().count() == 0


def test_the_revision_observed_last_is_published_whenever_it_was_trusted(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    engine = CatalogEngine(catalog)
    ids = []
    for month, batch in (("01", "b1"), ("02", "b2")):
        sid = put(spark, catalog, f"2026-{month}-01T00:00:00Z", batch)
        ids.append(catalog.read("product_revisions").filter(F.col("source_snapshot_id") == sid).first()["product_revision_id"])

    def decide(batch, revision, at, decision="trust"):
        p = catalog.read("product_revisions").filter(F.col("product_revision_id") == revision).select("product_revision_id", "source_snapshot_id")
        o = catalog.read("opportunity_revisions").join(p.select("source_snapshot_id"), "source_snapshot_id")
        e = p.select("product_revision_id", F.lit(None).cast("string").alias("opportunity_revision_id")).union(o.select(F.lit(None).cast("string"), "opportunity_revision_id"))
        catalog.append({"review_events": e.select("*", F.lit(decision).alias("decision"), F.lit(at).alias("created_at"), F.concat(F.lit(batch), F.coalesce("product_revision_id", "opportunity_revision_id")).alias("review_event_id"))}, batch)

    decide("r1", ids[1], "2026-03-01T00:00:00Z")
    decide("r2", ids[0], "2026-03-02T00:00:00Z")  # the older one, trusted later
    row = engine.published().first()
    assert row["product_revision_id"] == ids[1] and row["opportunity_observed_at"] == "2026-02-01T00:00:00Z" and row["published_at"] == "2026-03-01T00:00:00Z"
    decide("r3", ids[1], "2026-03-03T00:00:00Z", "reject")  # then the older one comes back
    assert engine.published().first()["product_revision_id"] == ids[0]


def test_constraints_keep_their_kinds(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    obs = observed(spark, "2026-01-01T00:00:00Z")
    sid = obs.first()["source_snapshot_id"]
    c = candidate(sid)
    cap = {"key": "cap", "kind": "other", "other_kind": "burst", "label": "b", "target_key": "hours", "quantity": {"value": 3, "comparator": "up_to", "source_unit": "h", "normalized_unit": "hour"}, "cadence": {"interval": 1, "unit": "day", "alignment": "rolling"}, "support": support("ev_offer")}
    c["opportunities"][0]["constraints"].append(cap)
    ingest(catalog, spark.createDataFrame([(sid, json.dumps(c))], "source_snapshot_id string, candidate string"), obs, "b")
    got = {r["constraint_key"]: (r["kind"], r["other_kind"], r["quantity_comparator"], r["cadence_alignment"]) for r in catalog.read("constraint_index").collect()}
    assert got == {"keep": ("retention", None, None, None), "cap": ("other", "burst", "up_to", "rolling")}
    obs = observed(spark, "2026-02-01T00:00:00Z")
    sid = obs.first()["source_snapshot_id"]
    c = candidate(sid, "2026-02-01T00:00:00Z")
    c["opportunities"][0]["entitlements"][0]["monetary_value"]["amount"] = 1e12
    with pytest.raises(Exception, match="safe range"):
        ingest(catalog, spark.createDataFrame([(sid, json.dumps(c))], "source_snapshot_id string, candidate string"), obs, "b3")


def test_a_repeated_observation_is_refused_as_a_whole(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    sid = put(spark, catalog, "2026-01-01T00:00:00Z", "b1")
    before = {t: catalog.read(t).count() for t in TABLES if t != "rejections"}
    assert put(spark, catalog, "2026-01-01T00:00:00Z", "b2") == sid
    assert {t: catalog.read(t).count() for t in before} == before and min(before[t] for t in ("source_snapshots", "product_revisions", "key_sets", "search_postings")) > 0
    assert [tuple(r)[:3] for r in catalog.read("rejections").collect()] == [(sid, "SNK-11", "source_snapshot_id")]
    # two candidates for one observation in the same batch: neither is the right one
    obs = observed(spark, "2026-02-01T00:00:00Z")
    sid2 = obs.first()["source_snapshot_id"]
    two = spark.createDataFrame([(sid2, json.dumps(candidate(sid2, "2026-02-01T00:00:00Z")))] * 2, "source_snapshot_id string, candidate string")
    ingest(catalog, two, obs, "b3")
    assert {t: catalog.read(t).count() for t in before} == before and catalog.read("rejections").filter(F.col("source_snapshot_id") == sid2).count() == 1


def test_a_bad_candidate_is_refused_with_its_rules(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    rows = [("startup_offers_csv", f"f:{k}", "Acme", f"https://acme.test/{k}", "p", TEXT) for k in range(5)]
    obs = observed(spark, "2026-01-01T00:00:00Z", rows)
    sid = {r["source_locator"]: r["source_snapshot_id"] for r in obs.collect()}
    docs = [candidate(sid[f"f:{k}"], "2026-01-01T00:00:00Z") for k in range(5)]
    docs[1]["evidence_spans"][0]["quote"] = "nowhere in the source"
    docs[2]["product"]["source_name"] = "another"
    docs[3]["opportunities"].append(docs[3]["opportunities"][0])
    told = [json.dumps(x) for x in docs]
    told[4] = "no json"
    ingest(catalog, spark.createDataFrame([(sid[f"f:{k}"], x) for k, x in enumerate(told)], "source_snapshot_id string, candidate string"), obs, "b", CONCEPTS, UNITS)
    found = {(r["source_snapshot_id"], r["rule_id"]) for r in catalog.read("rejections").collect()}
    assert {(sid["f:1"], "VAL-05"), (sid["f:2"], "VAL-18"), (sid["f:3"], "VAL-11"), (sid["f:4"], "VAL-01")} <= found
    assert sid["f:0"] not in {s for s, _ in found}
    assert [r[0] for r in catalog.read("source_snapshots").select("source_snapshot_id").collect()] == [sid["f:0"]]
    assert catalog.read("evidence_spans").filter("start_offset < 0").count() == 0
    assert keys.problems({t: catalog.read(t) for t in TABLES}, catalog.read("key_sets").limit(0), catalog.read("key_filters").limit(0)).count() == 0


def test_keys_and_references_are_checked_at_the_append(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    p = lambda *ids: spark.createDataFrame([(i,) for i in ids], "product_id string")
    o = lambda *ids: spark.createDataFrame(list(ids), "opportunity_id string, product_id string")
    catalog.append_checked({"products": p("prod_a", "prod_b")}, "one")
    _, refused = catalog.append_checked({"products": p("prod_b", "prod_c", "prod_d", "prod_d"), "opportunities": o(("opp_1", "prod_a"), ("opp_2", "prod_none"), ("opp_3", "prod_c"), ("opp_4", None))}, "two")
    assert sorted(tuple(r) for r in refused.collect()) == [("opportunities", "opp_2", "product_id->products"), ("products", "prod_b", "primary_key"), ("products", "prod_d", "primary_key")]
    assert sorted(r[0] for r in catalog.read("products").select("product_id").collect()) == ["prod_a", "prod_b", "prod_c"]
    assert sorted(r[0] for r in catalog.read("opportunities").select("opportunity_id").collect()) == ["opp_1", "opp_3", "opp_4"]
    _, refused = catalog.append_checked({"products": p("prod_x", "prod_x"), "opportunities": o(("opp_9", "prod_x"))}, "three")  # down the references
    assert {tuple(r)[1:] for r in refused.collect()} == {("prod_x", "primary_key"), ("opp_9", "product_id->products")}


def test_filters_let_every_known_key_through(spark):
    own = keys.key_rows({"products": spark.range(9000).select(F.concat(F.lit("prod_"), "id").alias("product_id"))})
    f = keys.filters(own, 9000)
    assert f.first()["blocks"] == 8
    asked = keys.key_rows({"products": spark.range(8000, 20_000).select(F.concat(F.lit("prod_"), "id").alias("product_id"))})
    assert keys.known(asked, own, f).count() == 1000
    few = keys.known(asked, own.limit(0), f)
    assert few.count() == 0


def test_two_writers_at_once_give_one_winner(spark, tmp_path):
    path = str(tmp_path / "c")
    a, b = Catalog.open(spark, path), Catalog.open(spark, path)
    rows = lambda x: {"products": spark.createDataFrame([(x,)], "product_id string")}
    seen = a.state.version
    a.append(rows("prod_a"), "a", checked_at=seen)
    with pytest.raises(Conflict):
        b.append(rows("prod_b"), "b", checked_at=seen)
    assert Catalog.open(spark, path).read("products").count() == 1
    b.append(rows("prod_b"), "b")  # without a check it goes in behind
    assert Catalog.open(spark, path).read("products").count() == 2 and a.read("products").count() == 1 and a.refresh() == 2
    log, state = a.log, a.state
    won = []
    with ThreadPoolExecutor(8) as pool:
        for done in [pool.submit(log.commit, state, {"batch_id": f"t{k}"}) for k in range(8)]:
            try:
                won.append(done.result())
            except Conflict:
                pass
    assert len(won) == 1 and log.state().version == 3


def test_the_kept_view_equals_the_recomputed_one(spark, tmp_path):
    rng = random.Random(11)
    products = [(f"pr_{k}", f"prod_{k % 5}", f"2026-01-0{1 + k % 4}", "text" if k % 4 else " ", ["e"]) for k in range(16)]
    opportunities = [(f"or_{k}", f"opp_{k % 6}", f"prod_{k % 6 % 5}", f"2026-01-0{1 + k % 3}", k % 5 > 0, k % 7 == 0) for k in range(18)]
    events = [(f"ev_{k:02}", f"pr_{k % 17}" if k % 2 else None, None if k % 2 else f"or_{k % 19}", rng.choice(["trust", "trust", "reject", "canonicalize", "request_revision"]), f"2026-02-{1 + rng.randrange(28):02}") for k in range(80)]
    ddl = {
        "product_revisions": "product_revision_id string, product_id string, observed_at string, description string, description_evidence array<string>",
        "opportunity_revisions": "opportunity_revision_id string, opportunity_id string, product_id string, observed_at string, entitled boolean, contradictory boolean",
        "review_events": "review_event_id string, product_revision_id string, opportunity_revision_id string, decision string, created_at string",
    }
    rows = {"product_revisions": products, "opportunity_revisions": opportunities, "review_events": events}
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    catalog.append({"opportunities": spark.createDataFrame([(f"opp_{k}", f"prod_{k % 5}") for k in range(6)], "opportunity_id string, product_id string")}, "o")
    pieces = [(t, rows[t][a : a + n]) for t, n in (("product_revisions", 6), ("opportunity_revisions", 7), ("review_events", 20)) for a in range(0, len(rows[t]), n)]
    rng.shuffle(pieces)
    cols = ["opportunity_id", "product_revision_id", "opportunity_revision_id", "published_at", "product_review_event_id", "opportunity_review_event_id"]
    for k, (t, some) in enumerate(pieces):
        catalog.append({t: spark.createDataFrame(some, ddl[t])}, f"b{k}")
        if k % 3 == 2:
            view.refresh(catalog)
    engine = CatalogEngine(catalog)
    assert not view.is_fresh(catalog) or len(pieces) % 3 == 0
    whole = sorted(tuple(r) for r in engine.published().select(*cols).collect())
    view.refresh(catalog)
    assert view.is_fresh(catalog)
    kept = engine.published().select(*cols)
    assert sorted(tuple(r) for r in kept.collect()) == whole and len(whole) > 2
    assert "review_events" not in kept._jdf.queryExecution().executedPlan().toString()
    # what a refresh reads: the new batch and the state, no revisions of before
    catalog.append({"review_events": spark.createDataFrame([("ev_99", "pr_1", None, "reject", "2026-03-01")], ddl["review_events"])}, "last")
    view.refresh(catalog)
    assert sorted(tuple(r) for r in engine.published().select(*cols).collect()) != whole or all(w[1] != "pr_1" for w in whole)


def test_many_batches_are_a_few_folders(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    catalog.FAN = 3
    for k in range(9):
        catalog.append({"rejections": spark.createDataFrame([(f"s{k}",)], "source_snapshot_id string")}, f"b{k}")
        catalog.compact()
    assert list(catalog.state.live["rejections"].values()) == [2] and catalog.read("rejections").count() == 9
    assert len(catalog.batches("rejections")) == 9
    # the log alone, with a thousand versions: what is opened is a checkpoint and a few entries
    log, state = Log(spark, str(tmp_path / "d")), State()
    for k in range(1000):
        state = log.commit(state, {"batch_id": f"b{k}", "add": {"products": {f"products/{k}": 0}}, "remove": {"products": [f"products/{k - 1}"]} if k else {}})
    read = []
    get = log._get
    log._get = lambda name: read.append(name) or get(name)
    again = log.state()
    assert again == state and again.version == 1000 and len(again.batches) == 1000 and len(read) <= 3 + CHECKPOINT_EVERY


def test_only_finished_batches_are_seen_and_nothing_updates(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    spark.createDataFrame([("prod_x", "t")], "product_id string, created_at string").write.parquet(str(tmp_path / "c/products/batch_id=half"))
    assert catalog.read("products").count() == 0
    assert not [m for m in dir(Catalog) if m.startswith(("update", "delete", "overwrite", "remove"))]
    with pytest.raises(ValueError):
        catalog.append({"nothing": spark.range(1)})


def test_bounds():
    assert bounded("x", ["a"], 100) == ("x", ["a"], 100) and clamped("500") == 100 and clamped("x") == 25
    for bad in (("x" * 513, [], 1), ("", ["a"] * 9, 1), ("", ["a" * 129], 1), ("", [], 0), ("", [], 101), ("", [], True)):
        with pytest.raises(ValueError):
            bounded(*bad)
    assert bounded(" x ", ["a", " "], 1, ["b"]) == ("x", ["a", "b"], 1)
    assert bounded_params({"q": ["x"], "capability": ["a"], "need": ["b"], "limit": ["7"]}) == ("x", ["a", "b"], 7)
    for bad in ({"other": ["1"]}, {"q": ["a", "b"]}, {"limit": ["1.5"]}, {"limit": ["0"]}, {"limit": ["-1"]}):
        with pytest.raises(ValueError):
            bounded_params(bad)
    assert catalog_kind({"product_revisions", "review_events"}) == "typed" and catalog_kind({"source_records", "opportunities"}) == "legacy"


def test_review_decisions_are_idempotent_and_conflicts_show(spark):
    queue = spark.createDataFrame([("q1", ["pr_1", "or_1", "pr_1"])], "review_id string, revision_ids array<string>")
    chosen = spark.createDataFrame([("q1", "accepted", "t")], "review_id string, decision string, decided_at string")
    none = spark.createDataFrame([], "review_event_id string")
    events = history.apply_decisions(queue, chosen, none)
    assert events.count() == 2 and {r["decision"] for r in events.collect()} == {"trust"}
    assert history.apply_decisions(queue, chosen, events).count() == 0
    other = spark.createDataFrame([("q1", "rejected", "t")], "review_id string, decision string, decided_at string")
    assert history.decision_conflicts(events, queue, other).count() == 1 and history.decision_conflicts(events, queue, chosen).count() == 0


def test_evaluation(spark):
    result = "struct<include: boolean, capabilities: array<string>, user_needs: array<string>, requirements: array<struct<field: string, value: string, evidence: string>>, possible_duplicate_names: array<string>, unsupported_or_unknown: array<string>>"
    traces = spark.createDataFrame([("s1", "ok", (True, ["a", "b"], ["n"], [("f", "v", "in text")], ["B"], ["x"])), ("s2", "error", None)], f"source_id string, status string, result {result}")
    labels = spark.createDataFrame([("s1", "A", True, ["a"], ["n", "m"], "g"), ("s2", "B", False, ["z"], [], "g")], "source_id string, name string, include boolean, capabilities array<string>, user_needs array<string>, duplicate_group string")
    sources = spark.createDataFrame([("s1", "it is in text"), ("s2", "")], "source_id string, raw_text string")
    r = evaluate.evaluate(traces, labels, sources).first()
    assert (r["schema_valid_rate"], r["inclusion_accuracy"], r["grounding_rate"], r["unknown_preservation"]) == (0.5, 0.5, 1.0, 1.0)
    assert (r["capability_precision"], r["capability_recall"], r["need_recall"], r["duplicate_precision"]) == (0.5, 1.0, 0.5, 1.0)


def test_streaming_reviews(spark, tmp_path):
    from marlstone.streaming.reviews import latest_decisions

    rows = [(1, "2026-01-01", "a", "trust"), (1, "2026-01-02", "b", "canonicalize"), (2, "2026-01-01", "c", "trust"), (2, "2026-01-03", "d", "reject")]
    schema = "target int, created_at string, review_event_id string, decision string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "e"))
    q = latest_decisions(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("decisions").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["target"], r["decision"]) for r in spark.table("decisions").collect()} == {(1, "trust"), (2, "reject")}


def test_tables_of_a_batch_shuffle_no_documents(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    obs = observed(spark, "2026-01-01T00:00:00Z", [("startup_offers_csv", f"f:{k}", "Acme", f"https://acme.test/{k}", "p", TEXT) for k in range(3)])
    told = [(r["source_snapshot_id"], json.dumps(candidate(r["source_snapshot_id"], "2026-01-01T00:00:00Z"))) for r in obs.collect()]
    joined = obs.join(spark.createDataFrame(told, "source_snapshot_id string, candidate string"), "source_snapshot_id")
    plan = written(plan_identity(joined.select("source_snapshot_id", "source_identity", "observed_at", "candidate", "raw_text"), catalog), "plan")
    tables = index_tables(plan, written(joined.drop("candidate"), "seen"))
    shuffled = {t for t, df in tables.items() if "Exchange" in df._jdf.queryExecution().executedPlan().toString()}
    assert shuffled <= {"products", "opportunities", "facet_index"}  # narrow rows that are made distinct
    assert tables["evidence_spans"].count() == 3 * len(candidate("s", "t")["evidence_spans"]) and tables["product_revisions"].count() == 3


def test_candidates_of_a_small_table_are_not_broadcast(spark, tmp_path, monkeypatch):
    from marlstone.operators import catalog as module

    plans = []
    monkeypatch.setattr(module, "written", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or written(df, label))
    spark.range(3).write.parquet(str(tmp_path / "k"))  # some bytes, from which whole documents come
    url = F.concat(F.lit("https://acme.test/"), F.col("id").cast("string"))
    obs = observe(spark.read.parquet(str(tmp_path / "k")).select(F.lit("readme").alias("source_kind"), url.alias("source_locator"), F.lit("Acme").alias("source_name"), url.alias("source_url"), F.lit("p").alias("source_platform"), F.lit(TEXT).alias("raw_text")), "2026-01-01T00:00:00Z")
    before, after = json.dumps(candidate("SNAP")).split("SNAP")
    told = obs.select("source_snapshot_id", F.concat(F.lit(before), "source_snapshot_id", F.lit(after)).alias("candidate"))
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    for batch in ("one", "two"):
        ingest(catalog, told, obs, batch)
    assert [label for label, _ in plans].count("plan") == 2 and catalog.read("product_revisions").count() == 3
    assert not [label for label, told in plans if label in ("observed", "plan") and "Broadcast" in told]
    assert not [label for label, told in plans if label == "plan" and "Exchange" in told]  # documents are shuffled once, when they meet their observations


def test_known_keys_of_a_product_are_found_again(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    two = lambda sid, at, keys: json.dumps(candidate(sid, at) | {"opportunities": [candidate()["opportunities"][0] | {"local_key": k} for k in keys]})
    ids = {}
    for at, keys in (("2026-01-01T00:00:00Z", ["a", "b"]), ("2026-02-01T00:00:00Z", ["b", None, "c", "a"])):
        obs = observed(spark, at, [("startup_offers_csv", "f:1", "Acme", "https://acme.test", "p", TEXT)])
        sid = obs.first()["source_snapshot_id"]
        told = spark.createDataFrame([(sid, two(sid, at, keys))], "source_snapshot_id string, candidate string")
        plan = plan_identity(obs.join(told, "source_snapshot_id"), catalog)
        ids[at] = {r["k"]: (r["opportunity_id"], r["opportunity_revision_id"], r["opportunity_supersedes"]) for r in plan.select("*", F.col("o.local_key").alias("k")).collect()}
        if at.startswith("2026-01"):
            ingest(catalog, told, obs, "first")
    first, second = ids.values()
    assert all(second[k][0] == first[k][0] and second[k][2] == first[k][1] for k in "ab")
    assert second["c"][2] is None and second[None][2] is None and len({v[0] for v in second.values()}) == 4


def scratch_folders():
    return {p.name for p in Path("/tmp/checkpoints").glob("marlstone-*")}


def test_a_batch_and_a_refresh_leave_only_the_catalog(spark, tmp_path):
    before, catalog = scratch_folders(), Catalog.open(spark, str(tmp_path / "c"))
    for batch, at in (("b1", "2026-01-01T00:00:00Z"), ("b2", "2026-01-01T00:00:00Z"), ("b3", "2026-02-01T00:00:00Z")):  # the second is refused
        put(spark, catalog, at, batch)
    trust(spark, catalog, "r", "2026-03-01T00:00:00Z")
    view.refresh(catalog)
    assert scratch_folders() == before
    assert catalog.read("product_revisions").count() == 2 and catalog.read("rejections").count() == 1
    assert CatalogEngine(catalog).published().count() == 1


def test_what_is_written_goes_where_a_build_fails(spark):
    before = scratch_folders()

    def build(path):
        spark.range(3).write.parquet(path)
        with scratch(spark):
            written(spark.range(3), "inner")
            raise RuntimeError("no")

    with pytest.raises(RuntimeError, match="no"):
        kept_folder(spark, "fails", "here", build)
    assert scratch_folders() == before
    kept = written(spark.range(3), "outside")  # outside of the block nothing goes
    assert kept.count() == 3 and len(scratch_folders() - before) == 1


def test_a_task_holds_few_megabytes_of_what_it_writes_and_reads(spark, tmp_path, monkeypatch):
    from marlstone.operators import catalog as module

    many = spark.range(0, 6000, 1, 1).select(F.col("id").cast("string").alias("source_snapshot_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(128)), lambda n: F.sha2(F.concat(F.col("id").cast("string"), n.cast("string")).cast("binary"), 256)), "").alias("full_text"))
    catalog = Catalog.open(spark, str(tmp_path / "c"))
    at = catalog.write("source_snapshots", many, "b")
    for files in (written(many, "many").inputFiles(), catalog._load("source_snapshots", [at]).inputFiles()):
        groups = [g.row_group(n).total_byte_size for f in files for g in [parquet.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata] for n in range(g.num_row_groups)]
        assert sum(groups) > 40 << 20 and max(groups) <= 24 << 20  # 48 MB of text
    keys, seen = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"), {}
    now = lambda: [spark.conf.get(k) for k in keys]
    monkeypatch.setattr(module, "written", lambda df, label: seen.update({label: now()}) or written(df, label))
    before = now()
    put(spark, catalog, "2026-01-01T00:00:00Z", "one")
    assert now() == before and [int(v) <= most for v, most in zip(seen["plan"], (512, 1000, 4 << 20), strict=True)] == [True] * 3
