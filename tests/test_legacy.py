import pytest
from pyspark.sql import functions as F

from marlstone.operators.history import violations
from marlstone.operators.legacy import CAPABILITIES, USER_NEEDS, FlatCatalog, Refresh, append_log, check_result, model_requests, plan_rules, staged
from marlstone.sources.readers import read_records

HEAD = "# L\n\n## Generative AI\n\n"
V1 = HEAD + "  * [Models](http://m) - Call hosted models by a model API\n  * [Other](http://o) - Something else\n\n## Talks\n\n  * [Course](http://c) - Learn\n"
V2 = HEAD + "  * [Models](http://m) - Call hosted models by a model API, now with more\n  * [Vectors](http://v) - vector search\n  * [Other](http://o) - Something else\n\n## Talks\n\n  * [Course](http://c) - Learn\n"
CSV = "Brand/Product,Description,Monetary Detail,Eligibility Notes,Category,Application Link,Platform/Source,Estimated Value\nCloudy,GPU cloud,cloud credits,startups only,Cloud Programs,http://x,Board,$1000\n"


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "v1").mkdir(), (tmp_path / "v2").mkdir()
    (tmp_path / "v1/README.md").write_text(V1), (tmp_path / "v2/README.md").write_text(V2), (tmp_path / "offers.csv").write_text(CSV)
    return tmp_path


def test_build_and_search(spark, files):
    rows = staged(read_records(spark, str(files / "v1/README.md"), str(files / "offers.csv"))).cache()
    assert [r["source_name"] for r in rows.select("source_name", "score").orderBy(F.col("score").desc(), "source_name").collect()] == ["Models", "Cloudy", "Other"]
    c = FlatCatalog(spark, str(files / "flat"))
    c.rebuild(rows, "2026-01-01T00:00:00Z")
    s = c.stats().first()
    assert (s["records"], s["offers"], s["products"], s["review_items"]) == (3, 1, 3, 1)
    assert [r["name"] for r in c.search("cloud").collect()] == ["Cloudy"]
    assert [r["name"] for r in c.search("api call").collect()] == ["Models"]  # by a linked need's label
    assert c.search("100%").count() == 0 and c.search(need="call-model-api").count() == 1 and c.search(source="startup_offers_csv").count() == 1 and c.search(limit="x").count() == 3
    d = c.details(c.search(capability="gpu-compute")).first()
    assert [x["id"] for x in d["capabilities"]] == ["cloud-credit", "gpu-compute"] and d["requirements"][0]["value"] == "startups only"
    assert c.needs().count() == len(USER_NEEDS) and c.capabilities().count() == len(CAPABILITIES)
    links = c.read("opportunities").join(c.read("source_records"), "source_id", "left_anti").count()
    assert links == 0
    requests = {r["source_id"]: r["request"] for r in model_requests(rows).collect()}
    assert len(requests) == 3 and all(q.count("comparison_candidate_names") == 1 for q in requests.values())
    append_log(rows.select("source_id"), str(files / "log"))
    append_log(rows.select("source_id"), str(files / "log"))
    assert spark.read.json(str(files / "log")).count() == 6


def test_refresh_and_promotion(spark, files):
    r = Refresh(spark, str(files / "state"))
    none = spark.createDataFrame([], "fingerprint string, status string")
    assert r.pointer("current") is None
    first = r.run("r1", str(files / "v1/README.md"), str(files / "offers.csv"), "t1")
    assert first["initial_load"] and first["review_items_added"] == 0 and r.pointer("current") == "r1"
    second = r.run("r2", str(files / "v2/README.md"), str(files / "offers.csv"), "t2")
    assert (second["added"], second["changed"], second["removed"], second["review_items_added"]) == (1, 1, 0, 2)
    with pytest.raises(ValueError, match="2 changes"):
        r.promote(none)
    again = r.run("r3", str(files / "v2/README.md"), str(files / "offers.csv"), "t3")
    assert again["review_items_added"] == 0
    with pytest.raises(ValueError):  # queued by the run before, still not accepted
        r.promote(none)
    assert r.promote(r.queue().withColumn("status", F.lit("accepted"))) == "r3" and r.pointer("current") == "r3"


def test_answer_rules(spark):
    schema = "source_id string, result struct<source_id: string, include: boolean, capabilities: array<string>, user_needs: array<string>, confidence: double, explanation: string, requirements: array<string>, possible_duplicate_names: array<string>, unsupported_or_unknown: array<string>>"
    df = spark.createDataFrame([("a", ("a", True, ["x"], [], 0.5, "", [], [], [])), ("b", ("c", None, ["z"], None, 2.0, None, [], [], []))], schema)
    found = violations(df, check_result(df, "result", ["x"], ["n"]), F.col("source_id"))
    assert {r["rule_id"] for r in found.collect()} == {"source_id", "include", "capabilities", "user_needs", "confidence", "explanation"}
    plan = spark.createDataFrame([("prod_abcd", "pr_abcd", None, None), ("x", "pr_abcd", "opp_1", "or_abcd")], "product_id string, product_revision_id string, opportunity_id string, opportunity_revision_id string")
    assert violations(plan, plan_rules(), F.col("product_id")).count() == 2
