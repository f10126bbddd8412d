"""The flat catalog: full rebuild, LIKE search, refresh with review queue, promotion (SNK-01/02/08/09, PRJ-04/10/11/12/14, API-03..06, DIF-*, SRC-09)."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import annotate, derive_products, select_top, with_score
from ..functions.text import record_identity, sha_id, slug
from ..sources.readers import read_records
from .engine import clamped
from .history import change_fingerprint, first_wins, insert_or_ignore, last_wins, promotion_blockers, snapshot_diff, violations
from .search import like_all, with_link_flags

# The flat catalog's needs and capabilities.
USER_NEEDS = [
    ("call-model-api", "I need to call an AI model through an API."), ("free-inference", "I need free or discounted model inference."), ("model-routing", "I need to compare or route between models."),
    ("embeddings-search", "I need embeddings or semantic search."), ("build-agent", "I need to build an AI agent."), ("train-model", "I need to train or fine-tune a model."), ("evaluate-ai", "I need to evaluate or monitor an AI system."),
    ("gpu-accelerator", "I need a GPU or accelerator."), ("ai-notebook", "I need a notebook or hosted AI development environment."), ("virtual-computer", "I need a virtual computer or VM."),
    ("cloud-credits", "I need cloud credits for an AI project."), ("generate-media", "I need to generate text, code, images, audio, or video."),
]
CAPABILITIES = [
    ("model-inference", "Hosted model inference"), ("model-api", "Model API access"), ("model-routing", "Model routing or gateway"), ("embeddings", "Embeddings"), ("vector-search", "Vector or semantic search"), ("agent-platform", "AI agent platform"),
    ("training", "Model training or fine-tuning"), ("evaluation", "AI evaluation"), ("observability", "AI observability"), ("gpu-compute", "GPU or accelerator compute"), ("notebook", "Hosted notebook"), ("virtual-machine", "Virtual machine or computer"),
    ("cloud-credit", "Cloud or infrastructure credit"), ("text-generation", "Text generation"), ("code-generation", "Code generation"), ("image-generation", "Image generation"), ("audio-generation", "Audio generation"), ("video-generation", "Video generation"),
]
TEXT = ["source_name", "source_description", "source_offer_detail"]


def staged(records: DataFrame, limit: int = 60) -> DataFrame:
    """Selected records with ids, product, opportunity and annotations; one row each, ready for every table and for diffing."""
    x = select_top(with_score(records, TEXT, "source_category"), limit=limit, order_col="source_order")
    x = x.withColumn("source_id", sha_id(F.concat_ws("\n", "source_kind", "source_locator", "raw_text"), 16, "src_"))
    x = annotate(x, TEXT, "source_category")
    kind = F.when(F.col("source_kind") == "startup_offers_csv", "startup_offer").otherwise("public_free_tier")
    opp = F.concat(F.lit("opp_"), slug(F.col("source_name")), F.lit("_"), sha_id(F.col("source_id"), 10))
    return x.withColumns({"opportunity_id": opp, "opportunity_type": kind})


def tables(rows: DataFrame, generated_at: str) -> dict[str, DataFrame]:
    """SNK-01, PRJ-10, PRJ-11: the flat tables of staged records; links and products keep the first by source order."""
    spark = rows.sparkSession
    derived = derive_products(rows, slug, keep=["source_order"])
    product = derive_products(rows, slug, keep=rows.columns)
    linked = lambda col, name: product.select("product_id", "source_id", F.explode(col).alias("l")).select("product_id", F.col("l.id").alias(name), "source_id", "l.derivation", "l.confidence", "l.evidence")
    unmapped = rows.filter((F.size("capabilities") == 0) & (F.size("needs") == 0))
    return {
        "metadata": spark.createDataFrame([("version", "0.0.1"), ("generated_at", generated_at)], "key string, value string"),
        "source_records": rows.select(*[c for c in rows.columns if c.startswith(("source_", "parent_", "estimated_", "raw_")) and c != "source_order"], F.col("score").alias("selection_score"), F.to_json("reasons").alias("selection_reasons_json")),
        "products": first_wins(derived, ["product_id"], "source_order").drop("source_order"),
        "opportunities": product.drop("name").select("opportunity_id", "source_id", "product_id", F.col("source_name").alias("name"), "opportunity_type", F.col("source_offer_detail").alias("benefit_text"), F.col("source_eligibility").alias("eligibility_text"), "estimated_value_usd"),
        "capabilities": spark.createDataFrame(CAPABILITIES, "capability_id string, label string"),
        "user_needs": spark.createDataFrame(USER_NEEDS, "user_need_id string, label string"),
        "product_capabilities": linked("capabilities", "capability_id"),
        "product_user_needs": linked("needs", "user_need_id"),
        "requirements": rows.filter(F.coalesce("source_eligibility", F.lit("")) != "").select(sha_id(F.concat(F.col("opportunity_id"), F.lit("\neligibility")), 16, "req_").alias("requirement_id"), "opportunity_id", F.lit("eligibility_text").alias("field"), F.col("source_eligibility").alias("value"), F.lit("source_stated").alias("derivation"), F.lit(1.0).alias("confidence"), F.col("source_eligibility").alias("evidence")),
        "review_items": unmapped.select(sha_id(F.concat(F.col("source_id"), F.lit("\nmissing_mapping")), 16, "rev_").alias("review_id"), "source_id", F.lit("missing_outcome_mapping").alias("item_type"), F.to_json(F.struct("source_name")).alias("payload_json"), F.lit(generated_at).alias("created_at")),
    }


def material() -> Column:
    """PRJ-12: what makes a change, as JSON text; id arrays sorted."""
    ids = lambda c: F.array_sort(F.transform(c, lambda x: x["id"]))
    return F.to_json(F.struct(F.col("source_name").alias("name"), F.col("source_url").alias("url"), F.col("source_description").alias("description"), F.col("source_offer_detail").alias("offer_detail"), F.col("source_eligibility").alias("eligibility"), "estimated_value_usd", ids("capabilities").alias("capabilities"), ids("needs").alias("needs")))


def identified(rows: DataFrame) -> DataFrame:
    """WIN-07: the last record of each identity, with its material."""
    x = rows.withColumns({"identity_key": record_identity(F.col("source_kind"), F.col("source_name"), F.col("source_url")), "material": material()})
    return last_wins(x, ["identity_key"], "score").select("identity_key", "material", "source_id")


def model_requests(rows: DataFrame, most: int = 60) -> DataFrame:
    """PRJ-14, JON-10: the request for each record of a selection; peers are one array that all rows share.

    A request names every peer, so a selection of more than ``most`` rows raises.
    """
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a selection has at most {most} records")
    names = rows.agg(F.array_sort(F.collect_list(F.struct("source_id", "source_name"))).alias("_all"))  # most rows at most
    peers = F.transform(F.filter("_all", lambda p: p["source_id"] != F.col("source_id")), lambda p: p["source_name"])
    record = F.struct("source_id", F.col("source_name").alias("name"), F.col("source_category").alias("category"), F.col("source_description").alias("description"), F.col("source_offer_detail").alias("offer_detail"), F.col("source_eligibility").alias("eligibility"), "parent_provider")
    request = F.to_json(F.struct(F.lit(json.dumps(dict(CAPABILITIES))).alias("controlled_capabilities"), F.lit(json.dumps(dict(USER_NEEDS))).alias("controlled_user_needs"), peers.alias("comparison_candidate_names"), record.alias("record")))
    return rows.crossJoin(F.broadcast(names)).select("source_id", request.alias("request"))  # one row on the right


class FlatCatalog:
    """Tables of one snapshot in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rebuild(self, rows: DataFrame, generated_at: str) -> None:
        for name, df in tables(rows, generated_at).items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.stats().withColumn("generated_at", F.lit(generated_at)).coalesce(1).write.mode("overwrite").json(f"{self.path}/build-summary")

    def summary(self) -> DataFrame:
        """SNK-02: the one-row summary that the last build wrote, as JSON."""
        return self.spark.read.json(f"{self.path}/build-summary")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def needs(self) -> DataFrame:
        return self.read("user_needs").orderBy("label")

    def capabilities(self) -> DataFrame:
        return self.read("capabilities").orderBy("label")

    def stats(self) -> DataFrame:
        """AGG-03: counts of the build."""
        s = self.read("source_records").agg(F.count("*").alias("records"), F.count_if(F.col("source_kind") == "startup_offers_csv").alias("offers"))
        for t in ("products", "product_capabilities", "product_user_needs", "review_items"):
            s = s.crossJoin(self.read(t).agg(F.count("*").alias(t)))  # one row each
        return s

    def search(self, q: str = "", need: str | None = None, capability: str | None = None, source: str | None = None, limit=25) -> DataFrame:
        """FLT-02, JON-07, SRT-04: every term in the text or in a linked need or capability; literal, not wildcards (T3)."""
        terms = [t for t in (q or "").strip().lower().split() if t][:8]
        s = self.read("source_records").select("source_id", "source_kind", "source_locator", "source_category", "source_url", "source_name", "source_description", "source_offer_detail", "source_eligibility", "raw_text", "selection_score")
        rows = self.read("opportunities").join(s, "source_id")
        caps = self.read("product_capabilities").join(self.read("capabilities"), "capability_id").select("product_id", "source_id", F.col("capability_id").alias("id"), "label")
        needs = self.read("product_user_needs").join(self.read("user_needs"), "user_need_id").select("product_id", "source_id", F.col("user_need_id").alias("id"), "label")
        key = F.concat_ws("\n", "product_id", "source_id")
        rows = rows.withColumn("_k", key)
        if terms:
            links = caps.union(needs).select(key.alias("_k"), F.concat_ws(" ", "id", "label").alias("_t"))
            rows, flags = with_link_flags(rows, links, "_k", "_t", terms)
            rows = rows.filter(like_all(F.concat_ws(" ", "source_name", "source_description", "source_offer_detail", "source_eligibility"), terms, flags))
        for links, wanted in ((needs, need), (caps, capability)):
            if wanted:
                rows = rows.join(links.filter(F.col("id") == wanted).select(key.alias("_k")).distinct(), "_k", "left_semi")
        if source:
            rows = rows.filter(F.col("source_kind") == source)
        return rows.drop("_k", *[c for c in rows.columns if c.startswith("_l")]).orderBy(F.col("selection_score").desc(), F.lower("name"), "opportunity_id").limit(clamped(limit))

    def details(self, rows: DataFrame) -> DataFrame:
        """PRJ-04: capabilities, needs and requirements as arrays, three grouped joins."""
        keys = ["product_id", "source_id"]
        for table, dim, name, out in (("product_capabilities", "capabilities", "capability_id", "capabilities"), ("product_user_needs", "user_needs", "user_need_id", "user_needs")):
            l = self.read(table).join(self.read(dim), name).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", F.col(name).alias("id"), "confidence", "evidence"))).alias(out))
            rows = rows.join(l, keys, "left")
        r = self.read("requirements").groupBy("opportunity_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "derivation", "confidence", "evidence"))).alias("requirements"))
        return rows.join(r, "opportunity_id", "left")


class RefreshRunning(RuntimeError):
    """DIF-04: another refresh holds the lock; a command ends with ``exit_code``."""

    exit_code = 75


class Refresh:
    """Snapshots by run, a pointer to the latest and one to the trusted state, and the review queue between them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def pointer(self, name: str) -> str | None:
        """SRC-09: the run that a pointer names, or none before the first load."""
        p, fs = self._fs(f"{name}.json")
        return json.loads(self.spark.read.text(str(p), wholetext=True).first()[0])["run_id"] if fs.exists(p) else None

    def point(self, name: str, run_id: str) -> None:
        """SNK-08: written after everything that it points to."""
        p, fs = self._fs(f"{name}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"run_id": run_id}).encode()))
        out.close()

    def staging(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshots/run_id={run_id}/staging")

    def queue(self) -> DataFrame:
        p, fs = self._fs("queue")
        schema = "review_id string, fingerprint string, run_id string, item_type string, identity_key string, status string, created_at string"
        return self.spark.read.schema(schema).parquet(str(p)) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def changes(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshots/run_id={run_id}/changes")

    def run(self, run_id: str, markdown: str | None, offers: str | None, at: str) -> dict:
        """DIF-01, DIF-02: builds a snapshot, compares it with the trusted one and queues what changed; the first load becomes the baseline."""
        rows = staged(read_records(self.spark, markdown, offers))
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshots/run_id={run_id}/staging")
        now, before = self.staging(run_id), self.pointer("current")
        diff = snapshot_diff(identified(self.staging(before)), identified(now), "identity_key", "material") if before else snapshot_diff(identified(now).limit(0), identified(now), "identity_key", "material")
        print_ = F.substring(change_fingerprint(F.col("change_type"), F.col("identity_key"), F.col("before"), F.col("after")), 1, 32)
        diff.withColumn("fingerprint", print_).write.mode("overwrite").parquet(f"{self.path}/snapshots/run_id={run_id}/changes")
        changes, added = self.changes(run_id), 0
        if before:
            new = changes.select(F.concat(F.lit("review_"), F.substring("fingerprint", 1, 16)).alias("review_id"), "fingerprint", F.lit(run_id).alias("run_id"), F.concat(F.lit("catalog_"), "change_type").alias("item_type"), "identity_key", F.lit("open").alias("status"), F.lit(at).alias("created_at"))
            new = insert_or_ignore(self.queue(), new, ["fingerprint"], "review_id")
            added = new.count()
            new.write.mode("append").parquet(f"{self.path}/queue")
        self.point("latest", run_id)
        if not before:
            self.point("current", run_id)
        kinds = {r["change_type"]: r["count"] for r in changes.groupBy("change_type").count().collect()}
        return {"run_id": run_id, "initial_load": not before, "records": now.count(), **{k: kinds.get(k, 0) for k in ("added", "changed", "removed")}, "review_items_added": added}

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """DIF-04: one refresh at a time; a second one raises at once and leaves the first one's lock alone."""
        p, fs = self._fs("refresh.lock")
        try:
            fs.create(p, False).close()
        except Py4JJavaError as e:
            if fs.exists(p):
                raise RefreshRunning(str(p)) from e
            raise
        try:
            yield
        finally:
            fs.delete(p, False)

    def job(self, run_id: str, markdown: str | None, offers: str | None, at: str) -> dict:
        """SNK-09: a run under the lock, with a line in the log whether it ends well or not."""
        with self.lock():
            code, told = 1, {}
            try:
                told = self.run(run_id, markdown, offers, at)
                code = 0
                return told
            finally:
                append_log(self.spark.createDataFrame([(run_id, at, code, json.dumps(told))], "run_id string, started_at string, exit_code int, summary string"), f"{self.path}/logs")

    def promote(self, decisions: DataFrame) -> str:
        """DIF-03: the latest snapshot becomes trusted if every one of its changes is accepted, whichever run queued it (D2)."""
        latest, current = self.pointer("latest"), self.pointer("current")
        if latest is None:
            raise ValueError("there is no snapshot")
        if latest != current:
            n = promotion_blockers(self.changes(latest), decisions).count()
            if n:
                raise ValueError(f"{n} changes are not accepted")
            self.point("current", latest)
        return latest


def append_log(df: DataFrame, path: str) -> None:
    """SNK-09: rows as lines of JSON behind what is there."""
    df.write.mode("append").json(path)


def check_result(df: DataFrame, result: str, capabilities: list[str], needs: list[str]) -> dict[str, Column]:
    """VAL-20: rules of a flat model answer, for ``history.violations``."""
    r = F.col(result)
    inside = lambda c, known: c.isNotNull() & (F.size(F.array_except(c, F.array(*[F.lit(k) for k in known]))) == 0)
    rules = {"source_id": r["source_id"] == F.col("source_id"), "include": r["include"].isNotNull(), "capabilities": inside(r["capabilities"], capabilities), "user_needs": inside(r["user_needs"], needs), "confidence": r["confidence"].between(0, 1), "explanation": r["explanation"].isNotNull()}
    rules |= {k: r[k].isNotNull() for k in ("requirements", "possible_duplicate_names", "unsupported_or_unknown")}
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def plan_rules() -> dict[str, Column]:
    """VAL-19, FN-18: the grammar of planned ids."""
    g = lambda c, p: F.col(c).isNull() | F.col(c).rlike(f"^{p}_[a-z0-9_]{{4,96}}$")
    return {"product_id": g("product_id", "prod"), "product_revision_id": g("product_revision_id", "pr"), "opportunity_id": g("opportunity_id", "opp"), "opportunity_revision_id": g("opportunity_revision_id", "or")}


def plan_problems(plan: DataFrame, opportunities: DataFrame, product_revisions: DataFrame, opportunity_revisions: DataFrame) -> DataFrame:
    """VAL-19: (rule_id, row_key) of planned revisions with ids out of grammar, an opportunity of another product, or a
    superseded revision that is unknown or of something else.

    plan: the ids and product_supersedes, opportunity_supersedes; the others are the catalog's tables.
    """
    owner = opportunities.select("opportunity_id", F.col("product_id").alias("_owner"))
    prior = product_revisions.select(F.col("product_revision_id").alias("product_supersedes"), F.col("product_id").alias("_of_product"))
    prior_opp = opportunity_revisions.select(F.col("opportunity_revision_id").alias("opportunity_supersedes"), F.col("opportunity_id").alias("_of_opportunity"))
    x = plan.join(owner, "opportunity_id", "left").join(prior, "product_supersedes", "left").join(prior_opp, "opportunity_supersedes", "left")
    inside = lambda ref, of, own: F.col(ref).isNull() | F.coalesce(F.col(of) == F.col(own), F.lit(False))
    rules = plan_rules() | {
        "opportunity_owner": F.col("_owner").isNull() | (F.col("_owner") == F.col("product_id")),
        "product_supersedes": inside("product_supersedes", "_of_product", "product_id"),
        "opportunity_supersedes": inside("opportunity_supersedes", "_of_opportunity", "opportunity_id"),
    }
    return violations(x, rules, F.coalesce("opportunity_revision_id", "product_revision_id"))
