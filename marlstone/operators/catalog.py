"""The append-only catalog: tables in Parquet, batches made visible by a log (SNK-05, SNK-07, SNK-10, VAL-21, IDN-*, PRJ-05..09)."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keys, sets
from ..functions.text import cited_json, money_micros, quote_offset, sha_id, source_identity
from .candidate import CANDIDATE_DDL
from .contract import CONTRACT_VERSION, run_rules
from .contract_columns import validate_candidates
from .history import violations
from .index import index_tables as text_index
from .keys import KEYS
from .log import Conflict, Log, State
from .publish import entitled, latest, uncontradicted
from .shared import ROW_GROUP, scratch, small_batches, written

TABLES = {
    "source_snapshots": "source_snapshot_id string, source_identity string, source_kind string, source_locator string, source_name string, source_url string, observed_at string, content_hash string, full_text string",
    "evidence_spans": "source_snapshot_id string, evidence_key string, quote string, start_offset int, end_offset int",
    "products": "product_id string, created_at string",
    "product_revisions": "product_revision_id string, product_id string, source_snapshot_id string, supersedes string, name string, description string, description_evidence array<string>, evidence_ids array<string>, document_json string, "
    "observed_at string, created_at string",
    "opportunities": "opportunity_id string, product_id string, local_key string, created_at string",
    "opportunity_revisions": "opportunity_revision_id string, opportunity_id string, product_id string, product_revision_id string, local_key string, source_snapshot_id string, supersedes string, availability string, effective_from string, effective_to string, "
    "entitled boolean, contradictory boolean, evidence_ids array<string>, document_json string, observed_at string, created_at string",
    "review_events": "review_event_id string, review_id string, product_revision_id string, opportunity_revision_id string, decision string, canonical_product_id string, reviewer_kind string, reviewer_id string, note string, created_at string",
    "facet_index": "product_revision_id string, namespace string, concept_id string, basis string",
    "entitlement_index": "opportunity_revision_id string, entitlement_key string, kind string, label string, quantity double, quantity_comparator string, source_unit string, normalized_unit string, cadence_interval bigint, cadence_unit string, cadence_alignment string, "
    "duration_value double, duration_unit string, monetary_micros bigint, monetary_currency string, monetary_comparator string, maximum_micros bigint, percentage double, percentage_comparator string, cost_scope string",
    "entitlement_applicability_index": "opportunity_revision_id string, entitlement_key string, ordinal int, target_type string, source_label string",
    "constraint_index": "opportunity_revision_id string, constraint_key string, kind string, other_kind string, target_key string, quantity double, quantity_comparator string, normalized_unit string, "
    "cadence_interval bigint, cadence_unit string, cadence_alignment string",
    "condition_index": "opportunity_revision_id string, condition_key string, family string, normalized_kind string, required boolean, verification_required boolean, state string, target_key string",
    "condition_geography_index": "opportunity_revision_id string, condition_key string, mode string, region string",
    "condition_audience_index": "opportunity_revision_id string, condition_key string, audience string",
    "search_index": "opportunity_revision_id string, name string, description string, outcomes string, source_text string",
    "search_postings": "term string, key string, part int, positions array<int>, length bigint, bucket int",
    "search_terms": "term string, documents bigint, bucket int",
    "search_totals": "documents bigint, tokens bigint",
    "key_sets": "of string, key string, bucket int",
    "key_filters": "blocks bigint, block bigint, bits binary",
    "revision_state": "revision_id string, kind string, key string, observed_at string, passes boolean, decided_at string, review_event_id string, decision string, bucket int",
    "key_state": "kind string, key string, revision_id string, observed_at string, decided_at string, review_event_id string, best boolean, bucket int",
    "rejections": "source_snapshot_id string, rule_id string, path string, message string",
}


#: Tables whose folders are partitioned by a hash bucket, and what their files are sorted by.
BUCKETED = {"search_postings": "term", "search_terms": "term", "key_sets": "key", "revision_state": "revision_id", "key_state": "key"}


class Catalog:
    """Tables under one folder.  There is ``append`` and ``read``; nothing updates or deletes rows.

    A batch is written table by table into its own folders and becomes visible as a
    whole when the log's next version names them.  A job that dies before that leaves files
    that no reader sees.  An open catalog reads one version until it appends or is
    refreshed.  ``compact`` folds small folders into larger ones of the same rows, level by level, so
    a table of n batches has some ``FAN * log(n)`` folders.
    """

    #: Folders of one level that are folded into one of the next.
    FAN = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._state: State | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        out = cls(spark, path)
        have = out.state.meta.get("contract_version", CONTRACT_VERSION)
        if have != CONTRACT_VERSION:
            raise ValueError(f"catalog version {have} is not {CONTRACT_VERSION}")
        return out

    @property
    def log(self) -> Log:
        return Log(self.spark, self.path)

    @property
    def state(self) -> State:
        if self._state is None:
            self.refresh()
        return self._state

    def refresh(self) -> int:
        """To the newest version, whose number it gives."""
        self._state = self.log.state()
        return self._state.version

    def batches(self, table: str) -> list[str]:
        return sorted(b for b, tables in self.state.batches.items() if table in tables)

    def write(self, table: str, df: DataFrame, folder: str) -> str:
        """The rows in a folder of the table, which no reader sees before the log names it."""
        want = self.spark.createDataFrame([], TABLES[table])
        if extra := set(df.columns) - set(want.columns):
            raise ValueError(f"{table} has no columns {sorted(extra)}")
        rows, at = want.unionByName(df, allowMissingColumns=True), f"{table}/batch_id={folder}"
        if table in BUCKETED:
            # adaptive execution gives small buckets one task together and splits a large one
            rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", BUCKETED[table])
            rows.write.mode("overwrite").options(**ROW_GROUP).partitionBy("bucket").parquet(f"{self.path}/{at}")
        else:
            rows.write.mode("overwrite").options(**ROW_GROUP).parquet(f"{self.path}/{at}")
        return at

    def append(self, parts: dict[str, DataFrame], batch_id: str | None = None, checked_at: int | None = None) -> str:
        """One batch, visible at once or not at all; a batch id that is in already appends nothing.

        With ``checked_at``, the version that the caller's checks have seen, ``Conflict``
        is raised if another version came since; else the batch goes in after whatever is there.
        """
        unknown = parts.keys() - TABLES.keys()
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        batch_id = batch_id or uuid.uuid4().hex
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError("a batch id is letters, digits, _ and -")
        if checked_at is None or self.state.version != checked_at:
            self.refresh()
        if batch_id in self.state.batches:
            return batch_id  # a retry of what is there already
        folder = f"{batch_id}-{uuid.uuid4().hex[:8]}"
        with ThreadPoolExecutor(8) as pool:  # tables do not depend on each other, so their jobs run side by side
            added = {name: {at: 0} for name, at in zip(parts, pool.map(lambda x: self.write(*x, folder), parts.items()), strict=True)}
        written_keys = keys.key_rows({t: self._load(t, list(added[t])) for t in parts if t in keys.KEYS})
        if written_keys is not None:
            added["key_sets"] = {self.write("key_sets", written_keys, folder): 0}
            stored = self._load("key_sets", list(added["key_sets"]))
            added["key_filters"] = {self.write("key_filters", keys.filters(stored, stored.count()), folder): 0}
        entry = {"batch_id": batch_id, "add": added, "meta": {"contract_version": CONTRACT_VERSION}}
        while True:
            if checked_at is not None and self.state.version != checked_at:
                raise Conflict(f"version {self.state.version} came after {checked_at}")
            try:
                self._state = self.log.commit(self.state, entry)
                return batch_id
            except Conflict:
                self.refresh()
                if batch_id in self.state.batches:
                    return batch_id

    def append_checked(self, parts: dict[str, DataFrame], batch_id: str | None = None) -> tuple[str, DataFrame]:
        """SNK-11: the batch without rows that repeat a key or refer to nothing, and (of, key, rule_id) of what was refused.

        Rows that refer to a refused row are refused too.  The check and the append are of
        one version: where another writer comes between, all is checked again.
        """
        while True:
            seen = self.refresh()
            if batch_id in self.state.batches:
                return batch_id, self.spark.createDataFrame([], "of string, key string, rule_id string")
            rows, refused = dict(parts), None
            for _ in range(len(keys.KEYS) + 1):  # a refusal goes down the references at most once a table
                found = written(keys.problems(rows, self.read("key_sets"), self.read("key_filters")), "refused")
                if found.isEmpty():
                    break
                refused = found if refused is None else refused.union(found)
                for table in rows:
                    for columns in [KEYS[table]] if table in KEYS else [c for t, c, _ in keys.REFERENCES if t == table]:
                        bad = found.filter(F.col("of") == table).select(F.col("key").alias("_key")).distinct()
                        rows[table] = rows[table].withColumn("_key", keys.key_of(columns)).join(bad, "_key", "left_anti").drop("_key")
            try:
                batch_id = self.append(rows, batch_id, checked_at=seen)
            except Conflict:
                continue
            return batch_id, refused if refused is not None else self.spark.createDataFrame([], "of string, key string, rule_id string")

    def compact(self) -> int:
        """Folds every ``FAN`` folders of one level of a table into one; how many went.  Rows stay as they are."""
        gone = 0
        for table in sorted(self.state.live):
            for level in range(64):
                paths = [p for p, at in self.state.live[table].items() if at == level]
                if len(paths) < self.FAN or table in ("revision_state", "key_state"):  # these are rewritten by bucket anyway
                    continue
                into = self.write(table, self._load(table, paths), f"level{level + 1}-{uuid.uuid4().hex[:8]}")
                while True:
                    try:
                        self._state = self.log.commit(self.state, {"add": {table: {into: level + 1}}, "remove": {table: paths}})
                        break
                    except Conflict:
                        self.refresh()
                        if not set(paths) <= self.state.live[table].keys():
                            return gone  # another compaction was faster
                gone += len(paths)
        return gone

    def _load(self, table: str, paths: list[str]) -> DataFrame:
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema)
        if table in BUCKETED:
            read = read.option("basePath", f"{self.path}/{table}")
        return read.parquet(*[f"{self.path}/{p}" for p in sorted(paths)]).select(*schema.names)

    def read(self, table: str) -> DataFrame:
        """Rows of the open version; older files that lack a column give null (SNK-10)."""
        return self._load(table, list(self.state.live.get(table, ())))


def observe(records: DataFrame, observed_at: str) -> DataFrame:
    """IDN-01: records with identity, snapshot id and time; the listing's kind is mapped to the catalog's (D1)."""
    kind = F.when(F.col("source_kind") == "startup_offers_csv", F.lit("startup_offer_csv")).otherwise(F.col("source_kind"))
    x = records.filter((F.trim(F.coalesce("source_name", F.lit(""))) != "") & (F.coalesce("raw_text", F.lit("")) != "")).withColumn("source_kind", kind)
    x = x.withColumn("source_identity", source_identity(F.col("source_kind"), F.col("source_url"), F.col("source_platform"), F.col("source_name")))
    return x.withColumns({"observed_at": F.lit(observed_at), "content_hash": F.sha2(F.col("raw_text").cast("binary"), 256), "source_snapshot_id": sha_id(F.concat_ws("\n", "source_identity", F.lit(observed_at)), 24, "srcsnap_")})


def known_ids(records: DataFrame, catalog: Catalog) -> DataFrame:
    """IDN-02: records with product_id, product_supersedes and, by local key, the opportunities that their product has (``_has``).

    The catalog is asked by identity alone, so of the joins only the last carries the records.  All are merge joins: a
    table's size on disk tells little of what repeated texts need in memory.
    """
    snaps, revs = catalog.read("source_snapshots"), catalog.read("product_revisions")
    known = latest(revs.join(snaps.select("source_snapshot_id", "source_identity").hint("merge"), "source_snapshot_id"), ["source_identity"], [F.col("observed_at").desc(), F.col("product_revision_id").desc()])
    known = known.select("source_identity", F.col("product_id").alias("_known"), F.col("product_revision_id").alias("product_supersedes"))
    old = latest(catalog.read("opportunity_revisions").filter("local_key is not null"), ["product_id", "local_key"], [F.col("observed_at").desc(), F.col("opportunity_revision_id").desc()])
    has = F.struct("local_key", F.struct(F.col("opportunity_id").alias("id"), F.col("opportunity_revision_id").alias("revision")))
    old = old.groupBy("product_id").agg(F.map_from_entries(F.collect_list(has)).alias("_has"))
    ids = records.select("source_identity").distinct().join(known.hint("merge"), "source_identity", "left")
    ids = ids.withColumn("product_id", F.coalesce("_known", sha_id(F.col("source_identity"), 24, "prod_"))).drop("_known")
    return records.join(ids.join(old.hint("merge"), "product_id", "left").hint("merge"), "source_identity", "left")


def plan_identity(candidates: DataFrame, catalog: Catalog) -> DataFrame:
    """IDN-02, JON-16: stable ids.  A known source keeps its product, a known local key its opportunity; each new revision names the one it replaces.

    candidates: source_snapshot_id, source_identity, observed_at, candidate (JSON text) and, where they are known by now, the columns
    of ``known_ids``; other columns stay.  The plan has a row for each opportunity, numbered from 0, or one without a number.
    """
    x = candidates if "_has" in candidates.columns else known_ids(candidates, catalog)
    x = x.withColumn("doc", F.from_json("candidate", CANDIDATE_DDL))
    x = x.withColumn("product_revision_id", sha_id(F.concat_ws("\n", "source_snapshot_id", "product_id"), 24, "pr_"))
    o = x.select("*", F.posexplode_outer("doc.opportunities").alias("number", "o"))
    o = o.withColumn("_old", F.try_element_at("_has", F.col("o.local_key")))
    oid = F.coalesce("_old.id", sha_id(F.concat_ws("\n", "product_id", "o.local_key"), 24, "opp_"))
    o = o.withColumn("opportunity_id", F.when(F.col("o").isNotNull(), oid)).withColumn("opportunity_supersedes", F.col("_old.revision"))
    o = o.withColumn("opportunity_revision_id", F.when(F.col("o").isNotNull(), sha_id(F.concat_ws("\n", "source_snapshot_id", "opportunity_id"), 24, "or_")))
    number = F.concat(F.lit("$.opportunities["), F.col("number").cast("string"), F.lit("]"))
    o = o.withColumns({"_product": cited_json(F.get_json_object("candidate", "$.product")), "_opportunity": cited_json(F.call_function("get_json_object", F.col("candidate"), number))})
    documents = {f"{of}_{name}": F.col(f"_{of}.{field}") for of in ("product", "opportunity") for name, field in (("document", "text"), ("evidence", "evidence_ids"))}
    # the opportunity is in its row, so the document keeps what all of them share
    return o.withColumn("doc", F.struct("doc.evidence_spans", "doc.product")).withColumns(documents).drop("_has", "_old", "candidate", "_product", "_opportunity")


def condition_columns(c: Column) -> list[Column]:
    """PRJ-05: the five families as common columns."""
    f = c["family"]
    kind = F.when(f == "boolean_requirement", c["kind"]).when(f == "external_credential", c["credential_type"]).when(f == "other", c["normalized_key"]).otherwise(f)
    return [c["key"].alias("condition_key"), f.alias("family"), kind.alias("normalized_kind"), c["required"].alias("required"), c["verification_required"].alias("verification_required"), c["state"].alias("state"), c["target_key"].alias("target_key")]


def index_tables(plan: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """SNK-05: every table's rows of the planned observations; all narrow, so a batch costs one pass for each table.

    ``plan`` has one candidate for each observation, and its text.  So a document's first row stands for it
    and nothing that holds documents is shuffled.

    Gates (FLT-07, FLT-08) and the evidence that documents cite anywhere (FN-15) are
    settled here, so a read parses no document.
    """
    one = plan.filter(F.coalesce("number", F.lit(0)) == 0)
    opp = plan.filter(F.col("opportunity_id").isNotNull())
    p, created = F.col("doc.product"), F.col("observed_at").alias("created_at")
    spans = one.select("source_snapshot_id", "raw_text", F.explode("doc.evidence_spans").alias("s"))
    start = quote_offset(F.col("raw_text"), F.col("s.quote"))
    rev = F.col("opportunity_revision_id")
    seen_at = F.col("observed_at")
    e = opp.select(rev, F.explode("o.entitlements").alias("e"))
    con, cond = opp.select(rev, F.explode("o.constraints").alias("c")), opp.select(rev, F.explode("o.conditions").alias("c"))
    name = F.coalesce(p["proposed_canonical_name"]["text"], p["source_name"])
    q = lambda c: [
        c["quantity"]["value"].alias("quantity"), c["quantity"]["comparator"].alias("quantity_comparator"), c["quantity"]["normalized_unit"].alias("normalized_unit"),
        c["cadence"]["interval"].alias("cadence_interval"), c["cadence"]["unit"].alias("cadence_unit"), c["cadence"]["alignment"].alias("cadence_alignment"),
    ]
    ent = F.col("e")
    return {
        "source_snapshots": observations.withColumnRenamed("raw_text", "full_text").select(*[c.split()[0] for c in TABLES["source_snapshots"].split(", ")]),
        "evidence_spans": spans.select("source_snapshot_id", F.col("s.id").alias("evidence_key"), F.col("s.quote").alias("quote"), start.cast("int").alias("start_offset"), (start + F.length("s.quote")).cast("int").alias("end_offset")),
        "products": one.select("product_id", created).dropDuplicates(["product_id"]),
        "product_revisions": one.select(
            "product_revision_id", "product_id", "source_snapshot_id", F.col("product_supersedes").alias("supersedes"), name.alias("name"), p["description"]["text"].alias("description"),
            p["description"]["support"]["evidence_ids"].alias("description_evidence"), F.col("product_evidence").alias("evidence_ids"), F.col("product_document").alias("document_json"), seen_at, created),
        "opportunities": opp.select("opportunity_id", "product_id", F.col("o.local_key").alias("local_key"), created).dropDuplicates(["opportunity_id"]),
        "opportunity_revisions": opp.select(
            rev, "opportunity_id", "product_id", "product_revision_id", F.col("o.local_key").alias("local_key"), "source_snapshot_id", F.col("opportunity_supersedes").alias("supersedes"), F.col("o.availability.value").alias("availability"),
            F.col("o.effective_period")["from"].alias("effective_from"), F.col("o.effective_period")["to"].alias("effective_to"), entitled(F.col("o.entitlements")).alias("entitled"),
            (~uncontradicted(F.col("o.ambiguities"))).alias("contradictory"), F.col("opportunity_evidence").alias("evidence_ids"), F.col("opportunity_document").alias("document_json"), seen_at, created),
        "facet_index": one.select("product_revision_id", F.explode("doc.product.facets").alias("f")).select("product_revision_id", "f.namespace", "f.concept_id", F.col("f.support.basis").alias("basis")).distinct(),
        "entitlement_index": e.select(
            rev, ent["key"].alias("entitlement_key"), ent["kind"].alias("kind"), ent["label"].alias("label"), ent["quantity"]["value"].alias("quantity"), ent["quantity"]["comparator"].alias("quantity_comparator"), ent["quantity"]["source_unit"].alias("source_unit"),
            ent["quantity"]["normalized_unit"].alias("normalized_unit"), ent["cadence"]["interval"].alias("cadence_interval"), ent["cadence"]["unit"].alias("cadence_unit"), ent["cadence"]["alignment"].alias("cadence_alignment"), ent["duration"]["value"].alias("duration_value"),
            ent["duration"]["unit"].alias("duration_unit"), money_micros(ent["monetary_value"]["amount"]).alias("monetary_micros"), ent["monetary_value"]["currency"].alias("monetary_currency"), ent["monetary_value"]["comparator"].alias("monetary_comparator"),
            money_micros(ent["maximum_value"]["amount"]).alias("maximum_micros"), ent["percentage_value"]["value"].alias("percentage"), ent["percentage_value"]["comparator"].alias("percentage_comparator"), ent["cost_scope"].alias("cost_scope")),
        "entitlement_applicability_index": e.select(rev, ent["key"].alias("entitlement_key"), F.posexplode(ent["applies_to"]).alias("ordinal", "a")).select("opportunity_revision_id", "entitlement_key", "ordinal", "a.target_type", "a.source_label"),
        "constraint_index": con.select(rev, F.col("c.key").alias("constraint_key"), F.col("c.kind").alias("kind"), F.col("c.other_kind").alias("other_kind"), F.col("c.target_key").alias("target_key"), *q(F.col("c"))),
        "condition_index": cond.select(rev, *condition_columns(F.col("c"))),
        "condition_geography_index": cond.select(rev, F.col("c.key").alias("condition_key"), F.col("c.mode").alias("mode"), F.explode("c.regions").alias("region")),
        "condition_audience_index": cond.select(rev, F.col("c.key").alias("condition_key"), F.explode("c.audiences").alias("audience")),
        "search_index": opp.select(rev, name.alias("name"), F.coalesce(p["description"]["text"], F.lit("")).alias("description"), F.array_join(F.transform(p["claimed_outcomes"], lambda x: x["text"]), " ").alias("outcomes"), F.col("raw_text").alias("source_text")),
    }


def plan_problems(plan: DataFrame, catalog: Catalog) -> DataFrame:
    """VAL-19: (rule_id, row_key) of planned revisions against the catalog's tables."""
    from .legacy import plan_problems as problems

    return problems(plan, catalog.read("opportunities"), catalog.read("product_revisions"), catalog.read("opportunity_revisions"))


def refusals(catalog: Catalog, joined: DataFrame, plan: DataFrame, concepts: dict[str, set[str]] | None, units: set[str] | None) -> DataFrame:
    """source_snapshot_id, rule_id, path, message: why an observation may not enter.

    Repeated observations (of the catalog or of the batch), candidates that break the contract or speak
    of another observation, planned ids that are out of order, and plans whose opportunities are not
    the candidate's.  ``joined`` holds observations with their candidates, ``plan`` their ids.
    """
    sid = F.col("source_snapshot_id")
    row = lambda df, rule, path, message: df.select(sid, rule.alias("rule_id"), path.alias("path"), message.alias("message"))
    asked = keys.key_rows({"source_snapshots": joined.select("source_snapshot_id")})
    stored = keys.known(asked, catalog.read("key_sets"), catalog.read("key_filters")).select(F.col("key").alias("source_snapshot_id"))
    twice = joined.groupBy("source_snapshot_id").count().filter("count > 1").select("source_snapshot_id")
    again = stored.union(twice).distinct()
    found = [row(again, F.lit("SNK-11"), F.lit("source_snapshot_id"), F.lit("the observation is there already"))]
    if concepts is not None:
        broken = validate_candidates(joined, "source_snapshot_id", "raw_text", "candidate", concepts, units or set())
        found.append(row(broken, F.col("rule_id"), F.col("path"), F.col("message")))
    spoken = violations(joined, run_rules("candidate", "source_snapshot_id", "observed_at", "source_name"), sid).withColumnRenamed("row_key", "source_snapshot_id")
    found.append(row(spoken, F.lit("VAL-18"), F.col("rule_id"), F.lit("must equal the observation's")))
    revision = F.coalesce("opportunity_revision_id", "product_revision_id")
    out_of_order = plan_problems(plan, catalog).join(plan.select("source_snapshot_id", revision.alias("row_key")).distinct(), "row_key")
    found.append(row(out_of_order, F.lit("VAL-19"), F.col("rule_id"), F.col("row_key")))
    wanted = joined.select("source_snapshot_id", F.explode(F.from_json("candidate", "opportunities array<struct<local_key: string>>")["opportunities"]["local_key"]).alias("local_key"))
    planned = plan.filter("opportunity_id is not null").select("source_snapshot_id", F.col("o.local_key").alias("local_key"))
    differ = sets.set_differences(wanted, planned, "source_snapshot_id", "local_key")
    found.append(row(differ, F.lit("SET-06"), F.concat(F.lit("opportunities/"), F.coalesce("local_key", F.lit("null"))), F.when(F.col("side") == "left", "no planned identity").otherwise("planned without a candidate")))
    return reduce(DataFrame.union, found)


def ingest(
    catalog: Catalog, candidates: DataFrame, observations: DataFrame, batch_id: str | None = None, concepts: dict[str, set[str]] | None = None, units: set[str] | None = None, most_tries: int = 5
) -> str:
    """SNK-05: checks, plans and appends one batch; nothing is visible unless all of it is.

    An observation that ``refusals`` names is refused as a whole and only its reasons
    enter, as ``rejections``; the contract is checked where the vocabulary is given.  Products and
    opportunities that are there already are not entered again (SNK-03).  All checks are of one
    version of the catalog; where another writer comes between, they are made again.
    """
    for _ in range(most_tries):
        seen = catalog.refresh()
        if batch_id is not None and batch_id in catalog.state.batches:
            return batch_id
        with scratch(catalog.spark), small_batches(catalog.spark):
            # once for each candidate row: a second candidate of one observation is a repetition
            told = known_ids(observations.dropDuplicates(["source_snapshot_id"]), catalog)
            # a merge join: candidates may come from a small table, by whose size they would be broadcast
            joined = written(candidates.select("source_snapshot_id", "candidate").hint("merge").join(told, "source_snapshot_id"), "observed")
            plan = written(plan_identity(joined.select("source_snapshot_id", "source_identity", "observed_at", "candidate", "raw_text", "product_id", "product_supersedes", "_has"), catalog), "plan")  # every table reads it: documents are parsed once
            refused = written(refusals(catalog, joined, plan, concepts, units), "refused")
            entering = joined.drop("candidate", "product_id", "product_supersedes", "_has")
            if not refused.isEmpty():
                bad = refused.select("source_snapshot_id").distinct()
                plan = written(plan.join(bad, "source_snapshot_id", "left_anti"), "entering")  # once, not for every table
                entering = entering.join(bad, "source_snapshot_id", "left_anti")
            parts = index_tables(plan, entering)
            for table, key in (("products", "product_id"), ("opportunities", "opportunity_id")):
                parts[table] = parts[table].join(catalog.read(table).select(key), key, "left_anti")
            parts["search_index"] = written(parts["search_index"], "texts")  # three tables of the index read it, which need no documents
            parts |= text_index(parts["search_index"], "opportunity_revision_id", ["name", "description", "outcomes", "source_text"])
            try:
                return catalog.append(parts | {"rejections": refused}, batch_id, checked_at=seen)
            except Conflict:
                continue
    raise Conflict(f"other writers came first {most_tries} times")
