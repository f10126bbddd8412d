"""The read side of the catalog: published view, search, evidence, counts (API-01..08, PRJ-01..04, FLT-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import view
from ..functions.text import html_escaped, literalize, prettify
from .catalog import Catalog
from .contract import CONTRACT_VERSION, VOCABULARY_VERSION
from .index import SearchIndex
from .publish import described, eligible_latest, latest_reviews, newest_first, published
from .search import facet_and


def bounded(q: str = "", capabilities: list[str] | None = None, limit: int = 25, need: list[str] | None = None) -> tuple[str, list[str], int]:
    """FLT-17: trimmed arguments, needs counted as capabilities; what is out of bounds raises."""
    q = (q or "").strip()
    wanted = [c.strip() for c in [*(capabilities or []), *(need or [])]]
    wanted = [c for c in wanted if c]
    if len(q) > 512:
        raise ValueError("q has at most 512 characters")
    if len(wanted) > 8 or any(len(c) > 128 for c in wanted):
        raise ValueError("at most 8 capabilities of at most 128 characters")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 100:
        raise ValueError("limit is an integer from 1 to 100")
    return q, wanted, limit


def bounded_params(params: dict[str, list[str]]) -> tuple[str, list[str], int]:
    """FLT-17 for decoded request parameters: an unknown name, a repeated q or limit, or a limit that is no number raises."""
    for name in params.keys() - {"q", "capability", "need", "limit"}:
        raise ValueError(f"unknown parameter {name}")
    if any(len(params.get(k, ())) > 1 for k in ("q", "limit")):
        raise ValueError("q and limit are given once")
    limit = params.get("limit", ["25"])[0]
    if not limit.isascii() or not limit.isdigit():
        raise ValueError("limit is an integer from 1 to 100")
    return bounded((params.get("q") or [""])[0], params.get("capability"), int(limit), params.get("need"))


def clamped(limit, default: int = 25) -> int:
    """SRT-07, legacy: anything becomes 1 to 100."""
    try:
        return max(1, min(100, int(limit)))
    except (TypeError, ValueError):
        return default


class CatalogEngine:
    """Methods return DataFrames; HTTP is left to the caller."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def published(self) -> DataFrame:
        """PRJ-01: one row for each published opportunity.

        Of the revisions that are trusted and pass their gate the one observed last
        stands for its product or opportunity, whenever it was trusted (WIN-02, WIN-03).
        """
        t = self.catalog.read
        if view.is_fresh(self.catalog):  # kept as batches came in: no history is ranked
            pr = t("product_revisions").join(view.standing(self.catalog, "product"), "product_revision_id")
            return self._joined(pr, t("opportunity_revisions").join(view.standing(self.catalog, "opportunity"), "opportunity_revision_id"))
        events = t("review_events").withColumn("target", F.coalesce("product_revision_id", "opportunity_revision_id"))
        last = latest_reviews(events, ["target"]).select("target", "decision", F.col("created_at").alias("decided_at"), "review_event_id")
        order = lambda c: [F.coalesce("observed_at", "created_at").desc(), F.col(c).desc()]
        pr = eligible_latest(t("product_revisions"), last, "product_revision_id", ["product_id"], order("product_revision_id"), described(F.col("description"), F.col("description_evidence")))
        orv = eligible_latest(t("opportunity_revisions"), last, "opportunity_revision_id", ["opportunity_id"], order("opportunity_revision_id"), F.col("entitled") & ~F.col("contradictory"))
        return self._joined(pr, orv)

    def _joined(self, pr: DataFrame, orv: DataFrame) -> DataFrame:
        of = lambda kind, extra: [
            F.col("review_event_id").alias(f"{kind}_review_event_id"), F.col("source_snapshot_id").alias(f"{kind}_snapshot_id"), F.col("observed_at").alias(f"{kind}_observed_at"),
            F.col("evidence_ids").alias(f"{kind}_evidence_ids"), F.col("document_json").alias(f"{kind}_document"), "decided_at", *extra,
        ]
        p = pr.select("product_id", "product_revision_id", *of("product", ["name", "description"]))
        o = orv.select("opportunity_id", "opportunity_revision_id", *of("opportunity", ["local_key", "availability"]))
        return published(self.catalog.read("opportunities").select("opportunity_id", "product_id"), p, o)

    def search(self, q: str = "", capabilities: list[str] | None = None, limit: int = 25, need: list[str] | None = None) -> DataFrame:
        """API-05: need-first search; ``rank`` is null without a text query."""
        q, wanted, limit = bounded(q, capabilities, limit, need)
        rows = self.published()
        facets = self.catalog.read("facet_index").filter("namespace = 'capability'")
        rows = facet_and(rows, facets, "product_revision_id", "concept_id", wanted)
        if not literalize(q):
            return newest_first(rows.withColumn("rank", F.lit(None).cast("double")), limit)
        hits = rows.join(self.index().bm25(q), "opportunity_revision_id")
        return hits.orderBy("rank", F.col("published_at").desc(), "opportunity_id").limit(limit)

    def index(self) -> SearchIndex:
        """The stored index of all revisions' search documents."""
        return SearchIndex(*[self.catalog.read(f"search_{n}") for n in ("postings", "terms", "totals")], "opportunity_revision_id")

    @staticmethod
    def _cited(rows: DataFrame) -> DataFrame:
        """(opportunity_id, source_snapshot_id, evidence_key) of all that the published documents cite."""
        pair = lambda kind: F.struct(F.col(f"{kind}_snapshot_id").alias("s"), F.col(f"{kind}_evidence_ids").alias("ids"))
        each = rows.select("opportunity_id", F.explode(F.array(pair("product"), pair("opportunity"))).alias("x"))
        return each.select("opportunity_id", F.col("x.s").alias("source_snapshot_id"), F.explode("x.ids").alias("evidence_key")).distinct()

    def hydrate(self, rows: DataFrame) -> DataFrame:
        """PRJ-02: publication, product, opportunity, facets, sources and evidence as nested columns, in three grouped joins whatever the number of rows."""
        t = self.catalog.read
        facets = t("facet_index").groupBy("product_revision_id").agg(F.array_sort(F.collect_set(F.struct("namespace", "concept_id", "basis"))).alias("facets"))
        spans = t("evidence_spans")
        evidence = self._cited(rows).join(spans, ["source_snapshot_id", "evidence_key"]).groupBy("opportunity_id").agg(F.array_sort(F.collect_set(F.struct("source_snapshot_id", "evidence_key", "quote", "start_offset", "end_offset"))).alias("evidence"))
        compact = t("source_snapshots").select("source_snapshot_id", "source_identity", "source_kind", "source_locator", "source_name", "source_url", "observed_at", "content_hash")  # PRJ-03
        of = rows.select("opportunity_id", F.explode(F.array_distinct(F.array("product_snapshot_id", "opportunity_snapshot_id"))).alias("source_snapshot_id"))
        sources = of.join(compact, "source_snapshot_id").groupBy("opportunity_id").agg(F.array_sort(F.collect_set(F.struct(*compact.columns))).alias("sources"))
        x = rows.join(facets, "product_revision_id", "left").join(evidence, "opportunity_id", "left").join(sources, "opportunity_id", "left")
        capability = F.transform(F.filter("facets", lambda f: f["namespace"] == "capability"), lambda f: F.struct(f["concept_id"].alias("id"), f["basis"].alias("basis")))
        nested = lambda kind, key: F.struct(F.col(key).alias("id"), F.col(f"{kind}_revision_id").alias("revision_id"), F.col(f"{kind}_observed_at").alias("observed_at"), F.col(f"{kind}_document").alias("document"))
        return x.withColumns({
            "capabilities": capability, "publication": F.struct("published_at", "product_review_event_id", "opportunity_review_event_id"),
            "product": nested("product", "product_id"), "opportunity": nested("opportunity", "opportunity_id"),
        })

    def cards(self, rows: DataFrame) -> DataFrame:
        """FN-21: what a page shows of hydrated rows, escaped: kinds of offer, name, description, capabilities, the link that leads there and the quotes."""
        of = lambda doc, path: F.get_json_object(F.col(f"{doc}.document"), path)
        kinds = F.array_distinct(F.transform(F.from_json(of("opportunity", "$.entitlements"), "array<struct<kind: string>>"), lambda e: e["kind"]))
        link = "array<struct<role: string, url: string>>"
        links = F.concat(*[F.coalesce(F.from_json(of(d, "$.links"), link), F.array().cast(link)) for d in ("product", "opportunity")])
        fit = F.filter(links, lambda l: l["role"].isin("application", "canonical_product", "source"))
        shown = {
            "kinds": F.array_join(F.transform(kinds, lambda k: F.replace(k, F.lit("_"), F.lit(" "))), " · "),
            "name": F.coalesce(of("product", "$.proposed_canonical_name.text"), of("product", "$.source_name"), F.col("opportunity_id")),
            "description": F.coalesce(of("product", "$.description.text"), of("opportunity", "$.plan_label.text")),
            "labels": F.array_join(F.transform("capabilities", lambda c: F.replace(c["id"], F.lit("-"), F.lit(" "))), ", "),
            "url": F.coalesce(F.get(fit, F.lit(0))["url"], F.get(links, F.lit(0))["url"]),
            "quotes": F.array_join(F.transform("evidence", lambda e: e["quote"]), "\n\n"),
        }
        return rows.select("opportunity_id", *[html_escaped(v).alias(k) for k, v in shown.items()])

    def opportunity(self, opportunity_id: str) -> DataFrame:
        """API-06: no or one row."""
        return self.hydrate(self.published().filter(F.col("opportunity_id") == opportunity_id))

    def capabilities(self) -> DataFrame:
        """API-04, AGG-01."""
        f = self.catalog.read("facet_index").filter("namespace = 'capability'").select("product_revision_id", "concept_id")
        x = self.published().select("opportunity_id", "product_revision_id").join(f, "product_revision_id")
        return x.groupBy("concept_id").agg(F.count_distinct("opportunity_id").alias("opportunity_count")).select("concept_id", prettify(F.col("concept_id")).alias("label"), "opportunity_count").orderBy("concept_id")

    def needs(self) -> DataFrame:
        """API-03: the typed catalog has no list of needs."""
        return self.catalog.spark.createDataFrame([], "need_id string, label string")

    def evidence(self, snapshot_id: str, evidence_id: str) -> DataFrame:
        """API-07: a span only if a published document of its snapshot cites it, with its source."""
        t = self.catalog.read
        near = self.published().filter((F.col("product_snapshot_id") == snapshot_id) | (F.col("opportunity_snapshot_id") == snapshot_id))  # FLT-11
        keys = self._cited(near).filter((F.col("source_snapshot_id") == snapshot_id) & (F.col("evidence_key") == evidence_id)).select("source_snapshot_id").distinct()
        spans = t("evidence_spans").filter((F.col("source_snapshot_id") == snapshot_id) & (F.col("evidence_key") == evidence_id))
        source = t("source_snapshots").filter(F.col("source_snapshot_id") == snapshot_id).select("source_snapshot_id", "source_kind", "source_locator", "source_name", "source_url", F.col("observed_at").alias("source_observed_at"))
        return spans.join(keys, "source_snapshot_id", "left_semi").join(source, "source_snapshot_id", "left")

    def coverage(self) -> DataFrame:
        """API-02, AGG-02: what is known against what is published."""
        t = self.catalog.read
        known = [t(n).agg(F.count("*").alias(a)) for n, a in (("products", "known_products"), ("opportunities", "known_opportunities"), ("product_revisions", "product_revisions"), ("opportunity_revisions", "opportunity_revisions"))]
        pub = self.published().agg(F.count_distinct("product_id").alias("published_products"), F.count_distinct("opportunity_id").alias("published_opportunities"))
        out = pub
        for one in reversed(known):
            out = one.crossJoin(out)  # one row each
        return out

    def health(self) -> DataFrame:
        """API-01: with the catalog's metadata."""
        metadata = {"status": "ok", "catalog_kind": "typed", "contract_version": CONTRACT_VERSION, "vocabulary_version": VOCABULARY_VERSION}
        return self.coverage().select(*[F.lit(v).alias(k) for k, v in metadata.items()], "*")

    def reviews(self, queue: DataFrame, status: str | None = "open", limit: int = 25) -> DataFrame:
        """API-08, SRT-05."""
        _, _, limit = bounded(limit=limit)
        return (queue.filter(F.col("status") == status) if status else queue).orderBy("created_at", "review_id").limit(limit)


    @staticmethod
    def review(queue: DataFrame, review_id: str) -> DataFrame:
        """REV-02: one item, no row if there is none."""
        return queue.filter(F.col("review_id") == review_id).limit(1)


def catalog_kind(tables: set[str]) -> str:
    """SRC-06: which generation a set of tables belongs to."""
    if {"catalog_metadata", "published"} <= tables or {"product_revisions", "review_events"} <= tables:
        return "typed"
    if {"source_records", "opportunities"} <= tables:
        return "legacy"
    raise ValueError("these tables are no catalog")


def open_catalog(spark: SparkSession, path: str) -> tuple[str, Catalog | None]:
    """SRC-06: the generation of the catalog in a folder, by the tables that lie there, and the typed one opened; both only read."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    kind = catalog_kind({f.getPath().getName() for f in fs.listStatus(p)} if fs.exists(p) else set())
    return kind, Catalog.open(spark, path) if kind == "typed" else None
