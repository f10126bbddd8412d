"""The reference operators over the driver's tables, each with its SQL.

Roles of the tables: review events are ``events`` (target user_id), products are
customers, product revisions orders, opportunities (customer, part) pairs, their
revisions lineitems; source records and full text are ``documents``, evidence is
``benchmark``, attempts are ``conversations``, identity urls are ``pages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import evaluate, history, index, publish, search, sets
from ..operators.shared import kept_folder, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"purchase": "trust", "signup": "trust", "error": "reject", "click": "request_revision", "view": "canonicalize"}
    decision = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    return table(spark, d, "events").select(F.col("user_id").alias("target"), F.col("ts").alias("created_at"), F.col("event_id").alias("review_event_id"), decision.alias("decision"))


_REV = """reviews AS (SELECT user_id AS target, ts AS created_at, event_id AS review_event_id,
 CASE event_type WHEN 'purchase' THEN 'trust' WHEN 'signup' THEN 'trust' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'request_revision' WHEN 'view' THEN 'canonicalize' END AS decision FROM events),
lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY created_at DESC, review_event_id DESC) AS rn FROM reviews WHERE decision <> 'canonicalize') WHERE rn = 1)"""


@query(f"WITH {_REV} SELECT target, created_at, review_event_id, decision FROM lr")
def latest_review(spark, d):
    """WIN-01, FLT-09."""
    return publish.latest_reviews(_reviews(spark, d), ["target"])


_PUB = f"""WITH {_REV},
pr AS (SELECT * FROM (SELECT o_custkey AS product_id, o_orderkey AS product_revision_id, o_orderdate, o_totalprice, lr.created_at AS decided_at,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
   FROM orders JOIN lr ON lr.target = o_custkey WHERE lr.decision = 'trust' AND o_totalprice > 0) WHERE rn = 1),
orv AS (SELECT * FROM (SELECT o_custkey AS product_id, l_partkey, l_orderkey, l_linenumber, l_shipdate,
   row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND l_quantity > 0) WHERE rn = 1)
SELECT pr.product_id, l_partkey AS part, product_revision_id, l_orderkey AS opportunity_order, l_linenumber AS opportunity_line, greatest(pr.decided_at, l_shipdate) AS published_at
FROM orv JOIN pr USING (product_id)"""


@query(_PUB)
def published_current(spark, d):
    """WIN-02, WIN-03, FLT-06/07 gates before rank, JON-02/03/04, AGG-15."""
    last = publish.latest_reviews(_reviews(spark, d), ["target"]).select("target", "decision", F.col("created_at").alias("decided_at"))
    orders = table(spark, d, "orders")
    product = orders.select(F.col("o_custkey").alias("product_id"), F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("product_revision_id"), "o_orderdate", "o_totalprice")
    pr = publish.eligible_latest(product, last, "target_id", ["product_id"], [F.col("o_orderdate").desc(), F.col("product_revision_id").desc()], F.col("o_totalprice") > 0)
    lines = table(spark, d, "lineitem").filter((F.col("l_returnflag") != "R") & (F.col("l_quantity") > 0)).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    rev = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("product_id")), "l_orderkey")
    orv = publish.latest(rev, ["product_id", "l_partkey"], [F.col("l_shipdate").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc()])
    pairs = pr.select("product_id", "product_revision_id", "decided_at")
    return orv.join(pairs, "product_id").select("product_id", F.col("l_partkey").alias("part"), "product_revision_id", F.col("l_orderkey").alias("opportunity_order"), F.col("l_linenumber").alias("opportunity_line"), F.greatest("decided_at", "l_shipdate").alias("published_at"))


@query(f"SELECT * FROM ({_PUB}) ORDER BY published_at DESC, product_id, part LIMIT 100")
def published_newest(spark, d):
    """SRT-02, SRT-07: the first hundred, newest first."""
    return published_current(spark, d).orderBy(F.col("published_at").desc(), "product_id", "part").limit(100)


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
 FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1""")
def resurfaced_revision(spark, d):
    """WIN-02: an older eligible revision comes back when newer ones are not."""
    o = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "o_orderdate")
    return publish.latest(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query("SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders")
def superseded_by(spark, d):
    """WIN-05, IDN-02."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return history.supersedes(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey").select("o_orderkey", "o_custkey", "supersedes")


@query("""SELECT o_custkey, l_partkey, l_orderkey, l_linenumber FROM (SELECT o_custkey, l_partkey, l_orderkey, l_linenumber,
 row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1""")
def local_key_reuse(spark, d):
    """WIN-04, JON-16: the latest revision of each local key."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    x = publish.latest(l.join(o, "l_orderkey"), ["o_custkey", "l_partkey"], [F.col("o_orderdate").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc()])
    return x.select("o_custkey", "l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT p_brand, count(DISTINCT l_orderkey)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def facet_counts(spark, d):
    """AGG-01, JON-06."""
    links = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return search.facet_counts(links, "p_brand", "l_orderkey")


@query("""WITH b AS (SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 2), f AS (SELECT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.l_orderkey = o_orderkey AND f.p_brand = b.p_brand))""")
def facet_and_filter(spark, d):
    """FLT-04, JON-07: orders that have parts of both of the first two brands."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    wanted = [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").limit(2).collect()]
    facets = table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).join(part, "l_partkey")
    return search.facet_and(table(spark, d, "orders").select("o_orderkey", "o_custkey"), facets, "o_orderkey", "p_brand", wanted)


@query("""SELECT 'order_without_customer' AS check_name, count(*)::BIGINT AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem_without_order', count(*)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'customer_without_order', count(*)::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphan_check(spark, d):
    """JON-09, SNK-11."""
    o, l, c = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    checks = [("order_without_customer", o.select("o_custkey"), c, "o_custkey", "c_custkey"), ("lineitem_without_order", l.select("l_orderkey"), o, "l_orderkey", "o_orderkey"), ("customer_without_order", c.select("c_custkey"), o, "c_custkey", "o_custkey")]
    return history.union_all([history.orphans(a, b, x, y).agg(F.count("*").alias("n")).select(F.lit(n).alias("check_name"), "n") for n, a, b, x, y in checks])


@query("""SELECT (SELECT count(*) FROM customer)::BIGINT AS known_products, (SELECT count(*) FROM orders)::BIGINT AS revisions, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::BIGINT AS final_revisions,
 (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')::BIGINT AS returned, (SELECT count(DISTINCT l_partkey) FROM lineitem)::BIGINT AS parts""")
def coverage_counts(spark, d):
    """AGG-02, AGG-03, API-02: independent scalar counts as one row."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    parts = [table(spark, d, "customer").agg(F.count("*").alias("known_products")), o.agg(F.count("*").alias("revisions"), F.count_if(F.col("o_orderstatus") == "F").alias("final_revisions")), l.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_partkey").alias("parts"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')")
def like_search(spark, d):
    """FLT-02, FLT-18."""
    return table(spark, d, "documents").filter(search.like_all(F.col("text"), ["the", "License"])).select("doc_id", "source")


@query("""SELECT doc_id, source FROM documents d WHERE (contains(lower(text), 'license') OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND contains('quality' || quality, 'y1')))""")
def like_or_exists(spark, d):
    """FLT-02 with links, JON-07: all rows that match themselves or by a linked one."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    links = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("link"))
    terms = ["y1"]
    x, flags = search.with_link_flags(docs, links, "doc_id", "link", terms)
    hit = F.contains(F.lower("text"), F.lit("license")) | flags["y1"]
    return x.filter(hit).select("doc_id", "source")


_TOK = r"array_to_string(regexp_extract_all(strip_accents(lower(coalesce(text,''))), '[\p{L}\p{N}]+'), ' ')"


def _index(spark: SparkSession, d: str) -> index.SearchIndex:
    """The stored index of ``documents``, built by the first query of a folder that needs it."""
    path = kept_folder(spark, "index", d, lambda path: index.build(table(spark, d, "documents"), "doc_id", ["text"], path))
    return index.open_index(spark, path, "doc_id", "long")


@query(rf"""WITH t AS (SELECT doc_id, ' ' || {_TOK} || ' ' AS p FROM documents) SELECT doc_id FROM t WHERE contains(p, ' the ') AND contains(p, ' license ')""")
def fts_match(spark, d):
    """FTS-01..03: every term as a phrase."""
    return _index(spark, d).matching("The LICENSE")


@query(rf"""WITH t AS (SELECT doc_id, ' ' || {_TOK} || ' ' AS p FROM documents) SELECT doc_id FROM t WHERE contains(p, ' mit license ')""")
def fts_phrase(spark, d):
    """FTS-03: a hyphenated term is a phrase of two tokens."""
    return _index(spark, d).matching("MIT-license")


@query("SELECT doc_id FROM documents WHERE false")
def fts_empty_phrase(spark, d):
    """FTS-04: a term without tokens empties the result."""
    return _index(spark, d).bm25("license ***").select("doc_id")


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text,''))), '[\p{{L}}\p{{N}}]+') AS a FROM documents),
f AS (SELECT doc_id, len(a) AS l, len(regexp_extract_all(' ' || array_to_string(a, '  ') || ' ', ' the ')) AS f1, len(regexp_extract_all(' ' || array_to_string(a, '  ') || ' ', ' license ')) AS f2 FROM t),
s AS (SELECT count(*) AS n, avg(l) AS al, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM f),
r AS (SELECT doc_id, -(CASE WHEN ln((n - d1 + 0.5) / (d1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d1 + 0.5) / (d1 + 0.5)) END * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / al))
 + CASE WHEN ln((n - d2 + 0.5) / (d2 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d2 + 0.5) / (d2 + 0.5)) END * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / al))) AS rank FROM f, s WHERE f1 > 0 AND f2 > 0)
SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY round(rank, 6), doc_id LIMIT 100""")
def bm25_topk(spark, d):
    """FTS-05, AGG-13, JON-05, SRT-03."""
    return _index(spark, d).bm25("the license").select("doc_id", F.round("rank", 6).alias("rank")).orderBy("rank", "doc_id").limit(100)


def _bound(t: str) -> str:
    return f"regexp_matches(' ' || lower(coalesce(text,'')) || ' ', '(^|[^a-z0-9]){t}($|[^a-z0-9])')"


_SCORE = rules.ScoreRules(categories=(("src0", 6, "category src0"), ("src1", 1, "category src1")), strong=("license", "rights reserved"), medium=("the", "and"), excluded=("idiot",))


@query(f"""WITH s AS (SELECT doc_id, (CASE WHEN source = 'src0' THEN 6 ELSE 0 END + CASE WHEN source = 'src1' THEN 1 ELSE 0 END + CASE WHEN {_bound('license')} THEN 3 ELSE 0 END
 + CASE WHEN {_bound('rights reserved')} THEN 3 ELSE 0 END + CASE WHEN {_bound('the')} THEN 1 ELSE 0 END + CASE WHEN {_bound('and')} THEN 1 ELSE 0 END - CASE WHEN {_bound('idiot')} THEN 5 ELSE 0 END)::INT AS score FROM documents)
SELECT doc_id, score FROM s WHERE score >= 4 ORDER BY score DESC, doc_id LIMIT 60""")
def term_score_topk(spark, d):
    """FN-05, FN-06, FLT-05, SRT-01."""
    scored = rules.with_score(table(spark, d, "documents").select("doc_id", "text", "source"), ["text"], "source", _SCORE)
    return scored.filter("score >= 4").orderBy(F.col("score").desc(), "doc_id").limit(60).select("doc_id", "score")


@query(f"""SELECT doc_id, CASE WHEN {_bound('mit license')} THEN 'mit license' WHEN {_bound('license')} THEN 'license' WHEN {_bound('copyright')} THEN 'copyright' WHEN regexp_matches(lower(text), 'all .{{0,20}}reserved') THEN 'reserved' END AS evidence FROM documents""")
def annotate_first_match(spark, d):
    """FN-07: the first term is the evidence, a pattern after them."""
    x = table(spark, d, "documents").select("doc_id", "text")
    why = rules.first_match(rules.haystack("text"), ["mit license", "license", "copyright"], "all .{0,20}reserved", "reserved")
    return x.select("doc_id", why.alias("evidence"))


@query("SELECT d.doc_id, b.item_id, (instr(d.text, b.text) - 1)::INT AS place FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def evidence_containment(spark, d):
    """JON-17, FLT-12, FN-13."""
    docs, quotes = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    x = search.contains_join(docs, quotes, "text", "quote")
    return x.select("doc_id", "item_id", text.quote_offset(F.col("text"), F.col("quote")).cast("int").alias("place"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_reference(spark, d):
    """JON-12."""
    return history.orphans(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "doc_id")


@query("SELECT p_partkey, p_brand || ' ' || p_type AS concept FROM part WHERE p_brand || ' ' || p_type NOT IN (SELECT p_brand || ' ' || p_type FROM part WHERE p_size > 45)")
def vocab_membership(spark, d):
    """JON-13, FLT-10: parts whose brand and type are not in the vocabulary of the large ones."""
    part = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("concept"), "p_size")
    vocabulary = part.filter("p_size > 45").select("concept")
    return history.orphans(part.select("p_partkey", "concept"), vocabulary, "concept", "concept").select("p_partkey", "concept")


@query("""SELECT doc_id, copies, doc_id = first_id AS is_first FROM (SELECT doc_id, count(*) OVER (PARTITION BY text)::BIGINT AS copies, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE copies > 1""")
def duplicate_text(spark, d):
    """VAL-05, SET-02: copies by digest, so texts are not shuffled; grouped with partial sums, written, joined back."""
    x = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    x = written(x, "digests")
    g = written(x.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1"), "copies")
    return x.join(g.hint("merge"), "h").select("doc_id", "copies", (F.col("doc_id") == F.col("first_id")).alias("is_first"))


@query("""SELECT l_orderkey, fingerprint, n FROM (SELECT l_orderkey, l_returnflag || '|' || l_linestatus || '|' || l_quantity::INT AS fingerprint, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL) WHERE n > 1""")
def economic_fingerprint(spark, d):
    """FN-20, VAL-16."""
    fp = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string"))
    return table(spark, d, "lineitem").groupBy("l_orderkey", fp.alias("fingerprint")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT doc_id, 'src_' || left(sha256(source || chr(10) || doc_id || chr(10) || text), 16) AS source_id FROM documents")
def sha_ids(spark, d):
    """FN-01, FN-10."""
    v = F.concat_ws("\n", "source", F.col("doc_id").cast("string"), "text")
    return table(spark, d, "documents").select("doc_id", text.sha_id(v, 16, "src_").alias("source_id"))


@query("SELECT page_id, 'page|' || regexp_replace(lower(trim(url)), '/$', '') AS identity FROM pages")
def url_identity(spark, d):
    """FN-08, FN-09."""
    p = table(spark, d, "pages")
    return p.select("page_id", text.source_identity(F.lit("page"), F.col("url"), F.lit(""), F.lit("")).alias("identity"))


@query("""SELECT p_partkey, CASE WHEN s = '' THEN 'record' ELSE s END AS slug FROM (SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 64) AS s FROM part)""")
def slugify(spark, d):
    """FN-02."""
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name"), ascii_only=True).alias("slug"))


@query("""SELECT o_orderkey, try_cast(regexp_replace('USD ' || o_custkey || '.50 for ' || o_orderkey % 7, '[^0-9.]', '', 'g') AS DOUBLE) AS value,
 try_cast(regexp_replace(o_orderpriority || '.5.5', '[^0-9.]', '', 'g') AS DOUBLE) AS bad FROM orders""")
def money_parse(spark, d):
    """FN-04, T8."""
    o = table(spark, d, "orders")
    offer = F.concat(F.lit("USD "), F.col("o_custkey").cast("string"), F.lit(".50 for "), (F.col("o_orderkey") % 7).cast("string"))
    return o.select("o_orderkey", text.money_value(offer).alias("value"), text.money_value(F.concat("o_orderpriority", F.lit(".5.5"))).alias("bad"))


@query("SELECT c_custkey, round(c_acctbal * 1e6)::BIGINT AS micros FROM customer")
def money_micros(spark, d):
    """FN-12."""
    return table(spark, d, "customer").select("c_custkey", text.money_micros(F.col("c_acctbal")).alias("micros"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') IS NULL AS absent FROM events")
def json_extract(spark, d):
    """FN-14."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("absent"))


@query("""SELECT o_orderkey, o_custkey, count(*)::BIGINT AS n_items, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def nested_hydrate(spark, d):
    """PRJ-02, AGG-09, SRT-06: children in one grouped pass, ordered inside the array."""
    child = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(child)).alias("c"))
    flat = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))), ",")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey").select("o_orderkey", "o_custkey", F.size("c").cast("long").alias("n_items"), flat.alias("items"))


@query("SELECT vec_id, i::INT - 1 AS ordinal, embedding[i] AS component FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def unnest_ordinal(spark, d):
    """PRJ-07: every component with its ordinal."""
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("ordinal", "component"))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'money' WHEN 'signup' THEN 'audience' WHEN 'error' THEN 'negative' ELSE 'other' END AS normalized_kind,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS required, CASE WHEN event_type = 'purchase' THEN round(value, 2) END AS state FROM events""")
def union_case_projection(spark, d):
    """PRJ-05, PRJ-11: a tagged union to common columns."""
    t = F.col("event_type")
    kind = F.when(t == "purchase", "money").when(t == "signup", "audience").when(t == "error", "negative").otherwise("other")
    return table(spark, d, "events").select("event_id", kind.alias("normalized_kind"), F.when(t.isin("purchase", "signup"), 1).otherwise(0).alias("required"), F.when(t == "purchase", F.round("value", 2)).alias("state"))


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    m = lambda status: F.concat_ws("|", status, "o_orderpriority")
    before = o.filter(F.col("o_orderkey") % 10 != 1).select("o_orderkey", m(F.col("o_orderstatus")).alias("material"))
    after = o.filter(F.col("o_orderkey") % 10 != 2).select("o_orderkey", m(F.when(F.col("o_orderkey") % 10 == 3, F.lit("X")).otherwise(F.col("o_orderstatus"))).alias("material"))
    return before, after


_DIFF = """WITH b AS (SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS before FROM orders WHERE o_orderkey % 10 <> 1),
a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority AS after FROM orders WHERE o_orderkey % 10 <> 2),
diff AS (SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN before IS DISTINCT FROM after THEN 'changed' END AS change_type, before, after
 FROM b FULL OUTER JOIN a ON a.o_orderkey = b.o_orderkey) WHERE change_type IS NOT NULL)"""


@query(_DIFF + " SELECT o_orderkey, change_type, before, after FROM diff")
def snapshot_diff(spark, d):
    """DIF-01, JON-11, PRJ-12, SET-04."""
    return history.snapshot_diff(*_snapshots(spark, d), "o_orderkey", "material")


@query(_DIFF + " SELECT change_type, count(*)::BIGINT AS n FROM diff GROUP BY change_type")
def change_summary(spark, d):
    """AGG-04."""
    return snapshot_diff(spark, d).groupBy("change_type").agg(F.count("*").alias("n"))


@query(_DIFF + " SELECT o_orderkey, sha256(change_type || chr(10) || o_orderkey || chr(10) || coalesce(before, '') || chr(10) || coalesce(after, '')) AS fingerprint FROM diff")
def change_fingerprint(spark, d):
    """DIF-02."""
    x = snapshot_diff(spark, d)
    return x.select("o_orderkey", history.change_fingerprint(F.col("change_type"), F.col("o_orderkey"), F.col("before"), F.col("after")).alias("fingerprint"))


@query(_DIFF + ", acc AS (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') SELECT change_type, count(*)::BIGINT AS blockers FROM diff WHERE o_orderkey NOT IN (SELECT o_orderkey FROM acc) GROUP BY change_type")
def promotion_gate(spark, d):
    """DIF-03, AGG-14."""
    accepted = table(spark, d, "orders").filter(F.col("o_orderpriority").like("1%")).select("o_orderkey", F.lit("accepted").alias("status"))
    left = history.promotion_blockers(snapshot_diff(spark, d), accepted, "o_orderkey")
    return left.groupBy("change_type").agg(F.count("*").alias("blockers"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events
 WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95)) WHERE rn = 1""")
def insert_or_ignore(spark, d):
    """SNK-03."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    there, new = e.filter("event_type = 'error' AND value > 95").select("user_id"), e.filter("event_type = 'click'").select("user_id", "event_id")
    return history.insert_or_ignore(there, new, ["user_id"], "event_id")


@query("""WITH n AS (SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1),
o AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n""")
def insert_or_replace(spark, d):
    """SNK-04, WIN-07."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    old = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return history.insert_or_replace(old, e.filter("event_type = 'purchase'").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def attempts_final(spark, d):
    """LLM-02."""
    return evaluate.final_attempts(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("""SELECT conv_id, CASE WHEN bool_and(length(text) > 60) THEN 'complete' WHEN bool_or(length(text) > 60) THEN 'partial' ELSE 'failed' END AS status FROM conversations GROUP BY conv_id""")
def run_status(spark, d):
    """AGG-11, LLM-03."""
    return evaluate.run_status(table(spark, d, "conversations"), "conv_id", F.length("text") > 60)


@query("""SELECT conv_id, nullif(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS tokens, coalesce(string_agg(turn::VARCHAR, '; ' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS turns FROM conversations GROUP BY conv_id""")
def attempt_sums(spark, d):
    """AGG-10, AGG-12: sums that are null when nothing was counted, messages in order."""
    c = table(spark, d, "conversations")
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))), lambda t: t.cast("string")), "; ")
    return c.groupBy("conv_id").agg(F.nullif(F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)), F.lit(0)).cast("long").alias("tokens"), turns.alias("turns"))


_DECIDED = """SELECT DISTINCT o_custkey::VARCHAR AS review_id, o_orderkey AS revision_id, CASE o_orderstatus WHEN 'F' THEN 'trust' WHEN 'O' THEN 'reject' ELSE 'request_revision' END AS decision FROM orders"""


@query(f"SELECT review_id, decision, count(*)::BIGINT AS n_events, min('rev_' || left(sha256(review_id || chr(10) || revision_id || chr(10) || decision), 32)) AS first_event FROM (SELECT review_id, revision_id, d.decision FROM (SELECT review_id, revision_id FROM ({_DECIDED})) JOIN (SELECT review_id, max(decision) AS decision FROM ({_DECIDED}) GROUP BY review_id) d USING (review_id)) GROUP BY review_id, decision")
def review_decisions(spark, d):
    """REV-03: decided items to events with deterministic ids; events that are there already are left out."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("review_id"), F.col("o_orderkey").cast("string").alias("revision_id"), "o_orderstatus")
    queue = o.groupBy("review_id").agg(F.collect_set("revision_id").alias("revision_ids"))
    kind = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("deferred")
    of_event = F.create_map(*[F.lit(x) for kv in history.EVENT_OF.items() for x in kv])
    chosen = o.select("review_id", kind.alias("k")).groupBy("review_id").agg(F.max_by("k", of_event[F.col("k")]).alias("decision")).withColumn("decided_at", F.lit("2026-01-01T00:00:00Z"))
    events = history.apply_decisions(queue, chosen, spark.createDataFrame([], "review_event_id string"))
    return events.groupBy("review_id", "decision").agg(F.count("*").alias("n_events"), F.min("review_event_id").alias("first_event"))


@query("""WITH x AS (SELECT (contains(lower(text), 'idiot') OR contains(lower(text), 'stupid'))::INT AS p, toxic AS y FROM documents JOIN labels USING (doc_id)),
s AS (SELECT sum(p * y)::BIGINT AS tp, sum(p * (1 - y))::BIGINT AS fp, sum((1 - p) * y)::BIGINT AS fn FROM x)
SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall FROM s""")
def precision_recall(spark, d):
    """EVL-01, AGG-05..07, JON-15."""
    low = F.lower("text")
    p = (F.contains(low, F.lit("idiot")) | F.contains(low, F.lit("stupid"))).cast("int")
    docs = table(spark, d, "documents").select("doc_id", p.alias("p"))
    x = docs.join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    return evaluate.precision_recall(x.select((F.col("p") * F.col("y")).alias("tp"), (F.col("p") * (1 - F.col("y"))).alias("fp"), ((1 - F.col("p")) * F.col("y")).alias("fn")))


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def carry_forward_sections(spark, d):
    """SRC-01, WIN-06."""
    from ..sources.readers import carry_forward

    c = table(spark, d, "conversations").withColumn("h", F.when(F.col("role") == "system", F.col("text")))
    return carry_forward(c, "h", ["conv_id"], "turn", "section").select("conv_id", "turn", "role", "section")


@query("""SELECT a.n_name, string_agg(b.n_name, ',' ORDER BY b.n_name) AS peers FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_name""")
def peers_excluding_self(spark, d):
    """JON-10, PRJ-14: the group's names without the own, from one grouped array instead of a self-join."""
    n = table(spark, d, "nation")
    g = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("all"))
    return n.join(g, "n_regionkey").select("n_name", F.array_join(F.array_except("all", F.array("n_name")), ",").alias("peers")).filter("peers <> ''")


@query("""SELECT rule_id, row_key FROM (
 SELECT 'quantity_positive' AS rule_id, l_orderkey || '|' || l_linenumber AS row_key FROM lineitem WHERE l_quantity <= 5 UNION ALL
 SELECT 'discount_range', l_orderkey || '|' || l_linenumber FROM lineitem WHERE l_discount > 0.09 UNION ALL
 SELECT 'known_status', l_orderkey || '|' || l_linenumber FROM lineitem WHERE l_linestatus NOT IN ('O', 'F'))""")
def validation_rules(spark, d):
    """SNK-11: every broken constraint of every row in one pass (the contract's own rules: ``validate_candidates``)."""
    l = table(spark, d, "lineitem")
    ok = {"quantity_positive": F.col("l_quantity") > 5, "discount_range": F.col("l_discount") <= 0.09, "known_status": F.col("l_linestatus").isin("O", "F")}
    return history.violations(l, ok, F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))


@query("SELECT 'p_name' AS rule_id, p_name AS row_key FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_check(spark, d):
    """SNK-11: unique keys."""
    return history.unique_violations(table(spark, d, "part"), ["p_name"], "p_name")


@query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def queue_list(spark, d):
    """REV-02, SRT-05, API-08: open items, oldest first."""
    return table(spark, d, "orders").filter(F.col("o_orderstatus") == "O").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", "o_orderpriority")


@query("SELECT review_id, CASE WHEN review_id = '7' AND status IN ('open','deferred') THEN 'accepted' ELSE status END AS status, CASE WHEN review_id = '7' AND status IN ('open','deferred') THEN 'fine' END AS note FROM (SELECT o_orderkey::VARCHAR AS review_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'deferred' ELSE 'rejected' END AS status FROM orders)")
def guarded_update(spark, d):
    """SNK-06, REV-01, REV-04: only an open or deferred item changes."""
    s = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "deferred").otherwise("rejected")
    q = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("review_id"), s.alias("status"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("decided_at"))
    return history.decide(q, "7", "accepted", "fine", "2026-01-01T00:00:00Z").select("review_id", "status", "note")


@query("""SELECT key, part_no, v FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part_no) AS rn FROM (
 SELECT p_brand AS key, 0 AS part_no, min(p_partkey) AS v FROM part WHERE p_size < 10 GROUP BY p_brand UNION ALL SELECT p_brand, 1, max(p_partkey) FROM part GROUP BY p_brand)) WHERE rn = 1""")
def concat_first_kept(spark, d):
    """SET-01, SET-02: two lists behind each other, the first of each key."""
    p = table(spark, d, "part")
    a = p.filter("p_size < 10").groupBy(F.col("p_brand").alias("key")).agg(F.min("p_partkey").alias("v")).withColumn("part_no", F.lit(0))
    b = p.groupBy(F.col("p_brand").alias("key")).agg(F.max("p_partkey").alias("v")).withColumn("part_no", F.lit(1))
    return history.first_wins(a.unionByName(b), ["key"], "part_no").select("key", "part_no", "v")


@query("""SELECT count(*)::BIGINT AS unmapped FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 1000 EXCEPT SELECT c_custkey FROM customer)""")
def coverage_union(spark, d):
    """SET-06, SET-07."""
    a = table(spark, d, "orders").filter("o_totalprice > 1000").select(F.col("o_custkey").alias("k"))
    return sets.uncovered(a, [table(spark, d, "customer").select(F.col("c_custkey").alias("k"))], "k").agg(F.count("*").alias("unmapped"))


@query(r"""SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])(free|discount|discounted|discounts|credit|credits|trial)($|[^a-z0-9_])') AS offers FROM documents""")
def offer_language(spark, d):
    """FLT-13..15, T15: a pattern with ASCII word boundaries."""
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(text.ascii_words(r"(?i)\b(?:free|discount(?:ed|s)?|credits?|trial)\b")).alias("offers"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*_`]', '', 'g') AS plain, replace(p_brand, '#', '-') AS b FROM part")
def strip_markup(spark, d):
    """FN-03, FN-17."""
    return table(spark, d, "part").select("p_partkey", text.strip_markdown(F.col("p_name")).alias("plain"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")).alias("b"))
