from collections import Counter

import pytest
from compare import DATA
from test_dedup import plain_lines
from test_tokens import check_packing

import corpus_pipeline as pipe
from marlstone.llm import mixing, registry, simhash, toxicity


def test_stages_by_hand(spark, tmp_path):
    """Every stage against a plain version on what the one before returned."""
    docs = registry.documents(spark, DATA)
    columns, seen = docs.columns, {}
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        if name != pipe.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() > 0
    was, now = ([tuple(r) for r in x.select("doc_id", "text").collect()] for x in seen["toxicity"])
    model = registry.toxicity_model(spark, seen["toxicity"][0], DATA)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(seen["toxicity"][0], model).collect()}
    assert Counter(now) == Counter(x for x in was if scores[x[0]] < 0.7)
    was, now = ([tuple(r) for r in x.select("doc_id", "text").collect()] for x in seen["line_dedup"])
    want = plain_lines(was)
    assert dict(now) == {i: want[i, t] if t else t for i, t in was}
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"][1].collect())
    was, now = seen["simhash_near_dedup"]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(was).collect()}
    assert Counter(r["doc_id"] for r in now.collect()) == Counter(i for i, c in groups.items() if i == c)
    was, now = seen["mix_sources"]
    assert Counter(r["doc_id"] for r in now.collect()) == Counter({r["doc_id"]: r["copies"] for r in mixing.plan(was).collect() if r["copies"]})
    from tokenizers import Tokenizer

    from marlstone.llm import tokens

    was, now = seen["best_fit_packing"]
    check_packing(now.collect(), [tuple(r) for r in was.select("doc_id", "text").collect()], Tokenizer.from_file(tokens.default_path()), 1024)


def test_five_word_similarity_on_documents(spark):
    """Components of the stage equal those of all pairs of shingle sets at 0.8 and more."""
    rows = [tuple(r) for r in registry.documents(spark, DATA).select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(registry.documents(spark, DATA)).collect()}

    def grams(t):
        w = t.encode().lower().split()
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = sorted((i, grams(t)) for i, t in rows)
    least = {i: i for i, _ in sets}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if (len(x & y) >= 0.8 * len(x | y)) and least[i] != least[j]:
                lo, hi = sorted((least[i], least[j]))
                least = {k: lo if v == hi else v for k, v in least.items()}
    assert got == least


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_edge_cases(spark, edge_df, clashing, any_names, edge, stage):
    """Nulls in every column, empty and long texts, ties, repeated rows, empty tables and clashing columns."""
    name, f = pipe.STAGES[stage]
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    had, got = texts(edge_df), f(spark, edge_df, DATA)
    assert f(spark, edge_df.limit(0), DATA).count() == 0
    if name == "best_fit_packing":
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ends = Counter(r["doc_id"] for r in got.filter("piece = 0").collect())
        assert ends == Counter(i for i, *_ in edge) and f(spark, clashing, DATA).count() == got.count()
        return
    assert got.columns == edge_df.columns
    mixed = f(spark, clashing, DATA)
    assert mixed.columns == clashing.columns and all(r["score"] == r["n_removed"] == r["copies"] == r["fingerprint"] == "x" for r in mixed.collect())
    assert texts(mixed) == texts(got)
    now = texts(got)
    odd = f(spark, any_names, DATA)
    assert odd.columns == any_names.columns and Counter((r[0], r[1]) for r in odd.collect()) == now and all(r[5:] == any_names.first()[5:] for r in odd.collect())
    if name == "toxicity":
        assert now == had  # all clean
    elif name == "line_dedup":
        assert sum(now.values()) == sum(had.values()) and Counter(i for i, _ in now.elements()) == Counter(i for i, _ in had.elements())
        assert now[4, None] == 1 and now[None, None] == 1 and now[5, ""] == 1 and now[2, ""] == 1 and now[1, edge[0][1]] == 1
    elif name == "simhash_near_dedup":
        assert all(n == 1 for n in now.values()) and set(now) <= set(had)
        assert (1, edge[0][1]) in now and not {2, 3} & {i for i, _ in now}  # a copy, and a near copy with one line more
        assert len([1 for _, t in now if not (t or "").strip()]) == 1  # null, empty and blank texts are one group
        assert (9, edge[12][1]) in now and (8, edge[11][1]) in now and (None, "a text without id") in now
    else:
        assert all(now[x] <= 3 * had[x] for x in now) and set(now) <= set(had)


def test_run(spark):
    assert pipe.run(spark, DATA).count() > 0 and pipe.QUERIES.keys() == {"pipeline"}
