import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and blank texts, one long text, ties, repeated rows, shared ids and clashing columns."""
    para = "one two three four five six seven eight nine ten"
    body = "\n".join(f"line {k} {para} {k * 7 % 11}" for k in range(12))
    rows = [
        (1, body, "en", "a", 5), (2, body, "en", "a", 5), (3, body + "\nlast line here", "en", "b", 5), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \n\t\n ", "en", None, 3),
        (None, "a text without id", "en", "a", 1), (None, None, None, None, None), (7, "word", "de", "c", 4), (7, "word", "de", "c", 4), (7, "another text under the same id", "de", "c", 4),
        (8, ("äöü €uro 😀 naïve\n" * 40) + "end", "fr", "b", 9), (9, " ".join(f"w{k % 997}" for k in range(9000)), "en", "a", 1), (10, "The Same\nThe Same\nThe Same\nThe Same\nThe Same", "en", "c", 2), (11, "<|endoftext|> is text", "en", "c", 1),
    ]
    return rows


@pytest.fixture()
def edge_df(spark, edge):
    return spark.createDataFrame(edge, DOCS)


@pytest.fixture()
def clashing(edge_df):
    """The same with columns named like results and internals."""
    from pyspark.sql import functions as F

    names = ["score", "spans", "size", "shard", "slot", "target", "copies", "source_size", "n_lines", "n_removed", "kept", "probability", "fingerprint", "component_id", "piece", "start", "length", "sequence_id", "offset"]
    return edge_df.withColumns({n: F.lit("x") for n in names})


@pytest.fixture()
def any_names(edge_df):
    """The same with columns named like the operators' own, with dots, and different from others only by case; each holds its place's number."""
    names = ["_row", "_id", "_text", "_starts", "_size", "_src", "_key", "_fp", "_n", "_copy", "_bucket", "_place", "_root", "c0", "c1", "a.b", "doc_id.text", "TEXT", "Doc_Id", "score", "SPANS", "n_removed", "copies", "`q`", ""]
    from pyspark.sql import functions as F

    return edge_df.select("*", *[F.lit(k).alias(f"z{k}") for k in range(len(names))]).toDF(*edge_df.columns, *names)
