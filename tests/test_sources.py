import random
import re

import pytest

from marlstone.sources import readers

MD = "# Listing\n\n* [Ignored](http://i)\n\n## Clouds\n\n  * [Alpha](http://a) - **Free** tier\n    * [Beta](http://b) – child\n  * [Gamma](http://c)\n  * [Dropped](http://d) no dash\n## Models\r\n  * [Delta](http://e) - text\r\n"
CSV = 'Brand/Product,Description,Monetary Detail,Eligibility Notes,Category,Application Link,Platform/Source,Estimated Value\n"Acme, Inc","says ""hi""\nagain",$5 credit,startups,Cloud Programs,http://x,Board,"$1,000"\n\nBare,only\n'


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "README.md").write_text(MD, newline="")
    (tmp_path / "offers.csv").write_text(CSV)
    return tmp_path


def test_markdown(spark, files):
    rows = readers.read_markdown(spark, str(files / "README.md")).orderBy("source_line").collect()
    assert [(r["source_line"], r["source_category"], r["source_name"], r["parent_provider"], r["source_description"]) for r in rows] == [
        (7, "Clouds", "Alpha", "", "Free tier"), (8, "Clouds", "Beta", "Alpha", "child"), (9, "Clouds", "Gamma", "", ""), (12, "Models", "Delta", "", "text"),
    ]
    assert rows[0]["source_locator"] == "README.md:7" and rows[0]["raw_text"] == "  * [Alpha](http://a) - **Free** tier"


def test_csv(spark, files):
    rows = readers.read_csv_rows(spark, str(files / "offers.csv")).orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == [2, 3]
    assert rows[0]["values"]["Brand/Product"] == "Acme, Inc" and rows[0]["values"]["Description"] == 'says "hi"\nagain'
    assert rows[1]["values"]["Category"] == "" and rows[1]["raw_text"].startswith("Brand/Product: Bare\nDescription: only\n")
    offers = readers.read_offers_csv(spark, str(files / "offers.csv")).orderBy("source_row").collect()
    assert [o["estimated_value_usd"] for o in offers] == [1000.0, 0.0] and offers[0]["source_locator"] == "offers.csv:2"


def test_union_and_vocabulary(spark, files):
    assert readers.read_records(spark, str(files / "README.md"), str(files / "offers.csv")).count() == 6
    (files / "v.json").write_text('{"version": "0.1.0", "facet_namespaces": {"capability": ["a", "b"]}, "normalized_units": ["hour"]}')
    concepts, units = readers.read_vocabulary(spark, str(files / "v.json"))
    assert sorted(map(tuple, concepts.collect())) == [("capability", "a"), ("capability", "b")] and units.first()[0] == "hour"


def plain_markdown(text):
    """One line after the other."""
    out, category, parent = [], None, ""
    item = re.compile(readers._ITEM)
    for n, line in enumerate(x.removesuffix("\r") for x in text.split("\n")):
        if m := re.match(r"^## (.+)$", line):
            category, parent = m[1].strip(), ""
        elif category is not None and (m := item.match(line)):
            name = re.sub(r"[*_`]", "", m[2]).strip()
            parent = name if len(m[1]) <= 2 else parent
            out.append((n + 1, category, name, parent if len(m[1]) > 2 else ""))
    return out


def plain_csv(text):
    """One character after the other."""
    rows, row, field, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                field, i = field + '"', i + 1
            else:
                quoted = not quoted
        elif quoted or c not in ",\n":
            field += c
        elif c == ",":
            row, field = [*row, field], ""
        else:
            row = [*row, field.removesuffix("\r")]
            rows += [row] if any(row) else []
            row, field = [], ""
        i += 1
    if field or row:
        rows.append([*row, field.removesuffix("\r")])
    head, *data = rows or [[]]
    return [(k + 2, {h: r[i] if i < len(r) else "" for i, h in enumerate(head)}) for k, r in enumerate(data)]


@pytest.mark.parametrize("size", [31, 201, 1 << 20])
def test_splits_of_any_size_give_the_same(spark, tmp_path, size):
    rng = random.Random(size)
    md = "".join(rng.choice(["## Head é %d\n", "text\n", "* [A%d](u) - x\n", "  * [B%d](u)\r\n", "    * [C%d](u) – y\n", "\n", "   * [D%d](u) no dash\n"]).replace("%d", str(k)) for k in range(120))
    cells = ["a", "", "x é", '"q, ""r"""', '"two\nlines"', '"\n\n"', 'in"si"de', '""', "b\r"]
    csvs = {f"f{k}.csv": "h1,h2,h1\n" + "".join(",".join(rng.choice(cells) for _ in range(rng.randrange(1, 4))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(60)) + end for k, end in enumerate(["", "last,", ",,", '""', '"open\nend', "x"])}
    (tmp_path / "README.md").write_text(md, newline="")
    (tmp_path / "csv").mkdir()
    for name, text in csvs.items():
        (tmp_path / "csv" / name).write_text(text, newline="")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = readers.split_lines(spark, str(tmp_path / "README.md"))
        assert (lines.select("_split").distinct().count() > 5) == (size < 1000)
        got = readers.read_markdown(spark, str(tmp_path / "README.md")).orderBy("source_line").collect()
        assert [(r["source_line"], r["source_category"], r["source_name"], r["parent_provider"]) for r in got] == plain_markdown(md)
        rows = readers.read_csv_rows(spark, str(tmp_path / "csv")).collect()
        assert sorted(((r["file"], r["row_number"], r["values"]) for r in rows), key=str) == sorted(((name, n, v) for name, text in csvs.items() for n, v in plain_csv(text)), key=str)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
