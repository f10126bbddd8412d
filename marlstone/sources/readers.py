"""Scans of listings, vocabularies and labelled runs (SRC-01 .. SRC-09)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import money_value, strip_markdown
from ..operators.shared import written

RECORD = (
    "source_kind string, source_locator string, source_file string, source_line int, source_row int, source_category string, source_name string, "
    "source_url string, source_description string, source_offer_detail string, source_eligibility string, source_platform string, parent_provider string, "
    "estimated_value_usd double, raw_text string"
)
_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
_ITEM = r"^(\s*)\* \[([^\]]+)\]\(([^)]+)\)(?:\s*[-–—]\s*(.*))?$"


def carry_forward(df: DataFrame, value: str, keys: list[str], order: str, out: str) -> DataFrame:
    """WIN-06: the last non-null value so far, within the keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """_f, _size, _split, _at, line: the lines of files that are read in splits.

    A split is named by where its block starts; ``_at`` ascends along its lines.  Lines end
    at line feeds only.
    """
    meta = F.col("_metadata")
    x = spark.read.text(path, lineSep="\n").select(meta["file_path"].alias("_f"), meta["file_size"].alias("_size"), meta["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    return x


def _before(keys: list[str], order: str):
    """All rows of the keys before a row."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def read_markdown(spark: SparkSession, path: str, source_kind: str = "free_for_dev_readme", platform: str = "free-for-dev", file_name: str = "README.md") -> DataFrame:
    """SRC-01: bullets of a Markdown catalog below its first ``## `` heading.

    A heading sets the category and ends the parent; an item indented by two or fewer becomes the
    parent of deeper ones.  Large files are read in splits: each split tells its number of
    lines and the heading and parent that it leaves, one row a split is folded along the file, and
    every split goes on from what it is handed.  Only headings and items are shuffled, a split a group.
    """
    lines = split_lines(spark, path).withColumn("line", F.regexp_replace("line", r"\r$", ""))
    item = lambda k: F.regexp_extract("line", _ITEM, k)
    is_heading, is_item = F.col("line").rlike(r"^## .+$"), F.col("line").rlike(_ITEM)
    told = lines.withColumn("_h", F.when(is_heading, F.trim(F.regexp_extract("line", r"^## (.+)$", 1))))
    told = told.withColumn("_own", F.when(is_item & (F.length(item(1)) <= 2), strip_markdown(item(2))))
    last = lambda c, test: F.max(F.when(test, F.struct(F.col("_at").alias("at"), F.col(c).alias("v"))))
    left = told.groupBy("_f", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"), last("_h", F.col("_h").isNotNull()).alias("_lh"), last("_own", F.col("_own").isNotNull()).alias("_lo"))
    # the parent that a split leaves: one after its last heading, none if that came later, unknown if there is neither
    parent = F.when(F.col("_lh").isNull(), F.col("_lo.v")).otherwise(F.when(F.coalesce(F.col("_lo.at") > F.col("_lh.at"), F.lit(False)), F.col("_lo.v")).otherwise(""))
    along = _before(["_f"], "_split")
    handed = left.withColumn("_leaves", parent).select(
        "_f", "_split", "_first", F.coalesce(F.sum("_lines").over(along), F.lit(0)).alias("_lines_before"), F.last("_lh.v", ignorenulls=True).over(along).alias("_category"), F.last("_leaves", ignorenulls=True).over(along).alias("_parent"),
    )
    rows = told.filter(is_heading | is_item).join(handed, ["_f", "_split"])
    w = Window.partitionBy("_f", "_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_section": F.count("_h").over(w), "source_category": F.coalesce(F.last("_h", ignorenulls=True).over(w), "_category")})
    rows = carry_forward(rows, "_own", ["_f", "_split", "_section"], "_at", "_near")
    rows = rows.withColumn("_parent", F.coalesce("_near", F.when(F.col("_section") == 0, F.col("_parent"))))
    rows = rows.filter(F.col("_h").isNull() & F.col("source_category").isNotNull())
    rows = rows.withColumns({"_indent": F.length(item(1)), "source_name": strip_markdown(item(2)), "source_url": item(3), "_text": strip_markdown(item(4)), "_n": F.col("_lines_before") + F.col("_at") - F.col("_first")})
    line = (F.col("_n") + 1).cast("int")
    return rows.select(
        F.lit(source_kind).alias("source_kind"), F.concat(F.lit(f"{file_name}:"), line.cast("string")).alias("source_locator"), F.lit(file_name).alias("source_file"), line.alias("source_line"),
        F.lit(None).cast("int").alias("source_row"), "source_category", "source_name", "source_url", F.col("_text").alias("source_description"), F.col("_text").alias("source_offer_detail"),
        F.lit("").alias("source_eligibility"), F.lit(platform).alias("source_platform"), F.when(F.col("_indent") > 2, F.coalesce("_parent", F.lit(""))).otherwise(F.lit("")).alias("parent_provider"),
        F.lit(None).cast("double").alias("estimated_value_usd"), F.col("line").alias("raw_text"),
    )


def _cells(row: str) -> list[str]:
    """A record's cells: quotes toggle anywhere, doubled ones inside are literal, a carriage return at the end goes."""
    out, parts = [""], row.split('"')
    for k, part in enumerate(parts):
        if k % 2:
            out[-1] += part
        elif not part and 0 < k < len(parts) - 1:
            out[-1] += '"'
        else:
            first, *more = part.split(",")
            out[-1] += first
            out += more
    out[-1] = out[-1].removesuffix("\r")
    return out


@F.pandas_udf(T.BooleanType())
def _holds_something(rows: pd.Series, last: pd.Series) -> pd.Series:
    """Whether a record is no blank one; the unterminated last one counts if there is any character or comma."""
    told = lambda row, last: bool(row.replace('"', "") or '""' in row[1:-1]) if last else any(_cells(row))
    return pd.Series([told(r, x) for r, x in zip(rows, last, strict=True)], dtype=bool)


@F.pandas_udf(T.StructType([T.StructField("values", T.MapType(T.StringType(), T.StringType())), T.StructField("raw_text", T.StringType())]))
def _named(rows: pd.Series, heads: pd.Series) -> pd.DataFrame:
    out = []
    for row, head in zip(rows, heads, strict=True):
        names, got = _cells(head), _cells(row)
        pairs = [(n, got[i] if i < len(got) else "") for i, n in enumerate(names)]
        out.append((dict(pairs), "\n".join(f"{n}: {v}" for n, v in pairs)))
    return pd.DataFrame(out, columns=["values", "raw_text"])


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: file, row_number (non-blank row + 2), values by header, raw_text.

    A line feed ends a record if an even number of quotes stands before it.  So large files are read
    in splits: each split tells its number of quotes and how many records end in it for either
    parity, one row a split is folded along the file, and every line then knows its record.
    Records may lie across splits; blank ones are skipped, but for an unterminated last one, and
    missing cells are empty strings.
    """
    lines = split_lines(spark, path).withColumn("_q", F.regexp_count("line", F.lit('"')))
    here = Window.partitionBy("_f", "_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_quotes", F.sum("_q").over(here))  # up to the line's end, from the split's start
    ends = lambda parity: F.count_if((F.col("_quotes") + parity) % 2 == 0)
    left = lines.groupBy("_f", "_split").agg(F.max("_quotes").alias("_sum"), ends(0).alias("_even"), ends(1).alias("_odd"), F.sum(F.octet_length("line") + 1).alias("_bytes"), F.max("_size").alias("_size"))
    along = _before(["_f"], "_split")
    left = left.withColumn("_parity", F.coalesce(F.sum("_sum").over(along), F.lit(0)) % 2)
    left = left.withColumn("_ends", F.when(F.col("_parity") == 0, F.col("_even")).otherwise(F.col("_odd")))
    whole = Window.partitionBy("_f")
    handed = left.select("_f", "_split", "_parity", F.coalesce(F.sum("_ends").over(along), F.lit(0)).alias("_ended"), (F.sum("_bytes").over(whole) > F.col("_size")).alias("_open"), F.sum("_ends").over(whole).alias("_all"), (F.sum("_sum").over(whole) % 2 == 1).alias("_odd_end"))
    lines = lines.join(handed, ["_f", "_split"])
    is_end = (F.col("_quotes") + F.col("_parity")) % 2 == 0
    before = F.coalesce(F.count_if(is_end).over(_before(["_f", "_split"], "_at")), F.lit(0))
    lines = lines.withColumn("_record", F.col("_ended") + before)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_split", "_at", "line"))), lambda x: x["line"]), "\n")
    records = lines.groupBy("_f", "_record").agg(text.alias("_row"), *[F.max(c).alias(c) for c in ("_open", "_all", "_odd_end", "_split")])
    # the file ends in a record without a line feed of its own: at the last line, or inside quotes
    last = F.when(F.col("_odd_end"), F.col("_record") == F.col("_all")).otherwise(F.col("_open") & (F.col("_record") == F.col("_all") - 1))
    row = F.when(F.col("_odd_end") & ~F.col("_open") & last, F.concat("_row", F.lit("\n"))).otherwise(F.col("_row"))
    records = records.withColumns({"_row": row, "_last": last}).filter(_holds_something("_row", "_last"))
    records = written(records.select("_f", "_record", "_row", "_split"), "records")
    number = records.groupBy("_f", "_split").agg(F.count("*").alias("_c")).select("_f", "_split", F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_c"))
    order = Window.partitionBy("_f", "_split").orderBy("_record")
    records = records.join(number, ["_f", "_split"]).withColumn("_n", F.col("_c") + F.row_number().over(order))
    heads = records.filter("_n = 1").select("_f", F.col("_row").alias("_head"))
    out = records.filter("_n > 1").join(heads, "_f").withColumn("_v", _named("_row", "_head"))
    return out.select(F.element_at(F.split("_f", "/"), -1).alias("file"), F.col("_n").cast("int").alias("row_number"), "_v.values", "_v.raw_text")


def read_offers_csv(spark: SparkSession, path: str, source_kind: str = "startup_offers_csv") -> DataFrame:
    """SRC-03: offer rows as records of the common 15 fields."""
    v = lambda k: F.col("values")[k]
    return read_csv_rows(spark, path).select(
        F.lit(source_kind).alias("source_kind"), F.concat_ws(":", "file", F.col("row_number").cast("string")).alias("source_locator"), F.col("file").alias("source_file"), F.lit(None).cast("int").alias("source_line"),
        F.col("row_number").alias("source_row"), v("Category").alias("source_category"), v("Brand/Product").alias("source_name"), v("Application Link").alias("source_url"), v("Description").alias("source_description"),
        v("Monetary Detail").alias("source_offer_detail"), v("Eligibility Notes").alias("source_eligibility"), v("Platform/Source").alias("source_platform"), F.lit("").alias("parent_provider"),
        money_value(v("Estimated Value")).alias("estimated_value_usd"), "raw_text",
    )


def read_records(spark: SparkSession, markdown: str | None = None, offers: str | None = None) -> DataFrame:
    """SET-01: listing rows, then offer rows, with an explicit ordinal."""
    parts = []
    if markdown:
        parts.append(read_markdown(spark, markdown).withColumn("_part", F.lit(0)))
    if offers:
        parts.append(read_offers_csv(spark, offers).withColumn("_part", F.lit(1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ordinal = F.struct("_part", "source_file", F.coalesce("source_line", "source_row"))
    return out.withColumn("source_order", ordinal).drop("_part")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-04: (namespace, concept_id) and (unit_id) dimension rows of a versioned JSON vocabulary."""
    raw = spark.read.text(path, wholetext=True)
    spaces = F.from_json(F.get_json_object("value", "$.facet_namespaces"), "map<string,array<string>>")
    concepts = raw.select(F.explode(spaces).alias("namespace", "ids")).select("namespace", F.explode("ids").alias("concept_id"))
    units = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.normalized_units"), "array<string>")).alias("unit_id"))
    return concepts, units


def read_record(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """SRC-05: a JSON record file, or the rows of a staging file with the id."""
    df = spark.read.json(path, multiLine=True)
    return df.filter(F.col("source_id") == source_id).limit(1) if source_id else df


def read_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-08: evaluation reports of a folder."""
    return spark.read.json(folder, multiLine=True, pathGlobFilter="*.evaluation.json", recursiveFileLookup=True)


def read_evaluation_inputs(spark: SparkSession, traces: str, labels: str, staging: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-07: traces, labels and staged records as rows."""
    one = lambda path, field: spark.read.json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")
    return one(traces, "traces"), one(labels, "labels"), spark.read.json(staging, multiLine=True)
