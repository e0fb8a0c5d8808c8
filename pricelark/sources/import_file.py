"""Bulk-import files: CSV with free header names, mapped onto import rows."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelark.functions.offers import SPACE
from pricelark.operators.imports import positions
from pricelark.session import ensure_checkpoint_dir

# Accepted header names (lower case, trimmed) and the field each one fills.
HEADERS = {
    "url": "url",
    "link": "url",
    "product url": "url",
    "target price": "target",
    "target_price": "target",
    "target": "target",
    "threshold": "threshold",
    "threshold %": "threshold",
    "drop_threshold_pct": "threshold",
    "notes": "notes",
    "tags": "tags",
}
_OPTIONS = {
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "quote": '"',
    "escape": '"',
}
FIELDS = ["url", "target", "threshold", "notes", "tags"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw cells as text: header line, trimmed values, doubled quotes, empty lines skipped.

    A quoted cell may span lines, so one file is one task; see ``read_large_csv`` for large ones.
    `_row` numbers the rows as if the files stood one behind the other in the order of their
    names, the first row being 2, after the header.
    """
    raw = spark.read.options(**_OPTIONS).option("header", True).option("multiLine", True).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    # one row per file: where its ids begin and how many rows the files before it have
    files = raw.groupBy("_file").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    row = F.col("_before") + F.col("_id") - F.col("_first") + 2
    return raw.join(files, "_file").withColumn("_row", row).drop("_file", "_id", "_first", "_before")


#: Physical lines of one record; a longer one is an unclosed quote, not a cell.
RECORD_LINES = 100_000


def read_large_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same rows for files of any size, each read by as many tasks as it has splits.

    A line begins a record if an even number of quotes stands before it. Quotes are counted per
    split and summed over the splits before it, records are numbered the same way, and lines of a
    record that spans several are put together again; only those are shuffled by record. Quotes
    must stand as CSV has them: around whole cells, doubled inside.
    """
    text = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    split = ["_file", "_start"]
    inside = Window.partitionBy(*split).orderBy("_id")  # a split, as large as one task reads
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: Column, name: str, sofar: Column) -> DataFrame:
        """``name``: the sum of ``value`` over the splits before a line's, and ``sofar`` in its own."""
        sums = rows.groupBy(*split).agg(F.sum(value).alias("_sum"))  # a row a split
        sums = sums.select(*split, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
        return rows.join(sums, split).withColumn(name, F.col("_carry") + sofar).drop("_carry")

    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    lines = text.withColumn("_quotes", quotes.cast("long"))
    lines = carried(lines, F.col("_quotes"), "_seen", F.sum("_quotes").over(upto))
    begins = ((F.col("_seen") - F.col("_quotes")) % 2 == 0).cast("long")
    lines = lines.withColumn("_begins", begins)
    lines = carried(lines, F.col("_begins"), "_record", F.sum("_begins").over(upto))
    ensure_checkpoint_dir(spark)
    lines = lines.select(*split, "_id", "_record", "value", (F.col("_seen") % 2).alias("_open"), "_begins").checkpoint()
    # a line that begins a record and leaves no quote open is a whole record
    whole = (F.col("_begins") == 1) & (F.col("_open") == 0)
    part = F.struct("_start", "_id", "value")
    several = lines.filter(~whole).groupBy("_file", "_record").agg(F.count("*").alias("_n"), F.collect_list(part).alias("_parts"))
    if not several.filter(F.col("_n") > RECORD_LINES).isEmpty():
        raise ValueError(f"a quoted cell of {path} spans more than {RECORD_LINES} lines")
    joined = F.array_join(F.transform(F.array_sort("_parts"), lambda p: p["value"]), "\n")
    records = lines.filter(whole).select("_file", "_record", "value")
    records = records.unionByName(several.select("_file", "_record", joined.alias("value")))
    first = [r["value"] for r in records.filter("_record = 1").orderBy("_file").select("value").collect()]  # a row a file
    if not first:
        raise ValueError(f"{path} has no header")
    if len(set(first)) > 1:
        raise ValueError("the files have different headers")
    names = next(csv.reader([first[0]], skipinitialspace=True))
    ddl = ", ".join(f"`{n.strip().replace('`', '``') or f'_c{i}'}` STRING" for i, n in enumerate(names))
    cells = F.from_csv("value", ddl, _OPTIONS)
    filled = records.filter((F.col("_record") > 1) & (F.trim("value") != ""))
    numbered = positions(filled, ["_file"], [], "_record", name="_nth")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = filled.groupBy("_file").agg(F.count("*").alias("_n"))  # a row a file
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = F.col("_before") + F.col("_nth") + 2
    return numbered.join(files, "_file").select(cells.alias("_cells"), row.alias("_row")).select("_cells.*", "_row")


def number_cell(text: Column) -> Column:
    """Numeric cell without currency sign, commas and spaces; text gives -1, empty gives null."""
    bare = F.regexp_replace(text, "₹|,|" + SPACE, "")
    plain = bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    # a cell of only spaces and signs counts as zero
    value = F.when(bare == "", F.lit(0.0)).when(plain, bare.try_cast("double"))
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(value, F.lit(-1.0)))


def tag_cell(text: Column) -> Column:
    """Comma- or semicolon-separated tags, trimmed, blanks dropped."""
    edges = f"^{SPACE}+|{SPACE}+$"
    parts = F.transform(F.split(text, "[,;]"), lambda t: F.regexp_replace(t, edges, ""))
    return F.filter(parts, lambda t: t != "")


def import_rows(raw: DataFrame, row_number: str | None = None) -> DataFrame:
    """(row_number, url, target_rupees, threshold_pct, notes, tags) from raw cells.

    ``row_number`` names a column that carries it; without one it is the `_row` of ``read_csv``.
    """
    found: dict[str, list[Column]] = {f: [] for f in FIELDS}
    for name in raw.columns:
        field = HEADERS.get(name.lower().strip())
        if field:
            cell = F.col("`" + name.replace("`", "``") + "`")
            found[field].insert(0, F.nullif(cell.cast("string"), F.lit("")))  # last column wins
    cells = {
        f: F.coalesce(*cols) if cols else F.lit(None).cast("string") for f, cols in found.items()
    }
    number = (
        F.col(row_number).cast("bigint")
        if row_number
        else F.col("_row")
    )
    return raw.select(
        number.alias("row_number"),
        cells["url"].alias("url"),
        number_cell(cells["target"]).alias("target_rupees"),
        number_cell(cells["threshold"]).alias("threshold_pct"),
        cells["notes"].alias("notes"),
        tag_cell(cells["tags"]).alias("tags"),
    )
