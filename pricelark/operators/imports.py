"""Bulk import: review of every row, registration of the valid ones, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelark.functions.binding import settled
from pricelark.functions.urls import Registry, default_registry, recognise
from pricelark.model import STAGGER_SECONDS
from pricelark.session import ensure_checkpoint_dir

CELL = 1_000_000


def positions(
    df: DataFrame, keys: list[str], major: list[str], by: str, cell: int = CELL, name: str = "pos"
) -> DataFrame:
    """0-based position of every row per key in (major, by) order; ``by`` is a long.

    Rows are counted per (major, range of ``by``) cell and the counts are summed
    before each cell, so no task sorts more than one cell. The input is run once and
    saved, for counts and rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    celled = df.withColumn("_cell", F.floor(F.col(by) / cell)).checkpoint()
    cells = [*keys, *major, "_cell"]
    sizes = celled.groupBy(*cells).agg(F.count("*").alias("_n"))
    order = Window.orderBy(*major, "_cell") if not keys else Window.partitionBy(*keys).orderBy(
        *major, "_cell"
    )
    before = F.coalesce(
        F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select(*cells, before.alias("_before"))
    # majors may be null, so the cells are matched null-safe
    a, b = celled.alias("a"), offsets.alias("b")
    same = F.lit(True)
    for c in cells:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    local = F.row_number().over(Window.partitionBy(*cells).orderBy(by)) - 1
    numbered = celled.withColumn("_local", local).alias("a")
    return numbered.join(b, same).select(
        "a.*", (F.col("_before") + F.col("_local")).cast("bigint").alias(name)
    ).drop("_cell", "_local")


def review(rows: DataFrame, existing: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Each row with its disposition and reason, in the order the checks apply.

    ``existing(canonical_url, display_name)``. Within a file the first acceptable row
    of a listing wins; that row is a minimum per listing, so a listing repeated
    any number of times costs one aggregate row.
    """
    seen = settled(rows.withColumn("r", recognise(F.coalesce("url", F.lit("")), registry))).select("*", "r.*").drop("r")
    bad_target = F.coalesce(~(F.col("target_rupees") > 0), F.lit(False))
    listing = F.col("kind") == "listing"
    able = listing & ~bad_target
    # conditional minimum and null-safe match: no filter that would parse the URLs again
    first = seen.groupBy(F.col("canonical_url").alias("_url")).agg(
        F.min(F.when(able, F.col("row_number"))).alias("_first")
    )
    known = existing.select(
        F.col("canonical_url").alias("_url"), F.col("display_name").alias("_known")
    )
    facts = first.join(known, "_url", "left")
    # rows without a listing match nothing; a key of their own keeps them out of one task
    own = F.concat(F.lit("row "), F.col("row_number").cast("string"))
    joined = seen.join(facts, F.coalesce("canonical_url", own) == F.col("_url"), "left")
    site = F.coalesce(
        F.concat(F.lit(" ("), F.col("detected_site"), F.lit(")")), F.lit("")
    )
    missing = F.coalesce("url", F.lit("")) == ""
    tracked = F.col("_known").isNotNull()
    cases: list[tuple[Column, str, Column]] = [
        (missing, "invalid", F.lit("Missing URL")),
        (
            F.col("kind") == "unsupported",
            "invalid",
            F.concat(
                F.lit("Unsupported site"),
                site,
                F.lit(f" — only {(registry or default_registry()).supported()} supported"),
            ),
        ),
        (
            F.col("kind") == "not_a_listing",
            "invalid",
            F.lit(
                "Could not resolve to a product listing (short link may be blocked, expired, "
                "or point to a search/category page)"
            ),
        ),
        (bad_target, "invalid", F.lit("Target price must be a positive number")),
        (
            ~tracked & (F.col("row_number") > F.col("_first")),
            "duplicate",
            F.lit("Duplicate of an earlier row in this file (first occurrence wins)"),
        ),
        (
            tracked,
            "duplicate",
            F.concat(F.lit("Already tracked as “"), F.col("_known"), F.lit("”")),
        ),
    ]
    disposition, reason = None, None
    for test, label, why in cases:
        disposition = F.when(test, label) if disposition is None else disposition.when(test, label)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    return joined.select(
        "*", disposition.otherwise("valid").alias("disposition"), reason.alias("reason")
    ).drop("_first", "_known", "_url")


def execute(reviewed: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """Product rows of a confirmed review: placeholder name, staggered first check.

    Listings that were registered since the review are left out; ``late_duplicates``
    reports them.
    """
    valid = positions(
        reviewed.filter(F.col("disposition") == "valid"), [], [], "row_number", name="nth"
    )
    fresh = valid.join(existing.select("canonical_url"), "canonical_url", "left_anti")
    wait = F.make_dt_interval(secs=F.col("nth") * STAGGER_SECONDS)
    return fresh.select(
        "row_number",
        "marketplace",
        "url",
        "canonical_url",
        "marketplace_product_id",
        F.concat(F.lit("Awaiting first check — "), F.col("marketplace_product_id")).alias(
            "display_name"
        ),
        F.round(F.col("target_rupees") * 100).cast("bigint").alias("target_paise"),
        "threshold_pct",
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.lit("active").alias("status"),
        (now + wait).alias("next_check_at"),
    )


def late_duplicates(reviewed: DataFrame, existing: DataFrame) -> DataFrame:
    valid = reviewed.filter(F.col("disposition") == "valid")
    return valid.join(existing.select("canonical_url"), "canonical_url", "left_semi").select(
        "row_number", "url", F.lit("Became a duplicate during import").alias("reason")
    )


def report(reviewed: DataFrame) -> DataFrame:
    """Counts of one import; the row errors stay a table of their own (``row_errors``)."""
    kind = F.col("disposition")
    return reviewed.agg(
        F.count("*").alias("total_rows"),
        F.count_if(kind == "valid").alias("imported"),
        F.count_if(kind == "duplicate").alias("duplicates"),
        F.count_if(kind == "invalid").alias("invalid"),
    )


def row_errors(reviewed: DataFrame) -> DataFrame:
    """Invalid and duplicate rows with their reason."""
    cols = ["row_number", F.coalesce("url", F.lit("")).alias("url"), "reason"]
    invalid = reviewed.filter(F.col("disposition") == "invalid").select(*cols)
    return invalid.unionByName(
        reviewed.filter(F.col("disposition") == "duplicate").select(*cols)
    )
