"""Catalogue, history, chart and alert-log queries: filters, orders, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.money import half_up
from pricelark.operators.slices import top_per_key
from pricelark.session import ensure_checkpoint_dir

# health filter -> condition; "failing" here ignores the status, the dashboard's does not
HEALTH = {
    "auto_paused": "status = 'paused_auto'",
    "failing": "consecutive_failures > 0",
    "healthy": "consecutive_failures = 0 AND status = 'active'",
}
# null order as the catalogue shows it: ascending ends with nulls, descending starts with them
SORTS = {
    "recent": "created_at DESC NULLS FIRST",
    "name": "display_name ASC NULLS LAST",
    "price_asc": "current_paise ASC NULLS LAST",
    "price_desc": "current_paise DESC NULLS FIRST",
    "biggest_drop": "discount_pct DESC NULLS FIRST",
    "recently_changed": "last_changed_at DESC NULLS FIRST",
}


def sort_order(name: str) -> Column:
    column, direction, _, nulls = SORTS[name].split()
    return getattr(F.col(column), f"{direction.lower()}_nulls_{nulls.lower()}")()


@dataclass(frozen=True)
class CatalogueQuery:
    """Filters and order of one catalogue request; unset means no filter."""

    search: str | None = None
    marketplace: str | None = None
    tag: str | None = None
    category: str | None = None
    stock: str | None = None
    status: str | None = None
    health: str | None = None
    min_paise: int | None = None
    max_paise: int | None = None
    sort: str = "recent"
    page: int = 1
    page_size: int = 25

    def predicates(self) -> list[Column]:
        out = []
        if self.search:
            out.append(contains_text(self.search, "display_name", "canonical_url"))
        if self.marketplace:
            out.append(F.col("marketplace") == self.marketplace)
        if self.tag:
            out.append(F.array_contains("tags", self.tag))
        if self.category == "none":
            out.append(F.col("category").isNull())
        elif self.category:
            out.append(F.col("category") == self.category)
        if self.stock:
            out.append(F.col("stock_status") == self.stock)
        if self.status:
            out.append(F.col("status") == self.status)
        if self.health:
            out.append(F.expr(HEALTH[self.health]))
        if self.min_paise is not None:
            out.append(F.col("current_paise") >= self.min_paise)
        if self.max_paise is not None:
            out.append(F.col("current_paise") <= self.max_paise)
        return out


def contains_text(term: str, *cols: str) -> Column:
    """Case-insensitive literal substring of any column."""
    test = F.lit(False)
    for c in cols:
        test = test | F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
    return test


def by_id(catalogue: DataFrame, product_id: int) -> DataFrame:
    """Point lookup; the equality reaches the scan's file statistics."""
    return catalogue.filter(F.col("product_id") == product_id)


def matching(catalogue: DataFrame, q: CatalogueQuery) -> DataFrame:
    for p in q.predicates():
        catalogue = catalogue.filter(p)
    return catalogue


def page(df: DataFrame, order: list[Column], number: int, size: int, cap: int = 100) -> DataFrame:
    """One page by offset; a size above the cap is an error, so that the top-k stays small."""
    within("page size", size, 1, cap)
    within("page number", number, 1)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def within(name: str, value: int, low: int, high: int | None = None) -> None:
    """Refuse an argument out of its range rather than return fewer rows than asked for."""
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} {value} is not within {low}..{'' if high is None else high}")


def catalogue_page(catalogue: DataFrame, q: CatalogueQuery) -> DataFrame:
    """Priority first, then the chosen order, then the id; with the total on each row."""
    found = matching(catalogue, q)
    order = [F.col("priority").asc_nulls_last(), sort_order(q.sort), F.col("product_id").asc()]
    total = found.agg(F.count("*").alias("total")).scalar()
    return page(found, order, q.page, q.page_size).select(
        "*", total.alias("total"), F.ceil(total / F.lit(q.page_size)).alias("pages")
    )


def catalogue_seek(catalogue: DataFrame, q: CatalogueQuery, ranges: int | None = None) -> DataFrame:
    """The same page, however deep: no task sorts more than a range of the list.

    Only the order's columns are dealt to ranges; rows counted per range give the total and
    say which ranges the page lies in. The whole rows of its ids are read at the end.
    """
    within("page size", q.page_size, 1, 100)
    within("page number", q.page, 1)
    spark = catalogue.sparkSession
    found = matching(catalogue, q)
    column = SORTS[q.sort].split()[0]
    order = [F.col("priority").asc_nulls_last(), sort_order(q.sort), F.col("product_id").asc()]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = found.select("priority", column, "product_id").repartitionByRange(n, *order)
    ensure_checkpoint_dir(spark)
    keys = keys.withColumn("_range", F.spark_partition_id()).checkpoint()  # ranges are drawn once
    sizes = sorted((r["_range"], r["count"]) for r in keys.groupBy("_range").count().collect())  # a row a range
    total, first, before, wanted, skipped = sum(k for _, k in sizes), (q.page - 1) * q.page_size, 0, [], 0
    for at, k in sizes:
        if before + k > first and before < first + q.page_size:
            skipped = before if not wanted else skipped
            wanted.append(at)
        before += k
    rows = keys.filter(F.col("_range").isin(wanted)).orderBy(*order).offset(max(first - skipped, 0)).limit(q.page_size)
    ids = [r["product_id"] for r in rows.select("product_id").collect()]  # one page
    return found.filter(F.col("product_id").isin(ids)).orderBy(*order).select(
        "*",
        F.lit(total).cast("long").alias("total"),
        F.lit(-(-total // q.page_size)).cast("long").alias("pages"),
    )


def history_page(
    checks: DataFrame, size: int = 50, number: int = 1, failed_only: bool = False
) -> DataFrame:
    """One page of every product's history, newest first."""
    rows = checks.filter(~F.col("success")) if failed_only else checks
    order = [F.col("checked_at").desc(), F.col("check_id").desc()]
    within("page size", size, 1, 200)
    within("page number", number, 1)
    ranked = top_per_key(rows, ["product_id"], order, size * number)
    return ranked.filter(F.col("rn") > size * (number - 1))


def history_after(checks: DataFrame, at: Column, check_id: Column, size: int) -> DataFrame:
    """Keyset page: the next rows after a (time, id) cursor."""
    later = (F.col("checked_at") > at) | (
        (F.col("checked_at") == at) & (F.col("check_id") > check_id)
    )
    # the plain time bound is implied by the cursor and reaches the scan
    return (
        checks.filter(F.col("checked_at") >= at)
        .filter(later)
        .orderBy("checked_at", "check_id")
        .limit(size)
    )


def trailing(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days up to ``now`` (1..3650)."""
    within("days", days, 1, 3650)
    return df.filter((F.col(at) >= now - F.make_dt_interval(days=F.lit(days))) & (F.col(at) <= now))


def chart_rows(checks: DataFrame, now: Column, days: int, cap: int | None = None) -> DataFrame:
    """The chart's rows of the range. With a cap, the oldest of each product and `truncated`."""
    window = trailing(checks, "checked_at", now, days)
    if cap is None:
        return window.withColumn("truncated", F.lit(False))
    order = [F.col("checked_at").asc(), F.col("check_id").asc()]
    sizes = window.groupBy("product_id").agg((F.count("*") > cap).alias("truncated"))
    return top_per_key(window, ["product_id"], order, cap).drop("rn").join(sizes, "product_id")


def chart_points(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("success")).select(
        "product_id",
        F.col("checked_at").alias("t"),
        "price_paise",
        "mrp_paise",
        (F.col("stock_status") == "out_of_stock").alias("out_of_stock"),
    )


def chart_failures(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("success")).select(
        "product_id", F.col("checked_at").alias("t"), F.col("failure_reason").alias("reason")
    )


def chart_stats(checks: DataFrame) -> DataFrame:
    """Low and high over live prices; the average over every priced success."""
    ok = F.col("success")
    live = ok & (F.col("stock_status") != "out_of_stock") & (F.col("price_paise") > 0)
    priced = F.when(ok, F.col("price_paise"))
    return checks.groupBy("product_id").agg(
        F.min(F.when(live, F.col("price_paise"))).alias("low_paise"),
        F.max(F.when(live, F.col("price_paise"))).alias("high_paise"),
        # whole rupees
        (half_up(F.sum(priced).cast("double") / F.count(priced) / 100)).cast("bigint").alias(
            "average_rupees"
        ),
    )


def alert_log(
    alerts: DataFrame,
    products: DataFrame,
    product_id: int | None = None,
    kind: str | None = None,
    delivery: str | None = None,
    number: int = 1,
    size: int = 25,
) -> DataFrame:
    """Newest alerts first with their product, missing products kept."""
    found = alerts
    for name, value in (("product_id", product_id), ("type", kind), ("delivery", delivery)):
        if value is not None:
            found = found.filter(F.col(name) == value)
    top = page(found, [F.col("fired_at").desc(), F.col("alert_id").desc()], number, size)
    names = products.select("product_id", "display_name", "marketplace")
    return top.join(names, "product_id", "left")
