"""Writers: history and audit appends, expiry of old folders, CSV exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.functions.clock import local_date
from pricelark.operators.usage import fixed
from pricelark.sources import folders
from pricelark.session import ensure_checkpoint_dir

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def csv_cell(value: Column) -> Column:
    """Quote a cell only when it holds a quote, comma or newline; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(
        text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as one CSV line, column order kept."""
    cells = [csv_cell(F.col("`" + c + "`")) for c in df.columns]
    # concat_ws keeps empty cells; only nulls are skipped and csv_cell leaves none
    return df.select(F.concat_ws(",", *cells).alias("line"))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A folder of CSV parts; with ``order`` the parts are ranges of it, sorted inside."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def rupees(paise: Column) -> Column:
    return (paise.cast("decimal(20,0)") / 100).cast("decimal(12,2)")


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").when(~flag, "no").otherwise("")


def _names(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id", F.col("display_name").alias("_name"), F.col("marketplace").alias("_market")
    )


def export_products(catalogue: DataFrame) -> DataFrame:
    """The products file; it can be imported again."""
    return catalogue.select(
        F.col("canonical_url").alias("url"),
        F.col("display_name").alias("name"),
        rupees(F.col("target_paise")).alias("target price"),
        (F.col("threshold_bp").cast("decimal(10,0)") / 100).cast("decimal(5,2)").alias("threshold"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.array_join("tags", ", ").alias("tags"),
        "marketplace",
        "status",
        rupees(F.col("current_paise")).alias("current price"),
        rupees(F.col("current_mrp_paise")).alias("mrp"),
        F.col("stock_status").alias("stock"),
        rupees(F.col("low_paise")).alias("all-time low"),
        rupees(F.col("high_paise")).alias("all-time high"),
        iso(F.col("last_checked_at")).alias("last checked (UTC)"),
        F.col("created_at").alias("_created_at"),
        F.col("product_id").alias("_id"),
    )


def export_history(history: DataFrame, products: DataFrame) -> DataFrame:
    """One line per check with the product's name, or its id when it is gone."""
    joined = history.join(_names(products), "product_id", "left")
    return joined.select(
        F.coalesce("_name", F.col("product_id").cast("string")).alias("product"),
        F.coalesce("_market", F.lit("")).alias("marketplace"),
        iso(F.col("checked_at")).alias("checked at (UTC)"),
        _yes_no(F.col("success")).alias("success"),
        rupees(F.col("price_paise")).alias("price"),
        rupees(F.col("mrp_paise")).alias("mrp"),
        F.col("discount_pct").alias("discount %"),
        F.col("stock_status").alias("stock"),
        F.to_json("offers").alias("offers"),
        F.coalesce("failure_reason", F.lit("")).alias("failure reason"),
        F.col("checked_at").alias("_at"),
        F.col("check_id").alias("_id"),
    )


# audit column -> export header, for the columns copied as they are
AUDIT_PLAIN = {
    "tier": "tier",
    "name": "scraped name",
    "price": "price",
    "mrp": "mrp",
    "stock_status": "stock",
    "price_source": "price source",
    "offers_count": "offers count",
    "offers_hash": "offers hash",
    "pincode_requested": "pincode requested",
    "pincode_applied": "pincode applied",
    "pincode_verified": "verified",
    "pincode_api_status": "api status",
    "api_price": "api price",
    "html_price": "html price",
    "exit_ip": "exit ip",
    "proxy_session": "proxy session",
    "duration_ms": "duration ms",
    "failure_reason": "failure reason",
    "failure_detail": "failure detail",
    "debug": "debug (json)",
}


def export_audit(audit: DataFrame, products: DataFrame) -> DataFrame:
    """One line per audited check, every diagnostic column and the blob."""
    joined = audit.join(
        products.select("product_id", F.col("display_name").alias("_name")), "product_id", "left"
    )

    def cell(name: str) -> Column:
        if name not in audit.columns:
            return F.lit("")
        if name == "pincode_verified":
            return _yes_no(F.col(name))
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return joined.select(
        F.coalesce("_name", F.col("product_id").cast("string")).alias("product"),
        "marketplace",
        iso(F.col("created_at")).alias("checked at (UTC)"),
        _yes_no(F.col("success")).alias("success"),
        *[cell(n).alias(h) for n, h in AUDIT_PLAIN.items()],
        F.col("audit_id").alias("_id"),
    )


def export_usage(usage: DataFrame) -> DataFrame:
    """Megabytes to one decimal, kilobytes per check to none."""

    def mb(name: str) -> Column:
        return fixed(F.col(name).cast("double") / 1e6, 1)

    per = F.col("wire_bytes").cast("double") / F.col("scrapes") / 1024
    return usage.select(
        F.col("display_name").alias("product"),
        "marketplace",
        "scrapes",
        F.col("ok").alias("succeeded"),
        "failed",
        "retries",
        F.col("tier2").alias("tier-2 (browser)"),
        mb("wire_bytes").alias("wire MB"),
        F.when(F.col("scrapes") > 0, fixed(per, 0)).otherwise("0").alias("KB / scrape"),
        mb("http_page").alias("page MB (http)"),
        mb("browser_page").alias("page MB (browser)"),
        mb("pincode_api").alias("pincode API MB"),
        mb("cookie_mint").alias("cookie mint MB"),
        mb("side_sheet").alias("side-sheet MB"),
        F.col("wire_bytes").alias("_bytes"),
        F.col("product_id").alias("_id"),
    )


def alert_values() -> tuple[Column, Column]:
    """Old and new value of an alert as JSON; null fields are left out, as each type has its own."""
    kind = F.col("type")

    def r(c: str) -> Column:
        return rupees(F.col(c)).cast("double")

    old = F.struct(
        r("old_paise").alias("price"),
        F.when(kind == "target_price", r("target_paise")).alias("target"),
        F.col("old_offers").alias("offers"),
        F.when(kind == "back_in_stock", "out_of_stock").alias("stockStatus"),
        F.when(kind == "auto_paused", "active").alias("status"),
    )
    new = F.struct(
        r("new_paise").alias("price"),
        F.when(kind == "target_price", r("target_paise")).alias("target"),
        F.when(kind == "threshold_drop", F.col("threshold_bp") / 100.0).alias("thresholdPct"),
        F.col("new_offers").alias("offers"),
        F.col("added").alias("added"),
        F.col("removed").alias("removed"),
        F.when(kind == "back_in_stock", "in_stock").alias("stockStatus"),
        F.when(kind == "auto_paused", "paused_auto").alias("status"),
        F.col("failure_reason").alias("failureReason"),
        F.col("consecutive_failures").alias("consecutiveFailures"),
    )
    return F.to_json(old), F.to_json(new)


def export_alerts(alerts: DataFrame, products: DataFrame) -> DataFrame:
    """One line per alert; an alert without a product belongs to the system."""
    joined = alerts.join(
        products.select("product_id", F.col("display_name").alias("_name")), "product_id", "left"
    )
    old, new = alert_values()
    return joined.select(
        F.coalesce("_name", F.lit("system")).alias("product"),
        "type",
        iso(F.col("fired_at")).alias("fired at (UTC)"),
        F.col("change_pct").alias("change %"),
        old.alias("old"),
        new.alias("new"),
        F.coalesce("status", F.lit("pending")).alias("delivery"),
        F.coalesce("delivery_error", F.lit("")).alias("delivery error"),
        F.col("fired_at").alias("_at"),
        F.col("check_id").alias("_id"),
    )


def saved_rows(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def stored_rows(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as a Parquet table of their own while the block runs: made once, and read in the columns asked for."""
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    try:
        df.write.parquet(place)
        yield spark.read.schema(df.schema).format("parquet").load(place)
    finally:
        folders.drop(spark, place)


def _within(column: str, values: list[str | None]) -> Column:
    known = F.coalesce(F.col(column).isin([v for v in values if v is not None]), F.lit(False))
    return known | F.col(column).isNull() if None in values else known


def _append(rows: DataFrame, path: str, folder: str, key: str) -> None:
    """Write the rows whose key is not yet in the folders that they would be written to, each once.

    Only those folders are listed and their keys read, whatever else the table holds; a rerun finds
    all its rows there and writes nothing. Keys alone are compared; whole rows are joined only in
    folders of which a part is there or a key comes twice. A folder's rows go to one task, or to
    several if they are many, so there are about as many files as folders."""
    spark = rows.sparkSession
    with ExitStack() as until_written:
        keep = until_written.enter_context
        rows = keep(stored_rows(rows))  # folders and rows must come from one reading
        there = folders.values(spark, path, folder)
        touched = [r[0] for r in rows.select(folder).distinct().collect()]  # a row a folder of this batch
        paths = [f"{path}/{there[value]}" for value in touched if value in there]
        own = rows.select(key, F.lit(1).cast("long").alias("_n"), F.lit(False).alias("_there"))
        if paths:
            known = spark.read.schema(rows.select(key).schema).parquet(*paths).filter(F.col(key).isNotNull())
            own = own.union(known.select(key, F.lit(0).cast("long"), F.lit(True)))
        marks = own.groupBy(F.col(key).alias("_key")).agg(F.sum("_n").alias("_n"), F.max("_there").alias("_there"))
        odd = keep(stored_rows(marks.filter((F.col("_n") > 1) | (F.col("_there") & (F.col("_n") > 0)))))
        if not odd.isEmpty():
            same = F.col(key).eqNullSafe(F.col("_key"))
            found = rows.select(key, folder).join(odd, same, "left").groupBy(folder)
            found = found.agg(F.count("*").alias("rows"), F.count("_n").alias("odd"), F.count_if("_there").alias("there"))
            found = found.collect()  # a row a folder of this batch
            mixed = rows.filter(_within(folder, [r[folder] for r in found if r["odd"] and r["there"] < r["rows"]]))
            mixed = mixed.join(odd.filter("_there"), same, "left_anti")
            twice = odd.filter("NOT _there")
            if not twice.isEmpty():
                once = mixed.join(twice, same, "left_semi").dropDuplicates([key])
                mixed = mixed.join(twice, same, "left_anti").union(once)
            plain = [r[folder] for r in found if not r["odd"]]
            rows = rows.filter(_within(folder, plain)).union(mixed)
        rows.hint("rebalance", folder).write.mode("append").partitionBy(folder).parquet(path)


def append_history(history: DataFrame, path: str) -> None:
    """Exactly one row per check, in month folders, also when a batch is written again."""
    rows = history.withColumn("checked_month", F.date_format("checked_at", "yyyy-MM"))
    _append(rows, path, "checked_month", "check_id")


def append_audit(audit: DataFrame, path: str) -> None:
    """One row per audit id, in day folders, also when a batch is written again."""
    rows = audit.withColumn("created_date", local_date(F.col("created_at"), "UTC").cast("string"))
    _append(rows, path, "created_date", "audit_id")


def append_alerts(alerts: DataFrame, path: str) -> None:
    """One row per check and rule, in day folders, also when a batch is written again."""
    rows = alerts.withColumns(
        {
            "fired_date": local_date(F.col("fired_at"), "UTC").cast("string"),
            "alert_key": F.concat_ws(":", "product_id", "check_id", "type"),
        }
    )
    _append(rows, path, "fired_date", "alert_key")


_STAGED = "_staged-"


def expire(spark: SparkSession, path: str, folder: str, at: str, cutoff: datetime) -> list[str]:
    """Delete rows with ``at`` before ``cutoff`` from a table in day folders; returns the days touched.

    Days before the cutoff's are dropped whole, without being read. Of the cutoff's own day the rows
    that stay are written beside it first and then take its place, so that a run that dies is finished
    by the next one. Every other day keeps its files.
    """
    edge = cutoff.date().isoformat()
    for name in folders.names(spark, path):  # what an earlier run left
        if name.startswith(_STAGED):
            _settle(spark, path, folder, name)
    days = folders.values(spark, path, folder)
    old = [d for d in days if d is not None and d < edge]
    for day in old:
        folders.drop(spark, f"{path}/{days[day]}")
    if edge in days:
        rows = spark.read.parquet(f"{path}/{days[edge]}")
        stays = F.col(at) >= F.lit(cutoff.isoformat(" ")).cast("timestamp")
        if not rows.filter(~stays).isEmpty():
            rows.filter(stays).write.parquet(f"{path}/{_STAGED}{edge}")
            _settle(spark, path, folder, _STAGED + edge)
            old.append(edge)
    return sorted(old)


def _settle(spark: SparkSession, path: str, folder: str, staged: str) -> None:
    """Put a whole staged day in its place; drop one that was not finished."""
    if folders.exists(spark, f"{path}/{staged}/{folders.DONE}"):
        place = f"{path}/{folder}={staged[len(_STAGED) :]}"
        folders.drop(spark, place)
        folders.move(spark, f"{path}/{staged}", place)
    else:
        folders.drop(spark, f"{path}/{staged}")
