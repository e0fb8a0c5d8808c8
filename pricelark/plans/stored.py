"""Registered queries: tables that are written in parts, expired and read back."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.model import AUDIT_RETENTION_DAYS
from pricelark.operators import alerts as A
from pricelark.operators import catalogue as C
from pricelark.operators import dashboard as D
from pricelark.operators import digest as G
from pricelark.operators import stored_state
from pricelark.plans.alerting import ALL_ALERTS_SQL, HISTORY_SQL, PRODUCT_STATE_SQL, SETTINGS, offer_texts
from pricelark.plans.catalogue import CYCLE_SQL, IMPACT_SQL, PAGE_COLUMNS, due_by_day, page_sql, with_state
from pricelark.plans.delivery import DIGEST_SQL
from pricelark.plans.delivery import SETTINGS as DIGEST_SETTINGS
from pricelark.plans.registry import AUDIT_SQL, PRODUCTS_SQL, query, sql
from pricelark.plans.text import IMPORT_SQL, RETENTION_SQL, import_file_rows
from pricelark.sources import import_file, sinks
from pricelark.sources import tables as M
from pricelark.sources.state_table import StateTable
from pricelark.streaming.monitor import new_folder

PARTS = ["1000-01-01", "1995-01-01", "1998-01-01", "9999-01-01"]


_KEPT: dict[tuple[str, str], stored_state.Monitor] = {}


def monitor(spark: SparkSession, sf_dir: str) -> stored_state.Monitor:
    """The check log taken in in three parts, the second of which is delivered twice. It is taken in
    by the first query of a session that asks for it; the others read what is stored."""
    of = (spark.sparkContext.applicationId, sf_dir)
    if of not in _KEPT:
        _KEPT[of] = _taken_in(spark, sf_dir)
    return _KEPT[of]


def _taken_in(spark: SparkSession, sf_dir: str) -> stored_state.Monitor:
    kept = stored_state.Monitor(spark, new_folder(spark, "monitor"), SETTINGS, buckets=8)
    checks = M.checks(spark, sf_dir)
    spans = list(zip(PARTS, PARTS[1:], strict=False))
    for part in (0, 1, 1, 2):
        low, high = spans[part]
        rows = checks.filter((F.col("checked_at") >= low) & (F.col("checked_at") < high))
        kept.ingest(part, rows)
    return kept


@query("product_state_stored", PRODUCT_STATE_SQL)
def product_state_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = monitor(spark, sf_dir).state()
    return state.withColumn("current_offers", offer_texts("current_offers"))


@query("catalogue_deep_page", page_sql("TRUE", "current_paise ASC NULLS LAST", 25, 6))
def catalogue_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late page of the catalogue over stored state, by counts per range of the list."""
    state = monitor(spark, sf_dir).state()
    q = C.CatalogueQuery(sort="price_asc", page=6)
    return C.catalogue_seek(with_state(M.products(spark, sf_dir), state), q).select(*PAGE_COLUMNS)


@query("digest_stored", DIGEST_SQL)
def digest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of one day from stored state and the alerts in that day's folders."""
    kept, products = monitor(spark, sf_dir), M.products(spark, sf_dir)
    state = kept.state().join(products.select("product_id", "display_name", "marketplace"), "product_id")
    day = (F.col("fired_at") >= M.as_of("2001-08-31 00:00:00")) & (F.col("fired_at") <= M.as_of())
    return G.digest(kept.alerts("2001-08-31", "2001-09-01").filter(day), products, state, DIGEST_SETTINGS)


@query("deletion_impact_stored", IMPACT_SQL)
def deletion_impact_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = monitor(spark, sf_dir).totals()
    known = M.products(spark, sf_dir).select("product_id").join(totals, "product_id", "left")
    return known.na.fill(0, ["history_count", "alert_count"])


@query("alerts_stored", sql(ALL_ALERTS_SQL, "SELECT * FROM all_alerts"))
def alerts_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor(spark, sf_dir).alerts().select(
        "product_id", "check_id", "fired_at", "type", "old_paise", "new_paise", "change_pct"
    )


@query("system_status_stored", CYCLE_SQL)
def system_status_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single row after three updates, the last of them repeated."""
    table = StateTable(spark, new_folder(spark, "status"), ("id",), buckets=1)
    cycle = F.date_trunc("DAY", F.col("checked_at"))
    due = due_by_day(spark, sf_dir)
    for part, day in enumerate(["1996-01-01", "1999-06-01", "2001-09-01", "2001-09-01"]):
        status = D.system_status(M.checks(spark, sf_dir), cycle, M.as_of(day), due)
        table.upsert(min(part, 2), status.withColumn("id", F.lit(1)))
    return table.read().drop("id")


@query("history_appended", HISTORY_SQL)
def history_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History written twice over, first a part of it, and read back from its month folders."""
    path = new_folder(spark, "history")
    rows = A.history_rows(M.check_log(spark, sf_dir), SETTINGS).drop("checked_month")
    with sinks.stored_rows(rows) as rows:
        sinks.append_history(rows.filter(F.col("checked_at") < "1996-01-01"), path)
        sinks.append_history(rows, path)
        sinks.append_history(rows, path)
    back = spark.read.parquet(path).drop("offers", "mrp_paise")
    return back.withColumn("checked_month", F.col("checked_month").cast("string"))


@query("audit_appended", sql(AUDIT_SQL, "SELECT audit_id, product_id, created_at, success, tier FROM audit"))
def audit_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "audit")
    rows = M.audit_log(spark, sf_dir)
    sinks.append_audit(rows.filter(F.col("audit_id") % 3 == 0), path)
    sinks.append_audit(rows, path)
    return spark.read.parquet(path).select("audit_id", "product_id", "created_at", "success", "tier")


@query("audit_expired", RETENTION_SQL)
def audit_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table after old days were dropped from disk."""
    path = new_folder(spark, "expiring")
    sinks.append_audit(M.audit_log(spark, sf_dir), path)
    now = datetime.fromisoformat(M.EVENTS_AS_OF)
    sinks.expire(spark, path, "created_date", "created_at", now - timedelta(days=AUDIT_RETENTION_DAYS))
    return spark.read.parquet(path).select("audit_id", "product_id", "created_at")


_MULTILINE = "'note ' || row_number || chr(10) || 'says \"' || row_number % 7 || '\", and more'"


@query(
    "import_large_file",
    sql(
        PRODUCTS_SQL + "," + IMPORT_SQL,
        f"""SELECT CAST(row_number() OVER (ORDER BY row_number) + 1 AS BIGINT) AS row_number, row_number AS own_row,
          CASE row_number % 3 WHEN 0 THEN {_MULTILINE} WHEN 1 THEN 'plain' END AS notes,
          nullif(trim(url), '') AS url FROM file""",
    ),
)
def import_large_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as import files whose cells hold quotes, commas and line ends, read in splits."""
    path = new_folder(spark, "import")
    n = F.col("row_number")
    said = F.concat(F.lit("note "), n, F.lit('\nsays "'), n % 7, F.lit('", and more'))
    rows = import_file_rows(spark, sf_dir).select(
        F.col("url"), F.when(n % 3 == 0, said).when(n % 3 == 1, "plain").alias("notes"), n.alias("own_row")
    )
    sinks.write_csv(rows, path, ["own_row"])
    back = import_file.read_large_csv(spark, path)
    return back.select(
        F.col("_row").cast("long").alias("row_number"), F.col("own_row").cast("long").alias("own_row"), "notes", "url"
    )
