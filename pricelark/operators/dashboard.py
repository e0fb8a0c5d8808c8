"""Fleet status, success rate, category counts, deletion impact, cycle reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.clock import stale
from pricelark.functions.money import half_up
from pricelark.model import HEARTBEAT_STALE_SECONDS

DROP_TYPES = ["threshold_drop", "target_price"]


def fleet_status(state: DataFrame) -> DataFrame:
    """One pass over the products; attention = auto-paused plus active failing."""
    status = F.col("status")
    failing = (F.col("consecutive_failures") > 0) & (status == "active")
    counts = state.agg(
        F.count("*").alias("total"),
        F.count_if(status == "active").alias("active"),
        F.count_if(status == "paused_user").alias("paused_user"),
        F.count_if(status == "paused_auto").alias("paused_auto"),
        F.count_if(failing).alias("failing"),
    )
    return counts.withColumn("attention", F.col("paused_auto") + F.col("failing"))


def banner(worker_stale: Column, attention: Column) -> Column:
    """State of the dashboard banner."""
    return (
        F.when(worker_stale, "stopped").when(attention > 0, "attention").otherwise("healthy")
    )


def heartbeat(last_seen: Column, now: Column) -> Column:
    return F.when(stale(last_seen, now, HEARTBEAT_STALE_SECONDS), "degraded").otherwise("ok")


def recent_alerts(alerts: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    since = now - F.make_dt_interval(hours=F.lit(hours))
    return alerts.filter((F.col("fired_at") >= since) & (F.col("fired_at") <= now)).agg(
        F.count("*").alias("alerts_24h"),
        F.count_if(F.col("type").isin(DROP_TYPES)).alias("drops_24h"),
    )


def pct2(part: Column, whole: Column) -> Column:
    """Percent to two decimals, null for an empty whole."""
    return F.when(
        whole > 0, half_up(part.cast("double") / whole * F.lit(10000.0)) / F.lit(100.0)
    )


def success_rate(checks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    since = now - F.make_dt_interval(days=F.lit(days))
    ok, total = F.count_if("success"), F.count("*")
    return (
        checks.filter((F.col("checked_at") >= since) & (F.col("checked_at") <= now))
        .agg(total.alias("total"), ok.alias("ok"))
        .withColumn("success_rate", pct2(F.col("ok"), F.col("total")))
    )


def category_counts(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category with its product count, by name."""
    counts = products.groupBy("category").agg(F.count("*").alias("products"))
    return (
        categories.join(counts, "category", "left")
        .select("category", F.coalesce("products", F.lit(0)).alias("products"))
        .orderBy("category")
    )


def deletion_impact(products: DataFrame, checks: DataFrame, alerts: DataFrame) -> DataFrame:
    """What deleting each product would remove."""
    history = checks.groupBy("product_id").agg(F.count("*").alias("history_count"))
    fired = alerts.groupBy("product_id").agg(F.count("*").alias("alert_count"))
    return (
        products.select("product_id")
        .join(history, "product_id", "left")
        .join(fired, "product_id", "left")
        .na.fill(0, ["history_count", "alert_count"])
    )


def cycle_report(checks: DataFrame, cycle: Column, due: DataFrame | None = None) -> DataFrame:
    """Checked, succeeded and failed per cycle; with ``due(cycle, due)``, how many were due."""
    report = _cycles(checks, cycle)
    if due is None:
        return report
    counted = due.groupBy(F.col("cycle").alias("_cycle")).agg(F.sum("due").cast("bigint").alias("due"))
    return (
        report.join(counted, F.col("cycle") == F.col("_cycle"), "left").drop("_cycle").na.fill(0, ["due"])
    )


def _cycles(checks: DataFrame, cycle: Column) -> DataFrame:
    return checks.groupBy(cycle.alias("cycle")).agg(
        F.count("*").alias("checked"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.min("checked_at").alias("started_at"),
        F.max("checked_at").alias("ended_at"),
    )


def system_status(checks: DataFrame, cycle: Column, now: Column, due: DataFrame | None = None) -> DataFrame:
    """One row: the last cycle's bookkeeping and the 7-day success rate."""
    done = cycle_report(checks.filter(F.col("checked_at") <= now), cycle, due)
    if due is None:
        done = done.withColumn("due", F.lit(None).cast("bigint"))
    newest = F.max(F.struct("cycle", "started_at", "ended_at", "due", "checked", "succeeded", "failed"))
    rate = success_rate(checks, now).select("success_rate").scalar()
    return done.agg(newest.alias("m")).select(
        F.col("m.started_at").alias("last_cycle_started_at"),
        F.col("m.ended_at").alias("last_cycle_ended_at"),
        F.col("m.due").alias("last_cycle_due"),
        F.col("m.checked").alias("last_cycle_checked"),
        F.col("m.succeeded").alias("last_cycle_succeeded"),
        F.col("m.failed").alias("last_cycle_failed"),
        rate.alias("success_rate_7d"),
    )
