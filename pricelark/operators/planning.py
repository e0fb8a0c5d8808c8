"""Which products to check next: due batch, daily sweep, next check time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelark.functions.clock import local_date, minutes_of_day, parse_hhmm
from pricelark.model import BATCH_PER_MARKETPLACE, Settings
from pricelark.operators.imports import positions


def interval(settings: Settings) -> Column:
    """The product's own interval, else the global one."""
    return F.coalesce("interval_minutes", F.lit(settings.check_interval_minutes))


def next_check(at: Column, minutes: Column, factor: Column | float = 1.0) -> Column:
    """Interval scaled by a jitter factor in 0.9..1.1 after a check."""
    factor = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return F.timestamp_micros(
        (F.unix_micros(at) + minutes.cast("bigint") * 60_000_000 * factor).cast("bigint")
    )


def jitter(seed: int | None = None) -> Column:
    return F.lit(0.9) + F.lit(0.2) * (F.rand() if seed is None else F.rand(seed))


def due(state: DataFrame, now: Column) -> DataFrame:
    """Active products whose time has come, the longest waiting first."""
    return state.filter((F.col("status") == "active") & (F.col("next_check_at") <= now)).orderBy(
        "next_check_at", "product_id"
    )


def check_plan(state: DataFrame, settings: Settings, now: Column, seed: str) -> DataFrame:
    """A shuffled batch per marketplace; empty while monitoring is paused.

    The rank limit reaches the map side, so each task ships at most a batch per
    marketplace.
    """
    ready = state.filter((F.col("status") == "active") & (F.col("next_check_at") <= now))
    if settings.monitoring_paused:
        ready = ready.filter(F.lit(False))
    shuffled = F.md5(F.concat_ws(":", F.col("product_id").cast("string"), F.lit(seed)))
    order = Window.partitionBy("marketplace").orderBy(shuffled, "product_id")
    return (
        ready.withColumn("slot", F.row_number().over(order))
        .filter(F.col("slot") <= BATCH_PER_MARKETPLACE)
    )


def sweep_due(settings: Settings, last: Column, now: Column) -> Column:
    """At or after the daily time, and not yet today in local time."""
    at = parse_hhmm(settings.daily_check_time)
    if at is None:
        return F.lit(False)
    today = local_date(last, settings.timezone) == local_date(now, settings.timezone)
    return (minutes_of_day(now, settings.timezone) >= at) & ~F.coalesce(today, F.lit(False))


def daily_sweep(state: DataFrame, settings: Settings, last: Column, now: Column) -> DataFrame:
    """Every active product, shortest interval first within its marketplace."""
    ready = state.filter(sweep_due(settings, last, now) & (F.col("status") == "active"))
    if settings.monitoring_paused:
        ready = ready.filter(F.lit(False))
    timed = ready.withColumn("every", interval(settings))
    return positions(timed, ["marketplace"], ["every"], "product_id", name="slot")


def numbered_list(products: DataFrame, page: int, size: int = 10) -> DataFrame:
    """A page of the product list numbered by creation time."""
    rows = products.orderBy("created_at", "product_id").offset(page * size).limit(size)
    # at most one page of rows is left to number
    place = Window.orderBy("created_at", "product_id")
    return rows.withColumn("number", F.row_number().over(place) + page * size)
