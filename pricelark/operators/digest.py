"""Rendered alerts, the daily or weekly digest, and one-line alert summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.money import format_inr, near_low
from pricelark.functions.render import escape_html, lookup, plain_number, with_message
from pricelark.model import MARKETPLACE_LABELS, OFFERS, Settings

_OPTIONAL = {
    "old_paise": "bigint",
    "new_paise": "bigint",
    "target_paise": "bigint",
    "change_pct": "double",
    "old_offers": OFFERS,
    "new_offers": OFFERS,
    "added": OFFERS,
    "removed": OFFERS,
    "failure_reason": "string",
    "consecutive_failures": "bigint",
    "health_message": "string",
}


def rendered(alerts: DataFrame, products: DataFrame, settings: Settings) -> DataFrame:
    """Alerts with their ``message``; a missing product shows the application's name."""
    for name, kind in _OPTIONAL.items():
        if name not in alerts.columns:
            alerts = alerts.withColumn(name, F.lit(None).cast(kind))
    names = products.select(
        "product_id", "display_name", "marketplace", F.col("canonical_url").alias("url")
    )
    joined = alerts.join(names, "product_id", "left")
    return with_message(joined, settings).drop("url")


def _count(n: Column, word: str) -> Column:
    return F.concat(
        n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
    )


def digest(
    alerts: DataFrame, products: DataFrame, state: DataFrame, settings: Settings
) -> DataFrame:
    """One row: counts and the digest text. ``alerts`` are the period's unsuppressed ones."""
    kind = F.col("type")
    counts = alerts.agg(
        F.count_if(kind.isin("threshold_drop", "target_price")).alias("drops"),
        F.count_if(kind.isin("offer_added", "offer_removed", "offer_change")).alias("offer_changes"),
        F.count_if(kind == "back_in_stock").alias("back_in_stock"),
    )
    # five rows each are what a digest shows; the lists are joined from five rows
    drops = alerts.filter(kind.isin("threshold_drop", "target_price")).join(
        products.select("product_id", "display_name"), "product_id"
    )
    rank = [F.col("change_pct").asc_nulls_last(), F.col("product_id"), kind]
    pct = F.coalesce("change_pct", F.lit(None).cast("double"))
    signed = F.concat(F.when(pct < 0, "-").otherwise(""), plain_number(pct))
    line = F.concat(
        F.lit("• "),
        escape_html(F.coalesce("display_name", F.lit("?"))),
        F.lit(": "),
        format_inr(F.coalesce("new_paise", F.lit(0))),
        F.lit(" ("),
        F.coalesce(signed, F.lit("—")),
        F.lit("%)"),
    )
    place = F.struct(
        F.coalesce("change_pct", F.lit(float("inf"))).alias("a"), "product_id", "type", line.alias("l")
    )
    top = drops.orderBy(*rank).limit(5).agg(_joined(place))

    price, low = F.col("current_paise"), F.col("low_paise")
    ratio = price.cast("double") / low
    near = state.filter((F.col("status") == "active") & near_low(price, low, settings.near_low_pct))
    low_line = F.concat(
        F.lit("• "),
        escape_html(F.col("display_name")),
        F.lit(" — "),
        format_inr(price),
        F.lit(" on "),
        lookup(F.col("marketplace"), MARKETPLACE_LABELS),
    )
    lows = (
        near.orderBy(ratio.asc(), F.col("product_id"))
        .limit(5)
        .agg(_joined(F.struct(ratio.alias("a"), "product_id", low_line.alias("l"))))
    )
    paused = state.agg(F.count_if(F.col("status") == "paused_auto"))

    row = counts.select(
        "*", top.scalar().alias("_top"), lows.scalar().alias("_low"), paused.scalar().alias("_paused")
    )
    changes = F.col("drops") + F.col("offer_changes") + F.col("back_in_stock")
    parts = [
        F.lit(f"📰 <b>{settings.app_name} {settings.digest_frequency} digest</b>"),
        F.concat(
            _count(F.col("drops"), "price drop"),
            F.lit(", "),
            _count(F.col("offer_changes"), "offer change"),
            F.lit(", "),
            F.col("back_in_stock").cast("string"),
            F.lit(" back in stock."),
        ),
        F.col("_top"),
        F.concat(F.lit("🔥 At or near recorded lows:\n"), F.col("_low")),
        F.when(
            F.col("_paused") > 0,
            F.concat(
                F.lit("⚠️ "),
                _count(F.col("_paused"), "product"),
                F.lit(" auto-paused and needing attention."),
            ),
        ),
        F.when(
            (changes == 0) & F.col("_low").isNull(),
            F.lit("No changes across your catalogue this period."),
        ),
    ]
    return row.select(
        "drops", "offer_changes", "back_in_stock", F.concat_ws("\n\n", *parts).alias("message")
    )


def _joined(entry: Column) -> Column:
    """The lines of at most five rows in their order, null when there is none."""
    rows = F.array_sort(F.collect_list(entry))
    text = F.array_join(F.transform(rows, lambda e: e["l"]), "\n")
    return F.nullif(text, F.lit("")).alias("t")


def alert_summary() -> Column:
    """One line per alert by type."""
    kind = F.col("type")
    price = F.coalesce(format_inr(F.col("new_paise")), F.lit("—"))
    pct = F.col("change_pct")
    signed = F.concat(F.when(pct < 0, "-").otherwise(""), plain_number(pct))
    added, removed = F.size(F.coalesce("added", F.array())), F.size(F.coalesce("removed", F.array()))
    return (
        F.when(kind == "target_price", F.concat(F.lit("hit its target — now "), price))
        .when(kind == "threshold_drop", F.concat(F.lit("dropped "), signed, F.lit("% to "), price))
        .when(kind == "price_change", F.concat(F.lit("changed "), signed, F.lit("% to "), price))
        .when(kind == "offer_change", "offers changed")
        .when(kind == "offer_added", _count(added, "new offer"))
        .when(kind == "offer_removed", F.concat(_count(removed, "offer"), F.lit(" removed")))
        .when(kind == "back_in_stock", "is back in stock")
        .when(kind == "auto_paused", "was auto-paused after repeated failures")
        .when(kind == "system_health", "system health notice")
        .otherwise(kind)
    )
