"""Proxy bandwidth from the audit log: per product, fleet totals and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.money import half_up

KIND_COLUMNS = ["http_page", "browser_page", "pincode_api", "cookie_mint", "side_sheet"]


def window_days(days: float | None) -> int:
    """Whole days, 14 when unset; outside 1..60 is an error."""
    rounded = int((days or 0) + 0.5) or 14
    if not 1 <= rounded <= 60:
        raise ValueError(f"a window of {rounded} days is not within 1..60")
    return rounded


BLOB = "proxy struct<byKind: map<string, struct<wireBytes: bigint>>>"


def with_kind_bytes(audit: DataFrame, kinds: list[str]) -> DataFrame:
    """Wire bytes per request kind from the diagnostics blob, parsed once; absent is 0."""
    parsed = audit.withColumn("_blob", F.from_json("debug", BLOB))
    by_kind = F.col("_blob.proxy.byKind")
    zero = F.lit(0).cast("bigint")
    return parsed.withColumns(
        {k: F.coalesce(F.try_element_at(by_kind, F.lit(k))["wireBytes"], zero) for k in kinds}
    ).drop("_blob")


def _measures() -> list[Column]:
    browser = F.col("tier") == "browser"
    return [
        F.count("*").alias("scrapes"),
        F.count_if("success").alias("ok"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum(F.coalesce("proxy_retries", F.lit(0))).alias("retries"),
        F.count_if(browser).alias("tier2"),
        F.sum(F.coalesce("bytes_wire", F.lit(0))).alias("wire_bytes"),
        F.sum(F.when(~browser, F.col("main_page")).otherwise(0)).alias("http_page"),
        F.sum(F.when(browser, F.col("main_page")).otherwise(0)).alias("browser_page"),
        F.sum("pincode_api").alias("pincode_api"),
        F.sum("cookie_mint").alias("cookie_mint"),
        F.sum("side_sheet").alias("side_sheet"),
    ]


def in_window(audit: DataFrame, now: Column, days: float | None) -> DataFrame:
    since = now - F.make_dt_interval(days=F.lit(window_days(days)))
    recent = audit.filter((F.col("created_at") >= since) & (F.col("created_at") <= now))
    return with_kind_bytes(recent, ["main_page", "pincode_api", "cookie_mint", "side_sheet"])


def usage(audit: DataFrame, products: DataFrame, now: Column, days: float | None) -> DataFrame:
    """Usage per product; a product no longer in the catalogue shows its id."""
    totals = in_window(audit, now, days).groupBy("product_id").agg(*_measures())
    names = products.select("product_id", "display_name", "marketplace")
    return totals.join(names, "product_id", "left").withColumns(
        {
            "display_name": F.coalesce("display_name", F.col("product_id").cast("string")),
            "marketplace": F.coalesce("marketplace", F.lit("")),
        }
    )


def usage_rollup(audit: DataFrame, now: Column, days: float | None) -> DataFrame:
    """Usage per product and, as the row without a product, the fleet total."""
    return (
        in_window(audit, now, days)
        .rollup("product_id")
        .agg(F.grouping("product_id").cast("int").alias("is_total"), *_measures())
    )


def whole_pct(part: Column, whole: Column) -> Column:
    """Whole percent, 0 for an empty whole."""
    share = half_up(part.cast("double") / whole * 100).cast("bigint")
    return F.when(whole > 0, share).otherwise(F.lit(0).cast("bigint"))


def ratios(usage: DataFrame, days: float | None) -> DataFrame:
    """Bytes per day, browser and success shares, bytes per check, share per kind."""
    wire, scrapes = F.col("wire_bytes"), F.col("scrapes")
    shares = {f"{k}_pct": whole_pct(F.col(k), wire) for k in KIND_COLUMNS}
    return usage.withColumns(
        {
            "bytes_per_day": wire.cast("double") / window_days(days),
            "tier2_pct": whole_pct(F.col("tier2"), scrapes),
            "ok_pct": whole_pct(F.col("ok"), scrapes),
            "kb_per_check": F.when(scrapes > 0, wire.cast("double") / scrapes / 1024).otherwise(0.0),
            **shares,
        }
    )


def byte_tally(requests: DataFrame) -> DataFrame:
    """(check_id, kind, wire_bytes, retry) -> per check totals and a map by kind.

    Kinds are few and fixed, so the map is built from conditional sums: nothing is
    collected per check.
    """
    from pricelark.model import REQUEST_KINDS

    sums = []
    for kind in REQUEST_KINDS:
        mine = F.col("kind") == kind
        sums += [
            F.sum(F.when(mine, F.col("wire_bytes"))).alias(f"b_{kind}"),
            F.count_if(mine).alias(f"n_{kind}"),
        ]
    totals = requests.groupBy("check_id").agg(
        F.sum("wire_bytes").alias("wire_bytes"),
        F.count("*").alias("requests"),
        F.count_if("retry").alias("retries"),
        *sums,
    )
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"n_{k}") > 0,
                    F.struct(
                        F.lit(k).alias("key"),
                        F.struct(
                            F.col(f"b_{k}").alias("wire_bytes"), F.col(f"n_{k}").alias("requests")
                        ).alias("value"),
                    ),
                )
                for k in REQUEST_KINDS
            ]
        )
    )
    return totals.select(
        "check_id", "wire_bytes", "requests", "retries", F.map_from_entries(entries).alias("by_kind")
    )


def bytes_label(n: Column) -> Column:
    """Byte count as GB / MB / KB / B text."""

    def scaled(unit: int, places: int, name: str) -> Column:
        # whole units of the last shown digit, halves up
        step = unit // 10**places
        shown = F.floor((n + step // 2) / step)
        text = F.floor(shown / 10**places).cast("string")
        if places:
            rest = F.lpad((shown % 10**places).cast("string"), places, "0")
            text = F.concat(text, F.lit("."), rest)
        return F.concat(text, F.lit(" " + name))

    return (
        F.when(n >= 1_000_000_000, scaled(1_000_000_000, 2, "GB"))
        .when(n >= 1_000_000, scaled(1_000_000, 1, "MB"))
        .when(n >= 1_000, scaled(1_000, 0, "KB"))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def fixed(x: Column, places: int) -> Column:
    """Fixed-point text of a non-negative number, halves up, locale-free."""
    return F.round(x.cast("decimal(38,10)"), places).cast(f"decimal(30,{places})").cast("string")


def interval_label(minutes: Column) -> Column:
    """'2h', '1h 30m', '45m', or 'default' when unset."""
    text = minutes.cast("string")
    hours = F.floor(minutes / 60).cast("string")
    return (
        F.when(minutes.isNull(), "default")
        .when(minutes % 60 == 0, F.concat(hours, F.lit("h")))
        .when(
            minutes > 60,
            F.concat(hours, F.lit("h "), (minutes % 60).cast("string"), F.lit("m")),
        )
        .otherwise(F.concat(text, F.lit("m")))
    )
