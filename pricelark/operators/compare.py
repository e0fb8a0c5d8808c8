"""Linked pairs: current comparison, merged series and time-weighted comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.money import cheaper_side, half_up, near_low, range_position
from pricelark.operators.slices import Running, running, slice_hot_keys


def pairs(products: DataFrame) -> DataFrame:
    """(a, b) once per linked pair; the pair's id is its smaller product."""
    a = products.select(F.col("product_id").alias("a_id"), F.col("linked_product_id").alias("b_id"))
    b = products.select(F.col("product_id").alias("b_id"))
    return a.filter(F.col("a_id") < F.col("b_id")).join(b, "b_id").select("a_id", "b_id")


def pair_compare(products: DataFrame, state: DataFrame) -> DataFrame:
    """Both sides' current price and the cheaper side."""
    side = state.select("product_id", "current_paise")
    return (
        pairs(products)
        .join(side.toDF("a_id", "a_paise"), "a_id", "left")
        .join(side.toDF("b_id", "b_paise"), "b_id", "left")
        .withColumn("cheaper", cheaper_side(F.col("a_paise"), F.col("b_paise")))
    )


def pair_series(products: DataFrame, points: DataFrame) -> DataFrame:
    """Both price series on one time axis; a side without a point at a time is null.

    One aggregate over (pair, time) instead of a full outer join: it combines
    before the shuffle and needs no skewed join.
    """
    pair_of = F.least("product_id", "linked_product_id")
    ids = pairs(products).select(F.col("a_id").alias("pair_id"), "b_id")
    tagged = points.withColumn("pair_id", pair_of).join(
        ids.drop("b_id"), "pair_id", "left_semi"
    )
    first = F.col("product_id") == F.col("pair_id")

    def newest(side: Column) -> Column:
        """The side's last price of the time: of equal times, that of the greatest check id."""
        last = F.struct("check_id", "price_paise") if "check_id" in points.columns else F.struct("price_paise")
        return F.max(F.when(side & F.col("price_paise").isNotNull(), last))["price_paise"]

    return tagged.groupBy("pair_id", F.col("checked_at").alias("t")).agg(
        newest(first).alias("a_paise"),
        newest(~first).alias("b_paise"),
    )


def near_lows(state: DataFrame, margin_pct: float) -> DataFrame:
    """Priced products at or near their recorded low, closest first."""
    price, low = F.col("current_paise"), F.col("low_paise")
    return (
        state.filter(near_low(price, low, margin_pct))
        .withColumn("above_low_paise", price - low)
        .orderBy((price.cast("double") / low).asc(), F.col("product_id").asc())
    )


def range_meter(state: DataFrame) -> DataFrame:
    pos = range_position(F.col("low_paise"), F.col("high_paise"), F.col("current_paise"))
    return state.filter(F.col("current_paise").isNotNull()).select(
        "product_id", pos.alias("position"), (pos <= 15).alias("near_low")
    )


def backfill_low_high(products: DataFrame, checks: DataFrame) -> DataFrame:
    """Set each product's low and high from its history; without history they stay as they are."""
    live = (
        F.col("success") & F.col("price_paise").isNotNull() & (F.col("stock_status") != "out_of_stock")
    )
    agg = checks.filter(live).groupBy("product_id").agg(
        F.min("price_paise").alias("_low"), F.max("price_paise").alias("_high")
    )
    return products.join(agg, "product_id", "left").withColumns(
        {
            "low_paise": F.coalesce("_low", "low_paise"),
            "high_paise": F.coalesce("_high", "high_paise"),
        }
    ).drop("_low", "_high")


def daily_ohlc(checks: DataFrame) -> DataFrame:
    """Minimum, maximum and closing price per product and day."""
    priced = checks.filter(F.col("success") & F.col("price_paise").isNotNull())
    return priced.groupBy(
        "product_id", F.date_trunc("DAY", F.col("checked_at")).alias("day")
    ).agg(
        F.min("price_paise").alias("low_paise"),
        F.max("price_paise").alias("high_paise"),
        F.max(F.struct("checked_at", "check_id", "price_paise"))["price_paise"].alias("close_paise"),
    )


def time_weighted_average(checks: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Average price weighted by how long each price stood, up to ``now``."""
    priced = checks.filter(
        F.col("success") & F.col("price_paise").isNotNull() & (F.col("checked_at") <= now)
    )
    src = slice_hot_keys(priced, ["product_id"], ["checked_at", "check_id"], limit)
    here = F.struct("checked_at", "price_paise")
    src = running(src, [Running("_prev", here, "last", False)])
    seconds = F.unix_seconds("checked_at") - F.unix_seconds("_prev.checked_at")
    # each row closes the span of the row before it; the newest row's span ends now
    spans = src.df.groupBy("product_id").agg(
        F.sum(seconds * F.col("_prev.price_paise")).alias("_area"),
        F.sum(seconds).alias("_secs"),
        F.max(F.struct("checked_at", "check_id", "price_paise")).alias("_last"),
    )
    tail = F.unix_seconds(now) - F.unix_seconds("_last.checked_at")
    area = F.coalesce("_area", F.lit(0)) + tail * F.col("_last.price_paise")
    secs = F.coalesce("_secs", F.lit(0)) + tail
    return spans.select(
        "product_id",
        secs.alias("seconds"),
        F.when(secs > 0, half_up(area.cast("double") / secs))
        .otherwise(F.col("_last.price_paise"))
        .cast("bigint")
        .alias("average_paise"),
    )


def cheaper_share(products: DataFrame, points: DataFrame, limit: int | None = None) -> DataFrame:
    """Per pair: share of the overlapping time each side was cheaper, and the mean gap.

    Both series are aligned as-of: at every time either side changes, each side
    holds its last known price.
    """
    merged = pair_series(products, points.filter(F.col("price_paise").isNotNull()))
    src = slice_hot_keys(merged, ["pair_id"], ["t"], limit)
    src = running(
        src,
        [
            Running("a", F.col("a_paise"), "last", False),
            Running("b", F.col("b_paise"), "last", False),
            Running("t0", F.col("t"), "last", False),
        ],
    )
    # the span before a row carries the prices known at its start
    secs = F.unix_seconds("t") - F.unix_seconds("t0")
    both = src.df.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    sums = both.groupBy("pair_id").agg(
        F.sum(secs).alias("seconds"),
        F.sum(F.when(F.col("a") < F.col("b"), secs).otherwise(0)).alias("a_cheaper"),
        F.sum(F.when(F.col("b") < F.col("a"), secs).otherwise(0)).alias("b_cheaper"),
        F.sum(secs * F.abs(F.col("a") - F.col("b"))).alias("gap_area"),
    )

    def share(c: str) -> Column:
        return F.when(
            F.col("seconds") > 0,
            half_up(F.col(c).cast("double") / F.col("seconds") * 10000.0) / 100.0,
        )

    return sums.select(
        "pair_id",
        "seconds",
        share("a_cheaper").alias("a_cheaper_pct"),
        share("b_cheaper").alias("b_cheaper_pct"),
        F.when(F.col("seconds") > 0, half_up(F.col("gap_area").cast("double") / F.col("seconds")))
        .cast("bigint")
        .alias("mean_gap_paise"),
    )


def parse_collapse(checks: DataFrame, hours: int = 1, share: float = 0.5) -> DataFrame:
    """Windows in which a marketplace's success share fell below a limit."""
    return (
        checks.groupBy("marketplace", F.window("checked_at", f"{hours} hours").alias("w"))
        .agg(F.count("*").alias("total"), F.count_if("success").alias("ok"))
        .filter(F.col("ok") < F.col("total") * F.lit(share))
        .select("marketplace", F.col("w.start").alias("window_start"), "total", "ok")
    )


