"""Money text, discounts and price-range expressions (integer paise inside)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelark.functions.offers import SPACE


def half_up(x: Column) -> Column:
    """Nearest whole number, halves toward +infinity."""
    return F.floor(x + F.lit(0.5))


def change_pct(old: Column, new: Column) -> Column:
    """Signed change in percent to two decimals; 0 when the old price is not positive."""
    return F.when(old <= 0, F.lit(0.0)).otherwise(
        half_up((new - old).cast("double") / old * F.lit(10000.0)) / F.lit(100.0)
    )


def discount_pct(price: Column, mrp: Column) -> Column:
    """Percent off the list price; 0 when either is unknown or there is no saving."""
    off = half_up((mrp - price).cast("double") / mrp * F.lit(10000.0)) / F.lit(100.0)
    return F.when(
        price.isNull() | mrp.isNull() | (mrp <= 0) | (price >= mrp), F.lit(0.0)
    ).otherwise(off)


def amount_text(text: Column) -> Column:
    """The first amount written in a text, as digits; null when there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)(rs\.?|inr|₹)", ""), ",|" + SPACE, "")
    return F.nullif(F.regexp_extract(bare, r"[0-9]+(?:\.[0-9]{1,2})?", 0), F.lit(""))


def amount_paise(text: Column) -> Column:
    """The first amount written in a text, in paise; null unless positive."""
    # digits beyond the decimal's range are no price; the cast makes them null
    paise = (amount_text(text).try_cast("decimal(30,2)") * 100).try_cast("bigint")
    return F.when(paise > 0, paise)


def _grouped(digits: Column) -> Column:
    """Indian digit grouping: the last three digits, then pairs."""
    size = F.length(digits)
    lead = F.substring(digits, F.lit(1), F.greatest(size - 3, F.lit(0)))
    tail = F.substring(digits, F.greatest(size - 2, F.lit(1)), F.lit(3))
    return F.when(size <= 3, digits).otherwise(
        F.concat(F.regexp_replace(lead, r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","), tail)
    )


def format_inr(paise: Column) -> Column:
    """Rupee text with Indian grouping; paise shown only when present."""
    size = F.abs(paise)
    rupees = F.floor(size / 100).cast("bigint")
    rest = (size % 100).cast("bigint")
    cents = F.when(rest == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0"))
    )
    sign = F.when(paise < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("₹"), _grouped(rupees.cast("string")), cents)


def near_low(price: Column, low: Column, margin_pct: float) -> Column:
    """Whether a price is within a margin of the recorded low."""
    return F.coalesce(price * F.lit(10000) <= low * F.lit(10000 + round(margin_pct * 100)), F.lit(False))


def range_position(low: Column, high: Column, current: Column) -> Column:
    """Where the price sits between low and high, 0..100; the span is at least one rupee."""
    span = F.greatest(F.lit(100), high - low)
    return F.least(
        F.lit(100.0), F.greatest(F.lit(0.0), (current - low).cast("double") / span * 100)
    )


def cheaper_side(a: Column, b: Column) -> Column:
    """'a' or 'b', null on a tie or a missing price."""
    return F.when(a < b, "a").when(b < a, "b")
