"""Per-product state along the check log, as running values over one ordering.

Everything a rule needs about the past of a product is a running last, minimum,
maximum or sum over the rows in (checked_at, ord, check_id) order, so one exchange
on (product, slice) and one sort serve all of them. Control events (resume, pause,
target changes) may be merged into the log as marker rows; they sort before a
check of the same time.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.offers import differences
from pricelark.model import OFFERS
from pricelark.operators.slices import HOT, SLICE, Running, Sliced, running, slice_hot_keys
from pricelark.sources import folders

KEY = ["product_id"]
ORDER = ["checked_at", "ord", "check_id"]


def success() -> Column:
    return F.col("success")


def live() -> Column:
    """A trusted current price: a success, not out of stock, priced."""
    return F.expr("success AND stock_status <> 'out_of_stock' AND price_paise > 0")



def _cut(src: Sliced, df: DataFrame) -> Sliced:
    """Between dependent scans of a sliced log: write once instead of recomputing."""
    if src.hot:
        df, place = folders.stored(df)
        return Sliced(df, src.keys, src.order, src.hot, (place,))
    return Sliced(df, src.keys, src.order, src.hot)


def log_of(checks: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """The ordered log. ``controls(product_id, at, control_id, action, target_paise)``."""
    log = checks.withColumns(
        {"ord": F.lit(1), "action": F.lit(None).cast("string"), "new_target": F.lit(None).cast("bigint")}
    )
    if controls is None:
        return log
    markers = controls.select(
        F.col("control_id").alias("check_id"),
        "product_id",
        F.col("at").alias("checked_at"),
        F.lit(0).alias("ord"),
        "action",
        F.when(F.col("action") != "clear_target", F.col("target_paise")).alias("new_target"),
    )
    return log.unionByName(markers, allowMissingColumns=True)


class CheckLog(NamedTuple):
    """A check log and, when known from a cheaper scan, its rows and time range per product."""

    checks: DataFrame
    sizes: DataFrame | None = None


def as_log(log: CheckLog | DataFrame) -> CheckLog:
    return log if isinstance(log, CheckLog) else CheckLog(log)


def sliced_log(
    log: CheckLog | DataFrame, controls: DataFrame | None = None, limit: int | None = None
) -> Sliced:
    log = as_log(log)
    # commands add rows the sizes do not know about
    sizes = log.sizes if controls is None else None
    return slice_hot_keys(log_of(log.checks, controls), KEY, ORDER, limit, sizes)


def target_specs() -> list[Running]:
    """The last target set, as a struct, since a cleared one is null."""
    setting = F.col("action").isin("set_target", "edit_target", "clear_target")
    return [Running("_t", F.when(setting, F.struct(F.col("new_target").alias("v"))), "last", True)]


def with_target(src: Sliced, initial: DataFrame | None = None) -> Sliced:
    """The target in force on every row: the last one set before it, else the product's."""
    out = running(src, target_specs(), initial)
    target = F.when(F.col("_t").isNotNull(), F.col("_t.v")).otherwise(F.col("target_paise"))
    return Sliced(out.df.withColumn("target_paise", target).drop("_t"), out.keys, out.order, out.hot)


def split_late(src: Sliced, state: DataFrame | None) -> tuple[Sliced, DataFrame]:
    """Rows to fold, and late ones: those without a time or not after the newest row before them,
    of this part or, by ``last_seen``, of the state."""
    place = F.struct(*ORDER)
    seen = running(src, [Running("last_seen", place, "max", False)], state)
    late = F.col("checked_at").isNull() | F.coalesce(place <= F.col("last_seen"), F.lit(False))
    fresh = seen.df.filter(~late).drop("last_seen")
    return Sliced(fresh, src.keys, src.order, src.hot), seen.df.filter(late)


def eligible() -> Column:
    return (
        success()
        & F.col("price_paise").isNotNull()
        & F.col("target_paise").isNotNull()
        & (F.col("stock_status") != "out_of_stock")
    )


def past_specs() -> list[Running]:
    """Previous price, stock, latch and whether there was any earlier success."""
    latch = (
        F.when(F.coalesce(F.col("action").isin("set_target", "clear_target"), F.lit(False)), False)
        .when(eligible(), F.col("price_paise") <= F.col("target_paise"))
        .when(success() & F.col("target_paise").isNull(), F.lit(False))
    )
    return [
        Running("prev_price", F.when(live(), F.col("price_paise"))),
        Running("prev_stock", F.when(success(), F.col("stock_status"))),
        Running("latched", latch),
        Running("had_success", F.when(success(), F.lit(True))),
    ]


def low_high_specs() -> list[Running]:
    price = F.when(live(), F.col("price_paise"))
    return [
        Running("low_paise", price, "min", True),
        Running("high_paise", price, "max", True),
    ]


def seen_offers(checks: DataFrame) -> DataFrame:
    """Offers only where a successful check saw some, so the scan carries no second copy."""
    some = success() & (F.size("offers") > 0)
    return checks.withColumn("offers", F.when(some, F.col("offers")))


def offer_specs() -> list[Running]:
    """Over ``seen_offers``: the last offers of a buyable listing, and the first ones at all."""
    buyable = F.when(F.col("stock_status") != "out_of_stock", F.col("offers"))
    return [Running("_usable", buyable, "last"), Running("_earliest", F.col("offers"), "first")]


def with_offers(src: Sliced) -> DataFrame:
    return with_offers_of(src.df)


def with_offers_of(df: DataFrame) -> DataFrame:
    """Effective offers before and at each check, and the reliable difference.

    A check without offers, or of an unbuyable listing, keeps the last known ones.
    """
    none = F.array().cast(OFFERS)
    out = df.withColumns(
        {
            "offers": F.coalesce("offers", none),
            "prev_offers": F.coalesce("_usable", "_earliest", none),
        }
    )
    unreliable = ((F.size("offers") == 0) | (F.col("stock_status") == "out_of_stock")) & (
        F.size("prev_offers") > 0
    )
    out = out.withColumn("_fresh", F.coalesce(success() & ~unreliable, F.lit(False)))
    compared = F.col("_fresh") & F.col("had_success")
    now, was = F.col("offers"), F.col("prev_offers")
    out = out.withColumn("_diff", F.when(compared, differences(now, was)))
    return out.withColumns(
        {
            "eff_offers": F.when(F.col("_fresh"), now).otherwise(was),
            "added": F.col("_diff.added"),
            "removed": F.col("_diff.removed"),
        }
    ).drop("_usable", "_earliest", "_fresh", "_diff")


def _resumes() -> Column:
    return F.coalesce(F.col("action") == "resume", F.lit(False))


def _failed() -> Column:
    return F.when(F.col("action").isNull() & ~success(), F.lit(1).cast("long"))


def failure_specs() -> list[Running]:
    """Failures so far, resumes so far, and the last pause or resume; markers included."""
    return [
        Running("_fails", _failed(), "sum", True),
        Running("_epoch", F.when(_resumes(), F.lit(1).cast("long")), "sum", True),
        Running(
            "_held_by",
            F.when(F.col("action").isin("pause", "resume"), F.col("action")),
            "last",
            True,
        ),
    ]


def run_specs() -> list[Running]:
    """Over ``failure_specs``: the failure counter at the last row that ended a run."""
    ends_run = _resumes() | F.coalesce(success(), F.lit(False))
    # the counter never falls, so a maximum finds the last one
    return [Running("_base", F.when(ends_run, F.col("_fails")), "max", True)]


def pause_specs() -> list[Running]:
    """The resume epoch of the last automatic pause."""
    return [Running("_paused_epoch", F.when(F.col("_hit"), F.col("_epoch")), "max", False)]


def with_failures(
    src: Sliced, limit: int, initial: DataFrame | None = None, further: Sequence[Running] = ()
) -> Sliced:
    """Length of the failure run at each row, and the row where monitoring pauses itself.

    Needs the columns of ``failure_specs``. A success or a resume ends the run. The
    pause fires once per resume epoch, and not while the user has paused the product.
    ``further`` values are added by the last scan, behind what is stored between the scans.
    """
    zero = F.lit(0).cast("long")
    df = src.df.withColumns(
        {"_fails": F.coalesce("_fails", zero), "_epoch": F.coalesce("_epoch", zero)}
    )
    src = stored = running(_cut(src, df), run_specs(), initial)
    run_len = F.col("_fails") - F.coalesce(F.col("_base"), zero)
    hit = (
        _failed().isNotNull()
        & (run_len == limit)
        & (F.coalesce(F.col("_held_by"), F.lit("resume")) == "resume")
    )
    df = src.df.withColumns({"run_len": run_len, "_hit": hit})
    src = running(_cut(src, df), [*pause_specs(), *further], initial)
    stored.drop_files()
    fires = F.col("_hit") & (F.coalesce(F.col("_paused_epoch"), F.lit(-1)) < F.col("_epoch"))
    return Sliced(src.df.withColumn("auto_paused", fires), src.keys, src.order, src.hot)


def only_checks(df: DataFrame) -> DataFrame:
    """Drop marker rows and helper columns."""
    helpers = ["_fails", "_epoch", "_held_by", "_base", "_hit", "_paused_epoch"]
    return df.filter(F.col("ord") == 1).drop("ord", "action", "new_target", SLICE, HOT, *helpers)


def spans(src: Sliced, flag: Column, at: str) -> DataFrame:
    """Contiguous runs of rows where ``flag`` holds -> (key, started, ended, rows)."""
    breaks = running(src, [Running("_island", F.when(~flag, F.lit(1).cast("long")), "sum", True)])
    return (
        breaks.df.filter(flag)
        .groupBy(*src.keys, F.coalesce("_island", F.lit(0).cast("long")).alias("_island"))
        .agg(
            F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("rows")
        )
        .drop("_island")
    )


def latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Newest row per key as a maximum, so it combines before the shuffle."""
    pick = F.max(F.struct(*order, F.struct(*cols).alias("_row")))
    return df.groupBy(*keys).agg(pick.alias("_m")).select(*keys, "_m._row.*")

