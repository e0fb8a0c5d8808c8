"""Alert rules over the check log: one pass, one row per fired alert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.money import change_pct
from pricelark.functions.offers import offers_hash
from pricelark.model import OFFERS, Settings
from pricelark.operators.sequence import (
    KEY,
    ORDER,
    CheckLog,
    as_log,
    eligible,
    failure_specs,
    live,
    low_high_specs,
    only_checks,
    offer_specs,
    past_specs,
    pause_specs,
    run_specs,
    seen_offers,
    sliced_log,
    split_late,
    success,
    target_specs,
    with_failures,
    with_offers,
    with_target,
)
from pricelark.operators.slices import Running, Sliced, closing, running, slice_hot_keys


def annotated(
    checks: CheckLog | DataFrame,
    settings: Settings,
    controls: DataFrame | None = None,
    limit: int | None = None,
    failures: bool = True,
    offers: bool = True,
) -> DataFrame:
    """The log with everything the rules need on each row; unused columns prune away."""
    log = as_log(checks)
    if offers:
        log = log._replace(checks=seen_offers(log.checks))
    src = sliced_log(log, controls, limit)
    if controls is not None:
        src = with_target(src)
    specs = past_specs() + low_high_specs()
    specs += offer_specs() if offers else []
    if failures and src.hot:  # the failures first, so that no other values are stored between their scans
        scanned = running(src, failure_specs())
        src = with_failures(scanned, settings.failure_limit, None, specs)
        scanned.drop_files()
        return _facts(src, offers)
    specs += failure_specs() if failures else []
    src = running(src, specs)
    if failures:
        src = with_failures(src, settings.failure_limit)
    return _facts(src, offers)


def _facts(src: Sliced, offers: bool) -> DataFrame:
    df = with_offers(src) if offers else src.df
    return only_checks(df).withColumns(
        {
            "latched": F.coalesce(F.col("latched"), F.lit(False)),
            "had_success": F.coalesce(F.col("had_success"), F.lit(False)),
        }
    )


def scan_specs() -> list[Running]:
    return past_specs() + low_high_specs() + offer_specs() + failure_specs()


def continue_log(
    checks: DataFrame,
    settings: Settings,
    state: DataFrame | None,
    limit: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda scanned: scanned,
) -> tuple[DataFrame, DataFrame]:
    """The next part of a log, after ``state``: (annotated rows, new state).

    The state is one row per product with the running values so far; the rows must
    come after the ones already in it. A hot product is sliced as in a whole log.
    ``keep`` may store the scanned rows, which both results are made of.
    """
    src = sliced_log(seen_offers(checks), None, limit)
    marks = [Running("last_seen", F.struct("checked_at", "check_id"), "max")]
    return _continued(src, settings, state, keep, marks)


def continue_commanded(
    log: DataFrame,
    settings: Settings,
    state: DataFrame | None,
    limit: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda scanned: scanned,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for a log with commands, as ``log_of`` makes it of ``seen_offers``, whose rows may come
    late: (annotated rows, new state, late rows)."""
    src, late = split_late(slice_hot_keys(log, KEY, ORDER, limit), state)
    marks = [Running("last_seen", F.struct(*ORDER), "max"), *target_specs()]
    rows, new_state = _continued(with_target(src, state), settings, state, keep, marks)
    return rows, new_state, late


def _continued(
    src: Sliced, settings: Settings, state: DataFrame | None, keep: Callable[[DataFrame], DataFrame], marks: list[Running]
) -> tuple[DataFrame, DataFrame]:
    done = with_failures(running(src, scan_specs(), state), settings.failure_limit, state)
    done = Sliced(keep(done.df), done.keys, done.order, done.hot)
    specs = scan_specs() + marks + run_specs() + pause_specs()
    return _facts(done, True), closing(done.df, KEY, ORDER, specs, state)


def price() -> Column:
    return F.col("price_paise")


def prev() -> Column:
    return F.col("prev_price")


def crosses_target() -> Column:
    return eligible() & (price() <= F.col("target_paise")) & ~F.col("latched")


def threshold_bp(settings: Settings) -> Column:
    """The product's own threshold, else the global one; 0 disables the rule."""
    return F.coalesce(F.col("threshold_bp"), F.lit(settings.threshold_bp).cast("bigint"))


def drops_enough(settings: Settings) -> Column:
    limit = threshold_bp(settings)
    return (
        success()
        & price().isNotNull()
        & F.col("had_success")
        & (prev() > 0)
        & (limit > 0)
        & ((prev() - price()) * 10000 >= limit * prev())
    )


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def fired(settings: Settings) -> dict[str, Column]:
    """Rule name -> whether it fires on the row, in the order alerts are recorded."""
    target = _sure(crosses_target()) & F.lit(settings.alert_target_price)
    drop = _sure(drops_enough(settings)) & F.lit(settings.alert_threshold_drop)
    moved = _sure(success() & F.col("had_success") & (price() != prev()))
    back = (
        F.col("had_success")
        & (F.col("prev_stock") == "out_of_stock")
        & (F.col("stock_status") == "in_stock")
    )
    return {
        "target_price": target,
        "threshold_drop": drop,
        "price_change": moved & F.lit(settings.alert_any_change) & ~target & ~drop,
        "offer_added": _sure(F.size("added") > 0) & F.lit(settings.alert_offer_added),
        "offer_removed": _sure(F.size("removed") > 0) & F.lit(settings.alert_offer_removed),
        "back_in_stock": _sure(back) & F.lit(settings.alert_back_in_stock),
        "auto_paused": _sure(F.col("auto_paused")),
    }


_OFFERS = "array<struct<type:string,description:string>>"

# which payload fields a rule fills; every other field of the alert row is null
_PAYLOAD = {
    "target_price": {"old_paise", "new_paise", "target_paise", "change_pct"},
    "threshold_drop": {"old_paise", "new_paise", "threshold_bp", "change_pct"},
    "price_change": {"old_paise", "new_paise", "change_pct"},
    "offer_added": {"new_paise", "old_offers", "new_offers", "added"},
    "offer_removed": {"new_paise", "old_offers", "new_offers", "removed"},
    "back_in_stock": {"new_paise"},
    "auto_paused": {"failure_reason", "consecutive_failures"},
}


_VALUES = {
    "old_paise": ("had_success", "prev_price", "bigint"),
    "new_paise": (None, "price_paise", "bigint"),
    "target_paise": (None, "target_paise", "bigint"),
    "threshold_bp": (None, "_limit", "bigint"),
    "change_pct": (None, "_change", "double"),
    "old_offers": (None, "prev_offers", _OFFERS),
    "new_offers": (None, "offers", _OFFERS),
    "added": (None, "added", _OFFERS),
    "removed": (None, "removed", _OFFERS),
    "failure_reason": (None, "failure_reason", "string"),
    "consecutive_failures": (None, "run_len", "bigint"),
}


#: Columns of an alert row.
ALERT_COLUMNS = "product_id bigint, check_id bigint, fired_at timestamp, rule int, type string, " + ", ".join(
    f"{name} {kind}" for name, (_, _, kind) in _VALUES.items()
)


def _payload(rules: dict[str, int]) -> list[str]:
    """The alert row of the rule in the column ``rule``, which is one of ``rules``."""
    kinds = " ".join(f"WHEN {i} THEN '{kind}'" for kind, i in rules.items())
    fields = ["rule", f"CASE rule {kinds} END AS type"]
    for name, (only_if, value, sql_type) in _VALUES.items():
        filled = [str(i) for kind, i in rules.items() if name in _PAYLOAD[kind]]
        test = f"rule IN ({', '.join(filled)})" + (f" AND {only_if}" if only_if else "")
        fields.append(f"CAST({f'CASE WHEN {test} THEN {value} END' if filled else 'NULL'} AS {sql_type}) AS {name}")
    return fields


def evaluate(log: DataFrame, settings: Settings, types: list[str] | None = None) -> DataFrame:
    """Explode the rules that fired on each annotated row into alert rows.

    Numbers of rules are exploded, and only an alert's own payload is made."""
    tests = fired(settings)
    rules = {k: i for i, k in enumerate(tests) if types is None or k in types}
    log = log.withColumns(
        {
            "_limit": threshold_bp(settings),
            "_change": F.when(F.col("had_success") & prev().isNotNull(), change_pct(prev(), price())),
        }
    )
    if len(rules) == 1:  # a single rule is a filter; no array to build
        [(kind, rule)] = rules.items()
        events = log.filter(tests[kind]).withColumn("rule", F.lit(rule))
    else:
        hits = [F.when(tests[kind], F.lit(rule)).otherwise(F.lit(-1)) for kind, rule in rules.items()]
        events = log.select("*", F.explode(F.array_remove(F.array(*hits), -1)).alias("rule"))
    return events.selectExpr("product_id", "check_id", "checked_at AS fired_at", *_payload(rules))


def alerts(
    checks: CheckLog | DataFrame,
    settings: Settings,
    types: list[str] | None = None,
    controls: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """All alerts (or some types) of a check log."""
    wanted = set(types or _PAYLOAD)
    log = as_log(checks)
    # no rule looks at these; slices of a hot product are stored with all columns that they have
    log = log._replace(checks=log.checks.drop("mrp_paise", "tier", "duration_ms"))
    log = annotated(
        log,
        settings,
        controls,
        limit,
        failures="auto_paused" in wanted,
        offers=bool(wanted & {"offer_added", "offer_removed"}),
    )
    absent = {}
    if "auto_paused" not in wanted:
        absent |= {"run_len": F.lit(None).cast("bigint"), "auto_paused": F.lit(False)}
    if not wanted & {"offer_added", "offer_removed"}:
        none = F.lit(None).cast(OFFERS)
        absent |= {"prev_offers": none, "added": none, "removed": none}
    return evaluate(log.withColumns(absent) if absent else log, settings, types)


def product_state(
    checks: CheckLog | DataFrame,
    settings: Settings,
    controls: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Current state per product, folded from its log by partial aggregates."""
    return with_status(folded(annotated(checks, settings, controls, limit)))


def continue_state(
    checks: DataFrame,
    settings: Settings,
    running_state: DataFrame | None,
    products: DataFrame | None,
    limit: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda scanned: scanned,
) -> tuple[DataFrame, DataFrame]:
    """The next part of a log: (running state, product state) after it.

    Both are stored between parts; only the new rows are read, and the products without
    any are carried over.
    """
    log, running_state = continue_log(checks, settings, running_state, limit, keep)
    return running_state, carried_state(folded(log), products)


def carried_state(new: DataFrame, products: DataFrame | None) -> DataFrame:
    """Product state after a part of the log from the part's own fold and the state before it."""
    if products is None:
        return with_status(new)
    old = products.withColumn("was_auto_paused", F.when(F.col("status") == "paused_auto", F.lit(True)))
    old = old.select([F.col(c).alias("old_" + c) for c in new.columns])
    both = new.join(old, new["product_id"] == old["old_product_id"], "full")
    least, most = {"low_paise"}, {"high_paise", "last_checked_at", "last_success_at", "last_changed_at"}

    def merged(c: str) -> Column:
        if c in least:
            return F.least(c, "old_" + c)
        return F.greatest(c, "old_" + c) if c in most else F.coalesce(c, "old_" + c)

    return with_status(both.select([merged(c).alias(c) for c in new.columns]))


def with_status(state: DataFrame) -> DataFrame:
    paused = F.when(F.col("was_auto_paused"), "paused_auto").otherwise("active")
    return state.withColumn("status", paused).drop("was_auto_paused")


def folded(log: DataFrame) -> DataFrame:
    """One row per product from annotated checks, by partial aggregates."""
    at = F.struct("checked_at", "check_id")
    changed = live() & (prev().isNull() | (prev() != price()))
    latch = (
        F.when(eligible(), price() <= F.col("target_paise"))
        .when(success() & F.col("target_paise").isNull(), F.lit(False))
        .otherwise(F.col("latched"))
    )

    def newest(value: Column, when: Column | None = None) -> Column:
        pair = F.struct(at.alias("at"), value.alias("v"))
        return F.max(pair if when is None else F.when(when, pair))["v"]

    return log.groupBy("product_id").agg(
        newest(price(), live()).alias("current_paise"),
        newest(F.col("mrp_paise"), live()).alias("current_mrp_paise"),
        newest(F.col("stock_status"), success()).alias("stock_status"),
        newest(F.col("eff_offers"), success()).alias("current_offers"),
        F.min(F.when(live(), price())).alias("low_paise"),
        F.max(F.when(live(), price())).alias("high_paise"),
        newest(latch).alias("target_crossed"),
        newest(F.when(success(), F.lit(0)).otherwise(F.col("run_len"))).alias(
            "consecutive_failures"
        ),
        F.max("checked_at").alias("last_checked_at"),
        F.max(F.when(success(), F.col("checked_at"))).alias("last_success_at"),
        F.max(F.when(changed, F.col("checked_at"))).alias("last_changed_at"),
        F.max(F.when(F.col("auto_paused"), F.lit(True))).alias("was_auto_paused"),
        newest(F.col("failure_reason"), ~success()).alias("last_failure_reason"),
    )


def history_rows(checks: CheckLog | DataFrame, settings: Settings, limit: int | None = None) -> DataFrame:
    """One history row per check, success or failure, with the effective offers."""
    log = annotated(checks, settings, None, limit, failures=False)
    return log.select(
        "check_id",
        "product_id",
        "checked_at",
        F.date_format("checked_at", "yyyy-MM").alias("checked_month"),
        "success",
        F.when(success(), price()).alias("price_paise"),
        F.when(success(), F.col("mrp_paise")).alias("mrp_paise"),
        F.when(success(), F.col("eff_offers")).alias("offers"),
        F.when(success(), offers_hash(F.col("eff_offers"))).alias("offers_hash"),
        F.when(success(), F.col("stock_status")).otherwise("unknown").alias("stock_status"),
        "tier",
        "duration_ms",
        "failure_reason",
    )
