"""Delivery hygiene: cooldown, quiet hours, held summaries, outcomes, digest.

Hygiene changes delivery only; suppressed and held alerts stay in the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.clock import in_quiet_hours, quiet_release
from pricelark.model import COOLDOWN_EXEMPT, HEALTH_ALERTS, HELD_BATCH, Settings
from pricelark.operators.slices import Running, row_numbers, running, slice_hot_keys
from pricelark.session import ensure_checkpoint_dir

KEY = ["product_id", "type"]
SESSION_LIMIT = 1000
"""Alerts of one burst folded in a single row; longer bursts go by pointer doubling."""


def judged(alerts: DataFrame, settings: Settings) -> DataFrame:
    """Add quiet-hours release (null when not held) and the time delivery counts from."""
    kind = F.col("type")
    holdable = F.lit(True) if settings.hold_health else ~kind.isin(HEALTH_ALERTS)
    release = F.when(
        holdable,
        quiet_release(F.col("fired_at"), settings.quiet_start, settings.quiet_end, settings.timezone),
    )
    return alerts.withColumn("_release", release).withColumn(
        "_eff", F.coalesce("_release", "fired_at")
    )


def delivery_plan(
    alerts: DataFrame,
    settings: Settings,
    session_limit: int | None = None,
    slice_limit: int | None = None,
) -> DataFrame:
    """(alert_id, product_id, type, fired_at, ...) plus status, reason, release_at.

    Cooldown is sequential per product and type: an alert is suppressed when an
    earlier alert of its key counts as delivered within the window before it. A held
    alert counts as delivered when its quiet window ends.
    """
    return continue_delivery(alerts, settings, None, session_limit, slice_limit)[0]


def continue_delivery(
    alerts: DataFrame,
    settings: Settings,
    state: DataFrame | None,
    session_limit: int | None = None,
    slice_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The same for the next part of an alert log: (plan, new state).

    The state is the last alert of each key that started a cooldown, and when it counts
    as delivered; it takes part as an alert before the new ones.
    """
    ruled = judged(alerts, settings)
    subject = F.col("product_id").isNotNull() & ~F.col("type").isin(COOLDOWN_EXEMPT)
    if settings.cooldown_minutes <= 0:
        subject = F.lit(False)
    free = ruled.filter(~subject).withColumn("_suppressed", F.lit(False))
    bound = ruled.filter(subject)

    times = bound.select(*KEY, "fired_at", "_eff").distinct()
    if state is not None:
        times = times.unionByName(state.select(*KEY, "fired_at", "_eff")).distinct()
    chain = _delivered_chain(times, settings.cooldown_minutes, session_limit, slice_limit)
    marked = bound.withColumn("_kind", F.lit(1)).unionByName(
        chain.withColumn("_kind", F.lit(0)), allowMissingColumns=True
    )
    if state is not None:  # the alert already decided comes before new ones of its time
        known = state.select(*KEY, "fired_at").withColumns(
            {"_kind": F.lit(1), "alert_id": F.lit(None).cast("long")}
        )
        marked = marked.unionByName(known, allowMissingColumns=True)
    # the newest chain row at or before each alert decides it
    src = slice_hot_keys(marked, KEY, ["fired_at", "_kind", "alert_id"], slice_limit)
    is_alert = F.col("_kind") == 1
    started = F.struct("fired_at", F.col("_eff").alias("eff"))
    src = running(
        src,
        [
            Running("_chain", F.when(~is_alert, started), "last", False),
            Running("_first", F.when(is_alert, F.struct("fired_at", "alert_id")), "max", False),
        ],
    )
    pending = F.col("_chain.eff") > F.col("fired_at")
    starts = (F.col("_chain.fired_at") == F.col("fired_at")) & (
        F.col("_first").isNull() | (F.col("_first.fired_at") < F.col("fired_at"))
    )
    new = src.df.filter(is_alert & F.col("alert_id").isNotNull())
    decided = new.withColumn("_suppressed", ~(pending | starts))
    plan = _outcome(decided.select(*free.columns).unionByName(free), settings)
    newest = F.max(F.struct("fired_at", "_eff"))
    return plan, chain.groupBy(*KEY).agg(newest.alias("m")).select(*KEY, "m.*")


def _outcome(df: DataFrame, settings: Settings) -> DataFrame:
    held = F.col("_release").isNotNull()
    return df.withColumns(
        {
            "status": F.when(F.col("_suppressed"), "suppressed")
            .when(held, "held_quiet_hours")
            .otherwise("delivered"),
            "reason": F.when(F.col("_suppressed"), f"cooldown {settings.cooldown_minutes}m"),
            "release_at": F.when(~F.col("_suppressed") & held, F.col("_release")),
        }
    ).drop("_release", "_eff", "_suppressed")


def _delivered_chain(
    times: DataFrame, minutes: int, session_limit: int | None, slice_limit: int | None
) -> DataFrame:
    """The alerts that start a cooldown: (product_id, type, fired_at, _eff).

    A burst is a run of alerts each within the cooldown of the one before; its
    first alert always starts a cooldown, so bursts are independent.
    """
    limit = SESSION_LIMIT if session_limit is None else session_limit
    width = F.make_dt_interval(mins=F.lit(minutes))
    src = slice_hot_keys(times, KEY, ["fired_at"], slice_limit)
    src = running(src, [Running("_before", F.col("_eff"), "max", False)])
    opens = F.col("_before").isNull() | (F.col("fired_at") > F.col("_before") + width)
    src = type(src)(src.df.withColumn("_opens", opens), src.keys, src.order, src.hot)
    src = running(
        src, [Running("_burst", F.when(F.col("_opens"), F.col("fired_at")), "last", True)]
    )
    nodes = src.df.select(*KEY, "_burst", "fired_at", "_eff")
    sized = nodes.groupBy(*KEY, "_burst").agg(F.count("*").alias("_n"))
    long_bursts = sized.filter(F.col("_n") > limit).select(*KEY, "_burst")
    if long_bursts.isEmpty():
        return _fold(nodes, width)
    short = nodes.join(long_bursts, [*KEY, "_burst"], "left_anti")
    long = nodes.join(long_bursts, [*KEY, "_burst"], "left_semi")
    return _fold(short, width).unionByName(_double(long, width, slice_limit))


def _fold(nodes: DataFrame, width: Column) -> DataFrame:
    """Walk each short burst in order inside one row."""
    step = F.struct(F.col("fired_at").alias("t"), F.col("_eff").alias("eff"))
    packed = nodes.groupBy(*KEY, "_burst").agg(F.array_sort(F.collect_list(step)).alias("_ts"))
    kind = "array<struct<t:timestamp,eff:timestamp>>"
    empty = F.struct(F.lit(None).cast("timestamp").alias("eff"), F.array().cast(kind).alias("out"))

    def walk(acc: Column, x: Column) -> Column:
        starts = acc["eff"].isNull() | (x["t"] > acc["eff"] + width)
        return F.when(
            starts, F.struct(x["eff"].alias("eff"), F.concat(acc["out"], F.array(x)).alias("out"))
        ).otherwise(acc)

    chain = F.aggregate("_ts", empty, walk, lambda acc: acc["out"])
    return packed.select(*KEY, F.explode(chain).alias("_x")).select(
        *KEY, F.col("_x.t").alias("fired_at"), F.col("_x.eff").alias("_eff")
    )


def _double(nodes: DataFrame, width: Column, slice_limit: int | None) -> DataFrame:
    """Follow "next alert after my cooldown" by pointer doubling.

    Each round doubles the hop length, so a chain of n alerts takes log2(n) joins
    and no task ever holds a whole burst.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    keys = [*KEY, "_burst"]
    points = nodes.select(
        *keys, F.col("fired_at").alias("_x"), F.lit(1).alias("_k"), "fired_at", "_eff"
    ).unionByName(
        nodes.select(
            *keys, (F.col("_eff") + width).alias("_x"), F.lit(0).alias("_k"), "fired_at", "_eff"
        )
    )
    # scanning backwards in time, the newest node seen is the next one after the probe
    back = points.withColumn("_back", F.timestamp_micros(-F.unix_micros("_x")))
    src = slice_hot_keys(back, keys, ["_back", "_k"], slice_limit)
    src = running(
        src, [Running("_next", F.when(F.col("_k") == 1, F.col("fired_at")), "last", False)]
    )
    jump = (
        src.df.filter((F.col("_k") == 0) & F.col("_next").isNotNull())
        .select(*keys, "fired_at", "_next")
        .checkpoint()
    )
    reached = [nodes.filter(F.col("fired_at") == F.col("_burst")).select(*keys, "fired_at")]
    while True:
        seen = reduce(DataFrame.unionByName, reached)
        new = seen.join(jump, [*keys, "fired_at"]).select(*keys, F.col("_next").alias("fired_at"))
        new = new.checkpoint()
        reached.append(new)
        hop = jump.withColumnRenamed("_next", "_mid").join(
            jump.select(*keys, F.col("fired_at").alias("_mid"), "_next"), [*keys, "_mid"]
        )
        jump = hop.select(*keys, "fired_at", "_next").checkpoint()
        if jump.isEmpty():
            seen = reduce(DataFrame.unionByName, reached)
            return seen.join(nodes, [*keys, "fired_at"]).select(*KEY, "fired_at", "_eff")


def recently_delivered(alerts: DataFrame, delivered: DataFrame, minutes: int) -> DataFrame:
    """Single-pass probe: alerts with a delivery of the same key in the window before them.

    The time range is cut into cells of the window's length, so the join is an
    equi-join on (product, type, cell) with at most one extra cell per row.
    """
    micros = minutes * 60_000_000
    cell = lambda c: F.floor(F.unix_micros(c) / micros)
    # within a cell only the oldest delivery after and the newest before a time matter
    past = (
        delivered.filter(F.col("product_id").isNotNull())
        .select("product_id", "type", "delivered_at", cell("delivered_at").alias("_cell"))
    )
    src = alerts.filter(F.col("product_id").isNotNull()).withColumn("_cell", cell("fired_at"))
    # newest delivery of the previous cell: one row per key and cell
    newest = past.groupBy("product_id", "type", (F.col("_cell") + 1).alias("_cell")).agg(
        F.max("delivered_at").alias("_prev")
    )
    first = past.groupBy("product_id", "type", "_cell").agg(F.min("delivered_at").alias("_first"))
    window = F.make_dt_interval(mins=F.lit(minutes))
    hit = (F.col("_first") <= F.col("fired_at")) | (F.col("_prev") >= F.col("fired_at") - window)
    return (
        src.join(newest, ["product_id", "type", "_cell"], "left")
        .join(first, ["product_id", "type", "_cell"], "left")
        .filter(F.coalesce(hit, F.lit(False)))
        .drop("_cell", "_prev", "_first")
    )


def quiet_flags(alerts: DataFrame, settings: Settings) -> DataFrame:
    s = settings
    at = F.col("fired_at")
    return alerts.withColumns(
        {
            "quiet": in_quiet_hours(at, s.quiet_start, s.quiet_end, s.timezone),
            "release_at": quiet_release(at, s.quiet_start, s.quiet_end, s.timezone),
        }
    )


def significance() -> Column:
    """Order of held alerts: target crossings, then the biggest drops, then the rest."""
    drop = F.lit(1.0) - F.least(F.lit(0.99), F.abs(F.coalesce("change_pct", F.lit(0.0))) / 100)
    return (
        F.when(F.col("type") == "target_price", 0.0)
        .when(F.col("type") == "threshold_drop", drop)
        .otherwise(2.0)
    )


def held_summaries(held: DataFrame, size: int = HELD_BATCH, limit: int | None = None) -> DataFrame:
    """One summary per release and batch of ``size`` held alerts in fired order.

    ``held(alert_id, type, fired_at, release_at, change_pct, message)``; every held
    alert is in exactly one summary.
    """
    src = row_numbers(slice_hot_keys(held, ["release_at"], ["fired_at", "alert_id"], limit))
    line = F.concat(
        F.lit("• "),
        F.array_join(F.filter(F.split("message", "\n"), lambda _, i: i > 0), " — "),
    )
    entry = F.struct(significance().alias("s"), "fired_at", "alert_id", line.alias("line"))
    batches = src.df.groupBy(
        "release_at", F.floor((F.col("rn") - 1) / size).alias("batch")
    ).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    n = F.size("entries")
    return batches.select(
        "release_at",
        "batch",
        n.alias("alerts"),
        F.concat(
            F.lit("🌙 <b>While you were away</b> — "),
            n.cast("string"),
            F.when(n == 1, " alert").otherwise(" alerts"),
            F.lit(" held during quiet hours:\n\n"),
            F.array_join(F.transform("entries", lambda e: e["line"]), "\n"),
        ).alias("message"),
    )


def grouped_messages(alerts: DataFrame, order: str) -> DataFrame:
    """Alerts of one product and time as one message in order, joined by blank lines.

    A group is what one check fired; its message is one text, so it is built in one row.
    """
    subject = F.coalesce(F.col("product_id").cast("string"), F.lit("system"))
    entry = F.struct(F.col(order).alias("o"), F.col("message").alias("m"))
    grouped = alerts.groupBy(subject.alias("subject"), "fired_at").agg(
        F.array_sort(F.collect_list(entry)).alias("_e"), F.count("*").alias("alerts")
    )
    return grouped.select(
        "subject",
        "fired_at",
        "alerts",
        F.array_join(F.transform("_e", lambda e: e["m"]), "\n\n").alias("message"),
    )


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """(alert_id, at, seq, outcome, error): current state per alert; a retry re-queues a failure."""
    newest = F.max(F.struct("at", "seq", "outcome", "error"))
    return (
        outcomes.groupBy("alert_id")
        .agg(newest.alias("_m"), F.count("*").alias("attempts"))
        .select(
            "alert_id",
            F.when(F.col("_m.outcome") == "retry", "pending")
            .otherwise(F.col("_m.outcome"))
            .alias("status"),
            F.when(F.col("_m.outcome") == "delivered", F.col("_m.at")).alias("delivered_at"),
            F.when(F.col("_m.outcome") == "failed", F.col("_m.error")).alias("error"),
            "attempts",
        )
    )


