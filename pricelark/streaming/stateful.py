"""Streams whose state goes on from micro-batch to micro-batch; every one goes through the scans of the batch job.

* Checks and user commands in one stream. Commands come before a check of the same time; the running
  values per product are held by a stored table of buckets, of which those with keys of the micro-batch are
  rewritten.
* Cooldown and quiet hours. An alert is decided when it comes; a held one is released once the event time
  seen, less ``delay``, is at the end of its quiet window, and a key's state ends with its cooldown. So the
  state is what the last cooldown and quiet window need, and is written anew by every micro-batch.

Hot products are sliced. No row passes through Python. A row that is not after the newest one folded for
its key, or has no time, is late: it is passed on with the type 'late' and changes nothing.
"""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricelark.model import COOLDOWN_EXEMPT, Settings
from pricelark.operators.alerts import continue_commanded, evaluate
from pricelark.operators.hygiene import continue_delivery, judged
from pricelark.operators.sequence import log_of, seen_offers
from pricelark.sources import folders
from pricelark.sources.sinks import stored_rows
from pricelark.sources.state_table import BUCKET, StateTable
from pricelark.streaming.monitor import LATE

# --- checks under commands ---------------------------------------------------


def run_checks(
    checks: DataFrame, controls: DataFrame | None, settings: Settings, folder: str, buckets: int = 64, **trigger: object
) -> StreamingQuery:
    """Alerts of the streams into ``folder/table``, late rows (with a command's ``action``) into ``folder/late``.

    Outputs of a micro-batch are written first, under its id, then its state is committed: a batch that
    dies between is run again and replaces them, one that is committed is not applied again."""
    spark = checks.sparkSession
    log = log_of(seen_offers(checks), controls)
    table = StateTable(spark, f"{folder}/products", ("product_id",), buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        with ExitStack() as until_applied:

            def step(old: DataFrame | None) -> DataFrame:
                state = None if old is None else old.drop(BUCKET)
                rows, new_state, late = continue_commanded(
                    batch, settings, state, keep=lambda scanned: until_applied.enter_context(stored_rows(scanned))
                )
                passed = late.select(
                    "product_id", "check_id", F.col("checked_at").alias("fired_at"), F.lit(LATE).alias("type"), "action"
                )
                for name, found in {"table": evaluate(rows, settings), LATE: passed}.items():
                    found.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
                return new_state

            table.apply(batch_id, batch.select("product_id"), step)
            table.vacuum()

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# --- cooldown and quiet hours ------------------------------------------------

DECIDED, RELEASED = "decided", "released"
SALTS = 64
ALERT = ["alert_id", "product_id", "type", "fired_at"]
_ORDER = ["_key", "type", "_salt"]  # alerts of one value of these come one after the other


def _keyed(alerts: DataFrame, settings: Settings) -> DataFrame:
    """Alerts without cooldown need no order, so their keys are salted: all alerts without a product are
    one key otherwise."""
    cooled = settings.cooldown_minutes > 0
    subject = F.lit(cooled) & F.col("product_id").isNotNull() & ~F.col("type").isin(COOLDOWN_EXEMPT)
    salt = F.when(subject, 0).otherwise(F.pmod(F.xxhash64("alert_id"), F.lit(SALTS))).cast("long")
    return alerts.withColumns({"_key": F.coalesce("product_id", F.lit(-1)), "_salt": salt})


def run_hold(alerts: DataFrame, settings: Settings, folder: str, delay: str = "0 seconds", **trigger: object) -> StreamingQuery:
    """Decisions into ``folder/decided``, releases into ``folder/released``, late alerts into ``folder/late``.

    ``delay`` is how long time waits for slow alerts. Outputs of a micro-batch are written under its id, and its
    state last, so that a batch which runs again starts from the same state and replaces what it wrote.
    The state: the time seen (``clock``), of every key the alert that started its cooldown (``chain``) and
    the newest alert (``seen``), both as long as they can matter, and the alerts held (``held``)."""
    spark = alerts.sparkSession
    width = F.make_dt_interval(mins=F.lit(settings.cooldown_minutes))

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(rows: DataFrame, name: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(place := f"{folder}/{name}/batch_id={batch_id}")
            return spark.read.schema(rows.schema).format("parquet").load(place)

        def kept(name: str) -> DataFrame | None:
            return spark.read.parquet(f"{folder}/state/{name}/batch_id={batch_id - 1}") if batch_id else None

        clock, chain, seen, held = (kept(name) for name in ("clock", "chain", "seen", "held"))
        before = clock.first()["ms"] if batch_id else None
        wait = F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {delay})")
        now = batch.agg(F.max(F.unix_millis("fired_at")).alias("ms")).select((F.col("ms") - wait).alias("ms")).first()["ms"]
        now = max((x for x in (before, now) if x is not None), default=None)
        passed = F.timestamp_millis(F.lit(now).cast("long"))

        # a row without an id only moves time on; of equal rows all but one are late
        rows = _keyed(batch.filter("alert_id IS NOT NULL").groupBy(*ALERT).agg(F.count("*").alias("_n")), settings)
        late = F.col("fired_at").isNull()
        if before is not None:
            late = late | (F.col("fired_at") < F.timestamp_millis(F.lit(before).cast("long")))
            rows = rows.join(seen, _ORDER, "left")
            late = late | F.coalesce(F.struct("fired_at", "alert_id") <= F.col("_last"), F.lit(False))
        with stored_rows(rows.select(*ALERT, "_key", "_salt", "_n", late.alias("_late"))) as rows:
            fresh = rows.filter("NOT _late")
            plan, new_chain = continue_delivery(fresh.select(*ALERT), settings, chain)
            none = F.lit(None).cast("timestamp").alias("release_at")
            decided = put(plan.select(*ALERT, "status", none), DECIDED)
            times = F.when(F.col("_late"), F.col("_n")).otherwise(F.col("_n") - 1)
            again = rows.withColumn("_i", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
            put(again.select(*ALERT, none), LATE)
            waiting = judged(decided.filter("status = 'held_quiet_hours'"), settings).select(*ALERT, "_release")
            waiting = waiting if held is None else held.unionByName(waiting)
            over = F.coalesce(F.col("_release") <= passed, F.lit(False))
            ended = F.timestamp_millis(F.unix_millis("_release")).alias("release_at")
            put(waiting.filter(over).select(*ALERT, F.lit("delivered").alias("status"), ended), RELEASED)

            last = F.max(F.struct("fired_at", "alert_id")).alias("_last")
            newest = fresh.filter(F.col("fired_at") >= passed).groupBy(*_ORDER).agg(last)
            if seen is not None:
                old = seen.filter(F.col("_last.fired_at") >= passed)
                newest = old.unionByName(newest).groupBy(*_ORDER).agg(F.max("_last").alias("_last"))
            put(waiting.filter(~over), "state/held")
            put(newest, "state/seen")
            put(new_chain.filter(F.col("_eff") + width >= passed), "state/chain")
            put(spark.range(1).select(F.lit(now).cast("long").alias("ms")), "state/clock")
        for name in ("clock", "chain", "seen", "held"):
            folders.drop(spark, f"{folder}/state/{name}/batch_id={batch_id - 2}")

    return (
        alerts.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def outcomes(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    """Every decided alert with its status, reason and the time when its hold really ended."""
    decided = spark.read.parquet(f"{folder}/{DECIDED}").drop("batch_id", "release_at")
    released = spark.read.parquet(f"{folder}/{RELEASED}").select("alert_id", "release_at")
    reason: Column = F.when(F.col("status") == "suppressed", f"cooldown {settings.cooldown_minutes}m")
    return decided.withColumn("reason", reason).join(released, "alert_id", "left")


def clock_row(alerts: DataFrame, at: Column) -> DataFrame:
    """One row of the alerts' shape that only says what time it is, so that the last holds end."""
    one = alerts.sparkSession.range(1)
    values = [
        at.cast("timestamp").alias(f.name) if f.name == "fired_at" else F.lit(None).cast(f.dataType).alias(f.name)
        for f in alerts.schema.fields
    ]
    return one.select(*values)
