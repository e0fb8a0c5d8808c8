"""Structured Streaming twins of the batch jobs: alerts, cooldown, counts, dedupe.

Each micro-batch goes through the same sliced scans as a whole log, started from the
running values kept in a state table, so a hot product is split inside a micro-batch
too. Outputs and state are written under the batch's id: a batch that runs again after
a failure replaces what it wrote, and reads the state of the batch before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pricelark.model import Settings
from pricelark.operators.alerts import continue_log, evaluate
from pricelark.operators.hygiene import continue_delivery
from pricelark.session import ensure_checkpoint_dir
from pricelark.sources.state_table import StateTable

Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def read_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, max_bytes: str | None = None
) -> DataFrame:
    """A table's files as a stream; ``max_bytes`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


LATE = "late"


def run_stateful(stream: DataFrame, step: Step, folder: str, **trigger: object) -> StreamingQuery:
    """Run ``step(batch, state) -> (output, new state)`` per micro-batch.

    ``trigger`` is passed on, for example ``processingTime="30 seconds"``; without, everything
    available is processed and the query ends. Output rows of type 'late' go to a table of
    their own.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{folder}/state/{batch_id - 1}") if batch_id else None
        batch = batch.persist()
        try:
            output, new_state = step(batch, state)
            for name, rows in split_late(output).items():
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
            new_state.write.mode("overwrite").parquet(f"{folder}/state/{batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def split_late(output: DataFrame) -> dict[str, DataFrame]:
    if "type" not in output.columns:
        return {"table": output}
    late = F.coalesce(F.col("type") == LATE, F.lit(False))
    return {"table": output.filter(~late), LATE: output.filter(late)}


def late_of(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that came too late to be folded."""
    return spark.read.parquet(f"{folder}/{LATE}").drop("batch_id")


def table_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/table").drop("batch_id")


def _is_late(at: Column, last: Column) -> Column:
    return F.coalesce(at <= last, F.lit(False))


def alert_step(settings: Settings, limit: int | None = None) -> Step:
    """Alerts of a micro-batch of checks.

    A check not after the newest one already folded is late: it is passed on with the
    type 'late' and never folded.
    """

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        late = batch.filter(F.lit(False))
        if state is not None:
            seen = batch.join(state.select("product_id", "last_seen"), "product_id", "left")
            is_late = _is_late(F.struct("checked_at", "check_id"), F.col("last_seen"))
            late = seen.filter(is_late).select(*batch.columns)
            batch = seen.filter(~is_late).select(*batch.columns)
        rows, new_state = continue_log(batch, settings, state, limit)
        found = evaluate(rows, settings)
        passed = late.select(
            "product_id", "check_id", F.col("checked_at").alias("fired_at"), F.lit(LATE).alias("type")
        )
        return found.unionByName(passed, allowMissingColumns=True), new_state

    return step


def cooldown_step(
    settings: Settings, session_limit: int | None = None, slice_limit: int | None = None
) -> Step:
    """Delivery status of a micro-batch of alerts."""

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        plan, chain = continue_delivery(batch, settings, state, session_limit, slice_limit)
        if state is None:
            return plan, chain
        newest = F.max(F.struct("fired_at", "_eff"))
        both = chain.unionByName(state.select(*chain.columns))
        merged = both.groupBy("product_id", "type").agg(newest.alias("m"))
        return plan, merged.select("product_id", "type", "m.*")

    return step


def hourly_counts(alerts: DataFrame, delay: str | None = None) -> DataFrame:
    """Alerts per type and hour; batch or stream. ``delay`` is how long a stream waits for late
    rows before it forgets an hour."""
    if delay:
        alerts = alerts.withWatermark("fired_at", delay)
    return (
        alerts.groupBy(F.window("fired_at", "1 hour").alias("w"), "type")
        .agg(F.count("*").alias("alerts"))
        .select(F.col("w.start").alias("hour"), "type", "alerts")
    )


def rolled(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Alerts per type in the ``hours`` before every full hour, from hourly counts.

    Each hourly row, not each alert, is given to the hours that count it.
    """
    ends = F.sequence(
        F.col("hour") + F.expr("INTERVAL 1 HOUR"),
        F.col("hour") + F.make_dt_interval(hours=F.lit(hours)),
        F.expr("INTERVAL 1 HOUR"),
    )
    return (
        hourly.select(F.explode(ends).alias("until"), "type", "alerts")
        .groupBy("until", "type")
        .agg(F.sum("alerts").alias("alerts"))
    )


def rolling_counts(alerts: DataFrame, hours: int = 24) -> DataFrame:
    return rolled(hourly_counts(alerts), hours)


def deduplicated(checks: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Repeated deliveries of a record dropped; the state forgets keys after ``delay``."""
    return checks.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def start_to_table(stream: DataFrame, folder: str, **trigger: object) -> StreamingQuery:
    """Append a stream to a table; without a trigger everything available, then it ends."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run an append stream over everything available into a table; later runs go on."""
    start_to_table(stream, folder).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def run_changes(
    stream: DataFrame,
    folder: str,
    keys: list[str],
    publish: Callable[[DataFrame, int], None] | None = None,
    buckets: int = 16,
    **trigger: object,
) -> StreamingQuery:
    """Change feed: the updated rows of each micro-batch, under its id; ``publish`` is told.

    Beside the feed the newest row of every key is kept in a stored table, of which a batch
    rewrites only the buckets it touches; a batch that runs again is applied once.
    """
    newest = latest_table(stream.sparkSession, folder, keys, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        place = f"{folder}/table/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(place)
        newest.upsert(batch_id, batch.sparkSession.read.schema(batch.schema).parquet(place))
        newest.vacuum()
        if publish:
            publish(batch, batch_id)

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_table(spark: SparkSession, folder: str, keys: list[str], buckets: int = 16) -> StateTable:
    return StateTable(spark, f"{folder}/newest", tuple(keys), buckets)


def current(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Newest version of every key of a change feed; the feed itself is not read."""
    return latest_table(spark, folder, keys).read()
