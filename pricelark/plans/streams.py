"""Registered queries: the streaming jobs, checked against the same SQL as a batch."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.model import Settings
from pricelark.plans.delivery import SETTINGS as HYGIENE
from pricelark.plans.delivery import _plan_sql
from pricelark.plans.registry import EVENT_ALERTS_SQL, query, sql
from pricelark.plans.text import CONTROLLED_ALERTS_SQL, product_commands
from pricelark.sources import tables as M
from pricelark.streaming import monitor as S
from pricelark.streaming import stateful as W

SETTINGS = replace(Settings(), failure_limit=2)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = M.table(spark, sf_dir, "events").schema
    return S.read_stream(spark, sf_dir, "events.parquet", schema)


def _as_checks(events: DataFrame) -> DataFrame:
    """Events as checks of the user's product: errors fail, signups find it sold out."""
    return events.selectExpr(
        "event_id AS check_id",
        "user_id AS product_id",
        "ts AS checked_at",
        "event_type <> 'error' AS success",
        """CASE event_type WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'out_of_stock'
           ELSE 'in_stock' END AS stock_status""",
        """CASE WHEN event_type NOT IN ('error', 'signup') THEN
           CAST(floor(value * 100) AS BIGINT) + 1 END AS price_paise""",
        "CAST(NULL AS BIGINT) AS mrp_paise",
        "CAST(array() AS ARRAY<STRUCT<type: STRING, description: STRING>>) AS offers",
        "'http' AS tier",
        "CASE WHEN event_type = 'error' THEN 'other' END AS failure_reason",
        "0 AS duration_ms",
        "CAST(2000 AS BIGINT) AS target_paise",
        "CAST(CASE WHEN user_id % 3 = 0 THEN 1000 END AS BIGINT) AS threshold_bp",
    )


_STREAM_SQL = """
c AS (SELECT event_id AS check_id, user_id AS product_id, ts AS checked_at, event_type <> 'error' AS success,
    CASE event_type WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'out_of_stock' ELSE 'in_stock' END AS stock,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(floor(value * 100) AS BIGINT) + 1 END AS price,
    CASE WHEN user_id % 3 = 0 THEN 1000 ELSE 500 END AS bp FROM events),
p AS (SELECT *, last_value(price IGNORE NULLS) OVER prior AS prev,
    last_value(CASE WHEN success THEN stock END IGNORE NULLS) OVER prior AS prev_stock,
    coalesce(last_value(CASE WHEN price IS NOT NULL THEN price <= 2000 END IGNORE NULLS) OVER prior, FALSE) AS latched,
    sum(CASE WHEN success THEN 0 ELSE 1 END) OVER upto AS f FROM c
  WINDOW prior AS (PARTITION BY product_id ORDER BY checked_at, check_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    upto AS (PARTITION BY product_id ORDER BY checked_at, check_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, f - coalesce(max(CASE WHEN success THEN f END) OVER (PARTITION BY product_id ORDER BY checked_at, check_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS run,
    CASE WHEN prev IS NOT NULL THEN floor(CAST(price - prev AS DOUBLE) / prev * 10000.0 + 0.5) / 100.0 END AS pct,
    coalesce(price <= 2000 AND NOT latched, FALSE) AS hit, coalesce((prev - price) * 10000 >= bp * prev, FALSE) AS dropped FROM p)"""


@query(
    "stream_alerts",
    sql(
        _STREAM_SQL,
        """SELECT product_id, check_id, checked_at AS fired_at, 'target_price' AS type, prev AS old_paise, price AS new_paise, pct AS change_pct FROM r WHERE hit
        UNION ALL SELECT product_id, check_id, checked_at, 'threshold_drop', prev, price, pct FROM r WHERE dropped
        UNION ALL SELECT product_id, check_id, checked_at, 'price_change', prev, price, pct FROM r WHERE price <> prev AND NOT hit AND NOT dropped
        UNION ALL SELECT product_id, check_id, checked_at, 'back_in_stock', NULL, price, NULL FROM r WHERE prev_stock = 'out_of_stock' AND stock = 'in_stock'
        UNION ALL SELECT product_id, check_id, checked_at, 'auto_paused', NULL, NULL, NULL FROM
          (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY checked_at, check_id) AS n FROM r WHERE NOT success AND run = 2) WHERE n = 1""",
    ),
)
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = S.new_folder(spark, "alerts")
    checks = _as_checks(_event_stream(spark, sf_dir))
    S.run_stateful(checks, S.alert_step(SETTINGS), folder).awaitTermination()
    return S.table_of(spark, folder).select(
        "product_id", "check_id", "fired_at", "type", "old_paise", "new_paise", "change_pct"
    )


@query(
    "stream_cooldown",
    sql(_plan_sql(True), "SELECT alert_id, status, release_at FROM plan"),
)
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = S.new_folder(spark, "cooldown")
    alerts = M.alerts_of(_event_stream(spark, sf_dir))
    S.run_stateful(alerts, S.cooldown_step(HYGIENE), folder).awaitTermination()
    return S.table_of(spark, folder).select("alert_id", "status", "release_at")


def _counts_sql(hours: int) -> str:
    return sql(
        EVENT_ALERTS_SQL,
        f""", hours AS (SELECT date_trunc('hour', fired_at) + to_hours(k) AS until, type FROM logged, range(1, {hours + 1}) t(k))
        SELECT until, type, count(*) AS alerts FROM hours GROUP BY 1, 2""",
    )


@query("counts_24h", _counts_sql(24))
def counts_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling_counts(M.logged_alerts(spark, sf_dir))


@query("stream_counts_24h", _counts_sql(24))
def stream_counts_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from the hourly ones that a stream keeps as a change feed."""
    return _stream_counts(spark, sf_dir, 24)


@query("stream_counts_7d", _counts_sql(168))
def stream_counts_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_counts(spark, sf_dir, 168)


def _stream_counts(spark: SparkSession, sf_dir: str, hours: int) -> DataFrame:
    folder = S.new_folder(spark, "feed")
    hourly = S.hourly_counts(M.alerts_of(_event_stream(spark, sf_dir)), "2 days")
    S.run_changes(hourly, folder, ["hour", "type"]).awaitTermination()
    return S.rolled(S.current(spark, folder, ["hour", "type"]), hours)


@query(
    "stream_dedupe",
    "SELECT event_id AS check_id, min(user_id) AS product_id FROM events GROUP BY event_id",
)
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, each kept once."""
    events = _as_checks(_event_stream(spark, sf_dir))
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = S.deduplicated(twice, ["check_id"], "checked_at", "40 days")
    return S.run_to_table(once.select("check_id", "product_id"), S.new_folder(spark, "dedupe"))


# --- streams with a state store ----------------------------------------------


def _in_parts(
    spark: SparkSession, sources: dict[str, tuple[DataFrame, str]], cuts: list[str], start, again=None
) -> None:
    """Deliver tables as files in parts of time and let a stream run after each; every run goes on
    where the one before stopped. ``sources`` gives each folder its rows and their time column;
    ``again`` delivers more with the last part."""
    for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for folder, (rows, at) in sources.items():
            part = rows.filter((F.col(at) >= low) & (F.col(at) < high))
            part.write.mode("append").parquet(folder)
        if again and i == len(cuts) - 2:
            again()
        start().awaitTermination()


@query("stream_controlled_alerts", CONTROLLED_ALERTS_SQL)
def stream_controlled_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and commands in one stream of three parts; a tenth of the first part's checks comes a
    second time with the last one and stays apart as late."""
    folder = S.new_folder(spark, "controlled")
    checks, commands = M.checks(spark, sf_dir), product_commands(spark, sf_dir)
    settings = Settings(failure_limit=3)
    cuts = ["1000-01-01", "1994-07-01", "1997-01-01", "9999-01-01"]

    def start():
        one = spark.readStream.schema(checks.schema).parquet(f"{folder}/checks")
        two = spark.readStream.schema(commands.schema).parquet(f"{folder}/commands")
        return W.run_checks(one, two, settings, folder)

    def again():
        slow = (F.col("checked_at") < cuts[1]) & (F.col("check_id") % 10 == 0)
        checks.filter(slow).write.mode("append").parquet(f"{folder}/checks")

    sources = {f"{folder}/checks": (checks, "checked_at"), f"{folder}/commands": (commands, "at")}
    _in_parts(spark, sources, cuts, start, again)
    found = S.table_of(spark, folder).filter(F.col("type").isin("target_price", "auto_paused"))
    return found.select("product_id", "check_id", "type", "target_paise")


@query("stream_quiet_hold", sql(_plan_sql(True), "SELECT * EXCLUDE (change_pct) FROM plan"))
def stream_quiet_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts in three parts; a hold's end is the time at which its timer went off. The last part is
    followed by a row that only says that two days have passed."""
    folder = S.new_folder(spark, "hold")
    alerts = M.logged_alerts(spark, sf_dir)
    cuts = ["1000-01-01", "2024-01-11", "2024-01-21", "9999-01-01"]

    def start():
        stream = spark.readStream.schema(alerts.schema).parquet(f"{folder}/alerts")
        return W.run_hold(stream, HYGIENE, folder)

    _in_parts(spark, {f"{folder}/alerts": (alerts, "fired_at")}, cuts, start)
    end = M.as_of(M.EVENTS_AS_OF) + F.expr("INTERVAL 2 DAYS")
    W.clock_row(alerts, end).write.mode("append").parquet(f"{folder}/alerts")
    start().awaitTermination()
    return W.outcomes(spark, folder, HYGIENE).select(
        "alert_id", "product_id", "type", "fired_at", "status", "reason", "release_at"
    )
