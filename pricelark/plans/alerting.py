"""Registered queries: alert rules and per-product state over the check log."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.model import Settings
from pricelark.operators import alerts as A
from pricelark.operators import sequence as S
from pricelark.operators.slices import running
from pricelark.plans.registry import (
    CHECKS_SQL,
    FAILURES_SQL,
    OFFERS_SQL,
    PAST_SQL,
    query,
    sql,
)
from pricelark.sources.sinks import saved_rows, stored_rows
from pricelark.sources import tables as M

SETTINGS = Settings()


@query(
    "alert_target_price",
    sql(
        PAST_SQL.replace("WITH", ""),
        """, calc AS (SELECT * FROM rules WHERE f_target)
        SELECT product_id, check_id, checked_at AS fired_at,
               CASE WHEN had_success THEN prev_price END AS old_paise,
               price_paise AS new_paise, target_paise, move_pct AS change_pct FROM calc""",
    ),
)
def alert_target_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alerts(M.check_log(spark, sf_dir), SETTINGS, ["target_price"]).select(
        "product_id", "check_id", "fired_at", "old_paise", "new_paise", "target_paise", "change_pct"
    )


@query(
    "alert_threshold_drop",
    sql(
        PAST_SQL,
        """SELECT product_id, check_id, checked_at AS fired_at, prev_price AS old_paise,
               price_paise AS new_paise, limit_bp AS threshold_bp, move_pct AS change_pct
        FROM rules WHERE f_drop""",
    ),
)
def alert_threshold_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alerts(M.check_log(spark, sf_dir), SETTINGS, ["threshold_drop"]).select(
        "product_id", "check_id", "fired_at", "old_paise", "new_paise", "threshold_bp", "change_pct"
    )


@query(
    "alert_price_change",
    sql(
        PAST_SQL,
        """SELECT product_id, check_id, checked_at AS fired_at, prev_price AS old_paise,
               price_paise AS new_paise, move_pct AS change_pct
        FROM rules WHERE f_moved AND NOT f_target AND NOT f_drop""",
    ),
)
def alert_price_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alerts(M.check_log(spark, sf_dir), SETTINGS, ["price_change"]).select(
        "product_id", "check_id", "fired_at", "old_paise", "new_paise", "change_pct"
    )


@query(
    "alert_back_in_stock",
    sql(
        PAST_SQL,
        "SELECT product_id, check_id, checked_at AS fired_at, price_paise AS new_paise FROM rules WHERE f_back",
    ),
)
def alert_back_in_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alerts(M.check_log(spark, sf_dir), SETTINGS, ["back_in_stock"]).select(
        "product_id", "check_id", "fired_at", "new_paise"
    )


def offer_texts(offers: str):
    return F.array_join(
        F.transform(F.col(offers), lambda o: F.concat(o["type"], F.lit("|"), o["description"])), "; "
    )


@query(
    "alert_offer_changes",
    sql(
        OFFERS_SQL,
        """SELECT product_id, check_id, checked_at AS fired_at, 'offer_added' AS type,
               array_to_string(added, '; ') AS offers, price_paise AS new_paise FROM diffs WHERE len(added) > 0
        UNION ALL
        SELECT product_id, check_id, checked_at, 'offer_removed', array_to_string(removed, '; '), price_paise
        FROM diffs WHERE len(removed) > 0""",
    ),
)
def alert_offer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.alerts(M.check_log(spark, sf_dir), SETTINGS, ["offer_added", "offer_removed"])
    side = F.when(F.col("type") == "offer_added", offer_texts("added")).otherwise(offer_texts("removed"))
    return found.select(
        "product_id", "check_id", "fired_at", "type", side.alias("offers"), "new_paise"
    )


@query(
    "alert_auto_paused",
    sql(
        FAILURES_SQL,
        """SELECT product_id, check_id, checked_at AS fired_at, failure_reason,
               CAST(run_len AS BIGINT) AS consecutive_failures FROM pauses""",
    ),
)
def alert_auto_paused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alerts(M.check_log(spark, sf_dir), SETTINGS, ["auto_paused"]).select(
        "product_id", "check_id", "fired_at", "failure_reason", "consecutive_failures"
    )


ALL_ALERTS_SQL = (
    OFFERS_SQL
    + """,
runs AS (
  SELECT product_id, check_id, checked_at, failure_reason, success, fails_upto - coalesce(max(CASE WHEN success THEN fails_upto END) OVER (
      PARTITION BY product_id ORDER BY checked_at, check_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS run_len
  FROM past),
pauses AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY checked_at, check_id) AS nth
    FROM runs WHERE NOT success AND run_len = 5) WHERE nth = 1),
all_alerts AS (
  SELECT product_id, check_id, checked_at AS fired_at, 'target_price' AS type,
         CASE WHEN had_success THEN prev_price END AS old_paise, price_paise AS new_paise, move_pct AS change_pct
  FROM rules WHERE f_target
  UNION ALL SELECT product_id, check_id, checked_at, 'threshold_drop', prev_price, price_paise, move_pct FROM rules WHERE f_drop
  UNION ALL SELECT product_id, check_id, checked_at, 'price_change', prev_price, price_paise, move_pct
            FROM rules WHERE f_moved AND NOT f_target AND NOT f_drop
  UNION ALL SELECT product_id, check_id, checked_at, 'offer_added', NULL, price_paise, NULL FROM diffs WHERE len(added) > 0
  UNION ALL SELECT product_id, check_id, checked_at, 'offer_removed', NULL, price_paise, NULL FROM diffs WHERE len(removed) > 0
  UNION ALL SELECT product_id, check_id, checked_at, 'back_in_stock', NULL, price_paise, NULL FROM rules WHERE f_back
  UNION ALL SELECT product_id, check_id, checked_at, 'auto_paused', NULL, NULL, NULL FROM pauses)"""
)


@query("alerts_all", sql(ALL_ALERTS_SQL, "SELECT * FROM all_alerts"))
def alerts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alerts(M.check_log(spark, sf_dir), SETTINGS).select(
        "product_id", "check_id", "fired_at", "type", "old_paise", "new_paise", "change_pct"
    )


@query("alerts_sliced", sql(ALL_ALERTS_SQL, "SELECT * FROM all_alerts"))
def alerts_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alerts with so low a limit that most products are scanned in slices."""
    return A.alerts(M.check_log(spark, sf_dir), SETTINGS, limit=12).select(
        "product_id", "check_id", "fired_at", "type", "old_paise", "new_paise", "change_pct"
    )


STATE_SQL = (
    OFFERS_SQL
    + """,
runs AS (
  SELECT *, fails_upto - coalesce(max(CASE WHEN success THEN fails_upto END) OVER (
      PARTITION BY product_id ORDER BY checked_at, check_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS run_len
  FROM diffs),
state AS (
  SELECT product_id,
    arg_max(price_paise, check_id) FILTER (is_live) AS current_paise,
    arg_max(mrp_paise, check_id) FILTER (is_live) AS current_mrp_paise,
    arg_max(stock_status, check_id) FILTER (success) AS stock_status,
    arg_max(eff_offers, check_id) FILTER (success) AS current_offers,
    min(price_paise) FILTER (is_live) AS low_paise,
    max(price_paise) FILTER (is_live) AS high_paise,
    arg_max(CASE WHEN success AND price_paise IS NOT NULL AND stock_status <> 'out_of_stock'
                 THEN price_paise <= target_paise ELSE latched END, check_id) AS target_crossed,
    CAST(arg_max(CASE WHEN success THEN 0 ELSE run_len END, check_id) AS BIGINT) AS consecutive_failures,
    max(checked_at) AS last_checked_at,
    max(checked_at) FILTER (success) AS last_success_at,
    max(checked_at) FILTER (is_live AND (prev_price IS NULL OR prev_price <> price_paise)) AS last_changed_at,
    CASE WHEN bool_or(NOT success AND run_len = 5) THEN 'paused_auto' ELSE 'active' END AS status,
    arg_max(failure_reason, check_id) FILTER (NOT success) AS last_failure_reason
  FROM runs GROUP BY product_id)"""
)


PRODUCT_STATE_SQL = sql(
    STATE_SQL,
    "SELECT * EXCLUDE (current_offers), array_to_string(current_offers, '; ') AS current_offers FROM state",
)


@query("product_state", PRODUCT_STATE_SQL)
def product_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = A.product_state(M.check_log(spark, sf_dir), SETTINGS)
    return state.withColumn("current_offers", offer_texts("current_offers"))


@query("product_state_parts", PRODUCT_STATE_SQL)
def product_state_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from three parts of the log, each continuing from the stored state."""
    checks = M.checks(spark, sf_dir)
    cuts = ["1000-01-01", "1995-01-01", "1998-01-01", "9999-01-01"]
    running_state = products = None
    for start, end in zip(cuts, cuts[1:], strict=False):
        part = checks.filter((F.col("checked_at") >= start) & (F.col("checked_at") < end))
        with ExitStack() as until_saved:

            def keep(rows: DataFrame) -> DataFrame:
                return until_saved.enter_context(stored_rows(rows))

            running_state, products = A.continue_state(keep(part), SETTINGS, running_state, products, keep=keep)
            running_state, products = saved_rows(running_state), saved_rows(products)
    return products.withColumn("current_offers", offer_texts("current_offers"))


@query(
    "all_time_low_high",
    sql(
        CHECKS_SQL,
        """SELECT product_id, min(price_paise) FILTER (is_live) AS low_paise,
               max(price_paise) FILTER (is_live) AS high_paise FROM live GROUP BY product_id""",
    ),
)
def all_time_low_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = F.when(S.live(), F.col("price_paise"))
    return (
        M.checks(spark, sf_dir)
        .groupBy("product_id")
        .agg(F.min(live).alias("low_paise"), F.max(live).alias("high_paise"))
    )


@query(
    "running_low_high",
    sql(
        CHECKS_SQL,
        """SELECT product_id, check_id,
             min(CASE WHEN is_live THEN price_paise END) OVER w AS low_paise,
             max(CASE WHEN is_live THEN price_paise END) OVER w AS high_paise
        FROM live WINDOW w AS (PARTITION BY product_id ORDER BY checked_at, check_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
)
def running_low_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = running(S.sliced_log(M.check_log(spark, sf_dir)), S.low_high_specs())
    return src.df.select("product_id", "check_id", "low_paise", "high_paise")


@query(
    "last_changed",
    sql(
        PAST_SQL,
        """SELECT product_id, max(checked_at) AS last_changed_at, count(*) AS changes FROM past
        WHERE is_live AND (prev_price IS NULL OR prev_price <> price_paise) GROUP BY product_id""",
    ),
)
def last_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.annotated(M.check_log(spark, sf_dir), SETTINGS, failures=False, offers=False)
    prev = F.col("prev_price")
    return (
        log.filter(S.live() & (prev.isNull() | (prev != F.col("price_paise"))))
        .groupBy("product_id")
        .agg(F.max("checked_at").alias("last_changed_at"), F.count("*").alias("changes"))
    )


@query(
    "effective_offers",
    sql(
        OFFERS_SQL,
        """SELECT product_id, check_id, array_to_string(prev_offers, '; ') AS prev_offers,
               array_to_string(eff_offers, '; ') AS eff_offers FROM diffs""",
    ),
)
def effective_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.annotated(M.check_log(spark, sf_dir), SETTINGS, failures=False)
    return log.select(
        "product_id",
        "check_id",
        offer_texts("prev_offers").alias("prev_offers"),
        offer_texts("eff_offers").alias("eff_offers"),
    )


@query(
    "failure_runs",
    sql(
        FAILURES_SQL,
        """SELECT product_id, check_id, checked_at, failure_reason, CAST(run_len AS BIGINT) AS run_len
        FROM runs WHERE NOT success""",
    ),
)
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = running(S.sliced_log(M.check_log(spark, sf_dir)), S.failure_specs())
    src = S.with_failures(src, SETTINGS.failure_limit)
    return src.df.filter(~F.col("success")).select(
        "product_id", "check_id", "checked_at", "failure_reason", "run_len"
    )


@query(
    "stock_bands",
    sql(
        CHECKS_SQL,
        """, marked AS (
          SELECT *, sum(CASE WHEN stock_status = 'out_of_stock' THEN 0 ELSE 1 END) OVER (
            PARTITION BY product_id ORDER BY checked_at, check_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
          FROM checks WHERE success)
        SELECT product_id, min(checked_at) AS started, max(checked_at) AS ended, count(*) AS rows
        FROM marked WHERE stock_status = 'out_of_stock' GROUP BY product_id, island""",
    ),
)
def stock_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = M.check_log(spark, sf_dir)
    points = S.CheckLog(log.checks.filter(F.col("success")), log.sizes)
    return S.spans(S.sliced_log(points), F.col("stock_status") == "out_of_stock", "checked_at")


HISTORY_SQL = sql(
    OFFERS_SQL,
    """SELECT check_id, product_id, checked_at, strftime(checked_at, '%Y-%m') AS checked_month, success,
         CASE WHEN success THEN price_paise END AS price_paise,
         CASE WHEN success THEN sha256(array_to_string(list_sort(list_transform(eff_offers, lambda x: 
           split_part(x, '|', 1) || '|' || lower(substr(x, instr(x, '|') + 1)))), chr(10))) END AS offers_hash,
         CASE WHEN success THEN stock_status ELSE 'unknown' END AS stock_status, tier, duration_ms, failure_reason
    FROM diffs""",
)


@query("history_rows", HISTORY_SQL)
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.history_rows(M.check_log(spark, sf_dir), SETTINGS).drop("offers", "mrp_paise")


@query(
    "latest_failure",
    sql(
        CHECKS_SQL,
        """SELECT product_id, arg_max(failure_reason, check_id) AS failure_reason, max(checked_at) AS failed_at
        FROM checks WHERE NOT success GROUP BY product_id""",
    ),
)
def latest_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = M.checks(spark, sf_dir).filter(~F.col("success"))
    return S.latest(
        failed, ["product_id"], ["checked_at", "check_id"], ["failure_reason", "checked_at"]
    ).withColumnRenamed("checked_at", "failed_at")


