"""Registered queries: small rules that no larger query reaches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.extract.attempts import clean_sheet_item
from pricelark.model import Settings
from pricelark.operators import alerts as A
from pricelark.operators import control
from pricelark.operators import dashboard as D
from pricelark.operators import digest as G
from pricelark.plans.delivery import inr_sql
from pricelark.plans.registry import PAST_SQL, query, sql
from pricelark.sources import tables as M


@query(
    "worker_heartbeat",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 OR epoch_ms(date_trunc('hour', ts) + INTERVAL 30 MINUTE) - epoch_ms(ts) > 120000
      THEN 'degraded' ELSE 'ok' END AS health FROM events""",
)
def worker_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as the last sign of life before half past its hour; a tenth never gave any."""
    seen = F.when(F.col("event_id") % 10 != 0, F.col("ts"))
    now = F.date_trunc("HOUR", "ts") + F.expr("INTERVAL 30 MINUTES")
    return M.table(spark, sf_dir, "events").select("event_id", D.heartbeat(seen, now).alias("health"))


@query(
    "sheet_items",
    """SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' on orders above ' || p_size ELSE '' END AS item FROM part""",
)
def sheet_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of a side sheet: a position in front, dots and spaces behind."""
    raw = F.concat(
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" OFFER  "), F.col("p_size"), F.lit("  "))).otherwise("Offer 1 "),
        F.regexp_replace("p_name", " ", "\n  "),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" on  orders above "), F.col("p_size"))).otherwise(""),
        F.when(F.col("p_size") % 5 == 0, " . .").otherwise("..."),
    )
    return M.table(spark, sf_dir, "part").select("p_partkey", clean_sheet_item(raw).alias("item"))


@query(
    "settings_split",
    "SELECT p_partkey, p_size % 2 = 0 AS offer_added, p_size % 2 = 0 AS offer_removed FROM part",
)
def settings_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One toggle copied into the two that replace it."""
    rows = M.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("offer_change"))
    return control.split_toggle(rows, "offer_change", "offer_added", "offer_removed")


@query(
    "own_template",
    sql(
        PAST_SQL,
        f"""SELECT product_id, check_id, display_name || ' {{emoji}} ' || {inr_sql('price_paise')} || ' / ' || {inr_sql('target_paise')} || ' -' AS message
        FROM (SELECT rules.*, p.display_name FROM rules JOIN products p USING (product_id) WHERE f_target)""".replace("{emoji}", "🎯"),
    ),
)
def own_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target alerts in the user's own words; a name that no value has is left empty."""
    settings = replace(Settings(), templates={"target_price": "{{productName}} {{ emoji }} {{newPrice}} / {{target}} -{{nothing}}  "})
    found = A.alerts(M.check_log(spark, sf_dir), settings, ["target_price"])
    return G.rendered(found, M.products(spark, sf_dir), settings).select("product_id", "check_id", "message")
