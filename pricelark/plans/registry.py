"""The query registry: a Spark callable and, where SQL can say it, its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# The model tables of pricelark.sources.tables, said again in SQL.
PRODUCTS_SQL = """
products AS (
  SELECT p_partkey AS product_id, p_name AS display_name,
         CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS category,
         CASE WHEN p_partkey % 2 = 0 THEN 'amazon_in' ELSE 'flipkart' END AS marketplace,
         CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 ELSE p_partkey - 1 END AS linked_product_id,
         CASE WHEN p_partkey % 2 = 0
              THEN 'https://www.amazon.in/dp/B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')
              ELSE 'https://www.flipkart.com/product/p/itm' || lpad(CAST(p_partkey AS VARCHAR), 13, '0')
         END AS canonical_url,
         CASE WHEN p_partkey % 2 = 0 THEN 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')
              ELSE 'itm' || lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS marketplace_product_id,
         CAST(round(p_retailprice * 100) AS BIGINT) AS mrp_paise,
         (CAST(round(p_retailprice * 100) AS BIGINT) * 93) // 100 AS target_paise,
         CASE WHEN p_size % 10 = 0 THEN 0 WHEN p_size % 10 = 1 THEN 800 END AS threshold_bp,
         CASE WHEN p_size % 4 = 0 THEN 30 WHEN p_size % 4 = 1 THEN 120 END AS interval_minutes,
         1 + p_size % 3 AS priority,
         string_split(replace(lower(p_type) || ',' || p_name, ' ', ','), ',') AS tags,
         TIMESTAMP '1995-01-01' + to_minutes(p_partkey) AS created_at
  FROM part)"""

CHECKS_SQL = (
    PRODUCTS_SQL
    + """,
lines AS (
  SELECT l_partkey, l_shipdate, min(l_discount) AS discount, min(l_tax) AS tax, min(l_suppkey) AS supp,
         min(l_quantity) AS qty, bool_or(l_returnflag = 'R') AS sold_out, bool_or(l_linestatus = 'F') AS browser
  FROM lineitem GROUP BY l_partkey, l_shipdate),
checks AS (
  SELECT l_partkey * 100000 + date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS check_id,
         product_id, l_shipdate AS checked_at, tax < 0.07 AS success,
         CASE WHEN NOT (tax < 0.07) THEN 'unknown' WHEN sold_out THEN 'out_of_stock' ELSE 'in_stock' END AS stock_status,
         CASE WHEN tax < 0.07 AND NOT sold_out
              THEN (products.mrp_paise * (100 - CAST(round(discount * 100) AS BIGINT))) // 100 END AS price_paise,
         CASE WHEN tax < 0.07 AND NOT sold_out THEN products.mrp_paise END AS mrp_paise,
         CASE WHEN tax < 0.07 THEN list_filter([
           CASE WHEN supp % 3 = 0 THEN 'bank_offer|Bank Offer: ' || (5 + supp % 4) || '% off on credit cards' END,
           CASE WHEN qty < 25 THEN 'coupon|Coupon: Save Rs. ' || CAST(50 * (1 + floor(qty / 10)) AS BIGINT) END,
           CASE WHEN browser THEN 'no_cost_emi|No Cost EMI available' END], lambda x: x IS NOT NULL)
           ELSE [] END AS offers,
         CASE WHEN browser THEN 'browser' ELSE 'http' END AS tier,
         CASE WHEN NOT (tax < 0.07) THEN ['fetch_blocked','fetch_timeout','http_error','parse_failed',
              'listing_removed','captcha','other'][supp % 7 + 1] END AS failure_reason,
         CAST(qty * 100 AS INTEGER) AS duration_ms,
         target_paise, CAST(threshold_bp AS BIGINT) AS threshold_bp
  FROM lines JOIN products ON l_partkey = product_id),
live AS (SELECT *, success AND stock_status <> 'out_of_stock' AND price_paise > 0 AS is_live FROM checks)"""
)

# Previous state on every check (closed forms over one ordering).
PAST_SQL = (
    CHECKS_SQL
    + """,
past AS (
  SELECT *,
    last_value(CASE WHEN is_live THEN price_paise END IGNORE NULLS) OVER prior AS prev_price,
    last_value(CASE WHEN success THEN stock_status END IGNORE NULLS) OVER prior AS prev_stock,
    coalesce(last_value(CASE WHEN success AND price_paise IS NOT NULL AND stock_status <> 'out_of_stock'
      THEN price_paise <= target_paise END IGNORE NULLS) OVER prior, FALSE) AS latched,
    coalesce(bool_or(success) OVER prior, FALSE) AS had_success,
    sum(CASE WHEN success THEN 0 ELSE 1 END) OVER upto AS fails_upto
  FROM live
  WINDOW prior AS (PARTITION BY product_id ORDER BY checked_at, check_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upto AS (PARTITION BY product_id ORDER BY checked_at, check_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rules AS (
  SELECT *,
    CASE WHEN had_success AND prev_price IS NOT NULL THEN
      CASE WHEN prev_price <= 0 THEN 0.0 ELSE
        floor(CAST(price_paise - prev_price AS DOUBLE) / prev_price * 10000.0 + 0.5) / 100.0 END END AS move_pct,
    coalesce(threshold_bp, 500) AS limit_bp,
    coalesce(success AND price_paise IS NOT NULL AND stock_status <> 'out_of_stock'
      AND price_paise <= target_paise AND NOT latched, FALSE) AS f_target,
    coalesce(success AND price_paise IS NOT NULL AND had_success AND prev_price > 0
      AND coalesce(threshold_bp, 500) > 0
      AND (prev_price - price_paise) * 10000 >= coalesce(threshold_bp, 500) * prev_price, FALSE) AS f_drop,
    coalesce(success AND had_success AND price_paise <> prev_price, FALSE) AS f_moved,
    coalesce(had_success AND prev_stock = 'out_of_stock' AND stock_status = 'in_stock', FALSE) AS f_back
  FROM past)"""
)

# Effective offers, written as a fold-free restatement over the offer strings.
OFFERS_SQL = (
    PAST_SQL
    + """,
eff AS (
  SELECT *,
    coalesce(last_value(CASE WHEN success AND len(offers) > 0 AND stock_status <> 'out_of_stock' THEN offers END IGNORE NULLS) OVER prior,
             first_value(CASE WHEN success AND len(offers) > 0 THEN offers END IGNORE NULLS) OVER prior, []) AS prev_offers,
    coalesce(last_value(CASE WHEN success AND len(offers) > 0 AND stock_status <> 'out_of_stock' THEN offers END IGNORE NULLS) OVER upto,
             first_value(CASE WHEN success AND len(offers) > 0 THEN offers END IGNORE NULLS) OVER upto, []) AS eff_offers
  FROM rules
  WINDOW prior AS (PARTITION BY product_id ORDER BY checked_at, check_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upto AS (PARTITION BY product_id ORDER BY checked_at, check_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
diffs AS (
  SELECT *,
    CASE WHEN success AND had_success AND NOT ((len(offers) = 0 OR stock_status = 'out_of_stock') AND len(prev_offers) > 0)
         THEN list_filter(offers, lambda x: NOT list_contains(prev_offers, x)) ELSE [] END AS added,
    CASE WHEN success AND had_success AND NOT ((len(offers) = 0 OR stock_status = 'out_of_stock') AND len(prev_offers) > 0)
         THEN list_filter(prev_offers, lambda x: NOT list_contains(offers, x)) ELSE [] END AS removed
  FROM eff)"""
)

FAILURES_SQL = (
    PAST_SQL
    + """,
runs AS (
  SELECT *, fails_upto - coalesce(max(CASE WHEN success THEN fails_upto END) OVER (
      PARTITION BY product_id ORDER BY checked_at, check_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS run_len
  FROM past),
pauses AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY checked_at, check_id) AS nth
    FROM runs WHERE NOT success AND run_len = 5) WHERE nth = 1)"""
)

EVENT_ALERTS_SQL = """
logged AS (
  SELECT event_id AS alert_id,
         CASE WHEN event_type <> 'purchase' THEN user_id END AS product_id,
         CASE event_type WHEN 'click' THEN 'price_change' WHEN 'view' THEN 'threshold_drop'
              WHEN 'signup' THEN 'target_price' WHEN 'error' THEN 'auto_paused'
              ELSE 'system_health' END AS type,
         ts AS fired_at,
         -least(99.0, floor(value * 10) / 100) AS change_pct
  FROM events)"""

AUDIT_SQL = """
audit AS (
  SELECT event_id AS audit_id, user_id AS product_id,
         CASE WHEN user_id % 2 = 0 THEN 'amazon_in' ELSE 'flipkart' END AS marketplace,
         ts AS created_at, event_type <> 'error' AS success,
         CASE WHEN event_type = 'view' THEN 'browser' ELSE 'http' END AS tier,
         k * 1000 + 200 AS main_page, k * 45 AS pincode_api,
         CASE WHEN event_type = 'click' THEN k * 30 ELSE 0 END AS cookie_mint,
         CASE WHEN k % 2 = 0 THEN k * 11 ELSE 0 END AS side_sheet,
         k % 3 AS proxy_retries, 1 + k % 4 AS proxy_requests
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def sql(*parts: str) -> str:
    """WITH-clause parts followed by the final SELECT."""
    return "WITH " + parts[0] + "\n" + "\n".join(parts[1:])
