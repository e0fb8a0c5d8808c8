"""Registered queries: catalogue, history, charts, dashboard, usage, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.extract.attempts import audit_rows, failure_fields
from pricelark.model import Settings
from pricelark.operators import alerts as A
from pricelark.operators import catalogue as C
from pricelark.operators import compare as P
from pricelark.operators import dashboard as D
from pricelark.operators import usage as U
from pricelark.plans.alerting import ALL_ALERTS_SQL, STATE_SQL
from pricelark.plans.registry import (
    AUDIT_SQL,
    CHECKS_SQL,
    EVENT_ALERTS_SQL,
    PRODUCTS_SQL,
    query,
    sql,
)
from pricelark.sources import tables as M

SETTINGS = Settings()


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their current state."""
    return with_state(M.products(spark, sf_dir), A.product_state(M.check_log(spark, sf_dir), SETTINGS))


def with_state(products: DataFrame, state: DataFrame) -> DataFrame:
    return products.join(state, "product_id", "left").withColumns(
        {
            "status": F.coalesce("status", F.lit("active")),
            "stock_status": F.coalesce("stock_status", F.lit("unknown")),
            "consecutive_failures": F.coalesce("consecutive_failures", F.lit(0).cast("bigint")),
            "discount_pct": _discount(),
        }
    )


def _discount():
    from pricelark.functions.money import discount_pct

    return F.when(
        F.col("current_paise").isNotNull(),
        discount_pct(F.col("current_paise"), F.col("current_mrp_paise")),
    )


CATALOGUE_SQL = (
    STATE_SQL
    + """,
catalogue AS (
  SELECT p.*, s.* EXCLUDE (product_id, status, stock_status, consecutive_failures),
    coalesce(s.status, 'active') AS status, coalesce(s.stock_status, 'unknown') AS stock_status,
    coalesce(s.consecutive_failures, 0) AS consecutive_failures,
    CASE WHEN current_paise IS NOT NULL THEN
      CASE WHEN current_mrp_paise IS NULL OR current_mrp_paise <= 0 OR current_paise >= current_mrp_paise THEN 0.0
      ELSE floor(CAST(current_mrp_paise - current_paise AS DOUBLE) / current_mrp_paise * 10000.0 + 0.5) / 100.0 END END AS discount_pct
  FROM products p LEFT JOIN state s USING (product_id))"""
)


@query(
    "table_scan",
    """SELECT p_partkey AS product_id, p_name AS display_name, p_size AS size FROM part""",
)
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("display_name"),
        F.col("p_size").alias("size"),
    )


@query(
    "catalogue_search",
    sql(
        PRODUCTS_SQL,
        """SELECT product_id, display_name, canonical_url FROM products
        WHERE contains(lower(display_name), 'ring') OR contains(lower(canonical_url), 'ring')""",
    ),
)
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = C.CatalogueQuery(search="RING")
    return C.matching(M.products(spark, sf_dir), q).select(
        "product_id", "display_name", "canonical_url"
    )


_PAGE_COLS = "product_id, display_name, priority, current_paise, discount_pct, status"
PAGE_COLUMNS = [*_PAGE_COLS.split(", "), "total", "pages"]


def page_sql(where: str, order: str, size: int, number: int = 1) -> str:
    return sql(
        CATALOGUE_SQL,
        f"""SELECT {_PAGE_COLS}, (SELECT count(*) FROM catalogue WHERE {where}) AS total,
            CAST(ceil((SELECT count(*) FROM catalogue WHERE {where}) / {size}.0) AS BIGINT) AS pages
        FROM catalogue WHERE {where} ORDER BY priority ASC NULLS LAST, {order}, product_id
        LIMIT {size} OFFSET {size * (number - 1)}""",
    )


def _page(spark: SparkSession, sf_dir: str, q: C.CatalogueQuery) -> DataFrame:
    return C.catalogue_page(catalogue(spark, sf_dir), q).select(*PAGE_COLUMNS)


@query("catalogue_page", page_sql("TRUE", "discount_pct DESC NULLS FIRST", 25, 2))
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, C.CatalogueQuery(sort="biggest_drop", page=2))


@query(
    "catalogue_price_band",
    page_sql(
        "marketplace = 'flipkart' AND current_paise >= 85000 AND current_paise <= 95000",
        "current_paise ASC NULLS LAST",
        50,
    ),
)
def catalogue_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = C.CatalogueQuery(
        marketplace="flipkart", min_paise=85000, max_paise=95000, sort="price_asc", page_size=50
    )
    return _page(spark, sf_dir, q)


@query(
    "catalogue_filters",
    sql(
        CATALOGUE_SQL,
        """SELECT product_id, display_name, category, stock_status, consecutive_failures FROM catalogue
        WHERE list_contains(tags, 'promo') AND category IS NULL AND stock_status = 'in_stock'""",
    ),
)
def catalogue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = C.CatalogueQuery(tag="promo", category="none", stock="in_stock")
    return C.matching(catalogue(spark, sf_dir), q).select(
        "product_id", "display_name", "category", "stock_status", "consecutive_failures"
    )


@query(
    "catalogue_health",
    sql(
        CATALOGUE_SQL,
        """SELECT product_id, status, consecutive_failures, status = 'paused_auto' AS auto_paused,
             consecutive_failures > 0 AS failing,
             consecutive_failures = 0 AND status = 'active' AS healthy FROM catalogue""",
    ),
)
def catalogue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).select(
        "product_id",
        "status",
        "consecutive_failures",
        *[F.expr(test).alias(name) for name, test in C.HEALTH.items()],
    )


@query(
    "history_page",
    sql(
        CHECKS_SQL,
        """SELECT product_id, check_id, checked_at, failure_reason FROM (
          SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY checked_at DESC, check_id DESC) AS rn
          FROM checks WHERE NOT success) WHERE rn <= 50""",
    ),
)
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history_page(M.checks(spark, sf_dir), size=50, failed_only=True).select(
        "product_id", "check_id", "checked_at", "failure_reason"
    )


@query(
    "history_keyset",
    sql(
        CHECKS_SQL,
        """SELECT check_id, product_id, checked_at, success FROM checks
        WHERE checked_at > TIMESTAMP '1998-03-01' OR (checked_at = TIMESTAMP '1998-03-01' AND check_id > 1000)
        ORDER BY checked_at, check_id LIMIT 5000""",
    ),
)
def history_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.history_after(
        M.checks(spark, sf_dir), M.as_of("1998-03-01 00:00:00"), F.lit(1000), 5000
    )
    return rows.select("check_id", "product_id", "checked_at", "success")


_CHART_SQL = (
    CHECKS_SQL
    + """, chart AS (SELECT * FROM checks
      WHERE checked_at >= TIMESTAMP '2001-09-01' - INTERVAL 365 DAY AND checked_at <= TIMESTAMP '2001-09-01')"""
)


@query(
    "chart_points",
    sql(
        _CHART_SQL,
        """SELECT product_id, checked_at AS t, price_paise, mrp_paise,
             stock_status = 'out_of_stock' AS out_of_stock FROM chart WHERE success""",
    ),
)
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chart_points(C.chart_rows(M.checks(spark, sf_dir), M.as_of(), 365))


@query(
    "chart_failures",
    sql(_CHART_SQL, "SELECT product_id, checked_at AS t, failure_reason AS reason FROM chart WHERE NOT success"),
)
def chart_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chart_failures(C.chart_rows(M.checks(spark, sf_dir), M.as_of(), 365))


@query(
    "chart_stats",
    sql(
        CHECKS_SQL,
        """SELECT product_id, min(price_paise) FILTER (is_live) AS low_paise, max(price_paise) FILTER (is_live) AS high_paise,
          CAST(floor(CAST(sum(price_paise) FILTER (success) AS DOUBLE) / count(price_paise) FILTER (success) / 100 + 0.5) AS BIGINT) AS average_rupees
        FROM live GROUP BY product_id""",
    ),
)
def chart_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chart_stats(M.checks(spark, sf_dir))


@query(
    "alert_log",
    sql(
        PRODUCTS_SQL + "," + EVENT_ALERTS_SQL,
        """SELECT alert_id, product_id, type, fired_at, display_name, marketplace FROM (
            SELECT * FROM logged WHERE type = 'threshold_drop' ORDER BY fired_at DESC, alert_id DESC LIMIT 100)
        LEFT JOIN products USING (product_id)""",
    ),
)
def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.alert_log(
        M.logged_alerts(spark, sf_dir), M.products(spark, sf_dir), kind="threshold_drop", size=100
    )
    return found.select(
        "alert_id", "product_id", "type", "fired_at", "display_name", "marketplace"
    )


# --- dashboard -------------------------------------------------------------


@query(
    "fleet_status",
    sql(
        CATALOGUE_SQL,
        """SELECT *, paused_auto + failing AS attention,
             CASE WHEN paused_auto + failing > 0 THEN 'attention' ELSE 'healthy' END AS banner FROM (
          SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active,
            count(*) FILTER (status = 'paused_user') AS paused_user,
            count(*) FILTER (status = 'paused_auto') AS paused_auto,
            count(*) FILTER (consecutive_failures > 0 AND status = 'active') AS failing FROM catalogue)""",
    ),
)
def fleet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = D.fleet_status(catalogue(spark, sf_dir))
    return status.withColumn("banner", D.banner(F.lit(False), F.col("attention")))


@query(
    "recent_alerts",
    sql(
        EVENT_ALERTS_SQL,
        """SELECT count(*) AS alerts_24h, count(*) FILTER (type IN ('threshold_drop', 'target_price')) AS drops_24h
        FROM logged WHERE fired_at >= TIMESTAMP '2024-01-30' AND fired_at <= TIMESTAMP '2024-01-31'""",
    ),
)
def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.recent_alerts(M.logged_alerts(spark, sf_dir), M.as_of(M.EVENTS_AS_OF))


@query(
    "success_rate_7d",
    sql(
        CHECKS_SQL,
        """SELECT total, ok, CASE WHEN total > 0 THEN floor(CAST(ok AS DOUBLE) / total * 10000.0 + 0.5) / 100.0 END AS success_rate
        FROM (SELECT count(*) AS total, count(*) FILTER (success) AS ok FROM checks
          WHERE checked_at >= TIMESTAMP '2001-09-01' - INTERVAL 7 DAY AND checked_at <= TIMESTAMP '2001-09-01')""",
    ),
)
def success_rate_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.success_rate(M.checks(spark, sf_dir), M.as_of())


@query(
    "category_counts",
    sql(
        PRODUCTS_SQL,
        """SELECT b.category, count(p.product_id) AS products
        FROM (SELECT DISTINCT p_brand AS category FROM part) b LEFT JOIN products p ON p.category = b.category
        GROUP BY b.category""",
    ),
)
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = M.table(spark, sf_dir, "part").select(F.col("p_brand").alias("category")).distinct()
    return D.category_counts(M.products(spark, sf_dir), labels)


IMPACT_SQL = sql(
    ALL_ALERTS_SQL,
    """SELECT p.product_id, coalesce(h.n, 0) AS history_count, coalesce(a.n, 0) AS alert_count FROM products p
    LEFT JOIN (SELECT product_id, count(*) AS n FROM checks GROUP BY 1) h USING (product_id)
    LEFT JOIN (SELECT product_id, count(*) AS n FROM all_alerts GROUP BY 1) a USING (product_id)""",
)


@query("deletion_impact", IMPACT_SQL)
def deletion_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = M.check_log(spark, sf_dir)
    return D.deletion_impact(M.products(spark, sf_dir), log.checks, A.alerts(log, SETTINGS))


def due_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due in a daily cycle: the products checked the day before, a row per cycle."""
    day = F.date_trunc("DAY", F.col("checked_at")) + F.expr("INTERVAL 1 DAY")
    return M.checks(spark, sf_dir).groupBy(day.alias("cycle")).agg(F.count_distinct("product_id").alias("due"))


@query(
    "cycle_report",
    sql(
        CHECKS_SQL,
        """, due AS (SELECT date_trunc('day', checked_at) + INTERVAL 1 DAY AS cycle, count(DISTINCT product_id) AS due
          FROM checks GROUP BY 1),
        report AS (SELECT date_trunc('day', checked_at) AS cycle, count(*) AS checked, count(*) FILTER (success) AS succeeded,
          count(*) FILTER (NOT success) AS failed, min(checked_at) AS started_at, max(checked_at) AS ended_at
        FROM checks GROUP BY 1)
        SELECT report.*, CAST(coalesce(due, 0) AS BIGINT) AS due FROM report LEFT JOIN due USING (cycle)""",
    ),
)
def cycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = D.cycle_report(M.checks(spark, sf_dir), F.date_trunc("DAY", F.col("checked_at")), due_by_day(spark, sf_dir))
    return report.withColumn("cycle", F.col("cycle").cast("timestamp"))


CYCLE_SQL = sql(
    CHECKS_SQL,
    """, last AS (SELECT max(checked_at) AS t FROM checks WHERE checked_at <= TIMESTAMP '2001-09-01'),
    week AS (SELECT count(*) AS total, count(*) FILTER (success) AS ok FROM checks
      WHERE checked_at >= TIMESTAMP '2001-09-01' - INTERVAL 7 DAY AND checked_at <= TIMESTAMP '2001-09-01')
    SELECT min(checked_at) AS last_cycle_started_at, max(checked_at) AS last_cycle_ended_at, count(*) AS last_cycle_checked,
      count(*) FILTER (success) AS last_cycle_succeeded, count(*) FILTER (NOT success) AS last_cycle_failed,
      any_value(CASE WHEN total > 0 THEN floor(CAST(ok AS DOUBLE) / total * 10000.0 + 0.5) / 100.0 END) AS success_rate_7d,
      (SELECT count(DISTINCT product_id) FROM checks, last
        WHERE date_trunc('day', checked_at) = date_trunc('day', t) - INTERVAL 1 DAY) AS last_cycle_due
    FROM checks, last, week WHERE date_trunc('day', checked_at) = date_trunc('day', t) AND checked_at <= TIMESTAMP '2001-09-01'""",
)


@query("system_status", CYCLE_SQL)
def system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle = F.date_trunc("DAY", F.col("checked_at"))
    return D.system_status(M.checks(spark, sf_dir), cycle, M.as_of(), due_by_day(spark, sf_dir))


@query(
    "check_labels",
    sql(
        CHECKS_SQL,
        """SELECT check_id, CASE WHEN product_id % 2 = 0 THEN 'Amazon India' ELSE 'Flipkart' END AS marketplace_label, CASE failure_reason
            WHEN 'fetch_blocked' THEN 'The marketplace temporarily blocked automated access' WHEN 'fetch_timeout' THEN 'The marketplace did not respond in time'
            WHEN 'http_error' THEN 'The marketplace returned an error' WHEN 'parse_failed' THEN 'The page layout has changed; maintenance may be required'
            WHEN 'listing_removed' THEN 'The listing appears to have been removed' WHEN 'captcha' THEN 'The marketplace presented a verification challenge'
            WHEN 'other' THEN 'An unexpected error occurred' END AS failure_label,
          list_extract(list_transform(offers, lambda x: CASE split_part(x, '|', 1) WHEN 'bank_offer' THEN 'Bank Offer' WHEN 'coupon' THEN 'Coupon' ELSE 'No Cost EMI' END), 1) AS offer_label
        FROM checks""",
    ),
)
def check_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every check as the labels a user sees."""
    from pricelark.functions.render import lookup
    from pricelark.model import FAILURE_REASON_LABELS, MARKETPLACE_LABELS, OFFER_TYPE_LABELS

    market = F.when(F.col("product_id") % 2 == 0, "amazon_in").otherwise("flipkart")
    return M.checks(spark, sf_dir).select(
        "check_id",
        lookup(market, MARKETPLACE_LABELS).alias("marketplace_label"),
        lookup(F.col("failure_reason"), FAILURE_REASON_LABELS).alias("failure_label"),
        lookup(F.get("offers", F.lit(0))["type"], OFFER_TYPE_LABELS).alias("offer_label"),
    )


# --- usage -----------------------------------------------------------------

_USAGE_SQL = (
    AUDIT_SQL
    + """,
usage AS (
  SELECT product_id, grouping(product_id) AS is_total, count(*) AS scrapes, count(*) FILTER (success) AS ok,
    count(*) FILTER (NOT success) AS failed, CAST(sum(proxy_retries) AS BIGINT) AS retries,
    count(*) FILTER (tier = 'browser') AS tier2,
    CAST(sum(main_page + pincode_api + cookie_mint + side_sheet) AS BIGINT) AS wire_bytes,
    CAST(sum(CASE WHEN tier <> 'browser' THEN main_page ELSE 0 END) AS BIGINT) AS http_page,
    CAST(sum(CASE WHEN tier = 'browser' THEN main_page ELSE 0 END) AS BIGINT) AS browser_page,
    CAST(sum(pincode_api) AS BIGINT) AS pincode_api, CAST(sum(cookie_mint) AS BIGINT) AS cookie_mint,
    CAST(sum(side_sheet) AS BIGINT) AS side_sheet
  FROM audit WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AND created_at <= TIMESTAMP '2024-01-31'
  GROUP BY ROLLUP (product_id))"""
)


@query(
    "proxy_usage",
    sql(
        PRODUCTS_SQL + "," + _USAGE_SQL,
        """SELECT usage.* EXCLUDE (is_total), coalesce(display_name, CAST(product_id AS VARCHAR)) AS display_name,
          coalesce(marketplace, '') AS marketplace
        FROM usage LEFT JOIN products USING (product_id) WHERE is_total = 0""",
    ),
)
def proxy_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.usage(M.audit_log(spark, sf_dir), M.products(spark, sf_dir), M.as_of(M.EVENTS_AS_OF), None)
    return rows.orderBy(F.col("wire_bytes").desc(), F.col("product_id").asc())


@query(
    "audit_usage",
    sql(
        PRODUCTS_SQL + "," + _USAGE_SQL,
        """SELECT usage.* EXCLUDE (is_total), coalesce(display_name, CAST(product_id AS VARCHAR)) AS display_name,
          coalesce(marketplace, '') AS marketplace
        FROM usage LEFT JOIN products USING (product_id) WHERE is_total = 0""",
    ),
)
def audit_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage report from our own audit rows, whose blob keeps what came in."""
    none = F.lit(None).cast("bigint")
    outcomes = M.audit_log(spark, sf_dir).withColumns(
        {
            "name": F.lit(None).cast("string"),
            "price_source": F.lit(None).cast("string"),
            "offers": F.array().cast("array<struct<type:string,description:string>>"),
            **{c: none for c in ("price_html", "price_json_ld", "price_embedded_first", "api_price_paise")},
        }
    )
    rows = U.usage(audit_rows(outcomes), M.products(spark, sf_dir), M.as_of(M.EVENTS_AS_OF), None)
    return rows


@query(
    "proxy_usage_rollup",
    sql(_USAGE_SQL, "SELECT * EXCLUDE (is_total), CAST(is_total AS INTEGER) AS is_total FROM usage"),
)
def proxy_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.usage_rollup(M.audit_log(spark, sf_dir), M.as_of(M.EVENTS_AS_OF), 14)


def _pct_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST(floor(CAST({part} AS DOUBLE) / {whole} * 100 + 0.5) AS BIGINT) ELSE 0 END"


@query(
    "proxy_ratios",
    sql(
        _USAGE_SQL,
        "SELECT product_id, CAST(wire_bytes AS DOUBLE) / 14 AS bytes_per_day,"
        + f"{_pct_sql('tier2', 'scrapes')} AS tier2_pct, {_pct_sql('ok', 'scrapes')} AS ok_pct,"
        + "CASE WHEN scrapes > 0 THEN CAST(wire_bytes AS DOUBLE) / scrapes / 1024 ELSE 0.0 END AS kb_per_check,"
        + ", ".join(f"{_pct_sql(k, 'wire_bytes')} AS {k}_pct" for k in U.KIND_COLUMNS)
        + " FROM usage",
    ),
)
def proxy_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.ratios(U.usage_rollup(M.audit_log(spark, sf_dir), M.as_of(M.EVENTS_AS_OF), 14), 14)
    return rows.select(
        "product_id",
        "bytes_per_day",
        "tier2_pct",
        "ok_pct",
        "kb_per_check",
        *[f"{k}_pct" for k in U.KIND_COLUMNS],
    )


@query(
    "byte_tally",
    """WITH req AS (
      SELECT l_orderkey AS check_id, ['main_page','pincode_api','cookie_mint','side_sheet','exit_ip','resolve'][l_linenumber % 6 + 1] AS kind,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS wire_bytes, l_returnflag = 'R' AS retry FROM lineitem)
    SELECT check_id, CAST(sum(wire_bytes) AS BIGINT) AS wire_bytes, count(*) AS requests,
      count(*) FILTER (retry) AS retries, CAST(sum(wire_bytes) FILTER (kind = 'main_page') AS BIGINT) AS main_page_bytes,
      count(DISTINCT kind) AS kinds
    FROM req GROUP BY check_id""",
)
def byte_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelark.model import REQUEST_KINDS

    kinds = F.array(*[F.lit(k) for k in REQUEST_KINDS])
    requests = M.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("check_id"),
        F.element_at(kinds, F.col("l_linenumber") % 6 + 1).alias("kind"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("wire_bytes"),
        (F.col("l_returnflag") == "R").alias("retry"),
    )
    return U.byte_tally(requests).select(
        "check_id",
        "wire_bytes",
        "requests",
        "retries",
        F.col("by_kind")["main_page"]["wire_bytes"].alias("main_page_bytes"),
        F.size("by_kind").cast("bigint").alias("kinds"),
    )


@query(
    "labels",
    """SELECT p_partkey AS product_id,
      CASE WHEN b >= 1000000000 THEN ((b + 5000000) // 1000000000) || '.' || lpad(CAST(((b + 5000000) // 10000000) % 100 AS VARCHAR), 2, '0') || ' GB'
           WHEN b >= 1000000 THEN ((b + 50000) // 1000000) || '.' || (((b + 50000) // 100000) % 10) || ' MB'
           WHEN b >= 1000 THEN ((b + 500) // 1000) || ' KB' ELSE b || ' B' END AS bytes_label,
      CASE WHEN m IS NULL THEN 'default' WHEN m % 60 = 0 THEN (m // 60) || 'h' WHEN m > 60 THEN (m // 60) || 'h ' || (m % 60) || 'm'
           ELSE m || 'm' END AS interval_label
    FROM (SELECT p_partkey, CAST(p_partkey * p_partkey * 321 AS BIGINT) AS b, CASE WHEN p_size % 4 <> 0 THEN p_size * 15 END AS m FROM part)""",
)
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return M.table(spark, sf_dir, "part").select(
        key.alias("product_id"),
        U.bytes_label(key * key * 321).alias("bytes_label"),
        U.interval_label(F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 15)).alias(
            "interval_label"
        ),
    )


# --- comparison ------------------------------------------------------------

_PAIRS_SQL = """,
pairs AS (SELECT a.product_id AS a_id, a.linked_product_id AS b_id FROM products a
          JOIN products b ON a.linked_product_id = b.product_id WHERE a.product_id < b.product_id)"""


@query(
    "pair_compare",
    sql(
        STATE_SQL + _PAIRS_SQL,
        """SELECT a_id, b_id, x.current_paise AS a_paise, y.current_paise AS b_paise,
          CASE WHEN x.current_paise < y.current_paise THEN 'a' WHEN y.current_paise < x.current_paise THEN 'b' END AS cheaper
        FROM pairs LEFT JOIN state x ON x.product_id = a_id LEFT JOIN state y ON y.product_id = b_id""",
    ),
)
def pair_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = A.product_state(M.check_log(spark, sf_dir), SETTINGS)
    return P.pair_compare(M.products(spark, sf_dir), state).select(
        "a_id", "b_id", "a_paise", "b_paise", "cheaper"
    )


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = M.products(spark, sf_dir).select("product_id", "linked_product_id")
    return M.checks(spark, sf_dir).filter(F.col("success")).join(links, "product_id")


_SERIES_SQL = (
    CHECKS_SQL
    + _PAIRS_SQL
    + """,
a AS (SELECT a_id, checked_at AS t, price_paise FROM checks JOIN pairs ON product_id = a_id WHERE success),
b AS (SELECT a_id, checked_at AS t, price_paise FROM checks JOIN pairs ON product_id = b_id WHERE success)"""
)


@query(
    "pair_series",
    sql(
        _SERIES_SQL,
        """SELECT coalesce(a.a_id, b.a_id) AS pair_id, coalesce(a.t, b.t) AS t,
             a.price_paise AS a_paise, b.price_paise AS b_paise
        FROM a FULL OUTER JOIN b ON a.a_id = b.a_id AND a.t = b.t""",
    ),
)
def pair_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_series(M.products(spark, sf_dir), _points(spark, sf_dir))


@query(
    "near_low",
    sql(
        STATE_SQL,
        """SELECT product_id, current_paise, low_paise, current_paise - low_paise AS above_low_paise FROM state
        WHERE current_paise * 10000 <= low_paise * 10200""",
    ),
)
def near_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = A.product_state(M.check_log(spark, sf_dir), SETTINGS)
    return P.near_lows(state, SETTINGS.near_low_pct).select(
        "product_id", "current_paise", "low_paise", "above_low_paise"
    )


@query(
    "range_position",
    sql(
        STATE_SQL,
        """SELECT product_id, p AS position, p <= 15 AS near_low FROM (
          SELECT product_id, least(100.0, greatest(0.0, CAST(current_paise - low_paise AS DOUBLE) / greatest(100, high_paise - low_paise) * 100)) AS p
          FROM state WHERE current_paise IS NOT NULL)""",
    ),
)
def range_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.range_meter(A.product_state(M.check_log(spark, sf_dir), SETTINGS))


@query(
    "low_high_backfill",
    sql(
        CHECKS_SQL,
        """SELECT p.product_id, coalesce(h.low, p.mrp_paise) AS low_paise, coalesce(h.high, p.mrp_paise) AS high_paise
        FROM products p LEFT JOIN (SELECT product_id, min(price_paise) AS low, max(price_paise) AS high FROM live
          WHERE success AND price_paise IS NOT NULL AND stock_status <> 'out_of_stock' GROUP BY 1) h USING (product_id)""",
    ),
)
def low_high_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = M.products(spark, sf_dir).withColumns(
        {"low_paise": F.col("mrp_paise"), "high_paise": F.col("mrp_paise")}
    )
    return P.backfill_low_high(before, M.checks(spark, sf_dir)).select(
        "product_id", "low_paise", "high_paise"
    )


@query(
    "daily_ohlc",
    sql(
        CHECKS_SQL,
        """SELECT product_id, date_trunc('day', checked_at) AS day, min(price_paise) AS low_paise,
          max(price_paise) AS high_paise, arg_max(price_paise, check_id) AS close_paise
        FROM checks WHERE success AND price_paise IS NOT NULL GROUP BY 1, 2""",
    ),
)
def daily_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_ohlc(M.checks(spark, sf_dir))


@query(
    "time_weighted_avg",
    sql(
        CHECKS_SQL,
        """, spans AS (
          SELECT product_id, price_paise, epoch(coalesce(lead(checked_at) OVER (PARTITION BY product_id ORDER BY checked_at, check_id),
            TIMESTAMP '2001-09-01')) - epoch(checked_at) AS secs
          FROM checks WHERE success AND price_paise IS NOT NULL AND checked_at <= TIMESTAMP '2001-09-01')
        SELECT product_id, CAST(sum(secs) AS BIGINT) AS seconds,
          CAST(floor(CAST(sum(CAST(secs AS BIGINT) * price_paise) AS DOUBLE) / CAST(sum(secs) AS BIGINT) + 0.5) AS BIGINT) AS average_paise
        FROM spans GROUP BY product_id""",
    ),
)
def time_weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.time_weighted_average(M.checks(spark, sf_dir), M.as_of())


@query(
    "cheaper_share",
    sql(
        _SERIES_SQL,
        """, times AS (SELECT a_id, t FROM a WHERE price_paise IS NOT NULL UNION SELECT a_id, t FROM b WHERE price_paise IS NOT NULL),
        held AS (
          SELECT times.a_id, times.t, x.price_paise AS pa, y.price_paise AS pb,
            lead(times.t) OVER (PARTITION BY times.a_id ORDER BY times.t) AS t2
          FROM times ASOF LEFT JOIN (SELECT * FROM a WHERE price_paise IS NOT NULL) x ON times.a_id = x.a_id AND times.t >= x.t
                     ASOF LEFT JOIN (SELECT * FROM b WHERE price_paise IS NOT NULL) y ON times.a_id = y.a_id AND times.t >= y.t),
        secs AS (SELECT *, CAST(epoch(t2) - epoch(t) AS BIGINT) AS s FROM held WHERE t2 IS NOT NULL AND pa IS NOT NULL AND pb IS NOT NULL)
        SELECT a_id AS pair_id, CAST(sum(s) AS BIGINT) AS seconds,
          floor(CAST(sum(CASE WHEN pa < pb THEN s ELSE 0 END) AS DOUBLE) / sum(s) * 10000.0 + 0.5) / 100.0 AS a_cheaper_pct,
          floor(CAST(sum(CASE WHEN pb < pa THEN s ELSE 0 END) AS DOUBLE) / sum(s) * 10000.0 + 0.5) / 100.0 AS b_cheaper_pct,
          CAST(floor(CAST(sum(s * abs(pa - pb)) AS DOUBLE) / sum(s) + 0.5) AS BIGINT) AS mean_gap_paise
        FROM secs GROUP BY a_id""",
    ),
)
def cheaper_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cheaper_share(M.products(spark, sf_dir), _points(spark, sf_dir))


@query(
    "parse_collapse",
    sql(
        CHECKS_SQL,
        """SELECT * FROM (SELECT CASE WHEN product_id % 2 = 0 THEN 'amazon_in' ELSE 'flipkart' END AS marketplace,
             checked_at AS window_start, count(*) AS total, count(*) FILTER (success) AS ok
          FROM checks GROUP BY 1, 2) WHERE ok < total * 0.7""",
    ),
)
def parse_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = F.when(F.col("product_id") % 2 == 0, "amazon_in").otherwise("flipkart")
    return P.parse_collapse(M.checks(spark, sf_dir).withColumn("marketplace", market), 1, 0.7)


@query(
    "product_lookup",
    sql(PRODUCTS_SQL, "SELECT product_id, display_name, category, marketplace FROM products WHERE product_id = 42"),
)
def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.by_id(M.products(spark, sf_dir), 42)
    return found.select("product_id", "display_name", "category", "marketplace")


@query(
    "failure_details",
    sql(
        CHECKS_SQL,
        """SELECT check_id, coalesce(nullif(failure_reason, 'captcha'), 'other') AS reason,
          'attempt of ' || duration_ms || ' ms' AS detail FROM checks WHERE NOT success""",
    ),
)
def failure_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks with their reason, or 'other' where none is known."""
    failed = M.checks(spark, sf_dir).filter(~F.col("success"))
    known = F.nullif("failure_reason", F.lit("captcha"))  # stands in for uncategorised ones
    said = F.concat(F.lit("attempt of "), F.col("duration_ms").cast("string"), F.lit(" ms"))
    reason, detail = failure_fields(known, said)
    return failed.select("check_id", reason.alias("reason"), detail.alias("detail"))
