"""The shared tables and their mapping onto the price-observation model.

``part`` plays the catalogue, ``lineitem`` the check log (one row per product and
time), ``events`` the alert log and the audit log, ``pages`` the raw pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelark.model import FAILURE_REASONS
from pricelark.functions.money import discount_pct
from pricelark.operators.sequence import CheckLog

AS_OF = "2001-09-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One shared table. Zone-less timestamps are read as UTC instants by the scan
    itself, so time filters still reach the parquet reader."""
    path = f"{sf_dir}/{name}.parquet"
    raw = spark.read.parquet(path)
    fields = [
        T.StructField(f.name, T.TimestampType() if f.dataType == T.TimestampNTZType() else f.dataType)
        for f in raw.schema.fields
    ]
    schema = T.StructType(fields)
    return raw if schema == raw.schema else spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one part per core, for costly row work.

    Large tables have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: user rules and listing identity, one row per part."""
    even = "p_partkey % 2 = 0"
    item = f"""CASE WHEN {even} THEN concat('B', lpad(p_partkey, 9, '0'))
                    ELSE concat('itm', lpad(p_partkey, 13, '0')) END"""
    site = f"""CASE WHEN {even} THEN 'https://www.amazon.in/dp/'
                    ELSE 'https://www.flipkart.com/product/p/' END"""
    mrp = "CAST(round(p_retailprice * 100) AS BIGINT)"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "p_name AS display_name",
        "CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS category",
        f"CASE WHEN {even} THEN 'amazon_in' ELSE 'flipkart' END AS marketplace",
        f"CASE WHEN {even} THEN p_partkey + 1 ELSE p_partkey - 1 END AS linked_product_id",
        f"concat({site}, {item}) AS canonical_url",
        f"{item} AS marketplace_product_id",
        f"{mrp} AS mrp_paise",
        f"({mrp} * 93) div 100 AS target_paise",
        """CAST(CASE WHEN p_size % 10 = 0 THEN 0 WHEN p_size % 10 = 1 THEN 800 END AS BIGINT)
           AS threshold_bp""",
        "CASE WHEN p_size % 4 = 0 THEN 30 WHEN p_size % 4 = 1 THEN 120 END AS interval_minutes",
        "1 + p_size % 3 AS priority",
        "split(concat(lower(p_type), ',', p_name), '[, ]') AS tags",
        "timestampadd(MINUTE, p_partkey, TIMESTAMP '1995-01-01') AS created_at",
    )


# offers a check saw, from buckets of the lines' own columns
_OFFERS = """array_compact(array(
  CASE WHEN supp % 3 = 0 THEN named_struct('type', 'bank_offer', 'description',
    concat('Bank Offer: ', 5 + supp % 4, '% off on credit cards')) END,
  CASE WHEN qty < 25 THEN named_struct('type', 'coupon', 'description',
    concat('Coupon: Save Rs. ', CAST(50 * (1 + floor(qty / 10)) AS BIGINT))) END,
  CASE WHEN browser THEN named_struct('type', 'no_cost_emi', 'description',
    'No Cost EMI available') END))"""


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (l_partkey, l_shipdate), column-wise: a hash aggregate that combines
    before the shuffle."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_shipdate")
        .agg(
            F.expr("min(l_discount) AS discount"),
            F.expr("min(l_tax) AS tax"),
            F.expr("min(l_suppkey) AS supp"),
            F.expr("min(l_quantity) AS qty"),
            F.expr("bool_or(l_returnflag = 'R') AS sold_out"),
            F.expr("bool_or(l_linestatus = 'F') AS browser"),
        )
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check log with the product's rules on each row (schema ``model.CHECKS``)."""
    rules = products(spark, sf_dir).selectExpr(
        "product_id", "mrp_paise AS list_paise", "target_paise", "threshold_bp"
    )
    reasons = ", ".join(f"'{r}'" for r in FAILURE_REASONS)
    return (
        merged_lines(spark, sf_dir)
        .withColumn("ok", F.expr("tax < 0.07"))
        .join(rules, F.expr("l_partkey = product_id"))
        .selectExpr(
            "l_partkey * 100000 + unix_date(CAST(l_shipdate AS DATE)) AS check_id",
            "product_id",
            "l_shipdate AS checked_at",
            "ok AS success",
            """CASE WHEN NOT ok THEN 'unknown' WHEN sold_out THEN 'out_of_stock'
               ELSE 'in_stock' END AS stock_status""",
            """CASE WHEN ok AND NOT sold_out THEN
               (list_paise * (100 - CAST(round(discount * 100) AS BIGINT))) div 100 END AS price_paise""",
            "CASE WHEN ok AND NOT sold_out THEN list_paise END AS mrp_paise",
            f"""CASE WHEN ok THEN {_OFFERS}
                ELSE CAST(array() AS ARRAY<STRUCT<type: STRING, description: STRING>>) END AS offers""",
            "CASE WHEN browser THEN 'browser' ELSE 'http' END AS tier",
            f"CASE WHEN NOT ok THEN element_at(array({reasons}), CAST(supp % 7 + 1 AS INT)) END AS failure_reason",
            "CAST(qty * 100 AS INT) AS duration_ms",
            "target_paise",
            "threshold_bp",
        )
    )


def check_log(spark: SparkSession, sf_dir: str) -> CheckLog:
    """The checks with an upper bound of their rows per product from one narrow scan."""
    sizes = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("product_id"))
        .agg(F.expr("count(*) AS n"), F.expr("min(l_shipdate) AS lo"), F.expr("max(l_shipdate) AS hi"))
    )
    return CheckLog(checks(spark, sf_dir), sizes)


def logged_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an alert log; purchases are system alerts without a product."""
    return alerts_of(table(spark, sf_dir, "events"))


def alerts_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("alert_id"),
        F.when(kind != "purchase", F.col("user_id")).alias("product_id"),
        F.when(kind == "click", "price_change")
        .when(kind == "view", "threshold_drop")
        .when(kind == "signup", "target_price")
        .when(kind == "error", "auto_paused")
        .otherwise("system_health")
        .alias("type"),
        F.col("ts").alias("fired_at"),
        (-F.least(F.lit(99.0), F.floor(F.col("value") * 10) / 100)).alias("change_pct"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the per-check audit log with its diagnostics blob as JSON text."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kinds = {
        "main_page": k * 1000 + 200,
        "pincode_api": k * 45,
        "cookie_mint": F.when(F.col("event_type") == "click", k * 30),
        "side_sheet": F.when(k % 2 == 0, k * 11),
    }
    by_kind = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    *[F.struct(v.alias("wireBytes")).alias(n) for n, v in kinds.items()]
                ).alias("byKind")
            ).alias("proxy")
        )
    )
    total = sum((F.coalesce(v, F.lit(0)) for v in kinds.values()), F.lit(0))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("audit_id"),
        F.col("user_id").alias("product_id"),
        F.when(F.col("user_id") % 2 == 0, "amazon_in").otherwise("flipkart").alias("marketplace"),
        F.col("ts").alias("created_at"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "view", "browser").otherwise("http").alias("tier"),
        total.cast("bigint").alias("bytes_wire"),
        (1 + k % 4).alias("proxy_requests"),
        (k % 3).alias("proxy_retries"),
        by_kind.alias("debug"),
    )


def with_discount(df: DataFrame) -> DataFrame:
    return df.withColumn("discount_pct", discount_pct(F.col("price_paise"), F.col("mrp_paise")))
