"""Registered queries: pages to snapshots, attempts to outcomes, audit rows, exports.

The shared pages carry no listing markup, so listing pages are written by Spark from
the catalogue rows; the checking SQL states the snapshot from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.extract import attempts, dispatch, layouts
from pricelark.functions import urls
from pricelark.functions.binding import let, settled
from pricelark.model import Settings
from pricelark.operators import alerts as A
from pricelark.operators import usage as U
from pricelark.plans.alerting import ALL_ALERTS_SQL
from pricelark.plans.catalogue import _USAGE_SQL, CATALOGUE_SQL, catalogue
from pricelark.plans.registry import CHECKS_SQL, OFFERS_SQL, PRODUCTS_SQL, query, sql
from pricelark.sources import sinks
from pricelark.sources import tables as M

SETTINGS = Settings()

_CARD = """concat('<div class="offers-items"><h6 class="offers-items-title">Bank Offer</h6><span class="offers-items-content">Upto ₹',
  p_size, ' discount<span class="a-truncate-cut">Upto…</span> on cards.</span><a class="vsx-offers-count">', {count},
  '</a><div data-side-sheet=\\'{{"contentId":"InstantBankDiscount"}}\\'></div></div>')"""


def pages_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layout A page per part, in eight states."""
    item = "concat('B', lpad(p_partkey, 9, '0'))"
    shown = "CAST(CAST(p_retailprice * 9 AS DECIMAL(12,0)) / 10 AS DECIMAL(12,2))"
    core = f"""concat('<div id="corePriceDisplay_desktop_feature_div"><span class="a-price"><span class="a-offscreen">₹', {shown},
      '</span></span><span class="basisPrice">M.R.P.: <span class="a-price a-text-price"><span class="a-offscreen">₹',
      CAST(p_retailprice AS DECIMAL(12,2)), '</span></span></span></div>')"""
    state = "p_partkey % 8"
    body = f"""CASE {state}
      WHEN 0 THEN concat({core}, '<div id="availability"><span> In stock </span></div>', {_CARD.format(count=1)})
      WHEN 1 THEN concat({core}, '<div id="availability">Currently unavailable.</div>')
      WHEN 2 THEN '<form action="/errors/validateCaptcha"></form>'
      WHEN 3 THEN concat({core}, '<div id="availability">In stock</div>')
      WHEN 4 THEN concat('<span id="priceblock_ourprice">Rs. ', {shown}, '</span>')
      WHEN 5 THEN concat({core}, '<div id="availability">In stock</div>', {_CARD.format(count=3)})
      WHEN 6 THEN '<div id="availability">Only 2 left in stock</div>'
      ELSE concat({core}, '<div id="availability">In stock</div>', {_CARD.format(count=2)}) END"""
    html = f"""concat('<!doctype html><html><head><link rel="canonical" href="https://www.amazon.in/dp/',
      CASE WHEN {state} = 3 THEN 'B999999999' ELSE {item} END, '"></head><body><span id="productTitle"> ', p_name, ' &amp; more </span>',
      '<img id="landingImage" src="https://img/', p_partkey, '.jpg">', {body}, '</body></html>')"""
    expanded = f"""CASE WHEN {state} = 7 THEN array(
      named_struct('label', 'Bank Offer', 'description', concat('10% off on  card ', p_size)),
      named_struct('label', 'Bank Offer', 'description', concat('10% OFF on card ', p_size, '. .')),
      named_struct('label', CAST(NULL AS STRING), 'description', 'Exchange bonus')) END"""
    return M.spread(M.table(spark, sf_dir, "part")).selectExpr(
        "p_partkey AS page_id",
        f"concat('https://www.amazon.in/slug/dp/', {item}, '/ref=x') AS url",
        f"{html} AS html",
        f"{expanded} AS expanded_offers",
    )


_A_SQL = """
base AS (SELECT *, p_partkey % 8 AS st, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS item,
    CAST(CAST(p_retailprice * 9 AS DECIMAL(12,0)) * 10 AS BIGINT) AS sale, CAST(round(p_retailprice * 100) AS BIGINT) AS list FROM part),
snap AS (SELECT p_partkey AS page_id, CASE st WHEN 2 THEN 'captcha' WHEN 3 THEN 'parse_failed' WHEN 5 THEN 'parse_failed' WHEN 6 THEN 'parse_failed' END AS failure_reason,
    CASE WHEN st IN (0, 4, 7) THEN sale END AS price, CASE WHEN st IN (0, 7) THEN list WHEN st = 4 THEN sale END AS mrp, * FROM base)"""


@query(
    "snapshot_extract_a",
    sql(
        _A_SQL,
        """SELECT page_id, failure_reason IS NULL AS success, failure_reason, CASE WHEN failure_reason IS NULL THEN item END AS marketplace_product_id,
          CASE WHEN failure_reason IS NULL THEN p_name || ' & more' END AS name, price AS price_paise, mrp AS mrp_paise,
          CASE WHEN failure_reason IS NULL THEN CASE WHEN price IS NULL OR price >= mrp THEN 0.0
            ELSE floor(CAST(mrp - price AS DOUBLE) / mrp * 10000.0 + 0.5) / 100.0 END END AS discount_pct,
          CASE WHEN failure_reason IS NULL THEN CASE WHEN st = 1 THEN 'out_of_stock' ELSE 'in_stock' END END AS stock_status,
          CASE st WHEN 0 THEN 'bank_offer|Upto ₹' || p_size || ' discount on cards.'
                  WHEN 7 THEN 'bank_offer|10% off on card ' || p_size || '; exchange|Exchange bonus'
                  ELSE CASE WHEN failure_reason IS NULL THEN '' END END AS offers,
          CASE WHEN price IS NOT NULL THEN 'buy-box' END AS price_source FROM snap""",
    ),
)
def snapshot_extract_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layouts.extract_a(pages_a(spark, sf_dir))
    return _flat(found).select(
        "page_id",
        "success",
        "failure_reason",
        "marketplace_product_id",
        "name",
        "price_paise",
        "mrp_paise",
        "discount_pct",
        "stock_status",
        "offers",
        "price_source",
    )


def _flat(snapshots: DataFrame) -> DataFrame:
    texts = F.transform("offers", lambda o: F.concat(o["type"], F.lit("|"), o["description"]))
    return snapshots.withColumn("offers", F.array_join(texts, "; "))


def pages_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layout B page per part, in seven states."""
    item = "concat('itm', lpad(p_partkey, 13, '0'))"
    whole = "CAST(floor(p_retailprice) AS BIGINT)"
    state = "p_partkey % 7"
    ld = """concat('<script type="application/ld+json">{{"@type":{kind},"name":"', p_name, '","image":["https://img/', p_partkey,
      '.jpg"],"offers":{{"price":"', {price}, '","availability":"https://schema.org/{stock}"}}}}</script>')"""
    good = ld.format(kind='"Product"', price=whole, stock="InStock")
    listed = ld.format(kind='["Thing","Product"]', price=whole, stock="InStock")
    sold = ld.format(kind='"Product"', price=whole, stock="SoldOut")
    lines = f"""concat('<strike>₹', {whole} + 100, '</strike><ul><li>Bank Offer: ', p_size, '% cashback<li>Free delivery<li>Bank  offer: ', p_size, '% Cashback .</ul>')"""
    blob = f"""concat('<script>window.__INITIAL_STATE__ = {{"a":{{"finalPrice":"', {whole}, '","mrp":', {whole} + 50,
      '}},"offers":[{{"type":"NepOffers","offerTitle":"Axis","offerType":"PBO","offerSubTitleRC":{{"x":{{"contentValue":"Credit Card • Cashback"}}}},"v":{{"metaInfoLabelValue":"₹', p_size, '0 off"}}}},',
      '{{"type":"NepOffers","offerTitle":"HDFC","tenure":6,"offerSubTitleRC":{{"contentValue":"Credit Card"}},"metaInfoLabelValue":"₹99 off/m (6 months)"}},',
      '{{"type":"NepOffers","offerTitle":"SBI","tenure":3,"offerSubTitleRC":{{"contentValue":"Credit Card • ₹500 off"}}}},',
      '{{"type":"NepOffers","offerTitle":"Exchange","offerType":"EXCHANGE","offerSubTitleRC":{{"contentValue":"Change pincode"}}}}]}};</script>')"""
    body = f"""CASE {state}
      WHEN 0 THEN concat({good}, '<h1>', p_name, '</h1>', {lines})
      WHEN 1 THEN concat('<h1><span>', p_name, '</span></h1>', {blob})
      WHEN 2 THEN {sold}
      WHEN 3 THEN '<p>Request blocked</p>'
      WHEN 4 THEN concat('<h1>', p_name, '</h1><div class="x-price-y">now ₹ ', {whole}, '.50</div><div class="price">₹1</div>')
      WHEN 5 THEN concat({listed}, {lines})
      ELSE concat({good}, '<h1>x</h1>') END"""
    html = f"""concat('<html><head><title>', p_name, ' - Flipkart.com</title><link rel="canonical" href="https://www.flipkart.com/s/p/',
      CASE WHEN {state} = 6 THEN 'itm9999999999999' ELSE {item} END, '"></head><body>', {body}, '</body></html>')"""
    return M.spread(M.table(spark, sf_dir, "part")).selectExpr(
        "p_partkey AS page_id",
        f"concat('https://www.flipkart.com/product/p/', {item}) AS url",
        f"{html} AS html",
        f"CASE WHEN {state} = 5 THEN CASE WHEN p_size > 25 THEN 'out_of_stock' ELSE 'in_stock' END END AS local_stock",
        f"CASE WHEN {state} = 5 AND p_size <= 25 THEN {whole} * 90 END AS local_price_paise",
        f"CASE WHEN {state} = 5 AND p_size <= 25 THEN {whole} * 95 END AS local_mrp_paise",
    )


_B_SQL = """
base AS (SELECT *, p_partkey % 7 AS st, 'itm' || lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS item, CAST(floor(p_retailprice) AS BIGINT) AS w FROM part),
snap AS (SELECT p_partkey AS page_id, CASE st WHEN 3 THEN 'fetch_blocked' WHEN 6 THEN 'parse_failed' END AS failure_reason,
    CASE st WHEN 0 THEN w * 100 WHEN 1 THEN w * 100 WHEN 4 THEN w * 100 + 50 WHEN 5 THEN CASE WHEN p_size <= 25 THEN w * 90 END END AS price,
    CASE st WHEN 0 THEN (w + 100) * 100 WHEN 1 THEN (w + 50) * 100 WHEN 4 THEN w * 100 + 50 WHEN 5 THEN CASE WHEN p_size <= 25 THEN w * 95 END END AS mrp, * FROM base)"""


@query(
    "snapshot_extract_b",
    sql(
        _B_SQL,
        """SELECT page_id, failure_reason IS NULL AS success, failure_reason, CASE WHEN failure_reason IS NULL THEN item END AS marketplace_product_id,
          CASE WHEN failure_reason IS NULL THEN p_name END AS name, price AS price_paise, mrp AS mrp_paise,
          CASE WHEN failure_reason IS NULL THEN CASE WHEN price IS NULL OR price >= mrp THEN 0.0
            ELSE floor(CAST(mrp - price AS DOUBLE) / mrp * 10000.0 + 0.5) / 100.0 END END AS discount_pct,
          CASE WHEN failure_reason IS NULL THEN CASE WHEN price IS NULL THEN 'out_of_stock' ELSE 'in_stock' END END AS stock_status,
          CASE WHEN st IN (0, 5) THEN 'bank_offer|Bank Offer: ' || p_size || '% cashback'
               WHEN st = 1 THEN 'bank_offer|Axis — Credit Card • Cashback — ₹' || p_size || '0 off; emi|SBI — Credit Card • ₹500 off'
               ELSE CASE WHEN failure_reason IS NULL THEN '' END END AS offers,
          CASE WHEN price IS NOT NULL THEN CASE st WHEN 0 THEN 'jsonld' WHEN 1 THEN 'embedded-json' WHEN 4 THEN 'price-element' ELSE 'pincode-api' END END AS price_source
        FROM snap""",
    ),
)
def snapshot_extract_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layouts.extract_b(pages_b(spark, sf_dir))
    return _flat(found).select(
        "page_id",
        "success",
        "failure_reason",
        "marketplace_product_id",
        "name",
        "price_paise",
        "mrp_paise",
        "discount_pct",
        "stock_status",
        "offers",
        "price_source",
    )


def _unescape_sql(text: str) -> str:
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return f"trim({text})"


@query(
    "page_extract",
    f"""SELECT page_id, {_unescape_sql("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')")} AS heading,
      {_unescape_sql("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's')")} AS title FROM pages""",
)
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    wants = layouts.picker([layouts.Want("h1", "h1"), layouts.Want("title", "title")])
    found = M.spread(M.table(spark, sf_dir, "pages")).withColumn("hits", wants(F.col("html")))
    return found.select(
        "page_id",
        F.coalesce(F.trim(layouts._one("h1")), F.lit("")).alias("heading"),
        F.coalesce(F.trim(layouts._one("title")), F.lit("")).alias("title"),
    )


@query(
    "page_walls",
    r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)validateCaptcha|Type the characters you see in this image') THEN 'captcha'
       WHEN regexp_matches(html, '(?i)To discuss automated access to Amazon data|api-services-support@amazon\.com') THEN 'fetch_blocked'
       WHEN regexp_matches(html, '(?is)Looking for something\?.*we can(?:''|no)t find that page') THEN 'listing_removed' END AS wall_a,
     CASE WHEN NOT (regexp_matches(html, '"@type"\s*:\s*"Product"') OR regexp_matches(html, '"(?:finalPrice|sellingPrice)"\s*:')) THEN
       CASE WHEN regexp_matches(html, '(?i)are you a human|unusual traffic|verify you''?re not a robot') THEN 'captcha'
         WHEN regexp_matches(html, '(?i)access denied|request blocked') THEN 'fetch_blocked'
         WHEN regexp_matches(html, '(?i)this page (?:is|was) unavailable|product (?:is )?no longer available') THEN 'listing_removed' END END AS wall_b FROM pages""",
)
def page_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = F.lit(False)
    for sign in layouts.PRODUCT_SIGNS_B:
        looks = looks | F.col("html").rlike(sign)
    return M.table(spark, sf_dir, "pages").select(
        "page_id",
        layouts._wall(layouts.WALLS_A).alias("wall_a"),
        F.when(~looks, layouts._wall(layouts.WALLS_B)).alias("wall_b"),
    )


# --- attempts --------------------------------------------------------------


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing responses of every customer's orders: one check per customer, an attempt per order."""
    price = "CAST(floor(o_totalprice) AS BIGINT)"
    kind = "o_orderkey % 6"
    component = f"""concat('{{"widget":[{{"pincode":', CASE WHEN {kind} = 3 THEN '110001' ELSE '"560001"' END, ',"sellerCount":2,"city":"Pune"',
      CASE WHEN {kind} = 2 THEN ',"errorCode":"NO_SERVICEABLE_SELLER"' ELSE '' END, '}}]}}')"""
    pls = f"""CASE WHEN {kind} = 1 THEN '{{"isAvailable":false,"availabilityStatus":"OUT_OF_STOCK"}}' ELSE '{{"isAvailable":true,"availabilityStatus":"IN_STOCK"}}' END"""
    final = f"""CASE WHEN {kind} = 5 THEN concat('"fsp":{{"value":', {price}, '}}') ELSE concat('"finalPrice":', {price}) END"""
    json = f"""concat('{{"RESPONSE":{{"pageData":{{"pageContext":{{"pricing":{{', {final}, ',"mrp":', {price} + o_custkey % 3 - 1,
      '}},"fdpEventTracking":{{"events":{{"psi":{{"pls":', {pls}, '}}}}}}}}}},"slots":', {component}, '}}}}')"""
    return M.spread(M.table(spark, sf_dir, "orders")).selectExpr(
        "o_custkey AS check_id",
        "o_orderkey AS attempt",
        f"CASE WHEN {kind} = 4 THEN 503 ELSE 200 END AS status",
        f"{json} AS json",
        "'560001' AS pincode",
    )


@query(
    "attempt_resolution",
    """WITH a AS (SELECT o_custkey AS check_id, o_orderkey AS attempt, o_orderkey % 6 AS kind, CAST(floor(o_totalprice) AS BIGINT) * 100 AS price,
        (CAST(floor(o_totalprice) AS BIGINT) + o_custkey % 3 - 1) * 100 AS mrp FROM orders),
      g AS (SELECT check_id, min(attempt) FILTER (kind IN (0, 1, 5)) AS first, count(*) FILTER (kind IN (0, 2, 3, 5)) AS votes,
        count(*) FILTER (kind = 2) AS nos, count(*) AS tried FROM a GROUP BY 1)
    SELECT g.check_id, CASE WHEN kind = 1 OR (first IS NULL AND votes > 0 AND votes = nos) THEN 'out_of_stock' WHEN first IS NOT NULL THEN 'in_stock' END AS local_stock,
      CASE WHEN kind <> 1 THEN price END AS local_price_paise, CASE WHEN kind <> 1 AND mrp >= price THEN mrp END AS local_mrp_paise,
      first IS NOT NULL AS verified, CAST(coalesce(first, tried) AS INTEGER) AS attempts,
      first IS NULL AND NOT (votes > 0 AND votes = nos) AS failed
    FROM g LEFT JOIN a ON a.attempt = g.first""",
)
def attempt_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.resolve_pricing(responses(spark, sf_dir))


@query(
    "location_resolution",
    """WITH a AS (SELECT o_custkey AS check_id, o_orderkey AS attempt, o_orderkey % 4 = 0 AS applied, o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS gone FROM orders),
      g AS (SELECT check_id, min(attempt) FILTER (applied OR gone) AS first, count(*) AS tried FROM a GROUP BY 1)
    SELECT g.check_id, CAST(coalesce(first, tried) AS INTEGER) AS attempts, coalesce(applied, FALSE) AS location_applied,
      CASE WHEN first IS NULL THEN 'other' END AS failure_reason FROM g LEFT JOIN a ON a.attempt = g.first""",
)
def location_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS check_id",
        "o_orderkey AS attempt",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'Mumbai 400001' WHEN o_orderkey % 4 = 1 THEN 'Delhi 110001' END AS resolved_location",
        "'400001' AS pincode",
        "o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS out_of_stock",
    )
    return attempts.resolve_location(rows)


@query(
    "tier_choice",
    """WITH t AS (SELECT o_orderkey AS check_id, o_orderstatus = 'F' AS ok1, ['fetch_blocked','fetch_timeout','captcha','http_error','parse_failed'][o_orderkey % 5 + 1] AS r1,
        o_custkey % 2 = 0 AS has2, o_custkey % 3 = 0 AS ok2 FROM orders),
      u AS (SELECT *, has2 AND NOT ok1 AND r1 IN ('fetch_blocked', 'captcha', 'parse_failed') AS esc FROM t)
    SELECT check_id, CASE WHEN esc THEN 'browser' ELSE 'http' END AS tier, CASE WHEN esc THEN ok2 ELSE ok1 END AS success,
      CASE WHEN esc THEN CASE WHEN NOT ok2 THEN 'other' END ELSE CASE WHEN NOT ok1 THEN r1 END END AS failure_reason FROM u""",
)
def tier_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = M.table(spark, sf_dir, "orders")
    first = orders.selectExpr(
        "o_orderkey AS check_id",
        "'http' AS tier",
        "o_orderstatus = 'F' AS success",
        """CASE WHEN o_orderstatus <> 'F' THEN element_at(array('fetch_blocked', 'fetch_timeout', 'captcha',
           'http_error', 'parse_failed'), CAST(o_orderkey % 5 + 1 AS INT)) END AS failure_reason""",
    )
    second = orders.filter("o_custkey % 2 = 0").selectExpr(
        "o_orderkey AS check_id",
        "'browser' AS tier",
        "o_custkey % 3 = 0 AS success",
        "CASE WHEN o_custkey % 3 <> 0 THEN 'other' END AS failure_reason",
    )
    return attempts.choose_tier(first.unionByName(second))


@query(
    "fetch_failures",
    """SELECT o_orderkey AS check_id, CASE WHEN timed THEN 'fetch_timeout' WHEN s IN (404, 410) THEN 'listing_removed'
        WHEN s IN (403, 429, 503) THEN 'fetch_blocked' WHEN s >= 400 THEN 'http_error' END AS reason
      FROM (SELECT *, [200, 404, 403, 500, 301, 429, 410][o_orderkey % 7 + 1] AS s, o_custkey % 10 = 0 AS timed FROM orders)""",
)
def fetch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr(
        "element_at(array(200, 404, 403, 500, 301, 429, 410), CAST(o_orderkey % 7 + 1 AS INT))"
    )
    reason = attempts.failure_from_status(status, F.expr("o_custkey % 10 = 0"))
    return M.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("check_id"), reason.alias("reason")
    )


# what a check brings: diagnostics as an object that has some of the facts' names, an array, a broken text or none
_DEBUG = """CASE check_id % 4 WHEN 0 THEN concat('{"exitIp": "10.0.0.', product_id % 250, '", "name": "old", "offers": [1]}')
  WHEN 1 THEN concat('[', product_id, ', "x"]') WHEN 2 THEN concat('{"cut off ', product_id) END"""


@query(
    "audit_rows",
    sql(
        CHECKS_SQL,
        """, seen AS (SELECT *, CASE WHEN check_id % 2 = 0 THEN price_paise + 100 END AS ld, CASE WHEN check_id % 3 = 0 THEN price_paise + 200 END AS embedded,
            CASE WHEN check_id % 5 = 0 THEN price_paise + 305 END AS api FROM checks)
        SELECT check_id, success, failure_reason, len(offers) AS offers_count,
          CASE WHEN len(offers) > 0 THEN sha256(array_to_string(list_sort(list_transform(offers, lambda x: split_part(x, '|', 1) || '|' || lower(substr(x, instr(x, '|') + 1)))), chr(10))) END AS offers_hash,
          coalesce(array_to_string(list_transform(offers, lambda x: replace(x, '|', ':')), '; '), '') AS items,
          array_to_string(list_filter([CASE WHEN ld IS NOT NULL THEN 'jsonld=' || ld END, CASE WHEN embedded IS NOT NULL THEN 'embedded-json=' || embedded END,
            CASE WHEN price_paise IS NOT NULL THEN 'html-winner=' || price_paise END, CASE WHEN api IS NOT NULL THEN 'pincode-api=' || api END], lambda x: x IS NOT NULL), ';') AS candidates,
          CASE WHEN price_paise IS NOT NULL THEN 'buy-box' END AS price_from,
          CAST(price_paise // 100 AS VARCHAR) || '.' || lpad(CAST(price_paise % 100 AS VARCHAR), 2, '0') AS price_html,
          CASE check_id % 4 WHEN 0 THEN 'exitIp,' WHEN 1 THEN 'value,' WHEN 2 THEN 'text,' ELSE '' END || 'name,offers,priceCandidates,provenance' AS keys,
          CASE check_id % 4 WHEN 0 THEN '10.0.0.' || (product_id % 250) WHEN 1 THEN '[' || product_id || ',"x"]' WHEN 2 THEN '{"cut off ' || product_id END AS own FROM seen""",
    ),
)
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows with every price signal, over diagnostics of every kind."""
    price, check = F.col("price_paise"), F.col("check_id")
    outcomes = M.checks(spark, sf_dir).withColumns(
        {
            "name": F.lit(None).cast("string"),
            "price_source": F.when(price.isNotNull(), "buy-box"),
            "price_html": price,
            "price_json_ld": F.when(check % 2 == 0, price + 100),
            "price_embedded_first": F.when(check % 3 == 0, price + 200),
            "api_price_paise": F.when(check % 5 == 0, price + 305),
            "debug": F.expr(_DEBUG),
        }
    )
    shape = """offers struct<items:array<string>>, priceCandidates array<struct<source:string,value_paise:bigint>>,
      provenance struct<price:string,priceHtml:string>, exitIp string, value string, text string"""
    read = {"_b": F.from_json("debug", shape), "_names": F.sort_array(F.json_object_keys("debug"))}
    rows = settled(attempts.audit_rows(outcomes).withColumns(read))
    found = F.transform("_b.priceCandidates", lambda c: F.concat_ws("=", c["source"], c["value_paise"].cast("string")))
    # the facts' names in order, behind what came in under other names
    names = F.col("_names")
    facts = F.array_intersect(names, F.array(*[F.lit(k) for k in ("name", "offers", "priceCandidates", "provenance")]))
    return rows.select(
        "check_id",
        "success",
        "failure_reason",
        F.col("offers_count").cast("bigint").alias("offers_count"),
        "offers_hash",
        F.array_join("_b.offers.items", "; ").alias("items"),
        F.array_join(found, ";").alias("candidates"),
        F.col("_b.provenance.price").alias("price_from"),
        F.col("_b.provenance.priceHtml").alias("price_html"),
        F.array_join(F.concat(F.array_except(names, facts), facts), ",").alias("keys"),
        F.coalesce("_b.exitIp", "_b.value", "_b.text").alias("own"),
    )


# --- a site that no module names -------------------------------------------


def bazaar() -> urls.Site:
    """A third marketplace: items under a language and a number, the name in the page's heading."""

    def listing(path: Column, _: Column) -> Column:
        found = F.regexp_extract_all(path, F.lit("^/[a-z]{2}/([0-9]+)(?:[.]html)?/?$"), F.lit(1))
        return let(
            F.try_element_at(found, F.lit(1)),
            lambda x: urls.found_listing(x, x, F.concat(F.lit("https://bazaar.example/item/"), x)),
        )

    def extract(pages: DataFrame) -> DataFrame:
        hits = layouts.picker([layouts.Want("h1", "h1")])
        read = pages.withColumn("hits", hits(F.col("html")))
        name = F.nullif(F.trim(F.coalesce(layouts._one("h1"), F.lit(""))), F.lit(""))
        return read.select(
            "page_id", F.lit("bazaar").alias("marketplace"), name.alias("name"), name.isNotNull().alias("success")
        )

    return urls.Site("bazaar", "Bazaar", ("example.com", "example.net", "example.org"), listing, extract)


_HEADING_SQL = _unescape_sql("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')")


@query(
    "third_site",
    f"""WITH p AS (SELECT page_id, nullif(regexp_extract(url, '^https?://[^/?#]*(/[a-z]{{2}}/([0-9]+)([.]html)?/?)([?#].*)?$', 2), '') AS id,
        {_HEADING_SQL} AS heading FROM pages)
    SELECT page_id, CASE WHEN id IS NULL THEN 'not_a_listing' ELSE 'listing' END AS kind, 'bazaar' AS marketplace,
      'https://bazaar.example/item/' || id AS canonical_url, id AS marketplace_product_id, nullif(heading, '') AS name, heading <> '' AS success FROM p""",
)
def third_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs recognised and pages read through a registry with a site registered here."""
    registry = dispatch.site_registry()
    registry.register(bazaar())
    pages = M.spread(M.table(spark, sf_dir, "pages"))
    known = pages.select("page_id", urls.recognise(F.col("url"), registry).alias("r")).select(
        "page_id", "r.kind", "r.marketplace", "r.canonical_url", "r.marketplace_product_id"
    )
    read = dispatch.snapshots(pages, registry).select("page_id", "name", "success")
    return known.join(read, "page_id")


# --- exports ---------------------------------------------------------------


@query(
    "export_products",
    sql(
        CATALOGUE_SQL,
        """SELECT canonical_url AS url, display_name AS name, CAST(target_paise / 100.0 AS DECIMAL(12,2)) AS "target price",
          CAST(threshold_bp / 100.0 AS DECIMAL(5,2)) AS threshold, array_to_string(tags, ', ') AS tags, marketplace, status,
          CAST(current_paise / 100.0 AS DECIMAL(12,2)) AS "current price", stock_status AS stock,
          CAST(low_paise / 100.0 AS DECIMAL(12,2)) AS "all-time low", CAST(high_paise / 100.0 AS DECIMAL(12,2)) AS "all-time high",
          strftime(last_checked_at, '%Y-%m-%dT%H:%M:%S.000Z') AS "last checked (UTC)" FROM catalogue""",
    ),
)
def export_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark, sf_dir).withColumn("notes", F.lit(""))
    return sinks.export_products(rows).drop("notes", "mrp", "_created_at", "_id")


@query(
    "export_history",
    sql(
        OFFERS_SQL,
        """SELECT p.display_name AS product, p.marketplace, strftime(checked_at, '%Y-%m-%dT%H:%M:%S.000Z') AS "checked at (UTC)",
          CASE WHEN success THEN 'yes' ELSE 'no' END AS success, CAST(CASE WHEN success THEN price_paise END / 100.0 AS DECIMAL(12,2)) AS price,
          CASE WHEN success THEN stock_status ELSE 'unknown' END AS stock, coalesce(failure_reason, '') AS "failure reason"
        FROM diffs JOIN products p ON p.product_id = diffs.product_id""",
    ),
)
def export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = M.with_discount(A.history_rows(M.check_log(spark, sf_dir), SETTINGS))
    rows = sinks.export_history(history, M.products(spark, sf_dir))
    return rows.drop("mrp", "discount %", "offers", "_at", "_id")


@query(
    "export_usage",
    sql(
        PRODUCTS_SQL + "," + _USAGE_SQL,
        """SELECT display_name AS product, marketplace, scrapes, ok AS succeeded, failed, retries, tier2 AS "tier-2 (browser)",
          ((wire_bytes + 50000) // 1000000) || '.' || (((wire_bytes + 50000) // 100000) % 10) AS "wire MB",
          CAST(CAST(floor(CAST(wire_bytes AS DOUBLE) / scrapes / 1024 + 0.5) AS BIGINT) AS VARCHAR) AS "KB / scrape"
        FROM usage JOIN products USING (product_id) WHERE is_total = 0""",
    ),
)
def export_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.usage(M.audit_log(spark, sf_dir), M.products(spark, sf_dir), M.as_of(M.EVENTS_AS_OF), None)
    return sinks.export_usage(rows).select(
        "product",
        "marketplace",
        "scrapes",
        "succeeded",
        "failed",
        "retries",
        "`tier-2 (browser)`",
        "`wire MB`",
        "`KB / scrape`",
    )


@query(
    "export_audit",
    sql(
        PRODUCTS_SQL
        + """, a AS (SELECT event_id, user_id, ts, event_type, CASE WHEN user_id % 2 = 0 THEN 'amazon_in' ELSE 'flipkart' END AS marketplace FROM events)""",
        """SELECT coalesce(display_name, CAST(user_id AS VARCHAR)) AS product, a.marketplace,
          strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS "checked at (UTC)",
          CASE WHEN event_type <> 'error' THEN 'yes' ELSE 'no' END AS success, CASE WHEN event_type = 'view' THEN 'browser' ELSE 'http' END AS tier
        FROM a LEFT JOIN products ON product_id = user_id""",
    ),
)
def export_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.export_audit(M.audit_log(spark, sf_dir), M.products(spark, sf_dir))
    return rows.select("product", "marketplace", "`checked at (UTC)`", "success", "tier")


@query(
    "export_alerts",
    sql(
        ALL_ALERTS_SQL,
        """SELECT p.display_name AS product, type, strftime(fired_at, '%Y-%m-%dT%H:%M:%S.000Z') AS "fired at (UTC)", change_pct AS "change %",
          'pending' AS delivery FROM all_alerts a JOIN products p ON p.product_id = a.product_id""",
    ),
)
def export_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.alerts(M.check_log(spark, sf_dir), SETTINGS).withColumns(
        {"status": F.lit("pending"), "delivery_error": F.lit(None).cast("string")}
    )
    rows = sinks.export_alerts(found, M.products(spark, sf_dir))
    return rows.select("product", "type", "`fired at (UTC)`", "`change %`", "delivery")


