"""Registered queries: money, offer and URL text, imports, control, planning, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.functions import clock, money, offers, render, urls
from pricelark.model import Settings
from pricelark.operators import alerts as A
from pricelark.operators import control, digest, imports, planning, quality
from pricelark.plans.alerting import ALL_ALERTS_SQL, STATE_SQL
from pricelark.plans.delivery import _num_sql, inr_sql
from pricelark.plans.registry import AUDIT_SQL, CHECKS_SQL, PRODUCTS_SQL, query, sql
from pricelark.sources import import_file
from pricelark.sources import tables as M

SETTINGS = Settings()

_SP = r"[\s\v\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _squash_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))"


def _form_sql(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '[|•·*_]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({plain}, '{_SP}+', ' ', 'g'), '[ .]+$', ''))"


def _class_sql(x: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({x}, '(?i){p}') THEN '{k}'"
        for k, p in offers.LABEL_PREFIXES + offers.KEYWORDS
    )
    return f"CASE {arms} ELSE 'other' END"


@query(
    "discount_pct",
    """SELECT l_orderkey, l_linenumber, l_partkey, p AS price, m AS mrp,
         CASE WHEN p IS NULL OR m <= 0 OR p >= m THEN 0.0 ELSE floor(CAST(m - p AS DOUBLE) / m * 10000.0 + 0.5) / 100.0 END AS discount
       FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) END AS p,
         CAST(round(l_extendedprice * 100) AS BIGINT) * (CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END) AS m FROM lineitem)""",
)
def discount_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sale = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")
    price = F.when(F.col("l_returnflag") != "R", sale)
    mrp = F.when(F.col("l_linenumber") == 7, 0).otherwise(
        F.round(F.col("l_extendedprice") * 100).cast("bigint")
    )
    rows = M.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", price.alias("price"), mrp.alias("mrp")
    )
    return rows.withColumn("discount", money.discount_pct(F.col("price"), F.col("mrp")))


_AMOUNT_SQL = """SELECT o_orderkey, text, CASE WHEN p > 0 THEN p END AS paise FROM (
  SELECT *, TRY_CAST(TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_replace(text, '(rs\\.?|inr|₹)', '', 'gi'), '[,\\s]', '', 'g'),
    '[0-9]+(?:\\.[0-9]{1,2})?', 0), '') AS DECIMAL(30,2)) * 100 AS BIGINT) AS p FROM texts)"""


@query(
    "parse_amount",
    """WITH texts AS (SELECT o_orderkey, CASE o_orderkey % 6
        WHEN 0 THEN '₹' || CAST(o_totalprice AS DECIMAL(15,2)) WHEN 1 THEN 'Rs. ' || CAST(floor(o_totalprice) AS BIGINT) || ' only'
        WHEN 2 THEN 'INR 1,' || (o_custkey % 900 + 100) || '.5 / month' WHEN 3 THEN o_orderpriority
        WHEN 4 THEN 'M.R.P.: ₹ 0' ELSE 'Price ' || o_custkey || ' was ' || o_orderkey END AS text FROM orders) """
    + _AMOUNT_SQL,
)
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(
            key % 6 == 0,
            F.concat(F.lit("₹"), F.col("o_totalprice").cast("decimal(15,2)").cast("string")),
        )
        .when(
            key % 6 == 1,
            F.concat(
                F.lit("Rs. "), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit(" only")
            ),
        )
        .when(
            key % 6 == 2,
            F.concat(F.lit("INR 1,"), (cust % 900 + 100).cast("string"), F.lit(".5 / month")),
        )
        .when(key % 6 == 3, F.col("o_orderpriority"))
        .when(key % 6 == 4, "M.R.P.: ₹ 0")
        .otherwise(
            F.concat(F.lit("Price "), cust.cast("string"), F.lit(" was "), key.cast("string"))
        )
    )
    rows = M.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.withColumn("paise", money.amount_paise(F.col("text")))


@query(
    "amount_in_text",
    f"""SELECT doc_id, nullif(regexp_extract(regexp_replace(regexp_replace(text, '(rs\\.?|inr|₹)', '', 'gi'), ',|{_SP}', '', 'g'),
      '[0-9]+(?:\\.[0-9]{{1,2}})?', 0), '') AS amount FROM documents""",
)
def amount_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = M.spread(M.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", money.amount_text(F.col("text")).alias("amount"))


# Offer phrases put before each order's priority text, by order key.
PHRASES = [
    "Bank Offer:",
    "bank  offer on",
    "No Cost EMI",
    "no-cost emi with",
    "EMI offers from",
    "Cashback up to",
    "cash back",
    "Coupon:",
    "Partner Offers",
    "Get GST invoice and",
    "Exchange offer",
    "10% instant discount with",
    "UPI",
    "Free delivery",
    "Buy on credit card",
    "with bonus exchange",
]


def _phrase_sql() -> str:
    return "[" + ", ".join(f"'{p}'" for p in PHRASES) + "][o_orderkey % 16 + 1] || ' ' || o_orderpriority"


def _phrase() -> Column:
    texts = F.array(*[F.lit(p) for p in PHRASES])
    head = F.element_at(texts, (F.col("o_orderkey") % 16 + 1).cast("int"))
    return F.concat(head, F.lit(" "), F.col("o_orderpriority"))


@query(
    "offer_classify",
    f"SELECT o_orderkey, text, {_class_sql('text')} AS type FROM (SELECT o_orderkey, {_phrase_sql()} AS text FROM orders)",
)
def offer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.table(spark, sf_dir, "orders").select("o_orderkey", _phrase().alias("text"))
    return rows.withColumn("type", offers.classify(F.col("text")))


@query(
    "offer_classify_text",
    f"SELECT doc_id, {_class_sql('text')} AS type FROM documents",
)
def offer_classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = M.spread(M.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", offers.classify(F.col("text")).alias("type"))


@query("comparison_form", f"SELECT doc_id, md5({_form_sql('text')}) AS form FROM documents")
def comparison_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = M.spread(M.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.md5(offers.comparison_form(F.col("text"))).alias("form"))


_LINES_SQL = f"""WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  clean AS (SELECT doc_id, i, {_squash_sql('line')} AS description FROM lines),
  formed AS (SELECT *, {_form_sql('description')} AS form FROM clean WHERE description <> ''),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, form ORDER BY i) AS nth FROM formed) WHERE nth = 1),
  typed AS (SELECT *, {_class_sql('description')} AS type FROM firsts)"""


def _raw_lines() -> Column:
    return F.transform(
        F.split("text", "\n"),
        lambda t: F.struct(F.lit(None).cast("string").alias("label"), t.alias("description")),
    )


@query(
    "offer_normalise",
    _LINES_SQL
    + """ SELECT d.doc_id, count(t.form) AS offers, md5(coalesce(string_agg(t.type || '|' || t.description, chr(10) ORDER BY encode(t.form)), '')) AS listing
        FROM documents d LEFT JOIN typed t ON t.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def offer_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page whose lines are raw offers."""
    docs = M.spread(M.table(spark, sf_dir, "documents"))
    found = docs.select("doc_id", offers.normalise(_raw_lines()).alias("o"))
    lines = F.transform("o", lambda o: F.concat(o["type"], F.lit("|"), o["description"]))
    return found.select(
        "doc_id",
        F.size("o").cast("bigint").alias("offers"),
        F.md5(F.array_join(lines, "\n")).alias("listing"),
    )


@query(
    "offer_hash",
    _LINES_SQL
    + """ SELECT d.doc_id, sha256(coalesce(string_agg(t.type || '|' || t.form, chr(10) ORDER BY encode(t.type || '|' || t.form)), '')) AS offers_hash
        FROM documents d LEFT JOIN typed t ON t.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def offer_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = M.spread(M.table(spark, sf_dir, "documents"))
    found = docs.select("doc_id", offers.normalise(_raw_lines()).alias("o"))
    return found.select("doc_id", offers.offers_hash(F.col("o")).alias("offers_hash"))


@query(
    "offer_diff",
    sql(
        CHECKS_SQL,
        """, seq AS (SELECT product_id, check_id, offers, lag(offers) OVER (PARTITION BY product_id ORDER BY checked_at, check_id) AS prev
            FROM checks WHERE success)
        SELECT product_id, check_id, len(list_filter(offers, lambda x: NOT list_contains(prev, x))) AS added,
          len(list_filter(prev, lambda x: NOT list_contains(offers, x))) AS removed FROM seq WHERE prev IS NOT NULL""",
    ),
)
def offer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelark.operators.sequence import CheckLog, sliced_log
    from pricelark.operators.slices import Running, running

    log = M.check_log(spark, sf_dir)
    checks = CheckLog(log.checks.filter("success"), log.sizes)
    src = running(sliced_log(checks), [Running("prev", F.col("offers"))])
    known = src.df.filter(F.col("prev").isNotNull())
    known = known.withColumn("_diff", offers.differences(F.col("offers"), F.col("prev")))
    return known.select(
        "product_id",
        "check_id",
        F.size("_diff.added").cast("bigint").alias("added"),
        F.size("_diff.removed").cast("bigint").alias("removed"),
    )


@query(
    "relative_time",
    """WITH x AS (SELECT event_id, floor((epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) / 1000.0 + 0.5) AS s FROM events),
      y AS (SELECT *, floor(s / 60 + 0.5) AS m FROM x), z AS (SELECT *, floor(m / 60 + 0.5) AS h FROM y), w AS (SELECT *, floor(h / 24 + 0.5) AS d FROM z)
    SELECT event_id, CASE WHEN s < 45 THEN 'just now' WHEN m < 60 THEN CASE WHEN m = 1 THEN '1 minute ago' ELSE CAST(m AS BIGINT) || ' minutes ago' END
      WHEN h < 24 THEN CASE WHEN h = 1 THEN '1 hour ago' ELSE CAST(h AS BIGINT) || ' hours ago' END
      ELSE CASE WHEN d = 1 THEN '1 day ago' ELSE CAST(d AS BIGINT) || ' days ago' END END AS seen FROM w""",
)
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = M.table(spark, sf_dir, "events")
    now = M.as_of(M.EVENTS_AS_OF)
    return events.select("event_id", clock.relative_time(F.col("ts"), now).alias("seen"))


@query(
    "csv_cells",
    """SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[",\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS cell FROM documents""",
)
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelark.sources.sinks import csv_cell

    docs = M.spread(M.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.md5(csv_cell(F.col("text"))).alias("cell"))


@query(
    "safe_html",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<\s*script[^>]*>.*?<\s*/\s*script\s*>', '', 'gis'),
       '<\s*style[^>]*>.*?<\s*/\s*style\s*>', '', 'gis'), ' on\w+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'gi'), 'javascript:', '', 'gi')) AS html FROM pages""",
)
def safe_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = M.spread(M.table(spark, sf_dir, "pages"))
    return pages.select("page_id", F.md5(render.safe_html(F.col("html"))).alias("html"))


@query(
    "alert_summaries",
    sql(
        ALL_ALERTS_SQL,
        f"""SELECT a.product_id, a.check_id, a.type, CASE a.type WHEN 'target_price' THEN 'hit its target — now ' || {inr_sql('new_paise')}
          WHEN 'threshold_drop' THEN 'dropped ' || CASE WHEN change_pct < 0 THEN '-' ELSE '' END || {_num_sql('change_pct')} || '% to ' || {inr_sql('new_paise')}
          WHEN 'price_change' THEN 'changed ' || CASE WHEN change_pct < 0 THEN '-' ELSE '' END || {_num_sql('change_pct')} || '% to ' || {inr_sql('new_paise')}
          WHEN 'offer_added' THEN len(added) || ' new offer' || CASE WHEN len(added) = 1 THEN '' ELSE 's' END
          WHEN 'offer_removed' THEN len(removed) || ' offer' || CASE WHEN len(removed) = 1 THEN '' ELSE 's' END || ' removed'
          WHEN 'back_in_stock' THEN 'is back in stock' ELSE 'was auto-paused after repeated failures' END AS summary
        FROM all_alerts a JOIN diffs d ON d.check_id = a.check_id""",
    ),
)
def alert_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.alerts(M.check_log(spark, sf_dir), SETTINGS)
    return found.select("product_id", "check_id", "type", digest.alert_summary().alias("summary"))


# --- URLs and imports ------------------------------------------------------


def _host_sql(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '{_SHAPE_SQL}', 2)), '^www\\.', '')"


_SHAPE_SQL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):/*(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _recognise_sql(source: str) -> str:
    """CTEs u (parts) and rec (recognition) over ``source(id, url)``."""
    return f"""
u AS (SELECT *, nullif({_host_sql('url')}, '') AS host, nullif(regexp_extract(url, '{_SHAPE_SQL}', 3), '') AS path,
        nullif(regexp_extract(url, '{_SHAPE_SQL}', 4), '') AS q FROM {source}),
m AS (SELECT *, CASE WHEN host IN ('amazon.in', 'amzn.in') OR host LIKE '%.amazon.in' OR host LIKE '%.amzn.in' THEN 'amazon_in'
        WHEN host = 'flipkart.com' OR host LIKE '%.flipkart.com' THEN 'flipkart' END AS marketplace,
      coalesce(nullif(regexp_extract(path, '/dp/([A-Z0-9]{{10}})(?:/|$)', 1), ''), nullif(regexp_extract(path, '/gp/product/([A-Z0-9]{{10}})(?:/|$)', 1), ''),
        nullif(regexp_extract(path, '/gp/aw/d/([A-Z0-9]{{10}})(?:/|$)', 1), ''), nullif(regexp_extract(path, '/product/([A-Z0-9]{{10}})(?:/|$)', 1), ''),
        nullif(regexp_extract(q, '(?:^|&)asin=([A-Z0-9]{{10}})(?:&|$)', 1), '')) AS asin,
      nullif(regexp_extract(path, '/p/(itm[0-9a-zA-Z]{{13}})(?:/|$)', 1), '') AS item,
      nullif(regexp_extract(q, '(?:^|&)pid=([A-Z0-9]{{16}})(?:&|$)', 1), '') AS pid FROM u),
rec AS (SELECT * EXCLUDE (host, path, q, asin, item, pid),
      CASE WHEN marketplace = 'amazon_in' THEN asin WHEN marketplace = 'flipkart' AND item IS NOT NULL THEN coalesce(pid, item) END AS marketplace_product_id,
      CASE WHEN marketplace = 'amazon_in' THEN 'https://www.amazon.in/dp/' || asin
           WHEN marketplace = 'flipkart' THEN 'https://www.flipkart.com/product/p/' || item || coalesce('?pid=' || pid, '') END AS canonical_url,
      CASE WHEN marketplace IS NULL THEN host END AS detected_site,
      CASE WHEN marketplace IS NULL THEN 'unsupported' WHEN CASE WHEN marketplace = 'amazon_in' THEN asin ELSE item END IS NULL THEN 'not_a_listing' ELSE 'listing' END AS kind FROM m)"""


_ID10 = "'B' || lpad(CAST((o_custkey * 2) % 4000 AS VARCHAR), 9, '0')"
_ID13 = "'itm' || lpad(CAST((o_custkey * 2 + 1) % 4000 AS VARCHAR), 13, '0')"
IMPORT_SQL = f"""
file AS (SELECT o_orderkey AS row_number, CASE o_orderkey % 9
    WHEN 0 THEN 'https://www.amazon.in/Some-Slug/dp/' || {_ID10} || '/ref=sr_1?tag=x'
    WHEN 1 THEN 'https://www.flipkart.com/slug/p/' || {_ID13} || '?pid=MOB' || lpad(CAST(o_custkey % 50 AS VARCHAR), 13, '0') || '&lid=L'
    WHEN 2 THEN '  https://m.amazon.in/gp/product/' || {_ID10} || '?psc=1 '
    WHEN 3 THEN NULL
    WHEN 4 THEN 'https://shop' || (o_custkey % 7) || '.example.com/item/' || o_custkey
    WHEN 5 THEN 'https://www.flipkart.com/search?q=' || o_custkey
    WHEN 6 THEN 'https://www.amazon.in/gp/aw/d/C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
    WHEN 7 THEN 'https://dl.flipkart.com/x/p/' || {_ID13} || '/?ref=y'
    ELSE 'not a url ' || o_custkey END AS url,
    CASE o_custkey % 5 WHEN 0 THEN '₹1,' || (o_orderkey % 900 + 100) WHEN 1 THEN 'cheap' WHEN 2 THEN '' WHEN 3 THEN CAST(o_orderkey % 300 AS VARCHAR) END AS target_text
  FROM orders),
cells AS (SELECT row_number, url, CASE WHEN coalesce(target_text, '') <> '' THEN coalesce(TRY_CAST(regexp_replace(target_text, '[₹,\\s]', '', 'g') AS DOUBLE), -1.0) END AS target_rupees FROM file),
{_recognise_sql('cells').strip()},
firsts AS (SELECT canonical_url, min(row_number) AS first_row FROM rec WHERE kind = 'listing' AND NOT coalesce(NOT (target_rupees > 0), FALSE) GROUP BY 1),
review AS (SELECT rec.*, CASE
    WHEN coalesce(url, '') = '' THEN 'invalid|Missing URL'
    WHEN kind = 'unsupported' THEN 'invalid|Unsupported site' || coalesce(' (' || detected_site || ')', '') || ' — only Amazon India and Flipkart are supported'
    WHEN kind = 'not_a_listing' THEN 'invalid|Could not resolve to a product listing (short link may be blocked, expired, or point to a search/category page)'
    WHEN NOT (target_rupees > 0) THEN 'invalid|Target price must be a positive number'
    WHEN p.display_name IS NULL AND row_number > first_row THEN 'duplicate|Duplicate of an earlier row in this file (first occurrence wins)'
    WHEN p.display_name IS NOT NULL THEN 'duplicate|Already tracked as “' || p.display_name || '”'
    ELSE 'valid|' END AS verdict
  FROM rec LEFT JOIN firsts USING (canonical_url) LEFT JOIN products p ON p.canonical_url = rec.canonical_url)"""


def import_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an import file of raw cells."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    asin = F.concat(F.lit("B"), F.lpad(((cust * 2) % 4000).cast("string"), 9, "0"))
    item = F.concat(F.lit("itm"), F.lpad(((cust * 2 + 1) % 4000).cast("string"), 13, "0"))
    text = cust.cast("string")
    cases = [
        F.concat(F.lit("https://www.amazon.in/Some-Slug/dp/"), asin, F.lit("/ref=sr_1?tag=x")),
        F.concat(
            F.lit("https://www.flipkart.com/slug/p/"), item, F.lit("?pid=MOB"),
            F.lpad((cust % 50).cast("string"), 13, "0"), F.lit("&lid=L"),
        ),
        F.concat(F.lit("  https://m.amazon.in/gp/product/"), asin, F.lit("?psc=1 ")),
        F.lit(None).cast("string"),
        F.concat(
            F.lit("https://shop"), (cust % 7).cast("string"), F.lit(".example.com/item/"), text
        ),
        F.concat(F.lit("https://www.flipkart.com/search?q="), text),
        F.concat(F.lit("https://www.amazon.in/gp/aw/d/C"), F.lpad(text, 9, "0")),
        F.concat(F.lit("https://dl.flipkart.com/x/p/"), item, F.lit("/?ref=y")),
        F.concat(F.lit("not a url "), text),
    ]
    url = F.lit(None).cast("string")
    for i, case in enumerate(cases):
        url = F.when(key % 9 == i, case).otherwise(url)
    target = (
        F.when(cust % 5 == 0, F.concat(F.lit("₹1,"), (key % 900 + 100).cast("string")))
        .when(cust % 5 == 1, "cheap")
        .when(cust % 5 == 2, "")
        .when(cust % 5 == 3, (key % 300).cast("string"))
    )
    cells = M.spread(M.table(spark, sf_dir, "orders")).select(
        key.alias("row"), url.alias("Product URL"), target.alias("Target Price")
    )
    return import_file.import_rows(cells, "row")


@query(
    "url_recognise",
    sql(
        "pg AS (SELECT page_id, url FROM pages)," + _recognise_sql("pg"),
        "SELECT page_id, kind, marketplace, canonical_url, marketplace_product_id, detected_site FROM rec",
    ),
)
def url_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = M.spread(M.table(spark, sf_dir, "pages"))
    return pages.select("page_id", urls.recognise(F.col("url")).alias("r")).select("page_id", "r.*")


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.review(import_file_rows(spark, sf_dir), M.products(spark, sf_dir))


@query(
    "import_review",
    sql(
        PRODUCTS_SQL + "," + IMPORT_SQL,
        """SELECT row_number, coalesce(url, '') AS url, canonical_url, marketplace_product_id,
          split_part(verdict, '|', 1) AS disposition, nullif(split_part(verdict, '|', 2), '') AS reason FROM review""",
    ),
)
def import_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select(
        "row_number",
        F.coalesce("url", F.lit("")).alias("url"),
        "canonical_url",
        "marketplace_product_id",
        "disposition",
        "reason",
    )


@query(
    "import_report",
    sql(
        PRODUCTS_SQL + "," + IMPORT_SQL,
        """SELECT count(*) AS total_rows, count(*) FILTER (verdict LIKE 'valid%') AS imported,
          count(*) FILTER (verdict LIKE 'duplicate%') AS duplicates, count(*) FILTER (verdict LIKE 'invalid%') AS invalid FROM review""",
    ),
)
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.report(_reviewed(spark, sf_dir))


@query(
    "import_errors",
    sql(
        PRODUCTS_SQL + "," + IMPORT_SQL,
        "SELECT row_number, coalesce(url, '') AS url, split_part(verdict, '|', 2) AS reason FROM review WHERE verdict NOT LIKE 'valid%'",
    ),
)
def import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.row_errors(_reviewed(spark, sf_dir))


@query(
    "import_execute",
    sql(
        PRODUCTS_SQL + "," + IMPORT_SQL,
        """SELECT row_number, marketplace, canonical_url, 'Awaiting first check — ' || marketplace_product_id AS display_name,
          CAST(round(target_rupees * 100) AS BIGINT) AS target_paise,
          TIMESTAMP '2001-09-01' + to_seconds(15 * (row_number() OVER (ORDER BY row_number) - 1)) AS next_check_at
        FROM review WHERE verdict LIKE 'valid%'""",
    ),
)
def import_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imports.execute(_reviewed(spark, sf_dir), M.products(spark, sf_dir), M.as_of())
    return rows.select(
        "row_number", "marketplace", "canonical_url", "display_name", "target_paise", "next_check_at"
    )


@query(
    "registration_check",
    sql(
        PRODUCTS_SQL + "," + IMPORT_SQL,
        "SELECT row_number, rec.canonical_url FROM rec WHERE EXISTS (SELECT 1 FROM products p WHERE p.canonical_url = rec.canonical_url)",
    ),
)
def registration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = import_file_rows(spark, sf_dir)
    asked = rows.select("row_number", urls.recognise(F.col("url"))["canonical_url"].alias("canonical_url"))
    return asked.join(
        M.products(spark, sf_dir).select("canonical_url"), "canonical_url", "left_semi"
    )


# --- control ---------------------------------------------------------------

_CONTROL_SQL = """
controls AS (SELECT user_id AS product_id, ts AS at_, event_id, CASE event_type WHEN 'click' THEN 'pause' WHEN 'view' THEN 'resume'
    WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'set_target' ELSE 'edit_target' END
    WHEN 'purchase' THEN 'clear_target' ELSE 'check_now' END AS action,
    CAST(floor(value * 100) AS BIGINT) AS target_paise FROM events)"""


def control_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as user commands."""
    kind = F.col("event_type")
    return M.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("product_id"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("control_id"),
        F.when(kind == "click", "pause")
        .when(kind == "view", "resume")
        .when(
            kind == "signup",
            F.when(F.col("event_id") % 2 == 0, "set_target").otherwise("edit_target"),
        )
        .when(kind == "purchase", "clear_target")
        .otherwise("check_now")
        .alias("action"),
        F.floor(F.col("value") * 100).cast("bigint").alias("target_paise"),
    )


@query(
    "control_fold",
    sql(
        PRODUCTS_SQL + "," + _CONTROL_SQL,
        """, f AS (SELECT product_id, arg_max(action, event_id) FILTER (action IN ('pause', 'resume')) AS st,
            max(at_) FILTER (action = 'resume') AS failures_reset_at, max(at_) FILTER (action IN ('resume', 'check_now')) AS due_at,
            arg_max(action, event_id) FILTER (action LIKE '%target') AS ta, max(event_id) FILTER (action LIKE '%target') AS te,
            max(at_) FILTER (action IN ('set_target', 'clear_target')) AS latch_reset_at FROM controls GROUP BY 1)
        SELECT p.product_id, CASE st WHEN 'pause' THEN 'paused_user' ELSE 'active' END AS status,
          CASE WHEN ta IS NULL THEN p.target_paise WHEN ta = 'clear_target' THEN NULL ELSE c.target_paise END AS target_paise,
          failures_reset_at, due_at, latch_reset_at
        FROM products p LEFT JOIN f USING (product_id) LEFT JOIN controls c ON c.event_id = f.te""",
    ),
)
def control_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = M.products(spark, sf_dir).withColumn("status", F.lit("active"))
    folded = control.fold(control_log(spark, sf_dir))
    return control.apply(products, folded).select(
        "product_id", "status", "target_paise", "failures_reset_at", "due_at", "latch_reset_at"
    )


def product_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands on products: orders of the part's number."""
    actions = F.array(
        *[F.lit(a) for a in ("set_target", "pause", "resume", "edit_target", "clear_target")]
    )
    key = F.col("o_orderkey")
    return (
        M.table(spark, sf_dir, "orders")
        .select(
            F.col("o_custkey").alias("product_id"),
            F.col("o_orderdate").alias("at"),
            key.alias("control_id"),
            F.element_at(actions, (key % 5 + 1).cast("int")).alias("action"),
            (85000 + key % 15000).alias("target_paise"),
        )
        .join(M.products(spark, sf_dir).select("product_id"), "product_id", "left_semi")
    )


CONTROLLED_ALERTS_SQL = sql(
    CHECKS_SQL,
    """, ctl AS (SELECT o_custkey AS product_id, o_orderdate AS at_, o_orderkey, ['set_target', 'pause', 'resume', 'edit_target', 'clear_target'][o_orderkey % 5 + 1] AS action,
        85000 + o_orderkey % 15000 AS new_target FROM orders WHERE o_custkey IN (SELECT product_id FROM products)),
    log AS (SELECT product_id, checked_at AS at_, 1 AS ord, check_id AS id, success, stock_status, price_paise, is_live, target_paise, NULL AS action, NULL AS new_target FROM live
      UNION ALL SELECT product_id, at_, 0, o_orderkey, NULL, NULL, NULL, NULL, NULL, action, new_target FROM ctl),
    a AS (SELECT *, last_value(CASE WHEN action IN ('set_target', 'edit_target') THEN new_target WHEN action = 'clear_target' THEN -1 END IGNORE NULLS) OVER upto AS t,
        last_value(CASE WHEN action IN ('pause', 'resume') THEN action END IGNORE NULLS) OVER upto AS held,
        sum(CASE WHEN action = 'resume' THEN 1 ELSE 0 END) OVER upto AS epoch,
        sum(CASE WHEN success = FALSE THEN 1 ELSE 0 END) OVER upto AS fails,
        last_value(CASE WHEN is_live THEN price_paise END IGNORE NULLS) OVER prior AS prev_price
      FROM log WINDOW upto AS (PARTITION BY product_id ORDER BY at_, ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        prior AS (PARTITION BY product_id ORDER BY at_, ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, CASE WHEN t IS NULL THEN target_paise WHEN t = -1 THEN NULL ELSE t END AS goal FROM a),
    c AS (SELECT *, success AND price_paise IS NOT NULL AND goal IS NOT NULL AND stock_status <> 'out_of_stock' AS ok,
        coalesce(last_value(CASE WHEN action IN ('set_target', 'clear_target') THEN FALSE
          WHEN success AND price_paise IS NOT NULL AND goal IS NOT NULL AND stock_status <> 'out_of_stock' THEN price_paise <= goal
          WHEN success AND goal IS NULL THEN FALSE END IGNORE NULLS) OVER prior, FALSE) AS latched,
        fails - coalesce(max(CASE WHEN success OR action = 'resume' THEN fails END) OVER upto, 0) AS run_len FROM b
      WINDOW upto AS (PARTITION BY product_id ORDER BY at_, ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        prior AS (PARTITION BY product_id ORDER BY at_, ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    hits AS (SELECT product_id, epoch, min(id) AS id FROM c WHERE success = FALSE AND run_len = 3 AND coalesce(held, 'resume') = 'resume' GROUP BY 1, 2)
    SELECT product_id, id AS check_id, 'target_price' AS type, goal AS target_paise FROM c WHERE ok AND price_paise <= goal AND NOT latched
    UNION ALL SELECT product_id, id, 'auto_paused', NULL FROM hits""",
)


@query("controlled_alerts", CONTROLLED_ALERTS_SQL)
def controlled_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and auto-pause alerts under commands."""
    commands = product_commands(spark, sf_dir)
    settings = Settings(failure_limit=3)
    found = A.alerts(
        M.check_log(spark, sf_dir), settings, ["target_price", "auto_paused"], commands
    )
    return found.select("product_id", "check_id", "type", "target_paise")


@query(
    "link_validation",
    sql(
        PRODUCTS_SQL,
        """, pool AS (SELECT product_id, marketplace, CASE WHEN product_id % 5 = 0 THEN linked_product_id END AS link FROM products),
        req AS (SELECT o_orderkey AS request_id, o_custkey AS a_id, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey ELSE (o_orderkey * 7) % 2500 END AS b_id FROM orders)
        SELECT request_id, a_id, b_id, reason IS NULL AS accepted, reason FROM (
          SELECT req.*, CASE WHEN a.product_id IS NULL OR b.product_id IS NULL THEN 'not_found' WHEN a_id = b_id THEN 'same_product'
            WHEN a.marketplace = b.marketplace THEN 'same_marketplace' WHEN a.link IS NOT NULL OR b.link IS NOT NULL THEN 'already_linked' END AS reason
          FROM req LEFT JOIN pool a ON a.product_id = a_id LEFT JOIN pool b ON b.product_id = b_id)""",
    ),
)
def link_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pool = M.products(spark, sf_dir).withColumn(
        "linked_product_id", F.when(F.col("product_id") % 5 == 0, F.col("linked_product_id"))
    )
    asked = M.table(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        cust.alias("a_id"),
        F.when(key % 11 == 0, cust).otherwise((key * 7) % 2500).alias("b_id"),
    )
    return control.validate_links(asked, pool)


@query(
    "link_candidates",
    sql(
        PRODUCTS_SQL,
        """SELECT product_id, display_name FROM (SELECT *, CASE WHEN priority = 1 THEN linked_product_id END AS l FROM products)
        WHERE marketplace <> 'amazon_in' AND l IS NULL""",
    ),
)
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = M.products(spark, sf_dir).withColumn(
        "linked_product_id", F.when(F.col("priority") == 1, F.col("linked_product_id"))
    )
    return control.link_candidates(pool, "amazon_in").select("product_id", "display_name")


@query(
    "cascade_delete",
    sql(
        CHECKS_SQL,
        """SELECT product_id, count(*) AS rows FROM checks
        WHERE product_id NOT IN (SELECT product_id FROM products WHERE priority = 2) GROUP BY 1""",
    ),
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = M.products(spark, sf_dir).filter(F.col("priority") == 2)
    kept = control.cascade(M.checks(spark, sf_dir), gone)
    return kept.groupBy("product_id").agg(F.count("*").alias("rows"))


@query(
    "set_null_delete",
    sql(
        PRODUCTS_SQL,
        """SELECT product_id, CASE WHEN category LIKE '%1%' THEN NULL ELSE category END AS category,
          CASE WHEN linked_product_id IN (SELECT product_id FROM products WHERE priority <> 2) THEN linked_product_id END AS linked_product_id
        FROM products WHERE priority <> 2""",
    ),
)
def set_null_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = M.products(spark, sf_dir).filter(F.col("priority") != 2)
    labels = M.table(spark, sf_dir, "part").select("p_brand").distinct()
    kept = labels.filter(~F.col("p_brand").contains("1"))
    out = control.set_null(products, "category", kept, "p_brand")
    return control.set_null(out, "linked_product_id", products, "product_id").select(
        "product_id", "category", "linked_product_id"
    )


# --- planning --------------------------------------------------------------

_DUE_SQL = (
    STATE_SQL
    + """,
ready AS (SELECT product_id, marketplace, status, coalesce(interval_minutes, 30) AS every,
    last_checked_at + to_minutes(CAST(coalesce(interval_minutes, 30) * 1440 AS BIGINT)) AS next_check_at FROM products JOIN state USING (product_id))"""
)


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their next check; an interval minute stands for a day at this data's pace."""
    state = A.product_state(M.check_log(spark, sf_dir), SETTINGS)
    joined = M.products(spark, sf_dir).join(state, "product_id")
    days = planning.interval(SETTINGS) * 1440
    return joined.withColumn(
        "next_check_at", planning.next_check(F.col("last_checked_at"), days)
    )


@query(
    "due_products",
    sql(
        _DUE_SQL,
        "SELECT product_id, marketplace, next_check_at FROM ready WHERE status = 'active' AND next_check_at <= TIMESTAMP '2001-11-15'",
    ),
)
def due_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = M.as_of("2001-11-15 00:00:00")
    return planning.due(_schedule(spark, sf_dir), now).select(
        "product_id", "marketplace", "next_check_at"
    )


@query(
    "check_plan",
    sql(
        _DUE_SQL,
        """SELECT product_id, marketplace, CAST(slot AS INTEGER) AS slot FROM (
          SELECT *, row_number() OVER (PARTITION BY marketplace ORDER BY md5(product_id || ':cycle-1'), product_id) AS slot
          FROM ready WHERE status = 'active' AND next_check_at <= TIMESTAMP '2001-11-15') WHERE slot <= 15""",
    ),
)
def check_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = M.as_of("2001-11-15 00:00:00")
    plan = planning.check_plan(_schedule(spark, sf_dir), SETTINGS, now, "cycle-1")
    return plan.select("product_id", "marketplace", "slot")


@query(
    "daily_sweep",
    sql(
        _DUE_SQL,
        """SELECT product_id, marketplace, every, row_number() OVER (PARTITION BY marketplace ORDER BY every, product_id) - 1 AS slot
        FROM ready WHERE status = 'active'""",
    ),
)
def daily_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, last = M.as_of("2001-11-15 02:00:00"), M.as_of("2001-11-14 02:00:00")
    plan = planning.daily_sweep(_schedule(spark, sf_dir), SETTINGS, last, now)
    return plan.select("product_id", "marketplace", "every", "slot")


@query(
    "numbered_list",
    sql(
        PRODUCTS_SQL,
        """SELECT product_id, display_name, CAST(n AS INTEGER) AS number FROM (
          SELECT *, row_number() OVER (ORDER BY created_at, product_id) AS n FROM products) WHERE n > 20 AND n <= 30""",
    ),
)
def numbered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.numbered_list(M.products(spark, sf_dir), page=2).select(
        "product_id", "display_name", "number"
    )


# --- quality and retention --------------------------------------------------


@query(
    "quality_violations",
    """SELECT p_partkey AS product_id, array_to_string(list_filter([
        CASE WHEN length(n) < 1 THEN 'display_name' END, CASE WHEN t <= 0 THEN 'target_price' END,
        CASE WHEN b < 0 OR b > 9900 THEN 'drop_threshold' END, CASE WHEN e < 10 OR e > 1440 THEN 'interval' END,
        CASE WHEN p_size < 1 OR p_size > 1000000 THEN 'priority' END, CASE WHEN length(repeat(p_name, p_size * 10)) > 5000 THEN 'notes' END,
        CASE WHEN p_size > 20 THEN 'tags' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM (SELECT *, CASE WHEN p_size = 7 THEN '' ELSE p_name END AS n, (p_size - 2) * 100 AS t, p_size * 250 - 500 AS b, p_size * 40 - 60 AS e FROM part)""",
)
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = M.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(size == 7, "").otherwise(F.col("p_name")).alias("display_name"),
        ((size - 2) * 100).alias("target_paise"),
        (size * 250 - 500).alias("threshold_bp"),
        (size * 40 - 60).alias("interval_minutes"),
        size.alias("priority"),
        F.expr("repeat(p_name, p_size * 10)").alias("notes"),
        F.array_repeat(F.lower("p_type"), size).alias("tags"),
    )
    checked = quality.check_rules(rows, quality.product_rules())
    return checked.select("product_id", F.array_join("violations", ",").alias("violations"))


RETENTION_SQL = sql(
    AUDIT_SQL,
    "SELECT audit_id, product_id, created_at FROM audit WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY",
)


@query("audit_retention", RETENTION_SQL)
def audit_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = M.as_of(M.EVENTS_AS_OF)
    return quality.retained(M.audit_log(spark, sf_dir), now).select(
        "audit_id", "product_id", "created_at"
    )


