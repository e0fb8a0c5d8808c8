"""Snapshots from raw pages: one set of strategies per marketplace layout.

A layout is a list of named selectors for the page helper plus Spark expressions that
turn the picked values into snapshot columns or a failure reason.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.extract.markup import compile_selector, pick, state_offers
from pricelark.functions.money import amount_paise, discount_pct
from pricelark.functions.offers import normalise, squash
from pricelark.functions.urls import recognise

HITS = "array<struct<key:string,pos:int,scope:int,value:string>>"
RAW_OFFERS = "array<struct<label:string,description:string>>"
STATE_OFFERS = "array<struct<title:string,kind:string,sub:string,amount:string,emi:boolean>>"

# Layout A price places in order, then places that only show whole rupees.
PRICES_A = [
    "#corePriceDisplay_desktop_feature_div .priceToPay .a-offscreen",
    "#corePriceDisplay_desktop_feature_div .a-price:not(.a-text-price) .a-offscreen",
    "#corePrice_feature_div .a-price:not(.a-text-price) .a-offscreen",
    "#apex_desktop .a-price:not(.a-text-price) .a-offscreen",
    "#tp_price_block_total_price_ww .a-offscreen",
    ".priceToPay .a-offscreen",
    "#price_inside_buybox",
    "#newBuyBoxPrice",
    "#priceblock_ourprice",
    "#priceblock_dealprice",
    "#corePriceDisplay_mobile_feature_div .a-price:not(.a-text-price) .a-offscreen",
]
WHOLE_PRICES_A = [
    "#corePriceDisplay_desktop_feature_div .priceToPay .a-price-whole",
    "#tp_price_block_total_price_ww .a-price-whole",
    "#corePrice_feature_div .a-price-whole",
    "#apex_desktop .a-price-whole",
]
MRPS_A = [
    "#corePriceDisplay_desktop_feature_div .a-price.a-text-price .a-offscreen",
    "#corePriceDisplay_desktop_feature_div .basisPrice .a-offscreen",
    "#corePrice_feature_div .a-price.a-text-price .a-offscreen",
    "#apex_desktop .a-price.a-text-price .a-offscreen",
    "#tp_price_block_total_price_ww .a-price.a-text-price .a-offscreen",
    "#corePriceDisplay_mobile_feature_div .a-price.a-text-price .a-offscreen",
]
# Page phrases.
OUT_A = "currently unavailable|out of stock|temporarily unavailable"
IN_A = "in stock|order soon|left in stock"
WALLS_A = [
    ("captcha", r"(?i)validateCaptcha|Type the characters you see in this image"),
    (
        "fetch_blocked",
        r"(?i)To discuss automated access to Amazon data|api-services-support@amazon\.com",
    ),
    ("listing_removed", r"(?is)Looking for something\?.*we can(?:'|no)t find that page"),
]
PRODUCT_SIGNS_B = [r'"@type"\s*:\s*"Product"', r'"(?:finalPrice|sellingPrice)"\s*:']
WALLS_B = [
    ("captcha", r"(?i)are you a human|unusual traffic|verify you'?re not a robot"),
    ("fetch_blocked", r"(?i)access denied|request blocked"),
    (
        "listing_removed",
        r"(?i)this page (?:is|was) unavailable|product (?:is )?no longer available",
    ),
]
EMBEDDED_PRICES_B = [
    r'(?i)"finalPrice"\s*:\s*"?(\d{2,9})',
    r'(?i)"sellingPrice"\s*:\s*\{[^}]*?"value"\s*:\s*"?(\d{2,9})',
    r'(?i)"sellingPrice"\s*:\s*"?(\d{2,9})',
    r'(?i)"price"\s*:\s*"?(\d{2,9})',
]
EMBEDDED_MRP_B = r'(?i)"mrp"\s*:\s*"?(\d{2,9})'
SOLD_OUT_B = "(?i)sold out|coming soon|notify me|currently unavailable"
OFFER_LINE_B = (
    "(?i)bank offer|special price|coupon|cashback|exchange|no cost emi|instant discount|partner offer"
)
OFFER_LABELS_B = {"EXCHANGE": "Exchange offer", "PBO": "Bank offer", "PBO_EMI": "No Cost EMI"}
MRP_TOLERANCE = 1.005


@dataclass(frozen=True)
class Want:
    """One named selector of a layout."""

    key: str
    selector: str
    attr: str | None = None
    first: bool = True
    where: str | None = None
    without: str | None = None
    scope: str | None = None


WANTS_A = [
    *[Want(f"price{i}", s) for i, s in enumerate(PRICES_A)],
    *[Want(f"whole{i}", s) for i, s in enumerate(WHOLE_PRICES_A)],
    Want("mrp", ", ".join(MRPS_A), first=False),
    Want("asin", "input#ASIN", attr="value"),
    Want("data_asin", "[data-asin]", attr="data-asin"),
    Want("canonical", 'link[rel="canonical"]', attr="href"),
    Want("title", "#productTitle", first=False),
    Want("h1", "h1 span"),
    Want("availability", "#availability", first=False),
    Want("image", "#landingImage", attr="src"),
    Want("image2", "#imgTagWrapperId img", attr="src"),
    Want("place", "#glow-ingress-line2", first=False),
    Want("card", ".offers-items", attr="class", first=False),
    Want("card_title", ".offers-items .offers-items-title", first=False, scope=".offers-items"),
    Want(
        "card_text",
        ".offers-items .offers-items-content",
        first=False,
        without="a-truncate-cut",
        scope=".offers-items",
    ),
    Want("card_count", ".offers-items .vsx-offers-count", first=False, scope=".offers-items"),
    Want(
        "card_sheet",
        ".offers-items [data-side-sheet]",
        attr="data-side-sheet",
        first=False,
        scope=".offers-items",
    ),
    Want("coupon", '#couponBadgeRegularVsn, .couponBadge, [id^="couponText"]', first=False),
    Want(
        "flat",
        "#vsxoffers_feature_div .vsx-offers-desktop-lv__item, #itembox-InstantBankDiscount",
        first=False,
    ),
]
RUPEE = r"₹\s?[\d,]+"
WANTS_B = [
    Want("canonical", 'link[rel="canonical"]', attr="href"),
    Want("jsonld", 'script[type="application/ld+json"]', first=False),
    Want("h1", "h1"),
    Want("title", "title", first=False),
    Want("body", "body", first=False),
    Want("price", '[class*="price"], [data-testid="selling-price"]', where=RUPEE),
    Want("struck", 'strike, del, s, [class*="strike"]', where=RUPEE),
    Want("line", "li", first=False, where=OFFER_LINE_B.replace("(?i)", "")),
]


def picker(wants: list[Want]) -> Callable[[Column], Column]:
    """A vectorised function html -> hits for one layout."""
    flags = {"line": re.I}
    ready = [
        {
            "key": w.key,
            "css": compile_selector(w.selector),
            "attr": w.attr,
            "first": w.first,
            "where": re.compile(w.where, flags.get(w.key, 0)) if w.where else None,
            "without": w.without,
            "scope": compile_selector(w.scope) if w.scope else None,
        }
        for w in wants
    ]

    @F.pandas_udf(HITS)
    def hits(html: pd.Series) -> pd.Series:
        return html.map(lambda text: pick(text or "", ready))

    return hits


def _state_offers(html: Column) -> Column:
    @F.pandas_udf(STATE_OFFERS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: state_offers(text or ""))

    return found(html)


def _all(key: str) -> Column:
    return F.transform(F.filter("hits", lambda h: h["key"] == key), lambda h: h["value"])


def _one(key: str) -> Column:
    return F.get(_all(key), F.lit(0))


def _text(key: str) -> Column:
    """Text of every element of a selector, joined as one."""
    return F.array_join(_all(key), "")


def _blank(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit(""))


def _wall(walls: list[tuple[str, str]]) -> Column:
    out = None
    for reason, pattern in walls:
        test = F.col("html").rlike(pattern)
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out


def _group(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(1))


def _cards() -> Column:
    """Offer cards: title, summary, count; partner and invoice cards are no offers."""

    def of(card: Column, key: str) -> Column:
        mine = F.filter("hits", lambda h: (h["key"] == key) & (h["scope"] == card["pos"]))
        return squash(F.coalesce(F.get(mine, F.lit(0))["value"], F.lit("")))

    cards = F.transform(
        F.filter("hits", lambda h: h["key"] == "card"),
        lambda c: F.struct(
            of(c, "card_title").alias("title"),
            of(c, "card_text").alias("summary"),
            F.greatest(
                F.coalesce(F.regexp_extract(of(c, "card_count"), r"\d+", 0).try_cast("int"), F.lit(1)),
                F.lit(1),
            ).alias("count"),
            F.coalesce(F.get_json_object(of(c, "card_sheet"), "$.contentId"), F.lit("")).alias("sheet"),
        ),
    )
    return F.filter(
        cards,
        lambda c: ((c["title"] != "") | (c["summary"] != ""))
        & ~c["title"].rlike("(?i)partner")
        & ~c["sheet"].rlike("(?i)partner")
        & ~c["summary"].rlike("(?i)gst invoice|business purchase"),
    )


def _raw(texts: Column, label: str | None) -> Column:
    lit = F.lit(label).cast("string")
    return F.transform(
        texts, lambda t: F.struct(lit.alias("label"), t.alias("description"))
    )


def _page_offers_a() -> Column:
    cards = F.transform(
        F.filter("cards", lambda c: c["summary"] != ""),
        lambda c: F.struct(c["title"].alias("label"), c["summary"].alias("description")),
    )
    rest = F.when(F.size("cards") > 0, cards).otherwise(_raw(_all("flat"), None))
    return F.concat(_raw(_all("coupon"), "coupon"), rest)


def extract_a(pages: DataFrame) -> DataFrame:
    """``pages(url, html, expanded_offers)`` of layout A -> snapshot columns, reason, detail.

    ``expanded_offers`` are the offers behind multi-offer cards, when they were fetched.
    """
    df = pages.withColumn("hits", picker(WANTS_A)(F.col("html"))).withColumns(
        {
            "wall": _wall(WALLS_A),
            "page_id_": F.coalesce(
                _one("asin"), _one("data_asin"), _group(_one("canonical"), r"/dp/([A-Z0-9]{10})")
            ),
            "name": F.coalesce(_blank(_text("title")), _blank(_one("h1"))),
            "availability": F.lower(_text("availability")),
            "cards": _cards(),
            "buy_box": F.coalesce(*[amount_paise(_one(f"price{i}")) for i in range(len(PRICES_A))]),
            "whole_box": F.coalesce(
                *[amount_paise(_one(f"whole{i}")) for i in range(len(WHOLE_PRICES_A))]
            ),
            "image_url": F.coalesce(_one("image"), _one("image2")),
            "expected": recognise(F.col("url"))["marketplace_product_id"],
            "resolved_location": _blank(squash(_text("place"))),
        }
    )
    seen = F.coalesce("buy_box", "whole_box")
    df = df.withColumn(
        "stock_status",
        F.when(F.col("availability").rlike(OUT_A), "out_of_stock")
        .when(F.col("availability").rlike(IN_A) | seen.isNotNull(), "in_stock")
        .otherwise("unknown"),
    ).withColumn("price_paise", F.when(F.col("stock_status") == "in_stock", seen))
    price = F.col("price_paise")
    listed = F.filter(
        F.transform(_all("mrp"), lambda t: amount_paise(t)), lambda v: v >= price
    )
    unexpanded = F.col("expanded_offers").isNull() & F.exists("cards", lambda c: c["count"] > 1)
    redirected = F.col("expected").isNotNull() & (F.col("page_id_") != F.col("expected"))
    df = df.withColumns(
        {
            "mrp_paise": F.when(
                price.isNotNull(), F.coalesce(F.get(listed, F.lit(0)), price)
            ),
            "offers": normalise(F.coalesce("expanded_offers", _page_offers_a())),
            "marketplace_product_id": F.coalesce("page_id_", "expected", F.lit("")),
            "price_source": F.when(
                price.isNotNull(),
                F.when(F.col("buy_box").isNotNull(), "buy-box").otherwise("buy-box-whole"),
            ),
        }
    )
    failures = [
        (F.col("wall").isNotNull(), F.col("wall"), F.lit("interstitial page")),
        (F.coalesce(redirected, F.lit(False)), F.lit("parse_failed"), F.lit("page is for another listing")),
        (unexpanded, F.lit("parse_failed"), F.lit("multi-offer card not expanded")),
        *_checks(),
    ]
    return _finish(df, failures, F.lit("amazon_in"))


def _checks() -> list[tuple[Column, Column, Column]]:
    """Required fields and snapshot sanity, in order."""
    failed = F.lit("parse_failed")
    price, mrp = F.col("price_paise"), F.col("mrp_paise")
    above = (mrp > 0) & (price > mrp * MRP_TOLERANCE)
    return [
        (F.col("name").isNull(), failed, F.lit("no product name")),
        (
            price.isNull() & (F.col("stock_status") != "out_of_stock"),
            failed,
            F.lit("no price"),
        ),
        (F.coalesce(above, F.lit(False)), failed, F.lit("price above list price")),
    ]


_SNAPSHOT = [
    "marketplace",
    "marketplace_product_id",
    "name",
    "price_paise",
    "mrp_paise",
    "discount_pct",
    "offers",
    "stock_status",
    "image_url",
    "price_source",
]


def _finish(df: DataFrame, failures: list[tuple[Column, Column, Column]], marketplace: Column) -> DataFrame:
    """Null the snapshot of a failed page; the first failure that applies names the reason."""
    reason, detail = None, None
    for test, why, text in failures:
        reason = F.when(test, why) if reason is None else reason.when(test, why)
        detail = F.when(test, text) if detail is None else detail.when(test, text)
    df = df.withColumns(
        {
            "marketplace": marketplace,
            "discount_pct": discount_pct(F.col("price_paise"), F.col("mrp_paise")),
            "failure_reason": reason,
            "failure_detail": detail,
        }
    )
    ok = F.col("failure_reason").isNull()
    kept = [c for c in df.columns if c in ("check_id", "attempt", "tier", "url", "fetched_at", "page_id")]
    extra = [c for c in ("price_html", "price_json_ld", "price_embedded", "price_embedded_first", "resolved_location") if c in df.columns]
    return df.select(
        *kept,
        ok.alias("success"),
        *[F.when(ok, F.col(c)).alias(c) for c in _SNAPSHOT],
        *extra,
        "failure_reason",
        "failure_detail",
    )


_JSONLD = (
    "array<struct<`@type`:string,name:string,image:string,"
    "offers:struct<price:string,availability:string>>>"
)


def _state_offer_rows() -> Column:
    """State offers that carry a value, as raw offers; the first of equal ones is kept."""
    rows = F.transform(
        "state",
        lambda o: F.struct(
            o["title"].alias("title"),
            o["kind"].alias("kind"),
            squash(F.coalesce(o["sub"], F.lit(""))).alias("sub"),
            squash(F.coalesce(o["amount"], F.lit(""))).alias("amount"),
            o["emi"].alias("emi"),
        ),
    )

    def value(o: Column) -> Column:
        """Amount without placeholders; null marks an instalment plan, which is no offer."""
        return F.when(
            ~o["amount"].rlike(r"(?i)off/m|/month|\(\d+\s*months?\)"),
            F.when(o["amount"].rlike(r"^₹\s*0(?!\w)|^0(?!\w)"), "").otherwise(o["amount"]),
        )

    def entry(o: Column) -> Column:
        amount = value(o)
        worth = (amount != "") | o["sub"].rlike(r"(?i)cashback|discount|instant|flat|\d+\s*%|\boff\b")
        emi = o["emi"] & o["sub"].rlike(r"₹\s?[\d,]+|\d+\s*%")
        bank = ~o["emi"] & amount.isNotNull() & worth
        label = F.when(
            o["emi"],
            F.when(F.concat_ws(" ", o["title"], o["sub"]).rlike(r"(?i)no[\s-]?cost"), "No Cost EMI")
            .otherwise("EMI offer"),
        )
        for code, text in OFFER_LABELS_B.items():
            label = label.when(o["kind"] == code, text)
        parts = F.array(o["title"], o["sub"], F.when(o["emi"], "").otherwise(amount))
        return F.when(
            emi | bank,
            F.struct(
                label.alias("label"),
                F.array_join(F.filter(parts, lambda p: p != ""), " — ").alias("description"),
                F.lower(
                    F.concat_ws("|", o["title"], F.when(o["emi"], o["sub"]).otherwise(amount))
                ).alias("same"),
            ),
        )

    kept = F.array_compact(F.transform(rows, entry))
    none = F.array().cast("array<struct<label:string,description:string,same:string>>")

    def add(acc: Column, o: Column) -> Column:
        known = F.exists(acc, lambda a: a["same"] == o["same"])
        return F.when(known, acc).otherwise(F.concat(acc, F.array(o)))

    return F.transform(
        F.aggregate(kept, none, add), lambda o: F.struct(o["label"].alias("label"), o["description"].alias("description"))
    )


def extract_b(pages: DataFrame) -> DataFrame:
    """``pages(url, html, local_stock, local_price_paise, local_mrp_paise)`` of layout B.

    The ``local_`` columns are the pricing response for the delivery place, null when
    there is none; they win over what the page shows.
    """
    df = pages.withColumns(
        {"hits": picker(WANTS_B)(F.col("html")), "state": _state_offers(F.col("html"))}
    )
    blocks = F.flatten(
        F.transform(_all("jsonld"), lambda t: F.coalesce(F.from_json(t, _JSONLD), F.array().cast(_JSONLD)))
    )
    product = F.filter(
        blocks, lambda b: (b["@type"] == "Product") | b["@type"].rlike(r'^\[.*"Product".*\]$')
    )
    rupees = r"(₹\s?[\d,]+(?:\.\d{1,2})?)"
    looks = F.lit(False)
    for sign in PRODUCT_SIGNS_B:
        looks = looks | F.col("html").rlike(sign)
    df = df.withColumns(
        {
            "ld": F.get(product, F.lit(0)),
            "wall": F.when(~looks, _wall(WALLS_B)),
            "page_pid": _group(_one("canonical"), r"[?&]pid=([A-Z0-9]{16})"),
            "page_item": _group(_one("canonical"), r"/p/(itm[0-9a-zA-Z]{13})"),
            "own_pid": _group(F.col("url"), r"[?&]pid=([A-Z0-9]{16})(?:[&#]|$)"),
            "own_item": _group(F.col("url"), r"/p/(itm[0-9a-zA-Z]{13})(?:[/?]|$)"),
        }
    )
    availability = F.coalesce(F.col("ld.offers.availability"), F.lit(""))
    heading = _blank(_one("h1"))
    titled = _blank(F.regexp_replace(_text("title"), r"(?i)- Flipkart\.com.*", ""))
    df = df.withColumns(
        {
            "name": F.coalesce(_blank(F.col("ld.name")), heading, titled),
            "price_json_ld": amount_paise(F.col("ld.offers.price")),
            # the first pattern that matches decides, even if its match is no amount
            "price_embedded": amount_paise(F.coalesce(*[_group(F.col("html"), p) for p in EMBEDDED_PRICES_B])),
            "price_embedded_first": amount_paise(_group(F.col("html"), EMBEDDED_PRICES_B[0])),
            "price_element": amount_paise(_group(_one("price"), rupees)),
            "ld_stock": F.when(availability.rlike("(?i)InStock"), "in_stock").when(
                availability.rlike("(?i)OutOfStock|SoldOut|Discontinued"), "out_of_stock"
            ),
            "image_url": F.when(
                F.col("ld.image").startswith("["), F.get_json_object(F.col("ld.image"), "$[0]")
            ).otherwise(F.col("ld.image")),
        }
    )
    shown = F.coalesce("price_json_ld", "price_embedded", "price_element")
    df = df.withColumns(
        {
            "page_stock": F.coalesce(
                "ld_stock",
                F.when(_text("body").rlike(SOLD_OUT_B), "out_of_stock"),
                F.when(shown.isNotNull(), "in_stock"),
                F.lit("unknown"),
            ),
            "_shown": shown,
        }
    ).withColumn("price_html", F.when(F.col("page_stock") == "in_stock", F.col("_shown")))
    on_page = F.col("price_html")
    embedded_mrp = amount_paise(_group(F.col("html"), EMBEDDED_MRP_B))
    page_mrp = F.when(
        on_page.isNotNull(),
        F.coalesce(amount_paise(_one("struck")), F.when(embedded_mrp >= on_page, embedded_mrp), on_page),
    )
    gone = F.coalesce(F.col("local_stock") == "out_of_stock", F.lit(False))
    local = F.col("local_price_paise").isNotNull()
    lines = _raw(_all("line"), None)
    source = F.when(F.col("price_json_ld").isNotNull(), "jsonld").when(
        F.col("price_embedded").isNotNull(), "embedded-json"
    )
    df = df.withColumns(
        {
            "price_paise": F.when(gone, None).when(local, F.col("local_price_paise")).otherwise(on_page),
            "mrp_paise": F.when(gone, None).when(local, F.col("local_mrp_paise")).otherwise(page_mrp),
            "stock_status": F.when(gone, "out_of_stock").when(local, "in_stock").otherwise(
                F.col("page_stock")
            ),
            "price_source": F.when(gone, None)
            .when(local, "pincode-api")
            .when(on_page.isNotNull(), source.otherwise("price-element")),
            "raw_offers": _state_offer_rows(),
        }
    )
    df = df.withColumns(
        {
            "offers": normalise(
                F.when(F.size("raw_offers") > 0, F.col("raw_offers")).otherwise(lines)
            ),
            "marketplace_product_id": F.coalesce(
                "page_pid", "page_item", "own_pid", "own_item", F.lit("")
            ),
        }
    )
    failed = F.lit("parse_failed")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    failures = [
        (F.col("wall").isNotNull(), F.col("wall"), F.lit("interstitial page")),
        (differs("page_item", "own_item"), failed, F.lit("page is for another listing")),
        (differs("page_pid", "own_pid"), failed, F.lit("page is for another variant")),
        *_checks(),
    ]
    return _finish(df, failures, F.lit("flipkart"))
