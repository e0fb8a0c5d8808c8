"""Pages and pricing responses of our own making, one state each."""

import json

import pytest
from pyspark.sql import functions as F

from pricelark.extract import attempts, layouts
from pricelark.extract.markup import Page, compile_selector, pick, response_facts, state_offers

A_URL = "https://www.amazon.in/dp/B0TEST0001"
B_URL = "https://www.flipkart.com/product/p/itm0123456789abc?pid=ABCDEFGHIJKLMNOP"


def a_page(body, title="Kettle", asin="B0TEST0001"):
    head = f'<input type=hidden id="ASIN" value="{asin}">' if asin else ""
    return f'<html><body>{head}<span id="productTitle">\n {title}\n</span>{body}</body></html>'


CORE = (
    '<div id="corePriceDisplay_desktop_feature_div"><span class="a-price priceToPay">'
    '<span class="a-offscreen">₹1,299.00</span></span><span class="basisPrice">M.R.P.: '
    '<span class="a-price a-text-price"><span class="a-offscreen">₹69.90</span></span>'
    '<span class="a-price a-text-price"><span class="a-offscreen">₹1,999</span></span></span></div>'
)
IN = '<div id="availability"> <span>In stock</span></div>'


def card(title, text, count="1 offer", sheet=None):
    config = f" data-side-sheet='{json.dumps({'contentId': sheet})}'" if sheet else ""
    return (
        f'<div class="offers-items"><h6 class="offers-items-title">{title}</h6><span class="offers-items-content">'
        f'{text}<span class="a-truncate-cut">{text[:4]}…</span></span><a class="vsx-offers-count">{count}</a><i{config}></i></div>'
    )


@pytest.fixture
def run_a(spark):
    def run(html, expanded=None):
        df = spark.createDataFrame(
            [(A_URL, html, expanded)],
            f"url string, html string, expanded_offers {layouts.RAW_OFFERS}",
        )
        return layouts.extract_a(df).first()

    return run


@pytest.fixture
def run_b(spark):
    def run(html, stock=None, price=None, mrp=None, url=B_URL):
        df = spark.createDataFrame(
            [(url, html, stock, price, mrp)],
            "url string, html string, local_stock string, local_price_paise long, local_mrp_paise long",
        )
        return layouts.extract_b(df).first()

    return run


def test_a_in_stock(run_a):
    r = run_a(a_page(CORE + IN + '<img id="landingImage" src="x.jpg">'))
    assert (r.success, r.name, r.price_paise, r.mrp_paise, r.discount_pct) == (True, "Kettle", 129900, 199900, 35.02)
    assert (r.stock_status, r.image_url, r.price_source, r.offers) == ("in_stock", "x.jpg", "buy-box", [])


def test_a_out_of_stock_has_no_price(run_a):
    r = run_a(a_page(CORE + '<div id="availability">Currently unavailable. In stock soon</div>'))
    assert (r.success, r.stock_status, r.price_paise, r.mrp_paise) == (True, "out_of_stock", None, None)


def test_a_implied_stock_and_whole_price(run_a):
    body = '<div id="apex_desktop"><span class="a-price-whole">2,499.</span></div>'
    r = run_a(a_page(body))
    assert (r.price_paise, r.mrp_paise, r.stock_status, r.price_source) == (249900, 249900, "in_stock", "buy-box-whole")


def test_a_carousel_price_is_not_the_price(run_a):
    body = '<div id="sp_detail2"><span class="a-price a-text-price"><span class="a-offscreen">₹2,24,999</span></span></div>'
    r = run_a(a_page(CORE + IN + body))
    assert r.mrp_paise == 199900
    assert run_a(a_page(IN + body)).failure_reason == "parse_failed"


@pytest.mark.parametrize(
    "html,reason",
    [
        ('<form action="/errors/validateCaptcha">', "captcha"),
        ("To discuss automated access to Amazon data please contact", "fetch_blocked"),
        ("Looking for something?\n We're sorry, we can't find that page", "listing_removed"),
        (a_page(CORE + IN, asin="B0OTHER999"), "parse_failed"),
        (a_page(CORE + IN, title=" "), "parse_failed"),
        (a_page(IN), "parse_failed"),
    ],
)
def test_a_failures(run_a, html, reason):
    r = run_a(html)
    assert (r.success, r.failure_reason, r.price_paise, r.name) == (False, reason, None, None)


def test_a_offers(run_a):
    body = CORE + IN + '<label id="couponText1">Apply ₹50 coupon</label>'
    body += card("Bank Offer", "5% off on cards") + card("Partner Offers", "Get GST invoice")
    r = run_a(a_page(body))
    assert [(o.type, o.description) for o in r.offers] == [("bank_offer", "5% off on cards"), ("coupon", "Apply ₹50 coupon")]


def test_a_multi_offer_card_needs_its_offers(run_a):
    body = CORE + IN + card("Bank Offer", "Up to 10%", "3 offers", "InstantBankDiscount")
    assert run_a(a_page(body)).failure_reason == "parse_failed"
    r = run_a(a_page(body), [("Bank Offer", "one"), ("Bank Offer", "two")])
    assert [o.description for o in r.offers] == ["one", "two"]


def test_a_flat_offers(run_a):
    body = CORE + IN + '<div id="vsxoffers_feature_div"><p class="vsx-offers-desktop-lv__item">Flat  5%</p></div>'
    assert [o.description for o in run_a(a_page(body)).offers] == ["Flat 5%"]


def test_sheet_items(spark):
    texts = ["Offer 12  Get 5% back . .", "See it..", "Offer 1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(attempts.clean_sheet_item(F.col("t"))).collect()]
    assert got == ["Get 5% back", "See it", ""]


def ld(**offer):
    data = {"@type": "Product", "name": "Lamp", "image": ["i.jpg", "j.jpg"], "offers": offer}
    return f'<script type="application/ld+json">{json.dumps(data)}</script>'


def test_b_json_ld(run_b):
    html = ld(price="39999", availability="https://schema.org/InStock") + "<h1>x</h1><strike>₹45,999</strike><ul><li>Bank Offer: 5% cashback<li>Free delivery</ul>"
    r = run_b(html)
    assert (r.name, r.price_paise, r.mrp_paise, r.stock_status, r.price_source) == ("Lamp", 3999900, 4599900, "in_stock", "jsonld")
    assert [(o.type, o.description) for o in r.offers] == [("bank_offer", "Bank Offer: 5% cashback")]
    assert (r.image_url, r.marketplace_product_id) == ("i.jpg", "ABCDEFGHIJKLMNOP")


def test_b_sold_out_and_coming_soon(run_b):
    assert run_b(ld(price=5, availability="SoldOut")).stock_status == "out_of_stock"
    r = run_b(ld(price=500) + "<body><p>Coming Soon</p></body>")
    assert (r.success, r.stock_status, r.price_paise) == (True, "out_of_stock", None)


def test_b_embedded_json_then_element(run_b):
    r = run_b('<h1>Lamp</h1><script>{"sellingPrice":{"currency":"INR","value":1499},"mrp":1999}</script>')
    assert (r.price_paise, r.mrp_paise, r.price_source) == (149900, 199900, "embedded-json")
    r = run_b("<title>Lamp - Flipkart.com | Buy</title><div class='sel-price'>Now ₹ 1,499.50</div>")
    assert (r.name, r.price_paise, r.price_source) == ("Lamp", 149950, "price-element")


def test_b_walls_only_without_product_signs(run_b):
    assert run_b("<p>Are you a human?</p>").failure_reason == "captcha"
    assert run_b("<p>Access denied</p>").failure_reason == "fetch_blocked"
    assert run_b("<p>product no longer available</p>").failure_reason == "listing_removed"
    assert run_b(ld(price=5, availability="InStock") + "<p>request blocked</p>").success


def test_b_identity_compares_like_with_like(run_b):
    good = ld(price=5, availability="InStock")
    link = '<link rel="canonical" href="https://www.flipkart.com/x/p/{}">'
    assert run_b(link.format("itm0123456789abc") + good).success
    assert run_b(link.format("itm999999999999z") + good).failure_reason == "parse_failed"
    assert run_b(link.format("itm0123456789abc?pid=XXXXXXXXXXXXXXXX") + good).failure_reason == "parse_failed"


def test_b_local_price_wins_and_absence_nulls(run_b):
    good = ld(price=500, availability="InStock")
    r = run_b(good, "in_stock", 45000, None)
    assert (r.price_paise, r.mrp_paise, r.price_html, r.price_source) == (45000, None, 50000, "pincode-api")
    r = run_b(good, "out_of_stock")
    assert (r.stock_status, r.price_paise, r.price_source) == ("out_of_stock", None, None)


def test_b_price_above_list_price_is_rejected(run_b):
    r = run_b(ld(price=500, availability="InStock"), "in_stock", 45000, 44000)
    assert (r.success, r.failure_reason) == (False, "parse_failed")
    assert run_b(ld(price=500, availability="InStock"), "in_stock", 44200, 44000).success


def nep(title, sub, amount=None, kind=None, **more):
    out = {"type": "NepOffers", "offerTitle": title, "offerSubTitleRC": {"v": [{"contentValue": sub}]}, **more}
    if amount:
        out["label"] = {"metaInfoLabelValue": amount}
    if kind:
        out["offerType"] = kind
    return out


def test_b_state_offers(run_b):
    state = {"deep": [
        nep("Axis", "Credit Card • Cashback", "₹750 off", "PBO"),
        nep("Axis", "Debit Card", "₹750 off", "PBO"),  # same title and amount
        nep("HDFC", "Credit Card", "₹99 off/m (6 months)", tenure=6),
        nep("HDFC", "Credit Card • ₹2,000 off", "₹99 off/m (6 months)", tenure=6),
        nep("Bajaj", "No cost • 5% off", tenure=3),
        nep("Exchange", "Change pincode to exchange item", "₹0", "EXCHANGE"),
    ]}
    html = ld(price=500, availability="InStock") + f"<script>window.__INITIAL_STATE__ = {json.dumps(state)};</script>"
    got = [(o.type, o.description) for o in run_b(html).offers]
    assert got == [
        ("bank_offer", "Axis — Credit Card • Cashback — ₹750 off"),
        ("no_cost_emi", "Bajaj — No cost • 5% off"),
        ("emi", "HDFC — Credit Card • ₹2,000 off"),
    ]
    assert state_offers("window.__INITIAL_STATE__ = {broken") == []


def test_selectors():
    html = '<div id=a class="x y"><p class=z>one<p class="z w">two <b data-k="v1">three</b></div><input id=i value=7>'
    page = Page(html)
    texts = lambda css: [page.text(i) for i in page.select(compile_selector(css))]
    assert texts("#a .z:not(.w)") == ["one"]
    assert texts(".x p b, .missing") == ["three"]
    assert texts('[data-k^="v"]') == texts('[data-k*="1"]') == texts("[data-k]") == ["three"]
    assert texts("#a") == ["onetwo three"]
    got = pick(html, [{"key": "k", "css": compile_selector("input#i"), "attr": "value"}])
    assert [(h["key"], h["value"]) for h in got] == [("k", "7")]


def response(price=500, mrp=700, available=True, pincode="560001", reason=None, code=None, status="IN_STOCK"):
    pls = {"isAvailable": available, "availabilityStatus": status, "unserviceabilityReason": reason}
    context = {"pricing": {"finalPrice": {"value": price}, "mrp": mrp}, "fdpEventTracking": {"events": {"psi": {"pls": pls}}}}
    place = {"pincode": pincode, "city": "Pune", "errorCode": code}
    return json.dumps({"RESPONSE": {"pageData": {"pageContext": context}, "slots": [{"w": place}]}})


NO_SELLER = dict(code="NO_SERVICEABLE_SELLER")


@pytest.mark.parametrize(
    "tries,want",
    [
        ([response()], ("in_stock", 50000, 70000, 1, False)),
        ([response(mrp=400)], ("in_stock", 50000, None, 1, False)),
        ([response(available=False, pincode=None)], ("out_of_stock", None, None, 1, False)),
        ([response(status="COMING_SOON")], ("out_of_stock", None, None, 1, False)),
        ([response(**NO_SELLER), response()], ("in_stock", 50000, 70000, 2, False)),
        ([response(**NO_SELLER)] * 3, ("out_of_stock", None, None, 3, False)),
        ([response(reason="NoServiceableVendor")] * 3, ("out_of_stock", None, None, 3, False)),
        ([response(**NO_SELLER), response(pincode="110001"), None], (None, None, None, 3, True)),
        (["not json", "{}", None], (None, None, None, 3, True)),
    ],
)
def test_pricing_attempts(spark, tries, want):
    rows = [(1, i + 1, 503 if t is None else 200, t or "", "560001") for i, t in enumerate(tries)]
    df = spark.createDataFrame(rows, "check_id long, attempt int, status int, json string, pincode string")
    r = attempts.resolve_pricing(df).first()
    assert (r.local_stock, r.local_price_paise, r.local_mrp_paise, r.attempts, r.failed) == want


def test_response_search():
    tree = {"RESPONSE": {"pageData": {"pageContext": {"a": [{"sellerName": "S"}], "b": {"availabilityStatus": "sold_out"}}}}, "x": {"pincode": 560001, "city": "P"}}
    facts = response_facts(json.dumps(tree))
    assert (facts["pincode"], facts["city"], facts["sold_out"], facts["seller_name"]) == ("560001", "P", True, "S")


def test_tiers(spark):
    rows = [
        (1, "http", True, None), (1, "browser", True, None),
        (2, "http", False, "captcha"), (2, "browser", True, None),
        (3, "http", False, "captcha"), (3, "browser", False, "other"),
        (4, "http", False, "http_error"), (4, "browser", True, None),
        (5, "http", False, "parse_failed"),
    ]
    df = spark.createDataFrame(rows, "check_id long, tier string, success boolean, failure_reason string")
    got = {r.check_id: (r.tier, r.success, r.failure_reason) for r in attempts.choose_tier(df).collect()}
    assert got == {
        1: ("http", True, None), 2: ("browser", True, None), 3: ("browser", False, "other"),
        4: ("http", False, "http_error"), 5: ("http", False, "parse_failed"),
    }


def test_diagnostics_are_parsed_once(spark):
    """The blob is put together as text: what came in is read once, and no fact is parsed again."""
    texts = [None, " ", "{}", '{"z":1,"name":"old","a":{"q":[2.50,null]}}', "[1]", "null", "{cut"]
    rows = [(i, t, "N \"q\"" if i else None, 12345, [("bank_offer", "A  B..")]) for i, t in enumerate(texts)]
    schema = "check_id int, debug string, name string, price_paise long, offers array<struct<type:string,description:string>>"
    outcomes = spark.createDataFrame(rows, schema).withColumns(
        {"price_source": F.lit("buy-box"), "price_html": F.col("price_paise"), "price_json_ld": F.lit(None).cast("long"),
         "price_embedded_first": F.lit(None).cast("long"), "api_price_paise": F.lit(None).cast("long")}
    )
    out = attempts.audit_rows(outcomes).select("check_id", "debug")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    got = [r.debug for r in out.orderBy("check_id").collect()]
    own = [d[: d.index('"provenance"')] for d in got]
    assert own == ["{", "{", "{", '{"a":{"q":[2.5,null]},"z":1,', '{"value":[1],', '{"value":null,', '{"text":"{cut",']
    facts = json.loads(got[1])
    assert facts["name"] == 'N "q"' and json.loads(got[0])["name"] is None and len(facts["offers"]["hash"]) == 64
    assert facts["provenance"] == {"price": "buy-box", "priceHtml": "123.45"}
    assert facts["priceCandidates"] == [{"source": "html-winner", "value_paise": 12345}]
