"""Money, offers, URLs, clocks and messages, case by case."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricelark.functions import clock, money, offers, render, urls
from pricelark.model import DEFAULT_TEMPLATES, Settings
from pricelark.operators import digest as G
from pricelark.operators import usage as U


@pytest.fixture
def one(spark):
    def run(column, **values):
        types = {bool: "boolean", int: "bigint", float: "double", str: "string", datetime: "timestamp"}
        schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in values.items()) or "x int"
        row = tuple(values.values()) or (1,)
        return spark.createDataFrame([row], schema).select(column.alias("c")).first().c

    return run


@pytest.mark.parametrize(
    "text,paise",
    [
        ("₹1,29,900.00", 12990000),
        ("1,299", 129900),
        ("Rs. 999", 99900),
        ("INR 49.5", 4950),
        ("₹ 0", None),
        ("free", None),
        ("", None),
        ("12 34", 123400),
        ("₹ 1 299", 129900),
    ],
)
def test_amounts(one, text, paise):
    assert one(money.amount_paise(F.col("t")), t=text) == paise


@pytest.mark.parametrize(
    "paise,text",
    [(0, "₹0"), (99900, "₹999"), (129900, "₹1,299"), (12345650, "₹1,23,456.50"), (1234567805, "₹1,23,45,678.05"), (100000000000, "₹1,00,00,00,000")],
)
def test_indian_grouping(one, paise, text):
    assert one(money.format_inr(F.col("p")), p=paise) == text


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Bank Offer: 5% Cashback on cards", "bank_offer"),
        ("No Cost EMI on select cards", "no_cost_emi"),
        ("no-cost emi", "no_cost_emi"),
        ("EMI offers from ₹500", "emi"),
        ("Cash back up to 50", "cashback"),
        ("Flat coupon", "coupon"),
        ("Get GST invoice", "partner"),
        ("Buy with exchange", "exchange"),
        ("10% instant discount", "bank_offer"),
        ("Free delivery", "other"),
        ("embankment", "other"),
    ],
)
def test_categories(one, text, kind):
    assert one(offers.classify(F.col("t")), t=text) == kind


def _raw(*texts):
    return F.array(*[F.struct(F.lit(l).cast("string").alias("label"), F.lit(t).alias("description")) for l, t in texts])


def test_normalise_dedupes_orders_and_labels(one):
    raw = _raw((None, "  Zeta   offer "), ("Bank Offer", "5% Cashback"), (None, "zeta offer. ."), (None, " "))
    got = one(offers.normalise(raw))
    assert [(o.type, o.description) for o in got] == [("bank_offer", "5% Cashback"), ("other", "Zeta offer")]


def test_hash_ignores_order_and_dots_not_amounts(one):
    a = one(offers.offers_hash(offers.normalise(_raw((None, "A 5"), (None, "B • x")))))
    b = one(offers.offers_hash(offers.normalise(_raw((None, "b  x . ."), (None, "a 5.")))))
    c = one(offers.offers_hash(offers.normalise(_raw((None, "A 6"), (None, "B x")))))
    assert a == b != c


LISTING = ("listing", "https://www.amazon.in/dp/B0CHX1W1XY", "B0CHX1W1XY")


@pytest.mark.parametrize(
    "url",
    [
        "https://www.amazon.in/dp/B0CHX1W1XY",
        "https://www.amazon.in/A-Slug/dp/B0CHX1W1XY",
        "https://www.amazon.in/dp/B0CHX1W1XY/ref=sr_1_3?keywords=x&qid=1",
        "https://www.amazon.in/dp/B0CHX1W1XY?tag=a-21",
        "https://www.amazon.in/gp/product/B0CHX1W1XY",
        "https://www.amazon.in/gp/aw/d/B0CHX1W1XY",
        "https://amazon.in/dp/B0CHX1W1XY",
        "https://m.amazon.in/dp/B0CHX1W1XY",
        "https://www.amazon.in/dp/B0CHX1W1XY/",
        "  https://www.amazon.in/dp/B0CHX1W1XY#top  ",
        "https://www.amazon.in/x?asin=B0CHX1W1XY&y=1",
    ],
)
def test_one_listing_many_links(one, url):
    r = one(urls.recognise(F.col("u")), u=url)
    assert (r.kind, r.canonical_url, r.marketplace_product_id) == LISTING


@pytest.mark.parametrize(
    "url,kind,site",
    [
        ("https://www.amazon.in/", "not_a_listing", None),
        ("https://www.amazon.in/s?k=phone", "not_a_listing", None),
        ("https://www.flipkart.com/mobiles/pr?sid=x", "not_a_listing", None),
        ("https://www.myntra.com/tshirt/p/123", "unsupported", "myntra.com"),
        ("https://www.amazon.com/dp/B0CHX1W1XY", "unsupported", "amazon.com"),
        ("https://notamazon.in/dp/B0CHX1W1XY", "unsupported", "notamazon.in"),
        ("not a url", "unsupported", None),
        ("", "unsupported", None),
    ],
)
def test_other_links(one, url, kind, site):
    r = one(urls.recognise(F.col("u")), u=url)
    assert (r.kind, r.detected_site) == (kind, site)


def test_variant_kept_only_when_well_formed(one):
    base = "https://dl.flipkart.com/s/p/itm4d2f8c3ba9e21?pid="
    assert one(urls.recognise(F.lit(base + "MOBGXKZ4GFWZHQCE&lid=1"))).marketplace_product_id == "MOBGXKZ4GFWZHQCE"
    assert one(urls.recognise(F.lit(base + "mobgx"))).marketplace_product_id == "itm4d2f8c3ba9e21"


def test_a_domain_is_claimed_once():
    registry = urls.default_registry()
    with pytest.raises(ValueError):
        registry.claim("other", ["AMAZON.in"])


@pytest.mark.parametrize(
    "start,end,utc,quiet",
    [
        ("22:00", "07:00", datetime(2026, 7, 1, 16, 30), True),  # 22:00 local
        ("22:00", "07:00", datetime(2026, 7, 1, 1, 29), True),
        ("22:00", "07:00", datetime(2026, 7, 1, 1, 30), False),  # 07:00 local
        ("13:00", "15:00", datetime(2026, 7, 1, 8, 0), True),
        ("13:00", "15:00", datetime(2026, 7, 1, 9, 30), False),
        (None, "07:00", datetime(2026, 7, 1, 20, 0), False),
        ("7pm", "07:00", datetime(2026, 7, 1, 20, 0), False),
        ("25:00", "07:00", datetime(2026, 7, 1, 20, 0), False),
        ("22:00", "22:00", datetime(2026, 7, 1, 16, 30), False),
    ],
)
def test_quiet_windows(one, start, end, utc, quiet):
    zone = "Asia/Kolkata"
    assert one(clock.in_quiet_hours(F.col("t"), start, end, zone), t=utc) is quiet
    release = one(clock.quiet_release(F.col("t"), start, end, zone), t=utc)
    assert (release is not None) is quiet and (release is None or release > utc)


@pytest.mark.parametrize(
    "seconds,text",
    [(-5, "just now"), (44, "just now"), (45, "1 minute ago"), (89, "1 minute ago"), (90, "2 minutes ago"), (3570, "1 hour ago"), (86400, "1 day ago"), (3 * 86400, "3 days ago")],
)
def test_relative_time(one, seconds, text):
    now = datetime(2026, 7, 1, 12)
    then = datetime.fromtimestamp(now.timestamp() - seconds)
    assert one(clock.relative_time(F.col("a"), F.col("b")), a=then, b=now) == text


def test_stamp_is_locale_free(one):
    assert one(clock.stamp(F.col("t"), "Asia/Kolkata"), t=datetime(2026, 6, 30, 20, 21)) == "01 Jul 2026, 01:51 AM"
    assert one(clock.stamp(F.col("t"), "UTC"), t=datetime(2026, 9, 5, 12, 0)) == "05 Sept 2026, 12:00 PM"


def test_heartbeat(one):
    now = datetime(2026, 7, 1)
    old = datetime(2026, 6, 30, 23, 57, 59)
    assert one(clock.stale(F.col("a"), F.col("b"), 120), a=old, b=now)
    assert not one(clock.stale(F.col("b"), F.col("b"), 120), b=now)
    assert one(clock.stale(F.lit(None).cast("timestamp"), F.col("b"), 120), b=now)


def split(text, limit):
    """Line packing, one line at a time."""
    if len(text) <= limit:
        return [text]
    out, cur = [], ""
    for line in text.split("\n"):
        if len(line) > limit:
            out += [cur] if cur else []
            cur = ""
            out += [line[i : i + limit] for i in range(0, len(line), limit)]
        elif len(cur) + len(line) + 1 > limit:
            out.append(cur)
            cur = line
        else:
            cur = f"{cur}\n{line}" if cur else line
    return out + ([cur] if cur else [])


@pytest.mark.parametrize(
    "text",
    ["a", "ab\ncd\nef\ngh", "x" * 35, "ab\n" + "y" * 25 + "\ncd", "\n\n\nabcdefghi\n\nk", "z" * 10, "z" * 10 + "\n" + "w" * 9],
)
def test_chunks(one, text):
    got = one(render.chunks(F.col("t"), 10), t=text)
    assert got == split(text, 10)
    assert all(len(c) <= 10 for c in got)


def test_wide_characters_count_double(one):
    assert one(render.units(F.col("t")), t="a🎯b") == 4
    assert len(one(render.chunks(F.col("t"), 10), t="🎯🎯🎯\n🎯🎯🎯")) == 2


@pytest.mark.parametrize("text", ["🎯" * 23, "a" + "🎯" * 12 + "b\n" + "c🎯" * 9, "x" * 9 + "🎯" + "y" * 9])
def test_parts_fit_in_units_and_hold_every_character(one, text):
    got = one(render.chunks(F.col("t"), 10), t=text)
    assert all(len(c.encode("utf-16-le")) <= 20 for c in got)
    assert "".join(got).replace("\n", "") == text.replace("\n", "")
    # a part ends only where the next character would not fit, or at a line end
    assert len(got[0].encode("utf-16-le")) >= 18


def test_template_is_filled_once_and_unknown_names_vanish(one):
    text = render.fill("{{ a }}-{{b}}-{{nope}}!", {"a": F.lit("{{b}}"), "b": F.lit("x")})
    assert one(text) == "{{b}}-x-!"


def _alert(spark, **values):
    base = {
        "product_id": 1, "type": "target_price", "fired_at": datetime(2026, 6, 30, 20, 21),
        "old_paise": 7490000, "new_paise": 6490000, "target_paise": 6500000, "change_pct": -13.35,
    }
    row = {**base, **values}
    schema = "product_id long, type string, fired_at timestamp, old_paise long, new_paise long, target_paise long, change_pct double"
    alerts = spark.createDataFrame([tuple(row[k] for k in base)], schema)
    products = spark.createDataFrame(
        [(1, "Phone <A> & B", "flipkart", "https://f/p?a=1&b=2")],
        "product_id long, display_name string, marketplace string, canonical_url string",
    )
    return alerts, products


def test_message(spark):
    alerts, products = _alert(spark)
    text = G.rendered(alerts, products, Settings()).first().message
    assert text == (
        "🎯 <b>Target price reached</b> — Flipkart\n📱 Phone &lt;A&gt; &amp; B\n\n"
        "Was:     ₹74,900\nNow:     ₹64,900\nTarget:  ₹65,000\n\n"
        '🔗 <a href="https://f/p?a=1&amp;b=2">Open on Flipkart</a>\n⏰ 01 Jul 2026, 01:51 AM'
    )


def test_own_template_blank_falls_back(spark):
    alerts, products = _alert(spark, type="price_change")
    own = Settings(templates={"price_change": "{{typeLabel}} {{changeSign}}{{changePct}}  \n"})
    assert G.rendered(alerts, products, own).first().message == "Price Decreased −13.35%"
    blank = Settings(templates={"price_change": "  "})
    assert "Price Decreased" in G.rendered(alerts, products, blank).first().message


def test_every_type_has_a_template():
    from pricelark.model import ALERT_EMOJI, ALERT_TYPE_LABELS, ALERT_TYPES

    assert set(DEFAULT_TEMPLATES) == set(ALERT_TYPES) == set(ALERT_TYPE_LABELS) == set(ALERT_EMOJI)


def test_safe_html(one):
    bad = '<b onclick="x()">hi</b><script>1</script><a href="javascript:alert(1)">z</a>'
    assert one(render.safe_html(F.col("t")), t=bad) == '<b>hi</b><a href="alert(1)">z</a>'


def test_labels(one):
    assert one(U.bytes_label(F.lit(2_345_678_901))) == "2.35 GB"
    assert one(U.bytes_label(F.lit(80_250_000))) == "80.3 MB"
    assert one(U.bytes_label(F.lit(999))) == "999 B"
    assert one(U.interval_label(F.lit(90))) == "1h 30m"
    assert [U.window_days(d) for d in (None, 0, 0.4, 7.5, 60)] == [14, 14, 14, 8, 60]
    for days in (900, -3):
        with pytest.raises(ValueError):
            U.window_days(days)
