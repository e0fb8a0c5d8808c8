"""Message rendering: template variables, substitution, chunking, HTML cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.clock import stamp
from pricelark.functions.money import format_inr, half_up
from pricelark.model import (
    ALERT_EMOJI,
    ALERT_TYPE_LABELS,
    CHUNK_MAX,
    DEFAULT_TEMPLATES,
    FAILURE_REASON_LABELS,
    MARKETPLACE_LABELS,
    MESSAGE_MAX,
    Settings,
)


def lookup(code: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """Label of a code from a small fixed table."""
    out = None
    for key, label in labels.items():
        test = code == key
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out if default is None else out.otherwise(F.lit(default))


def escape_html(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def safe_html(text: Column) -> Column:
    """Stored message HTML without scripts, styles, handlers or script links."""
    text = F.regexp_replace(text, r"(?is)<\s*(script|style)[^>]*>.*?<\s*/\s*\1\s*>", "")
    text = F.regexp_replace(text, r"(?i) on\w+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    return F.regexp_replace(text, r"(?i)javascript:", "")


def plain_number(x: Column) -> Column:
    """Shortest text of a number with at most two decimals: 5, 7.7, 12.34."""
    cents = F.round(F.abs(x) * 100).cast("bigint")
    rest = cents % 100
    frac = (
        F.when(rest == 0, "")
        .when(rest % 10 == 0, F.concat(F.lit("."), F.floor(rest / 10).cast("string")))
        .otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0")))
    )
    return F.concat(F.floor(cents / 100).cast("string"), frac)


def _money(paise: Column) -> Column:
    return F.coalesce(format_inr(paise), F.lit("—"))


def _bullets(offers: Column, empty: str) -> Column:
    lines = F.transform(
        offers, lambda o: F.concat(F.lit("• "), escape_html(o["description"]))
    )
    return F.when(
        offers.isNull() | (F.size(offers) == 0), F.lit(empty)
    ).otherwise(F.array_join(lines, "\n"))


def variables(settings: Settings) -> dict[str, Column]:
    """Every template variable over an alert row joined with its product."""
    kind = F.col("type")
    old, new = F.col("old_paise"), F.col("new_paise")
    fallback = half_up((new - old).cast("double") / old * 1000.0) / 10.0
    pct = F.coalesce("change_pct", F.when(old != 0, fallback))
    sign = F.coalesce(F.signum((new - old).cast("double")), F.signum(F.coalesce(pct, F.lit(0.0))))
    market = F.coalesce(
        lookup(F.col("marketplace"), MARKETPLACE_LABELS), F.lit(MARKETPLACE_LABELS["amazon_in"])
    )
    url = F.coalesce("url", F.lit(""))
    is_move = kind == "price_change"
    return {
        "emoji": F.when(is_move, F.when(sign > 0, "🟡").otherwise("🟢")).otherwise(
            lookup(kind, ALERT_EMOJI)
        ),
        "typeLabel": F.when(
            is_move, F.when(sign > 0, "Price Increased").otherwise("Price Decreased")
        ).otherwise(lookup(kind, ALERT_TYPE_LABELS)),
        "productName": escape_html(F.coalesce("display_name", F.lit(settings.app_name))),
        "marketplace": market,
        "url": escape_html(url),
        "link": F.when(
            url != "",
            F.concat(
                F.lit('<a href="'), escape_html(url), F.lit('">Open on '), market, F.lit("</a>")
            ),
        ).otherwise(""),
        "time": stamp(F.col("fired_at"), settings.timezone),
        "oldPrice": _money(old),
        "newPrice": _money(new),
        "price": _money(F.coalesce(new, old)),
        "changePct": F.coalesce(F.concat(plain_number(pct), F.lit("%")), F.lit("—")),
        "changeArrow": F.when(sign > 0, "▲").when(sign < 0, "▼").otherwise("■"),
        "changeSign": F.when(sign > 0, "+").when(sign < 0, "−").otherwise(""),
        "target": _money(F.col("target_paise")),
        "oldOffers": _bullets(F.col("old_offers"), "No offers"),
        "newOffers": _bullets(F.col("new_offers"), "No offers"),
        "addedOffers": _bullets(F.col("added"), "None"),
        "removedOffers": _bullets(F.col("removed"), "None"),
        "failureReason": F.coalesce(
            lookup(F.col("failure_reason"), FAILURE_REASON_LABELS), F.lit("Repeated failures")
        ),
        "failureCount": F.coalesce(F.col("consecutive_failures"), F.lit(0)).cast("string"),
        "healthMessage": escape_html(F.coalesce("health_message", F.lit("Attention needed"))),
    }


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template as one concatenation; unknown names are empty.

    The template is split once on the driver, so a value that happens to contain a
    placeholder is never substituted again.
    """
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template, flags=re.ASCII)
    cols = [
        F.lit(part) if i % 2 == 0 else values.get(part, F.lit(""))
        for i, part in enumerate(parts)
        if i % 2 or part
    ]
    return F.concat(*cols) if cols else F.lit("")


def with_message(alerts: DataFrame, settings: Settings) -> DataFrame:
    """Add ``message``: the user's template for the alert's type, or the default one.

    The variables are columns of their own first, so each is computed once however
    many templates name it.
    """
    values = variables(settings)
    named = alerts.withColumns({"_v_" + n: v for n, v in values.items()})
    refs = {n: F.col("_v_" + n) for n in values}
    out = None
    for kind, default in DEFAULT_TEMPLATES.items():
        own = settings.templates.get(kind, "")
        text = fill(own if own.strip() else default, refs)
        test = F.col("type") == kind
        out = F.when(test, text) if out is None else out.when(test, text)
    return named.withColumn("message", F.regexp_replace(out, r"\s+$", "")).drop(
        *["_v_" + n for n in values]
    )


def units(text: Column) -> Column:
    """Length as the message API counts it: characters beyond the basic plane are two."""
    return F.length(F.regexp_replace(text, "[\\x{10000}-\\x{10FFFF}]", "xx"))


def chunks(text: Column, limit: int = CHUNK_MAX) -> Column:
    """Split at line ends into parts of at most ``limit``; longer lines are cut hard.

    Works on lines packed by running length, so a long text costs time in proportion
    to its length.
    """
    # a filler behind each character that counts as two; no part ends between the two
    filled = F.regexp_replace(text, "([\\x{10000}-\\x{10FFFF}])", "$1\uffff")
    runs = rf"(?s).{{1,{limit}}}(?!\uffff)"

    def cut(line: Column) -> Column:
        return F.regexp_extract_all(line, F.lit(runs), F.lit(0))

    def bare(part: Column) -> Column:
        return F.replace(part, F.lit("\uffff"), F.lit(""))

    pieces = F.flatten(
        F.transform(
            F.split(filled, "\n"),
            lambda line: F.when(
                F.length(line) > limit,
                F.transform(cut(line), lambda s: F.struct(bare(s).alias("s"), F.lit(True).alias("whole"))),
            ).otherwise(F.array(F.struct(bare(line).alias("s"), F.lit(False).alias("whole")))),
        )
    )
    kind = "struct<done:array<string>,cur:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")).cast(kind)

    def flush(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(
            acc["done"]
        )

    def step(acc: Column, p: Column) -> Column:
        alone = F.struct(F.concat(flush(acc), F.array(p["s"])).alias("done"), F.lit("").alias("cur"))
        over = units(acc["cur"]) + units(p["s"]) + 1 > limit
        turn = F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), p["s"].alias("cur"))
        grow = F.struct(
            acc["done"].alias("done"),
            F.when(acc["cur"] != "", F.concat_ws("\n", acc["cur"], p["s"]))
            .otherwise(p["s"])
            .alias("cur"),
        )
        return F.when(p["whole"], alone).when(over, turn).otherwise(grow).cast(kind)

    folded = F.aggregate(pieces, start, step, flush)
    return F.when(units(text) <= limit, F.array(text)).otherwise(folded)


def outgoing(text: Column) -> Column:
    """The parts actually sent: one when it fits a message, else its chunks."""
    return F.when(units(text) > MESSAGE_MAX, chunks(text)).otherwise(F.array(text))
