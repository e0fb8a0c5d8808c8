"""Offer text: comparison form, classification, normalising, hashing and diffing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelark.functions.binding import let

# Category labels at the start of an offer text, tried in order.
LABEL_PREFIXES = [
    ("no_cost_emi", r"^\s*no[\s-]?cost\s*emi\b"),
    ("emi", r"^\s*emi( offers?)?\b"),
    ("bank_offer", r"^\s*bank offer\b"),
    ("cashback", r"^\s*cash\s?back\b"),
    ("coupon", r"^\s*coupon\b"),
    ("partner", r"^\s*partner offers?\b"),
    ("exchange", r"^\s*exchange( offer)?\b"),
]
# Keywords anywhere in the text, tried in order after the labels.
KEYWORDS = [
    ("no_cost_emi", r"\bno[\s-]?cost\s*emi\b"),
    ("cashback", r"\bcash\s?back\b"),
    ("exchange", r"\bexchange\b"),
    ("coupon", r"\bcoupon\b"),
    ("partner", r"\b(partner offer|gst invoice|business purchase|gst)\b"),
    ("bank_offer", r"\b(bank|credit card|debit card|emi|instant discount|upi)\b"),
]
# Fixed value: decorative characters that never distinguish two offers.
DECORATION = "|•·*_"

# whitespace as the web defines it; the regex engine's own \\s is ASCII only
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_WORD = "[A-Za-z0-9_]"
# no text without one of these words can have a category
_ANY_WORD = "(?i)emi|cash|coupon|partner|exchange|gst|business|bank|card|instant|upi"


def _ascii_edges(pattern: str) -> str:
    """ASCII word boundaries; the engine's own ones follow Unicode letters."""
    pattern = re.sub(r"\\b(?=[\w(])", lambda _: f"(?<!{_WORD})", pattern)
    return pattern.replace(r"\b", f"(?!{_WORD})")


def squash(text: Column) -> Column:
    """Runs of whitespace to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def comparison_form(text: Column) -> Column:
    """Lower-case text without decoration, extra spaces or trailing dots."""
    # letters and digits, nearly all of a text, are refused by the first range that is tried
    blank = "[[^a-z0-9]&&[" + DECORATION + SPACE[1:] + "]+"
    plain = F.regexp_replace(F.lower(text), blank, " ")
    return F.ltrim(F.rtrim(plain, F.lit(" .")))


def classify(text: Column) -> Column:
    """Offer category by leading label, else by keyword, else 'other'."""
    plain = F.regexp_replace(text, SPACE, " ")
    out = F.when(~text.rlike(_ANY_WORD), F.lit("other"))
    for kind, pattern in LABEL_PREFIXES + KEYWORDS:
        out = out.when(plain.rlike("(?i)" + _ascii_edges(pattern)), F.lit(kind))
    return out.otherwise(F.lit("other"))


def normalise(raw: Column) -> Column:
    """array<struct<label, description>> -> array<struct<type, description>>.

    Cleans each text, drops blanks, keeps the first of equal comparison forms and
    orders by comparison form so the result does not depend on page order.
    """
    cleaned = F.transform(
        raw,
        lambda o, i: F.struct(
            comparison_form(squash(o["description"])).alias("form"),
            i.alias("pos"),
            o["label"].alias("label"),
            squash(o["description"]).alias("description"),
        ),
    )
    by_form = F.array_sort(F.filter(cleaned, lambda o: o["description"] != ""))

    def first_of_form(entries: Column) -> Column:
        # next to its predecessor, a repeated form shows without searching the list
        return F.filter(
            entries,
            lambda o, i: (i == 0) | (F.get(entries, i - 1)["form"] != o["form"]),
        )

    return F.transform(
        let(by_form, first_of_form),
        lambda o: F.struct(
            classify(
                F.when(
                    F.coalesce(o["label"], F.lit("")) != "",
                    F.concat_ws(" ", o["label"], o["description"]),
                ).otherwise(o["description"])
            ).alias("type"),
            o["description"].alias("description"),
        ),
    )


def offers_hash(offers: Column) -> Column:
    """Order-free hash over category and comparison form."""
    lines = F.transform(
        offers, lambda o: F.concat(o["type"], F.lit("|"), comparison_form(o["description"]))
    )
    return F.sha2(F.array_join(F.sort_array(lines), "\n"), 256)


def _forms(offers: Column) -> Column:
    return F.transform(offers, lambda o: comparison_form(o["description"]))


def differences(now: Column, was: Column) -> Column:
    """Offers of either list whose comparison form is not in the other, as a struct (added, removed).
    Every comparison form is made once."""
    bound = F.struct(now.alias("n"), was.alias("w"), _forms(now).alias("nf"), _forms(was).alias("wf"))

    def without(offers: Column, own: Column, known: Column) -> Column:
        return F.filter(offers, lambda _, i: ~F.array_contains(known, F.get(own, i)))

    def both(b: Column) -> Column:
        return F.struct(
            without(b["n"], b["nf"], b["wf"]).alias("added"), without(b["w"], b["wf"], b["nf"]).alias("removed")
        )

    # equal lists, by far the commonest case, need no comparison forms
    none = F.struct(F.slice(now, 1, 0).alias("added"), F.slice(was, 1, 0).alias("removed"))
    return F.when(now == was, none).otherwise(let(bound, both))
