"""Several attempts per check to one outcome: tiers, localised pricing, audit rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.extract.markup import response_facts
from pricelark.functions.binding import let
from pricelark.functions.offers import offers_hash
from pricelark.model import ESCALATABLE

_FACTS = (
    "parsed boolean, pincode string, city string, error_code string, sold_out boolean,"
    "seller_id string, seller_name string"
)
# Places of the buy-box price in a pricing response, in order, and statuses
# that mean it cannot be bought.
CONTEXT = "$.RESPONSE.pageData.pageContext"
PSI = CONTEXT + ".fdpEventTracking.events.psi"
PRICE_PATHS = [
    CONTEXT + ".pricing.finalPrice",
    CONTEXT + ".pricing.fsp",
    PSI + ".ppd.finalPrice",
    PSI + ".ppd.fsp",
]
MRP_PATHS = [CONTEXT + ".pricing.mrp", PSI + ".ppd.mrp"]
UNBUYABLE = "(?i)OUT_OF_STOCK|SOLD_OUT|UNSERVICEABLE|COMING_SOON"


def choose_tier(attempts: DataFrame) -> DataFrame:
    """One attempt per check: the first tier when it worked or cannot be helped by the second.

    ``attempts(check_id, tier, success, failure_reason, ...)``, at most one per tier.
    """
    cols = [c for c in attempts.columns if c not in ("check_id", "tier")]
    row = F.struct(*cols)
    both = attempts.groupBy("check_id").agg(
        F.max(F.when(F.col("tier") == "http", row)).alias("_1"),
        F.max(F.when(F.col("tier") == "browser", row)).alias("_2"),
    )
    escalate = (
        F.col("_1").isNull()
        | (~F.col("_1.success") & F.col("_1.failure_reason").isin(ESCALATABLE))
    ) & F.col("_2").isNotNull()
    return both.select(
        "check_id",
        F.when(escalate, "browser").otherwise("http").alias("tier"),
        F.when(escalate, F.col("_2")).otherwise(F.col("_1")).alias("_r"),
    ).select("check_id", "tier", "_r.*")


def failure_from_status(status: Column, timed_out: Column) -> Column:
    """Failure reason of a fetch, null when it worked."""
    return (
        F.when(timed_out, "fetch_timeout")
        .when(status.isNull(), "http_error")
        .when(status.isin(404, 410), "listing_removed")
        .when(status.isin(403, 429, 503), "fetch_blocked")
        .when(status >= 400, "http_error")
    )


def _facts(text: Column) -> Column:
    @F.pandas_udf(_FACTS)
    def facts(texts: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in _FACTS.split(",")]
        return pd.DataFrame([response_facts(t) for t in texts], columns=names)

    return facts(text)


def _number(path: str) -> Column:
    """A number written plainly or as {value | amount | decimalValue}; in paise."""
    value = F.get_json_object("json", path)
    nested = F.coalesce(
        *[F.get_json_object(value, f"$.{k}").try_cast("double") for k in ("value", "amount", "decimalValue")]
    )
    return F.round(F.coalesce(value.try_cast("double"), nested) * 100).cast("bigint")


def read_responses(responses: DataFrame) -> DataFrame:
    """``(check_id, attempt, status, json, pincode)`` -> what each response says."""
    price = F.coalesce(*[_number(p) for p in PRICE_PATHS])
    mrp = F.coalesce(*[_number(p) for p in MRP_PATHS])
    status = F.nullif(F.get_json_object("json", PSI + ".pls.availabilityStatus"), F.lit(""))
    df = responses.withColumn("_f", _facts(F.coalesce("json", F.lit("")))).withColumns(
        {
            "price_paise": F.when(price > 0, price),
            "available": F.get_json_object("json", PSI + ".pls.isAvailable").try_cast("boolean"),
            "availability": status,
            "unserviceable": F.nullif(
                F.get_json_object("json", PSI + ".pls.unserviceabilityReason"), F.lit("")
            ),
            "applied": F.col("_f.pincode"),
            "city": F.col("_f.city"),
            "error_code": F.col("_f.error_code"),
            "seller": F.coalesce("_f.seller_name", "_f.seller_id"),
        }
    )
    unbuyable = F.coalesce(~F.col("available"), F.lit(False)) | F.coalesce(
        F.col("availability").rlike(UNBUYABLE), F.lit(False)
    )
    flagged = F.col("price_paise").isNotNull() & F.col("_f.sold_out")
    return df.withColumns(
        {
            "mrp_paise": F.when(mrp >= F.col("price_paise"), mrp),
            "unbuyable": unbuyable | flagged,
            "localised": F.col("unserviceable").isNull() & F.col("error_code").isNull(),
        }
    ).drop("_f")


def resolve_pricing(responses: DataFrame) -> DataFrame:
    """One localised price per check, or out of stock, or none.

    The first terminal attempt decides: an unbuyable listing ends the search, and a
    price counts once the response names the requested place. When every readable
    response says that no seller delivers there, the listing is out of stock.
    """
    read = read_responses(responses)
    ok = F.col("status") == 200
    gone = ok & F.col("unbuyable")
    trusted = (
        ok
        & ~F.col("unbuyable")
        & F.col("localised")
        & F.col("price_paise").isNotNull()
        & (F.col("applied") == F.col("pincode"))
    )
    verdict = F.struct(
        "attempt",
        gone.alias("gone"),
        F.when(~gone, F.col("price_paise")).alias("price_paise"),
        F.when(~gone, F.col("mrp_paise")).alias("mrp_paise"),
        F.coalesce(F.col("applied") == F.col("pincode"), F.lit(False)).alias("verified"),
    )
    votes = ok & ~F.col("unbuyable")
    sums = read.groupBy("check_id").agg(
        F.min(F.when(F.coalesce(gone | trusted, F.lit(False)), verdict)).alias("_v"),
        F.count_if(votes).alias("_votes"),
        F.count_if(votes & ~F.col("localised")).alias("_no_seller"),
        F.count("*").alias("_tried"),
    )
    nobody = F.col("_v").isNull() & (F.col("_votes") > 0) & (F.col("_votes") == F.col("_no_seller"))
    return sums.select(
        "check_id",
        F.when(F.col("_v.gone") | nobody, "out_of_stock")
        .when(F.col("_v").isNotNull(), "in_stock")
        .alias("local_stock"),
        F.col("_v.price_paise").alias("local_price_paise"),
        F.col("_v.mrp_paise").alias("local_mrp_paise"),
        F.coalesce("_v.verified", F.lit(False)).alias("verified"),
        F.coalesce("_v.attempt", "_tried").cast("int").alias("attempts"),
        (F.col("_v").isNull() & ~nobody).alias("failed"),
    )


def resolve_location(attempts: DataFrame) -> DataFrame:
    """Layout A: the first page that shows the requested place, or an unavailable listing.

    ``attempts(check_id, attempt, resolved_location, pincode, out_of_stock)``; a check
    without such a page fails.
    """
    applied = F.coalesce(F.col("resolved_location").contains(F.col("pincode")), F.lit(False))
    settles = applied | F.col("out_of_stock")
    pick = F.struct("attempt", applied.alias("applied"))
    return (
        attempts.groupBy("check_id")
        .agg(F.min(F.when(settles, pick)).alias("_v"), F.count("*").alias("_tried"))
        .select(
            "check_id",
            F.coalesce("_v.attempt", "_tried").cast("int").alias("attempts"),
            F.coalesce("_v.applied", F.lit(False)).alias("location_applied"),
            F.when(F.col("_v").isNull(), "other").alias("failure_reason"),
        )
    )


def clean_sheet_item(text: Column) -> Column:
    """An offer of a side sheet without its position prefix and trailing dots."""
    from pricelark.functions.offers import squash

    bare = F.regexp_replace(squash(text), r"(?i)^Offer\s+\d+\s*", "")
    return F.trim(F.regexp_replace(bare, r"[\s.]+$", ""))


def failure_fields(reason: Column, detail: Column) -> tuple[Column, Column]:
    """Anything uncategorised is 'other'; the detail is kept whole."""
    return F.coalesce(reason, F.lit("other")), detail


def price_candidates() -> Column:
    """Every price signal of a check with its source."""
    found = {
        "jsonld": "price_json_ld",
        "embedded-json": "price_embedded_first",
        "html-winner": "price_html",
        "pincode-api": "api_price_paise",
    }
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(c).isNotNull(),
                    F.struct(F.lit(s).alias("source"), F.col(c).alias("value_paise")),
                )
                for s, c in found.items()
            ]
        )
    )


def audit_rows(outcomes: DataFrame) -> DataFrame:
    """One diagnostic row per check; facts of the snapshot take their place in the JSON blob."""
    has = F.size(F.coalesce("offers", F.array())) > 0
    df = outcomes.withColumns(
        {
            "offers_count": F.size(F.coalesce("offers", F.array())),
            "offers_hash": F.when(has, offers_hash(F.col("offers"))),
            "_candidates": price_candidates(),
        }
    )
    items = F.transform(
        F.coalesce("offers", F.array()), lambda o: F.concat_ws(":", o["type"], o["description"])
    )
    def rupees(name: str) -> Column:
        return (F.col(name) / 100).cast("decimal(20,2)").cast("string")

    # members stand in the order of their names, as everywhere in the blob
    provenance = F.struct(
        F.col("price_source").alias("price"),
        rupees("price_embedded_first").alias("priceEmbedded"),
        rupees("price_html").alias("priceHtml"),
        rupees("price_json_ld").alias("priceJsonLd"),
    )
    listed = F.struct(F.col("offers_count").alias("count"), F.col("offers_hash").alias("hash"), items.alias("items"))
    facts = {
        "provenance": F.to_json(provenance),
        "name": _json_text(F.col("name")),
        "offers": F.to_json(listed),
        "priceCandidates": F.to_json("_candidates"),
    }
    blob = F.concat(*[x for i, (k, v) in enumerate(facts.items()) for x in (F.lit(f'{"," if i else ""}"{k}":'), v)])
    if "debug" in df.columns:
        own = let(F.try_parse_json("debug"), lambda read: _own_facts(F.col("debug"), read, list(facts)))
        blob = F.concat_ws(",", F.nullif(own, F.lit("")), blob)
    return df.withColumn("debug", F.concat(F.lit("{"), blob, F.lit("}"))).drop("_candidates", "offers")


def _json_text(text: Column) -> Column:
    """A text as JSON has it; null is said as null."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _own_facts(debug: Column, read: Column, facts: list[str]) -> Column:
    """Members of the diagnostics that came in but the facts, as JSON without its braces; ``read`` is
    their value. What is no object is kept whole: other JSON under `value`, text that is no JSON under
    `text`."""

    def members(of: Column) -> Column:
        own = F.map_filter(F.try_variant_get(of, "$", "map<string,variant>"), lambda k, _: ~k.isin(facts))
        return let(F.to_json(own), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))

    return (
        F.when(F.coalesce(F.trim(debug), F.lit("")) == "", "")
        .when(read.isNull(), F.concat(F.lit('"text":'), _json_text(debug)))
        .otherwise(F.coalesce(members(read), F.concat(F.lit('"value":'), F.to_json(read))))
    )
