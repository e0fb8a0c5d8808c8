"""User commands folded into product rules; links, deletes, settings changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = ["pause", "resume"]
TARGET = ["set_target", "edit_target", "clear_target"]


def fold(controls: DataFrame) -> DataFrame:
    """(product_id, at, control_id, action, target_paise) -> the last value of every field.

    Each field is a maximum over (at, control_id), so a product with any number of
    commands combines before the shuffle.
    """
    action = F.col("action")
    when_ = [F.col("at"), F.col("control_id")]

    def newest(test: Column, value: Column) -> Column:
        return F.max(F.when(test, F.struct(*when_, value.alias("v"))))["v"]

    target_set = F.max(F.when(action.isin(TARGET), F.struct(*when_, F.col("action"))))
    return controls.groupBy("product_id").agg(
        newest(
            action.isin(STATUS), F.when(action == "pause", "paused_user").otherwise("active")
        ).alias("new_status"),
        F.max(F.when(action == "resume", F.col("at"))).alias("failures_reset_at"),
        F.max(F.when(action.isin("resume", "check_now"), F.col("at"))).alias("due_at"),
        target_set.isNotNull().alias("target_changed"),
        newest(
            action.isin(TARGET), F.when(action != "clear_target", F.col("target_paise"))
        ).alias("new_target_paise"),
        F.max(F.when(action.isin("set_target", "clear_target"), F.col("at"))).alias(
            "latch_reset_at"
        ),
        F.max(F.when(action == "delete", F.lit(True))).alias("deleted"),
    )


def apply(products: DataFrame, folded: DataFrame) -> DataFrame:
    """Products with the folded commands applied; deleted ones are gone."""
    joined = products.join(folded, "product_id", "left")
    kept = joined.filter(F.col("deleted").isNull())
    return kept.withColumns(
        {
            "status": F.coalesce("new_status", "status"),
            "target_paise": F.when(
                F.coalesce("target_changed", F.lit(False)), F.col("new_target_paise")
            ).otherwise(F.col("target_paise")),
        }
    ).drop("new_status", "target_changed", "new_target_paise", "deleted")


def resume_all(state: DataFrame, at: Column) -> DataFrame:
    """One resume command per paused product."""
    paused = state.filter(F.col("status").isin("paused_auto", "paused_user"))
    return _commands(paused, at, "resume")


def check_all(state: DataFrame, at: Column) -> DataFrame:
    """One immediate check per active product."""
    return _commands(state.filter(F.col("status") == "active"), at, "check_now")


def _commands(state: DataFrame, at: Column, action: str) -> DataFrame:
    return state.select(
        "product_id",
        at.alias("at"),
        F.col("product_id").alias("control_id"),
        F.lit(action).alias("action"),
        F.lit(None).cast("bigint").alias("target_paise"),
    )


def validate_links(requests: DataFrame, products: DataFrame) -> DataFrame:
    """(request_id, a_id, b_id) -> accepted, reason. Each request on its own against the table."""
    side = products.select("product_id", "marketplace", "linked_product_id")
    joined = requests.join(side.toDF("a_id", "a_market", "a_link"), "a_id", "left").join(
        side.toDF("b_id", "b_market", "b_link"), "b_id", "left"
    )
    reason = (
        F.when(F.col("a_market").isNull() | F.col("b_market").isNull(), "not_found")
        .when(F.col("a_id") == F.col("b_id"), "same_product")
        .when(F.col("a_market") == F.col("b_market"), "same_marketplace")
        .when(F.col("a_link").isNotNull() | F.col("b_link").isNotNull(), "already_linked")
    )
    return joined.select(
        "request_id", "a_id", "b_id", reason.isNull().alias("accepted"), reason.alias("reason")
    )


def link(products: DataFrame, accepted: DataFrame) -> DataFrame:
    """Write both sides of accepted links."""
    both = accepted.select(F.col("a_id").alias("product_id"), F.col("b_id").alias("_l")).unionByName(
        accepted.select(F.col("b_id").alias("product_id"), F.col("a_id").alias("_l"))
    )
    return (
        products.join(both, "product_id", "left")
        .withColumn("linked_product_id", F.coalesce("_l", "linked_product_id"))
        .drop("_l")
    )


def unlink(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Clear the link on each named product and on its partner."""
    gone = ids.select("product_id").distinct()
    pairs = products.join(gone, "product_id", "left_semi").select(
        F.col("linked_product_id").alias("product_id")
    )
    cleared = gone.unionByName(pairs.filter(F.col("product_id").isNotNull())).distinct()
    flagged = products.join(cleared.withColumn("_c", F.lit(True)), "product_id", "left")
    return flagged.withColumn(
        "linked_product_id", F.when(F.col("_c").isNull(), F.col("linked_product_id"))
    ).drop("_c")


def link_candidates(products: DataFrame, marketplace: str) -> DataFrame:
    """Unlinked products of the other marketplace."""
    return products.filter(
        (F.col("marketplace") != marketplace) & F.col("linked_product_id").isNull()
    )


def cascade(fact: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of a fact table that survive the deletion of products."""
    return fact.join(deleted.select("product_id"), "product_id", "left_anti")


def set_null(products: DataFrame, column: str, survivors: DataFrame, key: str) -> DataFrame:
    """Null a reference whose target no longer exists."""
    alive = survivors.select(F.col(key).alias("_alive")).distinct()
    joined = products.join(alive, F.col(column) == F.col("_alive"), "left")
    return joined.withColumn(
        column, F.when(F.col("_alive").isNotNull(), F.col(column))
    ).drop("_alive")


def split_toggle(settings: DataFrame, old: str, first: str, second: str) -> DataFrame:
    """One column's value copied into two columns that replace it."""
    return settings.withColumns({first: F.col(old), second: F.col(old)}).drop(old)
