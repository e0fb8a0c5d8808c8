"""Input rules as data-quality columns, and audit retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.model import AUDIT_RETENTION_DAYS

# Bounds of user-set product fields.
NAME_MAX = 300
NOTES_MAX = 5000
TAG_MAX = 50
TAGS_MAX = 20


def product_rules() -> dict[str, Column]:
    """Rule name -> whether the row breaks it; null fields are unset and pass."""
    every, priority, pct = F.col("interval_minutes"), F.col("priority"), F.col("threshold_bp")
    bad_tag = F.exists("tags", lambda t: (F.length(t) < 1) | (F.length(t) > TAG_MAX))
    return {
        "display_name": (F.length("display_name") < 1) | (F.length("display_name") > NAME_MAX),
        "target_price": F.col("target_paise") <= 0,
        "drop_threshold": (pct < 0) | (pct > 9900),
        "interval": (every < 10) | (every > 1440),
        "priority": (priority < 1) | (priority > 1_000_000),
        "notes": F.length("notes") > NOTES_MAX,
        "tags": bad_tag | (F.size("tags") > TAGS_MAX),
    }


def settings_rules() -> dict[str, Column]:
    """The same for rows of user settings."""

    def outside(name: str, low: float, high: float) -> Column:
        return (F.col(name) < low) | (F.col(name) > high)

    clock = r"^\d{1,2}:\d{2}$"
    return {
        "check_interval_minutes": outside("check_interval_minutes", 10, 1440),
        "drop_threshold_pct": outside("drop_threshold_pct", 0.1, 99),
        "failure_limit": outside("failure_limit", 2, 50),
        "cooldown_minutes": outside("cooldown_minutes", 0, 1440),
        "near_low_pct": outside("near_low_pct", 0, 50),
        "quiet_start": ~F.col("quiet_start").rlike(clock),
        "quiet_end": ~F.col("quiet_end").rlike(clock),
        "digest_time": ~F.col("digest_time").rlike(clock),
        "daily_check_time": ~F.col("daily_check_time").rlike(clock),
        "digest_frequency": ~F.col("digest_frequency").isin("off", "daily", "weekly"),
        "pincode": ~F.col("pincode").rlike(r"^\d{6}$"),
    }


def violations(rules: dict[str, Column]) -> Column:
    """Names of the broken rules, in rule order."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(n)) for n, test in rules.items()])
    )


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def retained(audit: DataFrame, now: Column, days: int = AUDIT_RETENTION_DAYS) -> DataFrame:
    """Audit rows within retention; a row exactly at the cutoff stays."""
    return audit.filter(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))
