"""Data model: enumerations, labels, message templates, settings and schemas.

Money is held in integer paise throughout, so rule boundaries are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- Fixed values: codes stored in the data -------------------------------
MARKETPLACES = ["amazon_in", "flipkart"]
PRODUCT_STATUSES = ["active", "paused_user", "paused_auto"]
STOCK_STATUSES = ["in_stock", "out_of_stock", "unknown"]
ALERT_TYPES = [
    "target_price",
    "threshold_drop",
    "price_change",
    "offer_change",
    "offer_added",
    "offer_removed",
    "back_in_stock",
    "auto_paused",
    "system_health",
]
DELIVERY_STATUSES = ["pending", "delivered", "failed", "held_quiet_hours", "suppressed"]
FAILURE_REASONS = [
    "fetch_blocked",
    "fetch_timeout",
    "http_error",
    "parse_failed",
    "listing_removed",
    "captcha",
    "other",
]
EXTRACTION_TIERS = ["http", "browser"]
OFFER_TYPES = [
    "bank_offer",
    "no_cost_emi",
    "emi",
    "cashback",
    "coupon",
    "exchange",
    "partner",
    "other",
]
REQUEST_KINDS = ["main_page", "pincode_api", "cookie_mint", "side_sheet", "exit_ip", "resolve"]

# --- Fixed values: labels ---------------------------------------------------
MARKETPLACE_LABELS = {"amazon_in": "Amazon India", "flipkart": "Flipkart"}
FAILURE_REASON_LABELS = {
    "fetch_blocked": "The marketplace temporarily blocked automated access",
    "fetch_timeout": "The marketplace did not respond in time",
    "http_error": "The marketplace returned an error",
    "parse_failed": "The page layout has changed; maintenance may be required",
    "listing_removed": "The listing appears to have been removed",
    "captcha": "The marketplace presented a verification challenge",
    "other": "An unexpected error occurred",
}
OFFER_TYPE_LABELS = {
    "bank_offer": "Bank Offer",
    "no_cost_emi": "No Cost EMI",
    "emi": "EMI Offer",
    "cashback": "Cashback",
    "coupon": "Coupon",
    "exchange": "Exchange",
    "partner": "Partner Offer",
    "other": "Offer",
}
ALERT_TYPE_LABELS = {
    "target_price": "Target price reached",
    "threshold_drop": "Price drop",
    "price_change": "Price changed",
    "offer_change": "Offer changed",
    "offer_added": "New offer added",
    "offer_removed": "Offer removed",
    "back_in_stock": "Back in stock",
    "auto_paused": "Monitoring paused",
    "system_health": "System health",
}
ALERT_EMOJI = {
    "target_price": "🎯",
    "threshold_drop": "📉",
    "price_change": "↕️",
    "offer_change": "🏷️",
    "offer_added": "🏷️",
    "offer_removed": "🏷️",
    "back_in_stock": "📦",
    "auto_paused": "⚠️",
    "system_health": "🩺",
}

# --- Fixed values: default message templates --------------------------------
DEFAULT_TEMPLATES = {
    "target_price": """{{emoji}} <b>{{typeLabel}}</b> — {{marketplace}}
📱 {{productName}}

Was:     {{oldPrice}}
Now:     {{newPrice}}
Target:  {{target}}

🔗 {{link}}
⏰ {{time}}""",
    "threshold_drop": """{{emoji}} <b>{{typeLabel}}</b> — {{marketplace}}
📱 {{productName}}

Was:     {{oldPrice}}
Now:     {{newPrice}}
Change:  {{changeArrow}} {{changePct}}

🔗 {{link}}
⏰ {{time}}""",
    "price_change": """{{emoji}} <b>{{typeLabel}}</b> — {{marketplace}}
📱 {{productName}}

Was:     {{oldPrice}}
Now:     {{newPrice}}
Change:  {{changeArrow}} {{changePct}}

🔗 {{link}}
⏰ {{time}}""",
    "offer_change": """{{emoji}} <b>{{typeLabel}}</b> — {{marketplace}}
📱 {{productName}}

Price:   {{price}}

➕ New offers:
{{addedOffers}}

➖ Removed offers:
{{removedOffers}}

🔗 {{link}}
⏰ {{time}}""",
    "offer_added": """{{emoji}} <b>{{typeLabel}}</b> — {{marketplace}}
📱 {{productName}}

Price:   {{price}}

➕ New offers:
{{addedOffers}}

🔗 {{link}}
⏰ {{time}}""",
    "offer_removed": """{{emoji}} <b>{{typeLabel}}</b> — {{marketplace}}
📱 {{productName}}

Price:   {{price}}

➖ Removed offers:
{{removedOffers}}

🔗 {{link}}
⏰ {{time}}""",
    "back_in_stock": """{{emoji}} <b>{{typeLabel}}</b> — {{marketplace}}
📱 {{productName}}

Now available at {{price}}

🔗 {{link}}
⏰ {{time}}""",
    "auto_paused": """{{emoji}} <b>{{typeLabel}}</b> — {{marketplace}}
📱 {{productName}}

{{failureReason}}.
Paused after {{failureCount}} consecutive failed checks. Resume it once the listing looks right.

🔗 {{link}}
⏰ {{time}}""",
    "system_health": """{{emoji}} <b>{{typeLabel}}</b>

{{healthMessage}}

⏰ {{time}}""",
}

# --- Fixed values: limits ----------------------------------------------------
COOLDOWN_EXEMPT = ["auto_paused", "back_in_stock", "system_health"]
HEALTH_ALERTS = ["auto_paused", "system_health"]
ESCALATABLE = ["fetch_blocked", "captcha", "parse_failed"]
CHUNK_MAX = 3900
MESSAGE_MAX = 4096
AUDIT_RETENTION_DAYS = 14
BATCH_PER_MARKETPLACE = 15
STAGGER_SECONDS = 15
HELD_BATCH = 100
HEARTBEAT_STALE_SECONDS = 120


@dataclass(frozen=True)
class Settings:
    """One user's global settings; literals in every plan, never a join."""

    check_interval_minutes: int = 30
    drop_threshold_pct: float = 5.0
    failure_limit: int = 5
    monitoring_paused: bool = False
    alert_target_price: bool = True
    alert_threshold_drop: bool = True
    alert_any_change: bool = True
    alert_offer_added: bool = True
    alert_offer_removed: bool = True
    alert_back_in_stock: bool = True
    timezone: str = "Asia/Kolkata"
    cooldown_minutes: int = 60
    quiet_start: str | None = "22:00"
    quiet_end: str | None = "07:00"
    hold_health: bool = False
    digest_frequency: str = "daily"
    digest_time: str | None = None
    daily_check_time: str | None = "06:00"
    near_low_pct: float = 2.0
    app_name: str = "Price monitor"
    templates: dict[str, str] = field(default_factory=dict)

    @property
    def threshold_bp(self) -> int:
        """Global drop threshold in basis points."""
        return round(self.drop_threshold_pct * 100)


OFFER = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("description", T.StringType())]
)
OFFERS = T.ArrayType(OFFER)

CHECKS = T.StructType(
    [
        T.StructField("check_id", T.LongType(), False),
        T.StructField("product_id", T.LongType(), False),
        T.StructField("checked_at", T.TimestampType(), False),
        T.StructField("success", T.BooleanType(), False),
        T.StructField("stock_status", T.StringType()),
        T.StructField("price_paise", T.LongType()),
        T.StructField("mrp_paise", T.LongType()),
        T.StructField("offers", OFFERS),
        T.StructField("tier", T.StringType()),
        T.StructField("failure_reason", T.StringType()),
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("target_paise", T.LongType()),
        T.StructField("threshold_bp", T.LongType()),
    ]
)
