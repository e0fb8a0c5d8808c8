"""Local time: minutes of day, quiet hours, digest timing, relative time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_hhmm(text: str | None) -> int | None:
    """Minutes after midnight of a settings value, None when unset or malformed."""
    found = re.fullmatch(r"(\d{1,2}):(\d{2})", text or "")
    if not found:
        return None
    hours, minutes = int(found[1]), int(found[2])
    return hours * 60 + minutes if hours <= 23 and minutes <= 59 else None


def parse_hhmm_col(text: Column) -> Column:
    """The same for a column of texts."""
    hours = F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})$", 1).try_cast("int")
    minutes = F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})$", 2).try_cast("int")
    return F.when((hours <= 23) & (minutes <= 59), hours * 60 + minutes)


def local(ts: Column, timezone: str) -> Column:
    return F.from_utc_timestamp(ts, timezone)


def minutes_of_day(ts: Column, timezone: str) -> Column:
    at = local(ts, timezone)
    return F.hour(at) * 60 + F.minute(at)


def local_date(ts: Column, timezone: str) -> Column:
    return F.to_date(local(ts, timezone))


def quiet_window(start: str | None, end: str | None) -> tuple[int, int] | None:
    """The window in minutes, None when unset, malformed or of zero length."""
    a, b = parse_hhmm(start), parse_hhmm(end)
    return None if a is None or b is None or a == b else (a, b)


def in_quiet_hours(ts: Column, start: str | None, end: str | None, timezone: str) -> Column:
    """Half-open window that may span midnight."""
    window = quiet_window(start, end)
    if window is None:
        return F.lit(False)
    now = minutes_of_day(ts, timezone)
    a, b = window
    return (now >= a) & (now < b) if a < b else (now >= a) | (now < b)


def quiet_release(ts: Column, start: str | None, end: str | None, timezone: str) -> Column:
    """The end of the quiet window a timestamp lies in, null outside it."""
    window = quiet_window(start, end)
    if window is None:
        return F.lit(None).cast("timestamp")
    a, b = window
    at = local(ts, timezone)
    days = F.lit(0) if a < b else F.when(minutes_of_day(ts, timezone) >= a, 1).otherwise(0)
    end_local = F.date_trunc("DAY", at) + F.make_dt_interval(days=days, mins=F.lit(b))
    return F.when(
        in_quiet_hours(ts, start, end, timezone), F.to_utc_timestamp(end_local, timezone)
    )


def digest_due(
    frequency: Column, digest_time: Column, last: Column, now: Column, timezone: str
) -> Column:
    """Time-of-day gate plus a repeat guard of 20 hours (daily) or 144 hours (weekly)."""
    send_at = F.coalesce(parse_hhmm_col(F.coalesce(digest_time, F.lit("09:00"))), F.lit(540))
    hours = (F.unix_micros(now) - F.unix_micros(last)).cast("double") / 3.6e9
    return F.coalesce(
        (frequency != "off")
        & (minutes_of_day(now, timezone) >= send_at)
        & (last.isNull() | (hours >= F.when(frequency == "daily", 20.0).otherwise(144.0))),
        F.lit(False),
    )


def relative_time(then: Column, now: Column) -> Column:
    """'3 minutes ago' wording."""
    seconds = F.floor((F.unix_millis(now) - F.unix_millis(then)).cast("double") / 1000 + 0.5)
    minutes = F.floor(seconds / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)

    def ago(n: Column, unit: str) -> Column:
        return F.when(n == 1, f"1 {unit} ago").otherwise(
            F.concat(n.cast("bigint").cast("string"), F.lit(f" {unit}s ago"))
        )

    return (
        F.when(seconds < 45, "just now")
        .when(minutes < 60, ago(minutes, "minute"))
        .when(hours < 24, ago(hours, "hour"))
        .otherwise(ago(days, "day"))
    )


def stale(last_seen: Column, now: Column, seconds: int) -> Column:
    """No report at all, or an older one than the allowance."""
    age = F.unix_millis(now) - F.unix_millis(last_seen)
    return F.coalesce(age > seconds * 1000, F.lit(True))


# Month names, so the text does not follow the machine's locale.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec"]


def stamp(ts: Column, timezone: str) -> Column:
    """'01 Jul 2026, 01:51 AM' in local time."""
    at = local(ts, timezone)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(at))
    half = F.when(F.hour(at) < 12, "AM").otherwise("PM")
    twelve = F.when(F.hour(at) % 12 == 0, 12).otherwise(F.hour(at) % 12)

    def two(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    return F.concat(
        two(F.dayofmonth(at)), F.lit(" "), month, F.lit(" "), F.year(at).cast("string"),
        F.lit(", "), two(twelve), F.lit(":"), two(F.minute(at)), F.lit(" "), half,
    )
