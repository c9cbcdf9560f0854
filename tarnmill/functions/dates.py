"""Dates and times as Column expressions; ``today`` and ``now`` are given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of a relative unit.
UNIT_DAYS = {"day": 1, "days": 1, "d": 1, "h": 0, "hr": 0, "hrs": 0, "hour": 0, "hours": 0, "week": 7, "weeks": 7, "w": 7, "mo": 30, "month": 30, "months": 30, "year": 365, "years": 365, "y": 365}
RELATIVE = r"(\d+(?:\.\d+)?)\s*\+?\s*(day|days|d|h|hrs?|hours?|week|weeks|w|mo|month|months|year|years|y)\b"
TODAY_WORDS = ("today", "now", "just now", "just posted", "posted today", "active today")
PREFIXES = ("posted ", "active ", "employer active ", "urgently hiring ")


def posted_datetime(value: Column) -> Column:
    """A full ISO timestamp, in UTC if it names no offset; else null."""
    text = F.trim(value)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?(?:Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(text))


def posted_date(value: Column, today: Column) -> Column:
    """ISO dates, today and yesterday, and ages like ``Posted 3 days ago``; else null."""
    text = F.trim(value)
    low = F.regexp_replace(F.lower(text), "^" + "".join(f"(?:{p} *)?" for p in PREFIXES), "")
    iso = F.when(F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(text, 1, 10).try_cast("date"))
    unit = F.element_at(F.create_map(*(F.lit(x) for kv in UNIT_DAYS.items() for x in kv)), F.regexp_extract(low, RELATIVE, 2))
    age = F.bround(F.regexp_extract(low, RELATIVE, 1).try_cast("double") * unit).cast("int")
    return F.when(low.isin(*TODAY_WORDS), today).when(low == "yesterday", F.date_sub(today, 1)).otherwise(F.coalesce(iso, F.date_sub(today, age)))


def week_key(day: Column) -> Column:
    """ISO year and week, as in 2025-W01."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), day), F.lit("-W"), F.lpad(F.weekofyear(day), 2, "0"))


def fetch_window(now: Column) -> Column:
    """Monday three days and the digest, Tuesday to Thursday a day, Friday a week, the weekend nothing."""
    day = F.weekday(now)
    hours = F.when(day == 0, 72).when(day <= 3, 24).when(day == 4, 168).otherwise(0)
    reason = F.when(day == 0, "backfill").when(day <= 3, "daily").when(day == 4, "weekly").otherwise("idle")
    return F.struct(reason.alias("reason"), (now - F.make_dt_interval(hours=hours)).alias("window_start"), now.alias("window_end"), (day == 0).alias("generate_digest"), day.alias("day_of_week"))


def next_start(now: Column, hour: int = 9) -> Column:
    """The next weekday at the hour, strictly after now."""
    at = F.date_trunc("day", now) + F.make_dt_interval(hours=F.lit(hour))
    at = F.when(at <= now, at + F.make_dt_interval(days=F.lit(1))).otherwise(at)
    return at + F.make_dt_interval(days=F.greatest(7 - F.weekday(at), F.lit(0)) * (F.weekday(at) >= 5).cast("int"))


def timecode_seconds(text: Column) -> Column:
    """MM:SS or MM:SS:FF in seconds; null for anything else."""
    p = F.split(F.trim(text), ":")
    n = F.transform(p, lambda x: F.trim(x).try_cast("int"))
    good = F.size(n).isin(2, 3) & F.forall(n, lambda x: F.coalesce(x >= 0, F.lit(False))) & (F.get(n, F.lit(1)) < 60)
    return F.when(good, F.get(n, F.lit(0)) * 60 + F.get(n, F.lit(1)))


def lenient_date(value: Column) -> Column:
    """An ISO date; null for anything else."""
    head = F.substring(F.trim(value), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def lenient_datetime(value: Column, now: Column) -> Column:
    """A timestamp, or now where there is none to read."""
    return F.coalesce(F.try_to_timestamp(F.trim(value)), now)


def window_start(now: Column, days: Column | None = None) -> Column:
    """Where a run's window begins: so many days ago if given, else that of its weekday."""
    planned = fetch_window(now)["window_start"]
    return planned if days is None else F.coalesce(now - F.make_dt_interval(days=days.cast("int")), planned)


def freshness(last: Column, now: Column, reason: Column) -> Column:
    """Whether the last run lies as far back as it should: first, recent, stale or ok."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(last)) / 3600
    return F.when(last.isNull(), "first").when((hours < 1) & (reason != "idle"), "recent").when((hours > 72) & (reason == "daily"), "stale").otherwise("ok")


def publish_at(now: Column, zone: str, hour: int, minute: int = 0) -> Column:
    """The next time that the clock of a zone shows the hour, strictly after now; in UTC as ``now``."""
    local = F.from_utc_timestamp(now, zone)
    at = F.date_trunc("day", local) + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))
    return F.to_utc_timestamp(F.when(at <= local, at + F.make_dt_interval(days=F.lit(1))).otherwise(at), zone)


def whole_clips(target: Column, clip: Column) -> Column:
    """Seconds rounded up to whole clips; raises unless both are positive."""
    bad = ~F.coalesce((target > 0) & (clip > 0), F.lit(False))
    return F.when(bad, F.raise_error(F.lit("target and clip must be positive")).cast("long")).otherwise(F.ceil(target / clip) * clip)


def lookback_seconds(now: Column, after: Column) -> Column:
    """How far back a feed is read: a day at least."""
    return F.greatest(F.lit(86_400).cast("long"), F.unix_timestamp(now) - F.unix_timestamp(after))
