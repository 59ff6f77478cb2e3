"""Dates kept as text and parsed late, as Column expressions. Instants are milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelforge.functions.text import trimmed

DAY_MS = 86_400_000
DATE, TIME = r"(\d{4})-(\d{2})-(\d{2})", r"T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?"
EMBEDDED = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
# The range of integers read as yyyyMMddHHmmss, and the days ahead and since of alerts.
COMPACT_FROM, COMPACT_TO = 19_000_101_000_000, 29_991_231_235_959
ALERT_DAYS = 60


def calendar_date(text: Column) -> Column:
    """The date of a text that is one and exists; else null."""
    t = trimmed(text)
    return F.when(t.rlike(f"^{DATE}$"), F.try_to_date(t, "yyyy-MM-dd"))


def _days(date: Column) -> Column:
    return F.unix_date(date).cast("long")


def _moment(t: Column, form: str) -> Column:
    """Milliseconds of the date and time in t, as if it were UTC; null if it is none."""
    part = lambda i: F.regexp_extract(t, form, i)
    number = lambda c: F.when(c == "", F.lit(0)).otherwise(c).cast("long")
    date = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")
    h, m, s = number(part(4)), number(part(5)), number(part(6))
    ms = F.when(part(7) == "", F.lit(0)).otherwise(number(F.substring(F.rpad(part(7), 3, "0"), 1, 3)))
    ok = t.rlike(form) & (h <= 23) & (m <= 59) & (s <= 59)
    return F.when(ok, _days(date) * DAY_MS + ((h * 60 + m) * 60 + s) * 1000 + ms)


def zoned_ms(text: Column) -> Column:
    t, form = trimmed(text), f"^{DATE}{TIME}(Z|[+-]\\d{{2}}:?\\d{{2}})$"
    zone = F.regexp_extract(t, form, 8)
    digits = F.replace(F.substring(zone, 2, 10), F.lit(":"), F.lit(""))
    h, m = F.try_to_number(F.substring(digits, 1, 2), F.lit("99")).cast("long"), F.try_to_number(F.substring(digits, 3, 2), F.lit("99")).cast("long")
    shift = F.when(zone == "Z", F.lit(0)).when((h <= 23) & (m <= 59), (h * 60 + m) * 60_000 * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1))
    return _moment(t, form) - shift


def local_ms(text: Column, zone: str = "UTC") -> Column:
    """A date and time without zone, in the viewer's zone."""
    t = trimmed(text)
    ms = _moment(t, f"^{DATE}{TIME}$")
    if zone == "UTC":
        return ms
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(ms), zone))


def release_ms(text: Column, zone: str = "UTC") -> Column:
    """Zoned, then local, then plain date at UTC midnight, then a date inside other text."""
    inside = F.regexp_extract(text, EMBEDDED, 0)
    return F.coalesce(zoned_ms(text), local_ms(text, zone), _days(calendar_date(text)) * DAY_MS, _days(calendar_date(inside)) * DAY_MS)


def release_date(text: Column, zone: str = "UTC") -> Column:
    """The viewer's calendar date; plain dates are kept as they are."""
    at = F.from_utc_timestamp(F.timestamp_millis(zoned_ms(text)), zone).cast("date") if zone != "UTC" else F.date_from_unix_date(F.floor(zoned_ms(text) / DAY_MS).cast("int"))
    t = trimmed(text)
    local = F.when(local_ms(text).isNotNull(), calendar_date(F.substring(t, 1, 10)))
    return F.coalesce(calendar_date(text), at, local, calendar_date(F.regexp_extract(text, EMBEDDED, 0)))


def aired(text: Column, now_ms: Column) -> Column:
    return release_ms(text) <= now_ms


def days_until(today: Column, text: Column) -> Column:
    return F.date_diff(release_date(text), calendar_date(today))


def from_compact(value: Column) -> Column:
    """yyyyMMddHHmmss as milliseconds where it is one; other values as they are."""
    raw = F.lpad(value.cast("string"), 14, "0")
    iso = F.regexp_replace(raw, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6Z")
    return F.when(value.between(COMPACT_FROM, COMPACT_TO), F.coalesce(zoned_ms(iso), value)).otherwise(value)


def release_year(text: Column) -> Column:
    found = F.regexp_extract(text, r"\b(19|20)\d{2}\b", 0)
    return F.when(found != "", found).cast("int")


def display_year(text: Column) -> Column:
    """A bare year, else the year of the release date; 1000 to 9999."""
    year = F.coalesce(F.when(trimmed(text).rlike(r"^\d{4}$"), trimmed(text).cast("int")), F.year(release_date(text)))
    return F.when(year.between(1000, 9999), year)


def unreleased(raw: Column, info: Column, now_ms: Column, year: int) -> Column:
    """By the raw date, else by a date in the info, else by the first year in it."""
    by_raw = F.when(trimmed(raw) != "", aired(raw, now_ms))
    return F.coalesce(~by_raw, ~aired(trimmed(info), now_ms), release_year(info) > year, F.lit(False))


def release_alert(release: Column, seed_ms: Column, now_ms: Column, season: Column, seed_season: Column) -> Column:
    """NEW_SEASON or NEW_EPISODE for what aired after the seed and within ALERT_DAYS; else null."""
    fresh = (release <= now_ms) & (release > seed_ms) & (now_ms - release < ALERT_DAYS * DAY_MS)
    return F.when(fresh, F.when(season > seed_season, "NEW_SEASON").otherwise("NEW_EPISODE"))
