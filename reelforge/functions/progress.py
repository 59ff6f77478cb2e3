"""Predicates and derived columns of playback progress, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
COMPLETE_FRACTION = 0.90
COMPLETE_PERCENT = 90.0
STORE_FROM_MS = 1_000
SHORT_BELOW_MS = 121_000
NEXT_SEASON_DAYS = 7


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def should_store(position: Column) -> Column:
    return position >= STORE_FROM_MS


def is_short(duration: Column) -> Column:
    return (duration >= 1) & (duration < SHORT_BELOW_MS)


def is_complete(position: Column, duration: Column, ended: Column, fraction: float = COMPLETE_FRACTION) -> Column:
    """Ended counts unless the clip is short; else the share of a known duration decides."""
    return F.when(ended, ~is_short(duration)).when(duration <= 0, False).otherwise(position.cast("double") / F.nullif(duration, F.lit(0)).cast("double") >= fraction)


def clamped_percent(percent: Column) -> Column:
    """0 to 100; null stays null, which greatest() and least() alone would pass over."""
    return F.when(percent.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)))


def completion(flag: Column, percent: Column, position: Column, duration: Column) -> Column:
    """A set flag, a percent of 90 or more, or the position's share."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(clamped_percent(percent) >= COMPLETE_PERCENT, F.lit(False)) | F.coalesce(is_complete(F.greatest(position, F.lit(0)), duration, F.lit(False)), F.lit(False))


def resume_position(position: Column, percent: Column, duration: Column) -> Column:
    """The position where there is one, else the percent of the actual duration, else 0."""
    return F.when(position > 0, position).when((percent > 0) & (duration > 0), F.floor(duration * clamped_percent(percent) / 100)).otherwise(F.lit(0)).cast("long")


def in_progress(complete: Column, position: Column, percent: Column, source: Column, history_sources: list[str]) -> Column:
    return ~complete & ((position > 0) | (F.coalesce(percent, F.lit(0)) > 0)) & ~F.coalesce(source.isin(history_sources), F.lit(False))


def malformed_id(value: Column, namespaces: list[str]) -> Column:
    """Blank, or a namespace with nothing after it."""
    text = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""))
    return (text == "") | text.isin([*namespaces, *(f"{n}:" for n in namespaces)])


def season_number(season: Column) -> Column:
    return F.greatest(F.coalesce(season, F.lit(0)), F.lit(0))


def specials_last(season: Column) -> Column:
    return F.when(season_number(season) == 0, F.lit(2147483647)).otherwise(season_number(season))


def is_released(aired: Column, available: Column) -> Column:
    """An unknown date counts as released."""
    return available & F.coalesce(aired, F.lit(True))


def should_surface(watched: Column, candidate: Column, aired: Column, days: Column, available: Column, show_unaired: bool) -> Column:
    """Whether a candidate may be offered after a watched episode; across seasons an unknown date is not released."""
    rollover = season_number(candidate) != season_number(watched)
    window = (days >= 0) & (days <= NEXT_SEASON_DAYS)
    gone = F.when(days.isNull(), False).when(days <= 0, True).when(F.lit(not show_unaired), False).otherwise(~rollover | (days <= NEXT_SEASON_DAYS))
    same = F.lit(True) if show_unaired else F.coalesce(aired, F.lit(True))
    other = F.coalesce(aired, F.lit(False)) | (F.lit(show_unaired) & F.coalesce(window, F.lit(False)))
    return F.when(~available, gone).when(~rollover, same).otherwise(other)
