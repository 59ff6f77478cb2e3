"""Positions on a grid of preview cues, and absolute numbers of episodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelforge.functions.text import trimmed

# The namespaces whose ids name one run of episodes, and those cleared where a season is given.
RUNS = ("mal", "kitsu", "anidb", "anilist")
CLEARED = (*RUNS, "simkl")


def _shows(start: Column, end: Column, at: Column) -> Column:
    """A cue stands for the half of its length before it, too."""
    return F.coalesce((end > start) & (at >= start - F.floor((end - start) / 2)) & (at < end), F.lit(False))


def step_target(start: Column, end: Column, at: Column, delta: Column, duration: Column) -> Column:
    """Where a move by delta from `at` lands: whole cues where the cue stands for `at`, else `at` plus delta; within 0 and a known duration."""
    length = end - start
    steps = F.greatest(F.floor(F.abs(delta) / F.nullif(length, F.lit(0)) + 0.5), F.lit(1))
    moved = F.when(delta > 0, end + (steps - 1) * length).otherwise(start - steps * length)
    raw = F.greatest(F.when(_shows(start, end, at) & (delta != 0), moved).otherwise(at + delta), F.lit(0))
    return F.when(duration > 0, F.least(raw, duration)).otherwise(raw).cast("long")


def aligned_target(start: Column, end: Column, pending: Column, duration: Column) -> Column:
    """The start of the cue that stands for a pending position; null where nothing is to be corrected and at both ends of the media."""
    beyond = (duration > 0) & ((pending >= duration) | (start > duration))
    return F.when(_shows(start, end, pending) & (pending > 0) & ~beyond & (start >= 0) & (start != pending), start).cast("long")


def absolute_episode(anime: Column, video: Column, season: Column, number: Column, ids: dict[str, Column]) -> dict[str, Column]:
    """season, number and ids as one run of episodes knows them, where the video's id names a run and a number in it.

    Then that id alone stays and the season goes. Without such a number the season's own ids go where a season is given;
    an entry without a number becomes number 1. What is no anime stays as it is.
    """
    text = trimmed(video)
    part = lambda i: F.get(F.split(text, ":"), F.lit(i))
    space, own = F.lower(part(0)), part(1).try_cast("long")
    found = F.when(space.isin(*RUNS) & own.isNotNull(), part(2).try_cast("int"))
    first = number.isNull() & found.isNull()
    seasoned = found.isNull() & number.isNotNull() & F.coalesce(season > 0, F.lit(False))
    out = {
        "season": F.when(anime & (found.isNotNull() | first), F.lit(None)).otherwise(season),
        "number": F.when(anime & first, F.lit(1)).when(anime & found.isNotNull(), found).otherwise(number),
    }
    for name, value in ids.items():
        run = F.when(space == name, own.cast("string"))
        gone = seasoned if name in CLEARED else F.lit(False)
        out[name] = F.when(anime & found.isNotNull(), run).when(anime & gone, F.lit(None)).otherwise(value)
    return out
