"""Journals of watched records, keys that an upsert reuses, sections of a library by status, lists that only grow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelforge.functions.text import trimmed
from reelforge.operators.order import first_by, last_by, ranked

# What makes a progress entry fresher, first to last; texts count as empty where missing, numbers as least.
FRESHNESS = ("last_updated", "position", "duration", "video", "parent", "content_type", "season", "episode", "completed", "percent", "source", "parent_type", "title")
FRESHNESS_TEXTS = ("logo", "poster", "background", "episode_title", "thumbnail", "provider", "provider_id", "stream_title", "stream_subtitle", "pause_text", "source_url", "progress_key")
# Statuses of a library in the order of their sections.
STATUSES = ("watching", "plantowatch", "hold", "completed", "dropped")


def freshness(columns: Sequence[str]) -> list[Column]:
    """The order of freshness over those of its columns that a table has."""
    return [F.col(c) for c in FRESHNESS if c in columns] + [F.coalesce(F.col(c), F.lit("")) for c in FRESHNESS_TEXTS if c in columns]


def reused_keys(held: DataFrame, candidates: DataFrame, logical: Sequence[str], video: str, key: str) -> DataFrame:
    """candidates with the key of the held row that they update, or their own.

    A held row counts where all logical columns are equal (nulls too); one of the same video wins, then the freshest.
    Each side of a join is reduced to a row a key before it, so no candidate meets all rows of a title.
    """
    out = candidates
    for i, on in enumerate(([*logical, video], logical)):
        best = last_by(held, on, freshness(held.columns)).select(*(F.col(c).alias(f"__h{i}{c}") for c in on), F.col(key).alias(f"__key{i}"))
        out = out.join(best, [F.col(c).eqNullSafe(F.col(f"__h{i}{c}")) for c in on], "left").drop(*(f"__h{i}{c}" for c in on))
    return out.withColumn(key, F.coalesce("__key0", "__key1", key)).drop("__key0", "__key1")


def applied_journal(snapshot: DataFrame, journal: DataFrame, keys: Sequence[str], at: Sequence[str], titles: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """The records left after a journal: keys, watched, titles, ids.

    snapshot: keys, at, watched, titles, ids; journal: keys, at, watched (null: the first of `at`), removed, ids. The last
    event of a key decides. Titles come from the snapshot, an id from the last event that has one; a removal forgets both.
    One aggregation of structs: a key's history is never held in one place.
    """
    nothing = lambda names, like: [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in names]
    before = last_by(snapshot, keys, at).select(*keys, F.struct(F.lit(0).alias("x"), *at).alias("w"), "watched", F.lit(False).alias("removed"), *titles, *ids)
    after = journal.select(*keys, F.struct(F.lit(1).alias("x"), *at).alias("w"), F.coalesce("watched", at[0]).alias("watched"), "removed", *nothing(titles, snapshot), *ids)
    told = lambda c, when: F.max_by(F.when(when, F.struct("w", F.col(c).alias("v"))), F.when(when, F.col("w"))).alias(f"__{c}")
    per = before.unionByName(after).groupBy(*keys).agg(
        F.max_by(F.struct("watched", "removed"), "w").alias("__last"),
        F.max(F.when(F.col("removed"), F.col("w"))).alias("__gone"),
        *(told(c, F.col("w.x") == 0) for c in titles),
        *(told(c, F.col(c).isNotNull() & ~F.col("removed")) for c in ids),
    )
    kept = lambda c: F.when(F.col("__gone").isNull() | (F.col(f"__{c}.w") > F.col("__gone")), F.col(f"__{c}.v")).alias(c)
    return per.filter(~F.col("__last.removed")).select(*keys, F.col("__last.watched").alias("watched"), *map(kept, [*titles, *ids]))


def merged_badges(held: Column, matched: Column) -> Column:
    """Arrays of (name, image): held ones, then matched ones of new keys; all matched ones where none is held."""
    key = lambda b: F.lower(F.when(F.coalesce(trimmed(b["image"]) != "", F.lit(False)), b["image"]).otherwise(b["name"]))
    within = lambda badges, b: F.exists(badges, lambda y: key(y) == key(b))
    new = F.filter(matched, lambda b, i: ~within(held, b) & ~within(F.slice(matched, F.lit(1), i), b))
    return F.when(F.size(held) == 0, matched).otherwise(F.concat(held, new))


def status_sections(entries: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, status, type, id, saved, place: the first of each type and id within its status, newest saved first."""
    known = entries.filter(F.col("status").isin(*STATUSES))
    first = first_by(known, [*keys, "status", "type", "id"], order)
    return ranked(first, [*keys, "status"], [-F.col("saved"), *order], "place").select(*keys, "status", "type", "id", "saved", "place")


def status_items(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, type, id, status, saved, place of each type and id once: by the order of sections, then newest saved first."""
    turn = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    first = first_by(sections.withColumn("turn", turn), [*keys, "type", "id"], ["turn", "place"]).withColumnRenamed("place", "before")
    return ranked(first, keys, [-F.col("saved"), "turn", "before"], "place").select(*keys, "type", "id", "status", "saved", "place")
