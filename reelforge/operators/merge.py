"""Set operations and merges, change logs included: one row per key on each side, then one decision per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelforge.operators.order import first_by, last_by

UPSERT, DELETE = "upsert", "delete"


def append_first_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union in which the existing row of a key stays, else its first incoming one."""
    both = existing.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)))
    return first_by(both, keys, ["__side", *order]).drop("__side")


def upsert(current: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union in which the last row of the delta replaces the current row of its key."""
    both = current.withColumn("__side", F.lit(0)).unionByName(delta.withColumn("__side", F.lit(1)))
    return last_by(both, keys, ["__side", *order]).drop("__side")


def keep_listed(current: DataFrame, authoritative: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key an authoritative list still has."""
    return current.join(authoritative.select(*keys).distinct(), list(keys), "left_semi")


def fetched_or_newer_held(fetched: DataFrame, held: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Fetched rows, but of keys that are held and fetched the held one where its stamp is strictly later."""
    h = held.select(*keys, F.struct(*held.columns).alias("__held"))
    joined = fetched.join(h, list(keys), "left")
    newer = F.coalesce(F.col(f"__held.{stamp}") > F.col(stamp), F.lit(False))
    return joined.select(*(F.col(c) if c in keys else F.when(newer, F.col(f"__held.{c}")).otherwise(F.col(c)).alias(c) for c in fetched.columns))


def latest_events(events: DataFrame, keys: Sequence[str], event_id: str, operation: str = "operation") -> DataFrame:
    """The last event of each key among those whose operation is known."""
    known = events.filter(F.lower(F.trim(F.col(operation))).isin(UPSERT, DELETE))
    return last_by(known, keys, [event_id])


def apply_change_log(current: DataFrame, events: DataFrame, keys: Sequence[str], event_id: str = "event_id", operation: str = "operation", pending: DataFrame | None = None) -> DataFrame:
    """State after all events in order of id. Keys in pending keep what they have."""
    if pending is not None:
        events = events.join(pending.select(*keys).distinct(), list(keys), "left_anti")
    last = latest_events(events, keys, event_id, operation)
    stays = current.join(last.select(*keys), list(keys), "left_anti")
    return stays.unionByName(last.filter(F.lower(F.trim(F.col(operation))) == UPSERT).select(*current.columns))


def cursor_after(events: DataFrame, current: int, event_id: str = "event_id") -> DataFrame:
    return events.agg(F.greatest(F.lit(current).cast("long"), F.max(event_id)).alias("cursor"))


def delta_decisions(current: DataFrame, events: DataFrame, keys: Sequence[str], dirty: str, fresher: Column, equal: Column, event_id: str = "event_id") -> DataFrame:
    """decision per key of the events: UPSERT, DELETE, PRESERVE_LOCAL or IGNORE.

    current has the local rows, with a boolean `dirty` of those not yet sent; fresher and equal compare `local` and `event`.
    """
    last = latest_events(events, keys, event_id)
    e = last.select(*keys, F.struct(*last.columns).alias("event"))
    c = current.select(*keys, F.struct(*current.columns).alias("local"))
    absent, is_dirty = F.col("local").isNull(), F.coalesce(F.col(f"local.{dirty}"), F.lit(False))
    up = F.when(absent, "UPSERT").when(is_dirty & fresher, "PRESERVE_LOCAL").when(equal, "IGNORE").otherwise("UPSERT")
    down = F.when(absent, "IGNORE").when(is_dirty, "PRESERVE_LOCAL").otherwise("DELETE")
    return e.join(c, list(keys), "left").withColumn("decision", F.when(F.lower(F.trim("event.operation")) == UPSERT, up).otherwise(down))


def overlay_pending(server: DataFrame, local: DataFrame, upserts: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A snapshot without the rows deleted here, and with the local rows of those changed here."""
    keys = list(keys)
    mine = local.join(upserts.select(*keys).distinct(), keys, "left_semi")
    rest = server.join(deletes.select(*keys).distinct(), keys, "left_anti").join(mine.select(*keys), keys, "left_anti")
    return rest.unionByName(mine.select(*server.columns))


def snapshot_preserving(server: DataFrame, local: DataFrame, keys: Sequence[str], order: Sequence[str], dirty: str) -> DataFrame:
    """Newest server row per key; a dirty local row stays where the server has none or an older one."""
    s = last_by(server, keys, order).withColumn("__side", F.lit(0))
    mine = last_by(local, keys, order).filter(F.coalesce(F.col(dirty), F.lit(False))).select(*server.columns).withColumn("__side", F.lit(1))
    # On equal rows the server's stays.
    return last_by(s.unionByName(mine), keys, [*order, -F.col("__side")]).drop("__side")


def acknowledged(dirty: DataFrame, pushed: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Dirty keys left after a push: those not pushed, or changed here since."""
    p = pushed.groupBy(*keys).agg(F.max(stamp).alias("__pushed"))
    return dirty.join(p, list(keys), "left").filter(F.col("__pushed").isNull() | (F.col(stamp) > F.col("__pushed"))).drop("__pushed")


def migrated_keys(local: DataFrame, server: DataFrame, identity: Sequence[str], key: str) -> DataFrame:
    """local with new_key: the server's key of the same identity, where the server has exactly one such key."""
    one = server.groupBy(*identity).agg(F.min(key).alias("__lo"), F.max(key).alias("__hi")).filter(F.col("__lo") == F.col("__hi")).select(*identity, F.col("__lo").alias("__key"))
    return local.join(one, list(identity), "left").withColumn("new_key", F.coalesce("__key", key)).drop("__key")


def unambiguous(rows: DataFrame, lookup: Sequence[str], identity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per lookup key, of those that lead to one identity only."""
    same = rows.groupBy(*lookup).agg(F.min(F.struct(*identity)).alias("__lo"), F.max(F.struct(*identity)).alias("__hi")).filter(F.col("__lo") == F.col("__hi")).select(*lookup)
    return last_by(rows.join(same, list(lookup), "left_semi"), lookup, order)


def superseded(playback: DataFrame, watched: DataFrame, keys: Sequence[str], hidden: DataFrame, hidden_keys: Sequence[str]) -> DataFrame:
    """Playback rows that no watched row of equal key and at least equal stamp supersedes, and that no hidden key covers."""
    w = watched.groupBy(*keys).agg(F.max("stamp").alias("__stamp"))
    left = playback.join(w, list(keys), "left").filter(F.col("__stamp").isNull() | (F.col("__stamp") < F.col("stamp"))).drop("__stamp")
    return left.join(hidden.select(*hidden_keys).distinct(), list(hidden_keys), "left_anti")


def first_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each column the first value of a key that is not null."""
    at = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))
