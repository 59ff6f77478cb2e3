"""Receipts of writes applied to library entries, whose episodes lie in arrays of seasons.

An entry's receipts come together in their order and are folded over it by expressions; seasons are changed in place, so
no entry is taken apart. A receipt is for the first entry of its kind, else the first, of those whose ids, or
titles where they share no system, agree (priority_test).
Receipts that match none make an entry, together with later ones of the same media.

entries: keys, ord (order of an entry), kind (movie, show, anime), status, seasons, last_watched, watched, added, ids by system, title, year.
receipts: keys, seq, op (watch, unwatch, list), kind, status (for list, or what a watch resolved to), season, number,
tvdb_season, tvdb_number, at (text of a time), ids by system, title, year. Null seasons are none; a receipt without any id and title matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelforge.functions.text import trimmed
from reelforge.operators.identity import priority_test, sharing_any

EPISODE = "struct<number:int,watched_at:string,tvdb_season:int,tvdb_number:int>"
SEASONS = f"array<struct<number:int,episodes:array<{EPISODE}>>>"
STATE = f"struct<here:boolean,kind:string,status:string,seasons:{SEASONS},last_watched:string,watched:int,added:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _hit(season: Column, episode: Column, e: Column) -> Column:
    """Whether an episode is the one meant: by its other numbering, where the receipt gives one, or by season and number."""
    mapped = _is(episode["tvdb_season"], e["tvdb_season"]) & _is(episode["tvdb_number"], e["tvdb_number"])
    return mapped | (_is(season["number"], F.coalesce(e["season"], F.lit(1))) & _is(episode["number"], e["number"]))


def with_episode(seasons: Column, e: Column) -> Column:
    """seasons with the episode watched at e.at, and whether it was before (was). An episode that no season up to its own
    holds is put at the end of its season, or into a new one at the end."""
    target, both = F.coalesce(e["season"], F.lit(1)), e["tvdb_season"].isNotNull() & e["tvdb_number"].isNotNull()
    own = lambda k: F.when(both, e[k]).cast("int")
    fresh = F.struct(e["number"].cast("int").alias("number"), e["at"].alias("watched_at"), own("tvdb_season").alias("tvdb_season"), own("tvdb_number").alias("tvdb_number")).cast(EPISODE)

    def step(acc: Column, s: Column) -> Column:
        hits = F.filter(s["episodes"], lambda x: _hit(s, x, e))
        marked = lambda x: F.struct(x["number"].alias("number"), e["at"].alias("watched_at"), F.coalesce(own("tvdb_season"), x["tvdb_season"]).alias("tvdb_season"), F.coalesce(own("tvdb_number"), x["tvdb_number"]).alias("tvdb_number")).cast(EPISODE)
        updated = F.transform(s["episodes"], lambda x: F.when(_hit(s, x, e), marked(x)).otherwise(x))
        found, here = acc["found"] | (F.size(hits) > 0), _is(s["number"], target)
        put = F.when(~found & here, F.concat(updated, F.array(fresh))).otherwise(updated)
        return F.struct(
            F.concat(acc["seasons"], F.array(F.struct(s["number"].alias("number"), put.alias("episodes")))).cast(SEASONS).alias("seasons"), (found | here).alias("found"),
            F.when(F.size(hits) > 0, F.element_at(hits, -1)["watched_at"].isNotNull()).otherwise(acc["was"]).alias("was"),
        )

    none = F.struct(F.array().cast(SEASONS).alias("seasons"), F.lit(False).alias("found"), F.lit(False).alias("was"))
    new = F.array(F.struct(target.cast("int").alias("number"), F.array(fresh).alias("episodes"))).cast(SEASONS)
    done = lambda a: F.struct(F.when(a["found"], a["seasons"]).otherwise(F.concat(a["seasons"], new)).alias("seasons"), a["was"].alias("was"))
    return F.when(e["number"].isNull(), F.struct(seasons.alias("seasons"), F.lit(False).alias("was"))).otherwise(_let(F.aggregate(seasons, none, step), done))


def without_episode(seasons: Column, e: Column) -> Column:
    """seasons in which the episode is not watched, by either numbering."""
    target = F.coalesce(e["season"], F.lit(1))
    hit = lambda s, x: (_is(s["number"], target) & _is(x["number"], e["number"])) | (_is(x["tvdb_season"], target) & _is(x["tvdb_number"], e["number"]))
    plain = lambda s, x: F.struct(x["number"].alias("number"), F.when(~hit(s, x), x["watched_at"]).alias("watched_at"), x["tvdb_season"].alias("tvdb_season"), x["tvdb_number"].alias("tvdb_number"))
    return F.transform(seasons, lambda s: F.struct(s["number"].alias("number"), F.transform(s["episodes"], lambda x: plain(s, x)).alias("episodes"))).cast(SEASONS)


def _state(**parts: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in parts.items())).cast(STATE)


def applied(state: Column, e: Column) -> Column:
    """An entry after one receipt; here says whether there is one."""
    same = {k: state[k] for k in ("here", "kind", "status", "seasons", "last_watched", "watched", "added")}
    kind = F.coalesce(state["kind"], e["kind"])
    listed = _state(**same | {"here": F.lit(True), "kind": kind, "status": e["status"], "added": F.coalesce(state["added"], e["at"])})
    single = (kind == "movie") | ((kind == "anime") & e["number"].isNull())
    film = _state(**same | {"here": F.lit(True), "kind": kind, "status": F.coalesce(e["status"], F.lit("completed")), "last_watched": e["at"]})
    status = F.coalesce(e["status"], state["status"], F.lit("watching"))
    shown = _let(with_episode(state["seasons"], e), lambda r: _state(**same | {"here": F.lit(True), "kind": kind, "status": status, "seasons": r["seasons"], "last_watched": e["at"], "watched": state["watched"] + F.when(r["was"], 0).otherwise(1)}))
    bare = F.when(state["here"], _state(**same | {"status": status})).otherwise(_state(**same | {"here": F.lit(True), "kind": kind, "status": status, "last_watched": e["at"]}))
    gone = _state(here=F.lit(False), kind=F.lit(None), status=F.lit(None), seasons=F.array().cast(SEASONS), last_watched=F.lit(None), watched=F.lit(0), added=F.lit(None))

    def left(seasons: Column) -> Column:
        seen = F.filter(F.transform(F.flatten(F.transform(seasons, lambda s: s["episodes"])), lambda x: x["watched_at"]), lambda t: t.isNotNull())
        return _let(seen, lambda t: _state(**same | {"seasons": seasons, "last_watched": F.array_max(t), "watched": F.size(t)}))

    watch = F.when(single, film).when(e["number"].isNull(), bare).otherwise(shown)
    removed = F.when((e["kind"] == "movie") | e["number"].isNull(), gone).when(state["here"], _let(without_episode(state["seasons"], e), left)).otherwise(state)
    return F.when(e["op"] == "list", listed).when(e["op"] == "watch", watch).when(e["op"] == "unwatch", removed).otherwise(state)


def with_receipts(entries: DataFrame, receipts: DataFrame, keys: Sequence[str], systems: Sequence[str]) -> DataFrame:
    """keys, ord (null for a new entry), media (the first of a new entry's receipts), and what STATE holds, of the entries there are after all receipts."""
    keys, media = list(keys), [*systems, "title", "year"]
    # Pairs that share an id or a title within the keys; only these can pass the test.
    named = lambda c, name: F.when(c.isNotNull(), F.concat(F.to_json(F.struct(*keys)), F.lit(f"{name}:"), c.cast("string")))
    names = F.array_compact(F.array(*(named(F.col(s), s) for s in systems), named(F.lower(trimmed(F.col("title"))), "title")))
    left = receipts.select(F.struct(*keys, "seq").alias("r"), names.alias("names"), F.struct(*media).alias("__a"))
    right = entries.select(F.struct(*keys, "ord").alias("e"), names.alias("names"), F.struct(*media).alias("__b"))
    near = sharing_any(left, right, "r", "e", "names").join(left.drop("names"), "r").join(right.drop("names"), "e")
    pairs = near.filter(priority_test(systems)).select(*(F.col(f"r.{k}").alias(k) for k in keys), F.col("r.seq").alias("seq"), F.col("e.ord").alias("ord"))
    kinds = pairs.join(entries.select(*keys, "ord", F.col("kind").alias("own")), [*keys, "ord"]).join(receipts.select(*keys, "seq", "kind"), [*keys, "seq"])
    chosen = kinds.groupBy(*keys, "seq").agg(F.min(F.struct((F.col("own") != F.col("kind")).alias("x"), "ord")).alias("b")).select(*keys, "seq", F.col("b.ord").alias("ord"))
    first_id = F.coalesce(*(F.concat(F.lit(f"{s}:"), F.col(s).cast("string")) for s in systems), F.concat(F.lit("title:"), F.lower(trimmed(F.col("title")))))
    told_of = ["op", "kind", "status", "season", "number", "tvdb_season", "tvdb_number", "at"]
    told = receipts.join(chosen, [*keys, "seq"], "left").withColumn("media", F.when(F.col("ord").isNull(), first_id)).filter("ord is not null or media is not null")
    grouped = told.groupBy(*keys, "ord", "media").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*told_of).alias("e")))).alias("told"))
    now = _state(here=F.lit(True), kind=F.col("kind"), status=F.col("status"), seasons=F.coalesce(F.col("seasons").cast(SEASONS), F.array().cast(SEASONS)), last_watched=F.col("last_watched"), watched=F.coalesce("watched", F.lit(0)), added=F.col("added"))
    held = entries.select(*keys, "ord", now.alias("state"))
    both = held.join(grouped.filter("ord is not null").drop("media"), [*keys, "ord"], "left").withColumn("media", F.lit(None).cast("string"))
    nothing = _state(here=F.lit(False), kind=F.lit(None), status=F.lit(None), seasons=F.array().cast(SEASONS), last_watched=F.lit(None), watched=F.lit(0), added=F.lit(None))
    new = grouped.filter("ord is null").withColumn("state", nothing)
    rows = both.unionByName(new.select(both.columns))
    none = F.array().cast(rows.schema["told"].dataType)
    out = rows.withColumn("s", F.aggregate(F.coalesce("told", none), F.col("state"), lambda s, x: applied(s, x["e"])))
    return out.filter("s.here").select(*keys, "ord", "media", "s.*").drop("here")
