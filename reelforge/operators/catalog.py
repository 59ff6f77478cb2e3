"""Catalogs and candidates: orders, choices, cut-offs and ordered folds."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.patterns import compiles

LAST = 2147483647
OUTRO, SCENE = ("outro", "ed", "mixed-ed"), "post-credits"  # fixed values: kinds of segments
DUPLICATE_PAGES = 3


def provider_order(df: DataFrame, ranks: DataFrame, key: str, rank: str) -> DataFrame:
    """df with the rank an outside list gives each key; keys it lacks come last."""
    best = ranks.groupBy(key).agg(F.min(rank).alias("__rank"))
    return df.join(best, key, "left").withColumn(rank, F.coalesce("__rank", F.lit(LAST))).drop("__rank")


def source_bucket(source: Column, installed: Sequence[str], resolver: Column) -> tuple[Column, Column]:
    """(bucket, rank): directly resolved sources, then installed ones in their order, then others."""
    at = F.array_position(F.array(*map(F.lit, installed)), source)
    return F.when(resolver, 0).when(at > 0, 1).otherwise(2), F.when(~resolver & (at > 0), at).otherwise(F.lit(0))


def upcoming_last(released: Column, recency: Column, date: Column) -> list[Column]:
    """Sort keys: released rows by recency, then unaired ones by date with unknown dates last."""
    return [F.when(released, 0).otherwise(1).asc(), F.when(released, recency).desc_nulls_last(), F.when(~released, date).asc_nulls_last()]


def excluded_words(pattern: str) -> list[str]:
    """The words inside a pattern's negative lookaheads."""
    return [w.strip() for m in re.finditer(r"\(\?![^)]*?\(([^)]+)\)", pattern) for w in m[1].split("|") if w.strip()]


def user_pattern(text: Column, pattern: str) -> Column:
    """Found, without a word that the pattern excludes; a pattern that does not compile matches nothing."""
    if not compiles(f"(?i){pattern.strip()}"):
        return F.lit(False)
    words = excluded_words(pattern)
    found = text.rlike(f"(?i){pattern.strip()}")
    return found & ~text.rlike(rf"(?i)\b({'|'.join(re.escape(w) for w in words)})\b") if words else found


def auto_choice(df: DataFrame, keys: Sequence[str], group: Column, ready: Column, order: Sequence[str]) -> DataFrame:
    """The first ready row of each key, of the preferred group if it has one."""
    rest = [c for c in df.columns if c not in keys]
    best = df.filter(ready).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((~F.coalesce(group, F.lit(False))).alias("g"), *order)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in rest))


def fresher(left: DataFrame, right: DataFrame, keys: Sequence[str], updated: str, watched: str) -> DataFrame:
    """Left rows whose key the right side lacks, or that are later than its row."""
    r = right.groupBy(*keys).agg(F.max(watched).alias("__w"))
    return left.join(r, list(keys), "left").filter(F.col("__w").isNull() | (F.col(updated) > F.col("__w"))).drop("__w")


def spread_to_siblings(marked: DataFrame, edges: DataFrame, alias: str, entity: str) -> DataFrame:
    """Marked aliases and all aliases of their entities, through aliases of one entity only."""
    from reelforge.operators.identity import ambiguous

    clear = edges.join(ambiguous(edges, alias, entity), alias, "left_anti")
    hit = clear.join(marked.select(alias).distinct(), alias, "left_semi").select(entity).distinct()
    return marked.select(alias).unionByName(clear.join(hit, entity, "left_semi").select(alias)).distinct()


def following_scene(spans: DataFrame, keys: Sequence[str], start: str, end: str, kind: str, duration: str, tail: float = 5.0) -> DataFrame:
    """keys, start and end of what follows the last outro: the nearest scene after it, else a tail longer than `tail`."""
    outro = spans.filter(F.col(kind).isin(*OUTRO)).groupBy(*keys).agg(F.max(end).alias("__o"), F.max(duration).alias("__d"))
    scenes = spans.filter((F.lower(F.trim(kind)) == SCENE) & (F.col(end) > F.col(start))).join(outro.select(*keys, "__o"), list(keys)).filter((F.col(start) >= F.col("__o")) & ((F.col(duration) <= 0) | (F.col(start) < F.col(duration))))
    first = scenes.groupBy(*keys).agg(F.min(F.struct(start, end)).alias("s"))
    out = outro.join(first, list(keys), "left")
    gap = F.col("__d") - F.col("__o") > tail
    return out.select(*keys, F.coalesce(f"s.{start}", F.when(gap, F.col("__o"))).alias(start), F.coalesce(f"s.{end}", F.when(gap, F.col("__d"))).alias(end)).filter(F.col(start).isNotNull())


def next_card(position: Column, duration: Column, outro_start: Column, outro_end: Column, scene_end: Column, percent: float) -> Column:
    """Whether to offer the next episode: after a scene that follows the outro, at the outro's start where it closes the
    file, else at the user's share of the duration (97 to 100 percent). Times in ms."""
    share = min(100.0, max(97.0, percent))
    by_share = position / F.nullif(duration, F.lit(0)) >= share / 100
    threshold = F.floor((1 - share / 100) * duration)
    at_outro = F.when(duration - outro_end > threshold, by_share).otherwise(position >= outro_start)
    after = position >= F.greatest(F.least(scene_end, duration), F.ceil(duration * share / 100))
    return F.coalesce((duration > 0) & F.when(scene_end.isNotNull(), after).when(outro_end.isNotNull(), at_outro).otherwise(by_share), F.lit(False))


def paging_stops(pages: DataFrame, keys: Sequence[str], order: str, new: Column) -> DataFrame:
    """Pages up to the one that ends a run of DUPLICATE_PAGES pages without a new item."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = pages.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = run.withColumn("__dup", F.sum(1 - F.col("__new")).over(Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    stop = n.withColumn("__over", F.coalesce(F.max((F.col("__dup") >= DUPLICATE_PAGES).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return stop.filter("__over = 0").select(*pages.columns)


def by_absolute_number(episodes: DataFrame, seeds: DataFrame, keys: Sequence[str], season: str, episode: str) -> DataFrame:
    """The episode each seed (season, episode) means: the equal one, else, for season 1 where there are several main
    seasons, the one of that place among all main episodes."""
    main = episodes.filter(F.col(season) > 0)
    w = Window.partitionBy(*keys).orderBy(season, episode)
    placed = main.withColumn("__at", F.row_number().over(w)).withColumn("__many", F.min(season).over(Window.partitionBy(*keys)) != F.max(season).over(Window.partitionBy(*keys)))
    exact = episodes.select(*keys, season, episode, F.lit(True).alias("__same"))
    s = seeds.join(exact, [*keys, season, episode], "left")
    other = placed.filter("__many").select(*keys, F.col("__at").alias(episode), F.struct(season, episode).alias("__e"))
    out = s.join(other, [*keys, episode], "left")
    own = F.struct(F.col(season).alias("season"), F.col(episode).alias("episode"))
    found = F.when(F.col("__same"), own).when(F.col(season) == 1, F.struct(F.col(f"__e.{season}").alias("season"), F.col(f"__e.{episode}").alias("episode")))
    return out.select(*seeds.columns, found.alias("found")).filter("found.season is not null")


def collapsed_cues(cues: DataFrame, track: str, within: int = 125) -> DataFrame:
    """Cues without those near the last kept one of equal or blank text; of a blank and a worded one the worded stays.

    Each decision needs the last kept cue, so a track is one call.
    """
    words = lambda t: " ".join(re.sub(r"[^\w]+", " ", t.lower()).split())

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "ord"], kind="stable")
        kept: list[int] = []
        at, texts = rows["start"].tolist(), [t or "" for t in rows["text"]]
        for i in range(len(at)):
            p = kept[-1] if kept else None
            if p is not None and abs(at[p] - at[i]) <= within and (not texts[p].strip() or not texts[i].strip() or words(texts[p]) == words(texts[i])):
                if not texts[p].strip() and texts[i].strip():
                    kept[-1] = i
            else:
                kept.append(i)
        return rows.iloc[kept]

    return cues.groupBy(track).applyInPandas(fold, cues.schema)


def arrival_fold(current: DataFrame, events: DataFrame, keys: Sequence[str], order: str, stamp: str) -> DataFrame:
    """State after upserts and deletes in order of arrival: a dirty row gives way only to an upsert no older than it, which
    cleans it, and not to a delete. A key's events are folded in one expression."""
    rest = [stamp, "dirty"]
    e = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "operation", stamp))).alias("__events"))
    state = current.select(*keys, F.struct(F.lit(True).alias("here"), *rest).alias("__state"))
    joined = e.join(state, list(keys), "full")
    none = F.struct(F.lit(False).alias("here"), F.lit(None).cast("long").alias(stamp), F.lit(False).alias("dirty"))

    def step(s, ev):
        held = s["here"] & s["dirty"]
        up = F.when(held & (ev[stamp] < s[stamp]), s).otherwise(F.struct(F.lit(True).alias("here"), ev[stamp].alias(stamp), F.lit(False).alias("dirty")))
        down = F.when(held, s).otherwise(none)
        return F.when(ev["operation"] == "upsert", up).when(ev["operation"] == "delete", down).otherwise(s)

    empty = F.array().cast(joined.schema["__events"].dataType)
    out = joined.withColumn("__out", F.aggregate(F.coalesce("__events", empty), F.coalesce("__state", none), step))
    return out.filter("__out.here").select(*keys, *(F.col(f"__out.{c}").alias(c) for c in rest))


def resolved_identity(rows: DataFrame, group: str, order: str, aliases: str) -> DataFrame:
    """rows with entity, the smallest order of the rows they merge with: in order, a row joins what its aliases stand for,
    and its aliases then stand for the whole. What merges later does not reach back.

    A group is folded a batch at a time; what its aliases stand for in the end alone is held, and is joined to the rows.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def fold(batches):
        of, stands = None, {}
        for b in batches:
            told = []
            for at, names, g in zip(b[order].to_pylist(), b[aliases].to_pylist(), b[group].to_pylist(), strict=True):
                if g != of:
                    told += [(of, a, e) for a, e in stands.items()]
                    of, stands = g, {}
                entity = min([stands[a] for a in names or () if a in stands], default=at)
                for a in names or ():
                    stands[a] = entity
            yield _stands(b, told)
        if stands:
            yield _stands(b, [(of, a, e) for a, e in stands.items()])

    def _stands(b, told):
        kinds = b.schema.field(group).type, b.schema.field(aliases).type.value_type, pa.int64()
        return pa.record_batch([pa.array([t[i] for t in told], k) for i, k in enumerate(kinds)], names=["__g", "__a", "entity"])

    element = rows.schema[aliases].dataType.elementType.simpleString()
    stands = rows.select(group, order, aliases).repartition(group).sortWithinPartitions(group, F.asc_nulls_last(order)).mapInArrow(fold, f"__g {kind[group]}, __a {element}, entity long")
    named = rows.withColumn("__named", F.coalesce(F.size(aliases), F.lit(0)) > 0)
    same = F.col("__named") & F.col(group).eqNullSafe(F.col("__g")) & F.get(F.col(aliases), F.lit(0)).eqNullSafe(F.col("__a"))
    return named.join(stands, same, "left").select(*rows.columns, F.coalesce("entity", F.col(order).cast("long")).alias("entity"))


def url_template(pattern: str, values: dict[str, Column]) -> Column:
    """A pattern with required {x}, optional {x?} and alternatives {a|b}; null where a required value is missing."""
    parts, at = [], 0
    for m in re.finditer(r"\{([^{}]*)\}", pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        name, at = m[1], m.end()
        found = F.coalesce(*(values.get(n.strip().rstrip("?"), F.lit(None).cast("string")) for n in name.split("|")))
        parts.append(F.coalesce(found, F.lit("")) if name.endswith("?") else found)
    return F.concat(*parts, F.lit(pattern[at:]))


def string_hash(text: Column) -> Column:
    """The 31-multiplier hash of a text's UTF-16 code units with 32-bit wrap-around."""
    digits, span = F.hex(F.encode(text, "UTF-16BE")), 1 << 32
    units = F.transform(F.sequence(F.lit(0), (F.length(digits) / 4).cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    raw = F.when(text == "", F.lit(0).cast("long")).otherwise(F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % span))
    return F.when(raw >= span // 2, raw - span).otherwise(raw).cast("int")


def discover_query(spec: dict[str, object]) -> dict[str, str]:
    """Query parameters of a discovery filter: unset ones are left out, lists are joined, the region is US by default."""
    out = {k: ",".join(map(str, v)) if isinstance(v, list | tuple) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in spec.items() if v not in (None, "", [], ())}
    out.setdefault("watch_region" if "with_watch_providers" in out else "region", "US")
    return out
