"""Choices of an application: sections to fetch and to publish, a subtitle track by language, trailers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.language import codes_fit, language_code, region_of, regions_said, track_codes, variant_of
from reelforge.functions.text import trimmed
from reelforge.operators.order import first_by, ranked

# The place of what has no preference, the targets with regions, the category that leads, the fallback language.
LAST, WIDE, NARROW, GENERIC, ENGLISH = 2_147_483_647, ("pt-br", "es-419"), ("pt", "es"), "Trailer", "en"


def fetch_order(definitions: DataFrame, preferences: DataFrame, keys: Sequence[str], name: str, hero: bool, order: Sequence[str]) -> DataFrame:
    """keys, name, place: definitions that are shown, feed the hero or have no preference come first, each part by its preferred place.

    preferences: keys, name, enabled, hero_source, position; one row for each name.
    """
    both = definitions.join(preferences.select(*keys, name, "enabled", "hero_source", "position", F.lit(True).alias("set")), [*keys, name], "left")
    later = F.col("set").isNotNull() & ~F.coalesce("enabled", F.lit(False)) & ~(F.lit(hero) & F.coalesce("hero_source", F.lit(False)))
    return ranked(both, keys, [later, F.coalesce("position", F.lit(LAST)), *order], "place").select(*keys, name, "place")


def published_sections(definitions: DataFrame, sections: DataFrame, preferences: DataFrame, keys: Sequence[str], name: str, cache: str, order: Sequence[str]) -> DataFrame:
    """keys, name, title, n_items, place of the sections to show: cached with items and not switched off, under their own title where one is set.

    definitions: keys, name, cache, title; sections: cache, n_items; preferences: keys, name, enabled, custom_title, position.
    """
    filled = sections.filter("n_items > 0").select(cache, "n_items")
    both = definitions.join(filled, cache).join(preferences.select(*keys, name, "enabled", "custom_title", "position"), [*keys, name], "left")
    shown = both.filter(F.coalesce("enabled", F.lit(True))).withColumn("title", F.when(trimmed(F.col("custom_title")) != "", F.col("custom_title")).otherwise(F.col("title")))
    return ranked(shown, keys, [F.coalesce("position", F.lit(LAST)), *order], "place").select(*keys, name, "title", "n_items", "place")


def chosen_tracks(tracks: DataFrame, targets: DataFrame, keys: Sequence[str], normal_only: bool = False) -> DataFrame:
    """keys, ord of the track to show; null where no target is met.

    tracks: keys, ord, label, language, track, forced; targets: keys, position (from 0), target. The first target met
    decides: what is not forced comes first, of several tracks of a regional language the one whose words name the region.
    A regional target without a track takes one of the plain language that names the region; the first target gives up
    there. A single track of the other region does not meet a plain target. A key's tracks meet its targets, both short.
    """
    # What is costly is worked out once a track or once a target, before both meet, and what a pair needs once a pair.
    words = F.lower(F.concat_ws(" ", "label", "language", "track"))
    coded = tracks.select(*keys, "ord", "forced", F.lower("language").alias("language"), track_codes(F.col("language")).alias("codes"), words.alias("words"))
    coded = coded.select(*keys, "ord", "forced", "language", "codes", F.coalesce(F.get("codes", F.lit(0)), F.lit("")).alias("own"), regions_said(F.col("words")).alias("said"))
    coded = coded.withColumn("variant", variant_of(F.col("own"), F.col("said")))
    named = targets.select(*keys, "position", language_code(F.col("target")).alias("goal"))
    goal, base = F.col("goal"), F.substring_index("goal", "-", 1)
    away = region_of(F.col("said"), F.when(goal.isin(*WIDE), base).when(goal == "pt", "pt-br").when(goal == "es", "es-419"))
    open_ = ~F.col("forced") if normal_only else F.lit(True)
    odd = goal.isin(*NARROW) & (F.col("variant") != goal) & F.coalesce(F.col("variant") != F.col("language"), F.lit(True))
    pairs = coded.join(named, keys).select(*keys, "position", "goal", "forced", "ord", "own", region_of(F.col("said"), goal).alias("home"), away.alias("away"), (open_ & codes_fit(F.col("codes"), goal)).alias("fits"), odd.alias("odd"))
    home, away, fits = (F.col(c) for c in ("home", "away", "fits"))
    tier = F.when(~goal.isin(*WIDE, *NARROW) | (home & ~away), 0).when(home, 1).when(goal.isin(*WIDE) | ~away, 2).otherwise(3)
    stand_in = F.when(open_ & goal.isin(*WIDE) & (F.col("own") == base) & home, F.when(away, 2).when(F.col("forced"), 1).otherwise(0))
    per = pairs.groupBy(*keys, "position", "goal").agg(
        F.min(F.when(fits, F.struct("forced", tier.alias("tier"), "ord", "odd"))).alias("best"),
        *(F.count_if(fits & (F.col("forced") == f)).alias(n) for f, n in ((False, "plain"), (True, "forced_ones"))),
        F.min(F.when(stand_in.isNotNull(), F.struct(stand_in.alias("tier"), "ord"))).alias("other"),
    )
    alone = F.when(F.col("best.forced"), F.col("forced_ones")).otherwise(F.col("plain")) == 1
    met = F.when(F.col("best").isNull(), F.col("other.ord")).when(~(alone & F.col("best.odd")), F.col("best.ord"))
    stops = met.isNotNull() | (F.col("best").isNull() & F.col("goal").isin(*WIDE) & (F.col("position") == 0))
    decided = per.groupBy(*keys).agg(F.min(F.when(stops, F.struct("position", met.alias("ord")))).alias("d"))
    return tracks.select(*keys).distinct().join(decided, keys, "left").select(*keys, F.col("d.ord").alias("ord"))


def grouped_trailers(videos: DataFrame, keys: Sequence[str], language: str) -> DataFrame:
    """keys, category, video, place: videos of one site once each, by category and within it by season, language, official and date.

    videos: keys, ord, site, video, type, season, lang, official, published.
    """
    fine = videos.filter((F.lower("site") == "youtube") & (trimmed(F.col("video")) != ""))
    one = first_by(fine, [*keys, "video"], ["ord"]).withColumn("category", F.when(trimmed(F.col("type")) != "", F.col("type")).otherwise(GENERIC))
    whole = Window.partitionBy(*keys, "category")
    turn = F.when(F.lower("category") == GENERIC.lower(), 0).when(F.max("official").over(whole), 1).otherwise(2)
    lang = F.lower(trimmed(F.col("lang")))
    spoken = F.when(lang == language.partition("-")[0].lower(), 0).when(lang == ENGLISH, 1).otherwise(2)
    marked = one.withColumn("turn", turn).withColumn("seen", F.min("ord").over(whole))
    order = ["turn", F.lower("category"), "seen", F.col("season").isNull(), -F.col("season"), spoken, ~F.col("official"), F.desc(F.coalesce("published", F.lit(""))), "ord"]
    return ranked(marked, keys, order, "place").select(*keys, "category", "video", "place")
