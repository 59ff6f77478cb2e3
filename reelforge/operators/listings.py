"""Catalogues, releases, collections and reference tracks as ordered lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.text import trimmed
from reelforge.operators.align import SCALE_APART, SCALE_RANGE, SCALES
from reelforge.operators.rollups import timing_classes, version_key
from reelforge.operators.search import _mapped

# Marks of releases that are none yet, the date of parts without one; samples, tolerance and weights of references.
PRERELEASE, UNDATED, RECOMMENDED = r"(?i)(?:^|[\s._-])(alpha|beta|rc|preview)(?:[\s._-]|$)", "9999", 12
REFERENCE_SAMPLE, TARGET_SAMPLE, ANCHORS, NEAR_MS, RESIDUAL_MS, LEAST = 24, 32, 4, 1800, 900.0, 4
HIT_SHARE, RESIDUAL_SHARE, CUE_SHARE, SPAN_SHARE, PLAIN_BONUS = 0.80, 0.20, 0.60, 0.32, 0.08
SDH_WORDS = ("sdh", "shd", "hoh", "hearing impaired", "hearing-impaired", "closed caption")


def flat_catalogs(sources: DataFrame) -> DataFrame:
    """source, type, id, name, genres, genre_required of the catalogues of enabled sources that ask for a genre at most.

    sources: source, enabled, catalogs (array of type, id, name, extra: array of name, required, options).
    """
    rows = sources.filter("enabled").select("source", F.posexplode("catalogs").alias("place", "c"))
    extra = F.coalesce("c.extra", F.array().cast(rows.schema["c"].dataType["extra"].dataType))
    genre = F.get(F.filter(extra, lambda x: x["name"] == "genre"), F.lit(0))
    free = F.forall(extra, lambda x: ~F.coalesce(x["required"], F.lit(False)) | (x["name"] == "genre"))
    none = F.array().cast("array<string>")
    return rows.filter(free).select("source", "place", "c.type", "c.id", "c.name", F.coalesce(genre["options"], none).alias("genres"), F.coalesce(genre["required"], F.lit(False)).alias("genre_required"))


def overview(sources: DataFrame) -> DataFrame:
    """total, active, catalogs: how many sources there are, are active, and how many catalogues enabled ones have."""
    return sources.agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.coalesce(F.sum(F.when(F.col("enabled"), F.greatest(F.size("catalogs"), F.lit(0)))), F.lit(0)).alias("catalogs"))


def parsed_version(text: Column) -> Column:
    """The version in a text, or null."""
    return F.when(F.trim(text).rlike(r"^[vV]?\d+(\.\d+){0,2}(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"), F.trim(text))


def eligible_releases(releases: DataFrame, keys: Sequence[str], beta: Column, order: Sequence[str]) -> DataFrame:
    """releases (tag, name, draft, prerelease) with version and place, newest first: no drafts, none without a version in tag
    or name, and, but for beta readers, none that is marked or named as early."""
    version = F.coalesce(parsed_version(F.col("tag")), parsed_version(F.col("name")))
    early = F.coalesce(F.col("prerelease"), F.lit(False)) | F.split_part(version, F.lit("+"), F.lit(1)).contains("-") | F.coalesce(F.col("name").rlike(PRERELEASE), F.lit(False))
    kept = releases.filter(~F.coalesce(F.col("draft"), F.lit(False))).withColumn("version", version).filter(F.col("version").isNotNull() & (beta | ~early))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(version_key(F.col("version")).desc(), *order)))


def collection_parts(parts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """parts (title, release_date) with place, by date, those without one last; parts without a title go."""
    titled = parts.withColumn("title", trimmed(F.col("title"))).filter("title <> ''")
    date = F.coalesce(F.when(F.trim("release_date") != "", F.col("release_date")), F.lit(UNDATED))
    return titled.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(date, *order)))


def recommendations(rows: DataFrame, keys: Sequence[str], order: Sequence[str], kind: Column) -> DataFrame:
    """keys, id, type, title, place of the first RECOMMENDED rows with an id and any title; kind: the type of those that name none."""
    name = F.coalesce(*(F.when(trimmed(F.col(c)) != "", trimmed(F.col(c))) for c in ("title", "name", "original_title", "original_name")))
    own = F.when(F.lower("media_type") == "tv", "series").when(F.lower("media_type") == "movie", "movie").otherwise(kind)
    kept = rows.select(*keys, *order, "id", own.alias("type"), name.alias("title")).filter("id > 0 and title is not null")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= RECOMMENDED).select(*keys, "id", "type", "title", "place")


def valid_links(links: DataFrame, now: Column, max_age: Column, expiring: Column) -> DataFrame:
    """links (cached_at, url, info_hash) that may be used again: not too old, with an address that does not expire, or a hash."""
    url = F.coalesce(trimmed(F.col("url")), F.lit("")) != ""
    some = url | (F.coalesce(trimmed(F.col("info_hash")), F.lit("")) != "")
    return links.filter((max_age > 0) & (F.col("cached_at") > 0) & (now - F.col("cached_at") <= max_age) & some & ~(url & F.coalesce(expiring, F.lit(False))))


def stream_size(raw: Column, hint: Column, cached: Column) -> Column:
    """A stream's size: as its file says, as its source hints, as the cache knows."""
    return F.coalesce(raw, hint, cached)


# ---- reference tracks ------------------------------------------------------------------------------------------------


def evenly(starts: np.ndarray, most: int) -> np.ndarray:
    """At most `most` starts, evenly by place, each once."""
    if len(starts) <= most:
        return starts
    picked = starts[np.arange(most) * (len(starts) - 1) // (most - 1)]
    return picked[np.sort(np.unique(picked, return_index=True)[1])]


def affinity(reference: np.ndarray, target: np.ndarray) -> float:
    """How well starts of a target meet a reference's, at the best of a few scales and offsets, by samples of both."""
    if min(len(reference), len(target)) < LEAST:
        return 0.0
    r, t = evenly(reference, REFERENCE_SAMPLE), evenly(target, TARGET_SAMPLE)
    scales, spans = list(SCALES), (reference[-1] - reference[0], target[-1] - target[0])
    if min(spans) > 0 and SCALE_RANGE[0] <= spans[0] / spans[1] <= SCALE_RANGE[1] and all(abs(s - spans[0] / spans[1]) >= SCALE_APART for s in scales):
        scales.append(spans[0] / spans[1])
    best, anchors = 0.0, np.arange(ANCHORS)
    for scale in scales:
        scaled = np.floor(t * scale + 0.5).astype(np.int64)
        for offset in set((r[anchors * (len(r) - 1) // (ANCHORS - 1)] - scaled[anchors * (len(t) - 1) // (ANCHORS - 1)]).tolist()):
            at = np.searchsorted(reference, scaled + offset)
            near = np.minimum(np.abs(reference[np.minimum(at, len(reference) - 1)] - scaled - offset), np.abs(reference[np.maximum(at - 1, 0)] - scaled - offset))
            hits = near[near <= NEAR_MS]
            if len(hits):
                best = max(best, len(hits) / len(t) * HIT_SHARE + float(np.exp(-hits.mean() / RESIDUAL_MS)) * RESIDUAL_SHARE)
    return min(1.0, best)


def ranked_references(references: DataFrame, labels: DataFrame, target: DataFrame, key: str, preferred: Column) -> DataFrame:
    """track, affinity, suitability, sdh, place of each key's reference tracks, of tracks with equal times only one.

    references: key, track, start, end; labels: track, label, sound (flagged as describing sound), key; target: key, start,
    end. preferred: of a track, whether it is the wanted one.
    """
    # Tracks of equal times are found by all their times together, within a key.
    of = F.struct(F.col(key), F.col("track"))
    classes = timing_classes(references.select(of.alias("t"), "start", "end"), "t").select(F.explode("tracks").alias("t"), F.xxhash64("tracks").alias("klass"), F.element_at("tracks", 1).alias("of"))
    sdh = F.coalesce(F.col("sound"), F.lit(False)) | F.lower(F.coalesce("label", F.lit(""))).rlike("|".join(SDH_WORDS))
    named = classes.select(F.col(f"t.{key}").alias(key), F.col("t.track").alias("track"), "of").join(labels.select(key, "track", sdh.alias("sdh")), [key, "track"])
    one = named.groupBy(key, "of").agg(F.min(F.struct("sdh", "track")).alias("m")).select(key, "m.track", "m.sdh")
    listed = lambda df, keys, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(name))
    pairs = listed(references, [key, "track"], "r").join(one, [key, "track"]).join(listed(target, [key], "t"), key)
    edge = lambda c: F.greatest(F.lit(1), F.element_at(c, -1)["end"] - F.element_at(c, 1)["start"])
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y)
    span = lambda c: F.when(F.size(c) < 2, 1).otherwise(edge(c))
    suit = ratio(F.size("r"), F.size("t")) * CUE_SHARE + ratio(span("r"), span("t")) * SPAN_SHARE + F.when(F.col("sdh"), 0.0).otherwise(PLAIN_BONUS)
    rows = pairs.select(key, "track", "sdh", suit.alias("suitability"), F.col("r.start").alias("r"), F.col("t.start").alias("t"))
    work = lambda row: [(affinity(np.array(row["r"], np.int64), np.array(row["t"], np.int64)),)]
    scored = _mapped(rows, [key, "track", "sdh", "suitability"], work, (("affinity", "double", pa.float64()),))
    by = [(~F.coalesce(preferred, F.lit(False))).alias("p"), F.desc("affinity"), F.desc("suitability"), F.col("sdh"), F.col("track")]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by)))
