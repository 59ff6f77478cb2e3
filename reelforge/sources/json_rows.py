"""JSON payloads as rows: unknown keys are ignored, wrong or missing fields become null, rows without what they need go.

Numbers may arrive as text, so they are read as text and cast; a payload that is no JSON gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelforge.functions.text import list_or_csv, trimmed

STREAMS = "struct<streams: array<struct<name: string, title: string, description: string, url: string, infoHash: string, externalUrl: string, fileIdx: string, sources: array<string>, behaviorHints: struct<bingeGroup: string, videoSize: string, filename: string, notWebReady: string, proxyHeaders: string>, clientResolve: string>>>"
METAS = "struct<metas: array<struct<id: string, type: string, name: string, poster: string, releaseInfo: string, imdbRating: string, genres: string>>>"
MANIFEST = "struct<id: string, name: string, version: string, types: array<string>, idPrefixes: array<string>, resources: array<string>>"
RATINGS = "struct<ratings: array<struct<source: string, value: string, score: string>>>"
# The largest rating of each source, and other names of sources.
RATING_TOP = {"imdb": 10.0, "mal": 10.0, "letterboxd": 5.0, "tmdb": 100.0, "tomatoes": 100.0, "metacritic": 100.0, "trakt": 100.0, "audience": 100.0}
RATING_ALIASES = {"popcorn": "audience", "tomatoesaudience": "audience", "myanimelist": "mal"}


def _text(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t != "", t)


def _int(c: Column) -> Column:
    return trimmed(c).try_cast("int")


def streams(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The payload's other columns and, per candidate in order: ord, name, title, description, addresses, hints."""
    rest = [c for c in payloads.columns if c != payload]
    one = payloads.select(*rest, F.posexplode(F.from_json(payload, STREAMS)["streams"]).alias("ord", "s"))
    hints = F.col("s.behaviorHints")
    rows = one.select(
        *rest,
        "ord",
        _text(F.col("s.name")).alias("name"),
        _text(F.col("s.title")).alias("title"),
        F.coalesce(_text(F.col("s.description")), _text(F.col("s.title"))).alias("description"),
        _text(F.col("s.url")).alias("url"),
        _text(F.col("s.infoHash")).alias("info_hash"),
        _text(F.col("s.externalUrl")).alias("external_url"),
        _int(F.col("s.fileIdx")).alias("file_idx"),
        F.col("s.sources").alias("sources"),
        hints["bingeGroup"].alias("binge_group"),
        trimmed(hints["videoSize"]).try_cast("long").alias("video_size"),
        hints["filename"].alias("filename"),
        (F.coalesce(hints["notWebReady"] == "true", F.lit(False)) | hints["proxyHeaders"].isNotNull()).alias("not_web_ready"),
        F.col("s.clientResolve").alias("client_resolve"),
    )
    return rows.filter("url is not null or info_hash is not null or external_url is not null or client_resolve is not null")


def catalog_items(payloads: DataFrame, keys: list[str], most: int, payload: str = "payload") -> DataFrame:
    """Valid items of each page, each id and type once, at most `most` of a page, with the page's raw count."""
    from reelforge.operators.order import first_by, ranked

    raw = payloads.select(*keys, F.from_json(payload, METAS)["metas"].alias("metas"))
    # The count is a column before the page is exploded: beside it, every item would be given its whole page.
    rows = raw.select(*keys, F.size("metas").alias("raw_count"), "metas").select(*keys, "raw_count", F.posexplode("metas").alias("ord", "m"))
    named = rows.select(*keys, "raw_count", "ord", _text(F.col("m.id")).alias("id"), _text(F.col("m.type")).alias("type"), _text(F.col("m.name")).alias("name"), F.col("m.releaseInfo").alias("release_info"), trimmed(F.col("m.imdbRating")).try_cast("double").alias("rating"), list_or_csv(F.col("m.genres")).alias("genres"))
    fine = named.filter("id is not null and type is not null and name is not null")
    return ranked(first_by(fine, [*keys, "type", "id"], ["ord"]), keys, ["ord"], "place").filter(F.col("place") <= most)


def manifest_resources(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per resource of a manifest. A resource may be a bare name, which takes the manifest's types and prefixes."""
    m = F.from_json(payload, MANIFEST)
    rest = [c for c in payloads.columns if c != payload]
    rows = payloads.select(*rest, m.alias("m")).select("*", F.posexplode("m.resources").alias("ord", "raw"))
    own = F.from_json(F.col("raw"), "struct<name: string, types: array<string>, idPrefixes: array<string>>")
    is_object = F.startswith(trimmed(F.col("raw")), F.lit("{"))
    out = rows.withColumn("own", F.when(is_object, own))
    return out.select(*rest, F.col("m.id").alias("id"), "ord", F.coalesce("own.name", "raw").alias("resource"), F.coalesce("own.types", "m.types").alias("types"), F.coalesce("own.idPrefixes", "m.idPrefixes").alias("prefixes"))


def supports(resource: Column, types: Column, prefixes: Column, kind: Column, video: Column, wanted: str = "stream") -> Column:
    """Whether a resource row serves a type and an id; no prefixes serve all ids."""
    return (resource == wanted) & F.coalesce(F.array_contains(types, kind), F.lit(False)) & (prefixes.isNull() | (F.size(prefixes) == 0) | F.exists(prefixes, lambda p: F.startswith(video, p)))


def ratings(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """keys, source, value: the first plausible rating of each known source; letterboxd's is a twentieth of its score, if any."""
    from reelforge.operators.order import first_by

    rows = payloads.select(*keys, F.posexplode(F.from_json(payload, RATINGS)["ratings"]).alias("ord", "r"))
    source = F.col("r.source")
    for a, b in RATING_ALIASES.items():
        source = F.when(source == a, F.lit(b)).otherwise(source)
    raw, score = (trimmed(F.col(f"r.{c}")).try_cast("double") for c in ("value", "score"))
    value = F.when(raw >= 0, F.when((source == "letterboxd") & score.isNotNull(), score / 20.0).otherwise(raw))
    top = F.lit(None).cast("double")
    for s, t in RATING_TOP.items():
        top = F.when(source == s, F.lit(t)).otherwise(top)
    named = rows.select(*keys, "ord", source.alias("source"), value.alias("value"), top.alias("top")).filter("value >= 0 and value <= top").drop("top")
    return first_by(named, [*keys, "source"], ["ord"]).select(*keys, "source", "value")


def batched_ratings(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """keys, id, source, value of answers about many media, each by one of three ids; of equal ids the last counts."""
    media = f"array<struct<imdb_id:string,imdbid:string,ids:map<string,string>,{RATINGS.removeprefix('struct<').removesuffix('>')}>>"
    rows = payloads.select(*keys, F.posexplode(F.from_json(payload, media)).alias("ord", "m"))
    named = rows.select(*keys, "ord", F.coalesce("m.imdb_id", "m.imdbid", F.element_at("m.ids", "imdb")).alias("id"), F.to_json(F.struct("m.ratings")).alias("payload")).filter("id is not null")
    last = named.groupBy(*keys, "id").agg(F.max_by("payload", "ord").alias("payload"))
    return ratings(last, [*keys, "id"])
