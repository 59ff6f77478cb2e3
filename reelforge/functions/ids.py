"""Identifiers of several systems, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelforge.functions.text import trimmed

# Systems whose ids are numbers, systems whose ids are text, and the ones of animation.
NUMERIC, TEXTUAL, ANIME = ("tmdb", "trakt", "simkl", "mal", "anidb", "anilist", "kitsu"), ("imdb", "tvdb", "mdblist"), ("mal", "anidb", "anilist", "kitsu")
SYSTEMS = ("imdb", "tmdb", "tvdb", "trakt", "simkl", "mal", "anidb", "anilist", "kitsu", "mdblist")
TYPE_ALIASES = (("movie", "film"), ("series", "show", "tv", "tvshow", "anime"))


def external_ids(raw: Column) -> Column:
    """A struct with the one id that a text names: `tt…` is imdb's, a bare number trakt's, `system:value` that system's."""
    full = trimmed(raw)
    is_imdb = F.lower(full).startswith("tt")
    prefix = F.lower(F.split_part(full, F.lit(":"), F.lit(1)))
    value = trimmed(F.split_part(full, F.lit(":"), F.lit(2)))
    known = prefix.isin(*SYSTEMS)
    out = []
    for s in SYSTEMS:
        own = ~is_imdb & (prefix == s)
        if s in NUMERIC:
            c = F.when(own, value.try_cast("long"))
            if s == "trakt":
                c = F.when(~is_imdb & ~known, full.try_cast("long")).otherwise(c)
        else:
            c = F.when(own & (value != ""), value)
            if s == "imdb":
                c = F.when(is_imdb, F.split_part(full, F.lit(":"), F.lit(1))).otherwise(c)
        out.append(c.alias(s))
    return F.struct(*out)


def media_kind(kind: Column, ids: Column) -> Column:
    anime = ids[ANIME[0]].isNotNull()
    for s in ANIME[1:]:
        anime = anime | ids[s].isNotNull()
    k = F.lower(trimmed(kind))
    return F.when(anime | (k == "anime"), "ANIME").when(k.isin("movie", "film"), "MOVIE").otherwise("SHOW")


def canonical_id(**by_system: Column) -> Column:
    """`system:value` of the first system in order of the arguments that has one."""
    return F.coalesce(*(F.concat(F.lit(f"{s}:"), c.cast("string")) for s, c in by_system.items()))


def aliases(**by_system: Column) -> Column:
    return F.array_compact(F.array(*(F.concat(F.lit(f"{s}:"), c.cast("string")) for s, c in by_system.items())))


def watched_key(kind: Column, content: Column, season: Column, episode: Column) -> Column:
    return F.concat_ws(":", trimmed(kind), trimmed(content), F.coalesce(season, F.lit(-1)).cast("string"), F.coalesce(episode, F.lit(-1)).cast("string"))


def type_aliases(kind: Column) -> Column:
    k = F.lower(trimmed(kind))
    out = F.array(trimmed(kind))
    for names in TYPE_ALIASES:
        out = F.when(k.isin(*names), F.array(*map(F.lit, names))).otherwise(out)
    return out


def watched_keys(kind: Column, content: Column, season: Column, episode: Column) -> Column:
    return F.transform(type_aliases(kind), lambda k: watched_key(k, content, season, episode))


def public_address(url: Column) -> Column:
    """An http address whose host is neither this machine nor in a private, link-local or zero range."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = (F.when(v4, F.split_part(host, F.lit("."), F.lit(i)).cast("int")) for i in (1, 2))
    private = v4 & (a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)))
    v6 = host.rlike(r"^\[(::1|::|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]:.*)\]$")
    return (host != "") & (host != "localhost") & ~F.endswith(host, F.lit(".localhost")) & ~private & ~v6
