"""What a candidate source is and whether it can be played, as Column expressions over the columns of sources.json_rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelforge.functions.text import info_hash, trimmed


def _set(c: Column) -> Column:
    return F.coalesce(trimmed(c) != "", F.lit(False))


def is_magnet(url: Column) -> Column:
    return F.coalesce(F.lower(trimmed(url)).startswith("magnet:"), F.lit(False))


def is_torrent_address(url: Column) -> Column:
    return F.coalesce(F.lower(trimmed(url)).startswith("torrent://"), F.lit(False))


def playable_url(url: Column) -> Column:
    """The address that a player can take; magnets and torrent addresses are none."""
    return F.when(_set(url) & ~is_magnet(url) & ~is_torrent_address(url), trimmed(url))


def opens_externally(url: Column, hash_: Column, resolve: Column, external: Column) -> Column:
    return ~_set(url) & ~_set(hash_) & resolve.isNull() & playable_url(external).isNotNull()


def is_torrent(url: Column, hash_: Column, external: Column, direct: Column) -> Column:
    return ~direct & (_set(hash_) | is_magnet(url) | is_magnet(external) | is_torrent_address(url) | is_torrent_address(external))


def needs_resolving(url: Column, hash_: Column, external: Column, direct: Column) -> Column:
    return is_torrent(url, hash_, external, direct) & playable_url(url).isNull()


def peer_hash(hash_: Column, url: Column, external: Column) -> Column:
    """The hash, else that of the first magnet, else of the first torrent address."""
    magnet = F.when(is_magnet(url), url).when(is_magnet(external), external)
    torrent = F.when(is_torrent_address(url), url).when(is_torrent_address(external), external)
    return F.coalesce(F.when(_set(hash_), trimmed(hash_)), info_hash(magnet), info_hash(torrent))


def selectable(url: Column, hash_: Column, resolve: Column, external: Column, direct: Column, peers: bool, managed: Column) -> Column:
    by_peers = needs_resolving(url, hash_, external, direct) & peer_hash(hash_, url, external).isNotNull() if peers else F.lit(False)
    return playable_url(url).isNotNull() | opens_externally(url, hash_, resolve, external) | by_peers | managed


def supports_search(extra: Column) -> Column:
    """A catalog with a search property and no other required one; extra: array of (name, isRequired, options)."""
    return F.exists(extra, lambda p: p["name"] == "search") & ~F.exists(extra, lambda p: F.coalesce(p["isRequired"], F.lit(False)) & (p["name"] != "search"))


def supports_discover(extra: Column) -> Column:
    """A catalog that asks for nothing but, at most, a genre it lists."""
    asks = lambda p: F.coalesce(p["isRequired"], F.lit(False))
    none = lambda p: F.coalesce(F.size(p["options"]), F.lit(0)) <= 0
    bad = lambda p: asks(p) & F.when(p["name"] == "genre", none(p)).otherwise(p["name"] != "skip")
    return ~F.exists(extra, bad)


def catalog_path(kind: Column, catalog: Column, genre: Column, search: Column, skip: Column) -> Column:
    """The resource path of a catalog request: filters that are set go into the address."""
    part = lambda name, c: F.when(_set(c), F.concat(F.lit(f"{name}="), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))
    extra = F.array_join(F.array_compact(F.array(part("search", search), part("genre", genre), F.when(skip > 0, F.concat(F.lit("skip="), skip.cast("string"))))), "&")
    return F.concat(F.lit("catalog/"), kind, F.lit("/"), catalog, F.when(extra != "", F.concat(F.lit("/"), extra)).otherwise(""), F.lit(".json"))


def season_posters(keyed: Column, positional: Column, seasons: Column) -> Column:
    """A map of season to poster: keyed ones, else a list aligned to the seasons: all of them, the main ones, specials and
    the main ones where the first is null, else 1, 2, 3 and on."""
    all_ = F.array_sort(F.array_distinct(F.filter(seasons, lambda s: s >= 0)))
    main = F.filter(all_, lambda s: s > 0)
    n = F.size(positional)
    at = F.when(F.size(all_) == n, all_).when(F.size(main) == n, main).when((F.size(main) > 0) & (n == F.size(main) + 1) & F.get(positional, F.lit(0)).isNull(), F.concat(F.array(F.lit(0)), main)).otherwise(F.transform(positional, lambda _, i: i + 1))
    pairs = F.filter(F.arrays_zip(at.alias("k"), positional.alias("v")), lambda p: F.coalesce(trimmed(p["v"]) != "", F.lit(False)))
    listed = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], trimmed(p["v"]))))
    return F.when(F.coalesce(F.size(keyed) > 0, F.lit(False)), keyed).otherwise(listed)
