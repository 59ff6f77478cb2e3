"""What a home screen shows: continue watching, what is up next and coming, cached rows, history edits, fixed orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.progress import malformed_id
from reelforge.functions.text import title_sort_key, trimmed
from reelforge.operators.order import first_by, last_by, ranked

# Names that are no id, the fraction from which an entry is not shown, the last place of unranked rows.
NAMESPACES = ["tmdb", "imdb", "trakt"]
SHOWN_BELOW, LAST = 0.995, 2_147_483_647


def _filled(c: Column) -> Column:
    return F.coalesce(trimmed(c) != "", F.lit(False))


def since(df: DataFrame, stamp: str, cutoff: int | None) -> DataFrame:
    """Rows from the cutoff on; all without one."""
    return df if cutoff is None else df.filter(F.col(stamp) >= cutoff)


def continue_rows(entries: DataFrame, up_next: DataFrame, keys: Sequence[str], mode: str = "default", today: str = "") -> DataFrame:
    """keys, content, parent, video, stamp, is_next, released, place (from 1 for each key) of the rows to continue with.

    entries: keys, parent, video, series, stamp, fraction, ord; up_next: keys, parent, video, stamp, released, ord.
    Series in progress put their own next episode aside; the newest row of a title stays, an entry before a next
    episode of the same time. Modes: default; streaming puts what is not yet released last, by date, unknown dates at
    the end; upcoming rows of split mode come from split_upcoming().
    """
    busy = entries.filter(F.col("series") & _filled(F.col("parent"))).select(*keys, "parent").distinct()
    shown = entries.filter(F.col("fraction") < SHOWN_BELOW).select(*keys, "parent", "video", "stamp", F.lit(False).alias("is_next"), F.lit(None).cast("string").alias("released"), "ord")
    free = up_next.join(busy, [*keys, "parent"], "left_anti").select(*keys, "parent", "video", "stamp", F.lit(True).alias("is_next"), "released", "ord")
    rows = shown.unionByName(free).withColumn("content", F.when(_filled(F.col("parent")), F.col("parent")).otherwise(F.col("video")))
    first = first_by(rows.withColumn("age", -F.col("stamp")), [*keys, "content"], ["age", "is_next", "ord"])
    late = F.lit(False)
    if mode == "streaming" and today:
        late = F.col("is_next") & _filled(F.col("released")) & (F.substring("released", 1, 10) > today)
    order = [F.col("late"), F.when(F.col("late"), F.col("released")), "age", "is_next", "ord"]
    return ranked(first.withColumn("late", late), keys, order, "place").select(*keys, "content", "parent", "video", "stamp", "is_next", "released", "place")


def split_upcoming(rows: DataFrame, keys: Sequence[str], release: Column, now: int, order: Sequence[str | Column]) -> DataFrame:
    """rows with upcoming, and place within its part: the main part in its order, the upcoming one by release."""
    marked = rows.withColumn("upcoming", F.coalesce(F.col("is_next") & (release > now), F.lit(False)))
    return ranked(marked, [*keys, "upcoming"], [F.when(F.col("upcoming"), release), *order], "place")


def completed_seeds(entries: DataFrame, watched: DataFrame, keys: Sequence[str], provider_owns: bool, furthest: bool) -> DataFrame:
    """The last completed episode of each series: keys, parent, season, episode, stamp.

    Both sides: keys, parent, series, season, episode, stamp; entries also done. Specials, rows without a number, and
    names that are no id do not count; watched rows do unless the provider keeps the history. furthest: by number, not time.
    """
    fine = lambda df: df.filter(F.col("series") & (F.col("season") != 0) & F.col("episode").isNotNull() & ~malformed_id(F.col("parent"), NAMESPACES)).select(*keys, "parent", "season", "episode", "stamp")
    both = fine(entries.filter("done"))
    if not provider_owns:
        both = both.unionByName(fine(watched))
    return last_by(both, [*keys, "parent"], ["season", "episode", "stamp"] if furthest else ["stamp", "season", "episode"])


def current_up_next(rows: DataFrame, seeds: DataFrame, keys: Sequence[str], drop_unseeded: bool, active: DataFrame | None = None) -> DataFrame:
    """rows (keys, content, seed_season, seed_episode) whose seed did not move; a row without a seed stays, but where those
    of titles that are not active go. active: keys, content; without it, the titles that have a seed."""
    now = seeds.select(*keys, "content", F.col("season").alias("now_season"), F.col("episode").alias("now_episode"))
    joined = rows.join(now, [*keys, "content"], "left")
    same = (F.col("seed_season") == F.col("now_season")) & (F.col("seed_episode") == F.col("now_episode"))
    kept = joined.filter(F.col("now_season").isNull() | F.coalesce(same, F.lit(False))).drop("now_season", "now_episode")
    return kept.join((seeds if active is None else active).select(*keys, "content").distinct(), [*keys, "content"], "left_semi") if drop_unseeded else kept


def with_cache(resolved: DataFrame, cached: DataFrame, settled: DataFrame, keys: Sequence[str], fill: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Resolved rows, blanks in `fill` filled from the cache, and cached rows whose key is not settled without a result."""
    a = resolved.select(*keys, F.struct(*fill, *take).alias("new"))
    b = cached.select(*keys, F.struct(*fill, *take).alias("old")).join(settled.select(*keys, F.lit(True).alias("settled")).distinct(), keys, "left")
    both = a.join(b, keys, "full").filter(F.col("new").isNotNull() | F.col("settled").isNull())
    filled = [F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(_filled(F.col(f"new.{c}")), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in fill]
    taken = [F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in take]
    return both.select(*keys, *filled, *taken)


def richest(df: DataFrame, keys: Sequence[str], stamp: str, facts: Sequence[str], ord_: str) -> DataFrame:
    """The newest row of each key; of the same time the one with the most filled facts, and then the first."""
    score = sum((_filled(F.col(c)).cast("int") for c in facts), F.lit(0))
    return last_by(df.withColumn("score", score).withColumn("turn", -F.col(ord_)), keys, [stamp, "score", "turn"]).drop("turn")


def without_history(marks: DataFrame, removed: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(marks, rollups) after removals (keys, season, episode): a removal without an episode drops the title, one with an
    episode clears its mark, of season 1 unless it names one. rollups: keys, last_watched, watched of every title left."""
    titles = removed.filter("episode is null").select(*keys).distinct()
    parts = removed.filter("episode is not null").select(*keys, F.coalesce("season", F.lit(1)).alias("season"), "episode", F.lit(True).alias("cleared")).distinct()
    left = marks.join(titles, keys, "left_anti").join(parts, [*keys, "season", "episode"], "left")
    out = left.withColumn("watched_at", F.when(F.col("cleared").isNull(), F.col("watched_at"))).drop("cleared")
    return out, out.groupBy(*keys).agg(F.max("watched_at").alias("last_watched"), F.count("watched_at").alias("watched"))


def found_catalogs(wanted: DataFrame, catalogs: DataFrame) -> DataFrame:
    """wanted (request, source, catalog, type) with the owner and catalog it means: of its source by the exact id, then by
    the id before the first comma; else of the first enabled source by the exact id. catalogs: owner, id, type, ord, enabled.

    Of an owner's equal ids, and of all owners', the first alone is joined, so a request meets three catalogs at most.
    """
    on = catalogs.filter("enabled").drop("enabled").select("owner", "id", "type", "ord")
    own, any_ = first_by(on, ["owner", "id", "type"], ["ord"]), first_by(on, ["id", "type"], ["ord"])
    met = lambda df, test, step: wanted.alias("w").join(df.alias("c"), test).select("w.request", F.lit(step).alias("step"), "c.ord", "c.owner", "c.id")
    exact, same_type, same_owner = (F.expr(x) for x in ("w.catalog = c.id", "w.type = c.type", "w.source = c.owner"))
    by_short = F.expr("substring_index(w.catalog, ',', 1) = c.id")
    hits = met(own, exact & same_type & same_owner, 0).unionByName(met(own, by_short & same_type & same_owner, 1)).unionByName(met(any_, exact & same_type, 2))
    best = first_by(hits, ["request"], ["step", "ord"])
    return wanted.join(best.select("request", "owner", F.col("id").alias("found")), "request", "left")


def fixed_order(name: str) -> list[Column]:
    """Sort keys of a named list: votes, rating and date of title lists, downloads, grouped streams, releases, library options."""
    low = lambda c: F.lower(trimmed(F.coalesce(F.col(c), F.lit(""))))
    date = F.coalesce(F.col("date"), F.col("info"), F.lit(""))
    return {
        "original": [],
        "rating": [F.coalesce(F.col("rating").try_cast("double"), F.lit(-1.0)).desc(), date.desc()],
        "votes": [F.coalesce(F.col("votes"), F.lit(0)).desc()],
        "date": [date.desc()],
        "downloads": [F.coalesce(F.col("season"), F.lit(LAST)).asc(), F.coalesce(F.col("episode"), F.lit(LAST)).asc(), low("episode_title").asc(), low("title").asc(), F.col("id").asc()],
        "grouped": [F.lower(F.coalesce(F.col(c), F.lit(""))).asc() for c in ("source", "label", "subtitle")],
    }[name]


def credit_lists(credits: DataFrame, keys: Sequence[str], today: str) -> DataFrame:
    """keys, list (popular, latest, upcoming), place, id: each credit once by id; the dated lists by string dates."""
    once = first_by(credits, [*keys, "id"], ["ord"])
    w = lambda name, *order: Window.partitionBy(*keys).orderBy(*order, "ord")
    lists = [
        ("popular", F.lit(True), F.coalesce("popularity", F.lit(0.0)).desc()),
        ("latest", F.col("date") <= today, F.col("date").desc()),
        ("upcoming", F.col("date") > today, F.col("date").asc()),
    ]
    parts = [once.filter(keep).select(*keys, F.lit(name).alias("list"), F.row_number().over(w(name, order)).alias("place"), "id") for name, keep, order in lists]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def file_groups(files: DataFrame, key: str, size: str) -> DataFrame:
    """One item for each group of files: its first name, files and the sum of known sizes, null where none is known."""
    return files.groupBy(key).agg(F.min_by("item", "ord").alias("item"), F.count("*").alias("files"), F.sum(size).alias("bytes"))


def english_titles(rows: DataFrame, key: str, title: str, other: str, ord_: str) -> DataFrame:
    """The first title of each id without Chinese, Japanese or Korean letters; blank titles give way to the other name."""
    text = F.coalesce(F.nullif(trimmed(F.col(title)), F.lit("")), F.nullif(trimmed(F.col(other)), F.lit("")))
    fine = rows.withColumn("text", text).filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))
    return first_by(fine, [key], [ord_]).select(key, "text")


def useful_title(normal: Column) -> Column:
    """Whether a normalised episode title says more than a number."""
    return _filled(normal) & ~normal.rlike(r"^(episode|ep|e) \d+$")


def episode_label(season: Column, episode: Column, title: Column) -> Column:
    """S1E2 and the title, whichever are there."""
    code = F.when(season.isNotNull() & episode.isNotNull(), F.concat(F.lit("S"), season, F.lit("E"), episode)).when(episode.isNotNull(), F.concat(F.lit("E"), episode))
    return F.concat_ws(" • ", code, F.when(_filled(title), title))


def skips_itself(start: Column, end: Column, kind: Column, selected: Sequence[str]) -> Column:
    """Whether a segment is whole, in order and of a selected kind."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(finite(start) & finite(end) & (start >= 0) & (end > start) & kind.isin(*selected), F.lit(False))


def sources_loaded(groups: DataFrame, keys: Sequence[str], scope: str, installed: DataFrame) -> DataFrame:
    """keys, loaded: no relevant group loads any more. scope: all, installed or plugins; groups: keys, addon, loading."""
    known = groups.join(installed.select("addon", F.lit(True).alias("known")).distinct(), "addon", "left")
    relevant = {"all": F.lit(True), "installed": F.col("known").isNotNull(), "plugins": F.col("known").isNull()}[scope]
    return known.groupBy(*keys).agg((~F.bool_or(F.col("loading") & relevant)).alias("loaded"))


def overlaid(remote: DataFrame, own: DataFrame, keys: Sequence[str], now: int) -> DataFrame:
    """remote and the own entries that still count: not expired, and not yet confirmed by a remote entry of their video.

    Both: keys, video, stamp, fraction, done; own also expires. A remote entry that is at most a minute older confirms a
    finished one if it is finished, another one if their fractions differ by 0.03 at most. The newest entry of a video stays.
    """
    there = remote.select(*keys, "video", F.col("stamp").alias("r_stamp"), F.col("fraction").alias("r_fraction"), F.col("done").alias("r_done"))
    close = F.when(F.col("done"), F.col("r_done")).otherwise(F.abs(F.col("r_fraction") - F.col("fraction")) <= 0.03)
    joined = own.filter(F.col("expires") > now).join(there, [*keys, "video"], "left")
    sure = joined.groupBy(*keys, "video", "stamp", "fraction", "done").agg(F.coalesce(F.bool_or(close & (F.col("r_stamp") >= F.col("stamp") - 60_000)), F.lit(False)).alias("sure"))
    active = sure.filter("not sure").select(*keys, "video", "stamp", "fraction", "done", F.lit(True).alias("own"))
    both = remote.select(*keys, "video", "stamp", "fraction", "done", F.lit(False).alias("own")).unionByName(active)
    return last_by(both.withColumn("turn", F.when(F.col("own"), 0).otherwise(1)), [*keys, "video"], ["stamp", "turn", "fraction"]).drop("turn")


def prepared(candidates: DataFrame, keys: Sequence[str], key: str, chosen: Column, matches: Column, limit: int) -> DataFrame:
    """The candidates to prepare, each key once: the chosen one, those that match, the rest, as far as the limit; place from 1."""
    once = first_by(candidates.withColumn("step", F.when(chosen, 0).when(matches, 1).otherwise(2)), [*keys, key], ["ord"])
    return ranked(once, keys, ["step", "ord"], "place").filter(F.col("place") <= limit)


def library_rows(items: DataFrame, keys: Sequence[str], key: str, kind: str, wanted: str | None, sort: str) -> DataFrame:
    """Items of all sections, each key once, of one kind where any item has it, with their place by one of five orders.

    items: also ord, list_rank, tracker_rank, saved, title, id.
    """
    name, tie = title_sort_key(F.col("title")), [F.lower(trimmed(F.col("title"))), F.col("id")]
    orders = {
        "default": [F.coalesce("list_rank", "tracker_rank", F.lit(LAST)).asc(), F.col("saved").desc(), *tie],
        "added_desc": [F.col("saved").desc(), *tie],
        "added_asc": [F.col("saved").asc(), *tie],
        "title_asc": [name.asc(), F.col("id")],
        "title_desc": [name.desc(), F.col("id")],
    }
    once = first_by(items, [*keys, key], ["ord"]).withColumn("kind", F.lower(trimmed(F.col(kind))))
    if wanted is not None:
        w = Window.partitionBy(*keys)
        same = F.col("kind") == wanted.strip().lower()
        once = once.withColumn("any", F.max(F.coalesce(same, F.lit(False))).over(w)).filter(~F.col("any") | same).drop("any")
    return ranked(once, keys, orders[sort], "place")


def like_dialogue(text: Column) -> Column:
    """Not wholly in brackets, and with a letter or a digit."""
    whole = trimmed(text)
    return F.coalesce(~whole.rlike(r"(?s)^(\(.*\)|\[.*\])$") & whole.rlike(r"[\p{L}\p{Nd}]"), F.lit(False))


def shown_name(path: Column) -> Column:
    """The last part of a path, or all of it where that is blank."""
    last = F.regexp_extract(path, r"[^/\\]*$", 0)
    return F.when(trimmed(last) == "", path).otherwise(last)


def plain_name(name: Column) -> Column:
    """The last part of a path in lower case, without its ending, its letters and digits in words."""
    last = F.regexp_replace(F.lower(shown_name(name)), r"\.[^.]*$", "")
    return trimmed(F.regexp_replace(last, r"[^a-z0-9]+", " "))


def chosen_file(files: DataFrame, wanted: DataFrame, keys: Sequence[str], whole_path: bool = False) -> DataFrame:
    """One file for each request that has a playable one: the first whose name holds a wanted one or lies in it, the first whose name holds an
    episode's mark, the one at the wanted index, then before it, then of that id, else the largest.

    files: keys, pos (from 0), id, name, size, playable; wanted: keys, names, marks (arrays, lower case), index. Marks are
    looked for in a path's last part, or in all of it; blank names match nothing.
    """
    rows = files.filter("playable").join(wanted, keys)
    name = F.lower(trimmed(F.col("name") if whole_path else shown_name(F.col("name"))))
    plain = plain_name(F.col("name"))
    held = F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), plain_name), lambda n: n != "")
    named = F.exists(held, lambda n: F.contains(plain, n) | F.contains(n, plain))
    marked = F.exists(F.coalesce("marks", F.array().cast("array<string>")), lambda m: F.contains(name, m))
    step = (
        F.when(named, 0).when(marked, 1).when(F.col("pos") == F.col("index"), 2)
        .when((F.col("index") > 0) & (F.col("pos") == F.col("index") - 1), 3).when(F.col("id") == F.col("index"), 4).otherwise(5)
    )
    sized = rows.withColumn("step", step).withColumn("less", F.when(F.col("step") == 5, -F.coalesce("size", F.lit(0))).otherwise(0))
    return first_by(sized, keys, ["step", "less", "pos", "id", "name"]).select(*keys, "id", "name", "step")
