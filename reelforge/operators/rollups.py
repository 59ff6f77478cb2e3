"""Grouped results: sections, votes, compact nesting, choices by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sections(items: DataFrame, kind: str, order: Sequence[Column], item: str) -> DataFrame:
    """kind, items: the ids of each kind's items in order, newest first by the caller's columns."""
    return items.groupBy(kind).agg(F.transform(F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(item).alias("item")))), lambda x: x["item"]).alias("items"))


def dominant(votes: DataFrame, keys: Sequence[str], category: str, none: str) -> DataFrame:
    """keys, category of the most votes (the first of equals), where it has more votes than `none`."""
    n = votes.groupBy(*keys, category).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.min_by(F.when(F.col(category) != none, F.col(category)), F.struct((F.col(category) == none).alias("x"), (-F.col("n")).alias("v"), category)).alias("best"), F.max(F.when(F.col(category) != none, F.col("n"))).alias("top"), F.coalesce(F.max(F.when(F.col(category) == none, F.col("n"))), F.lit(0)).alias("none"))
    return best.filter("top > none").select(*keys, F.col("best").alias(category), F.col("top").alias("votes"))


def throughput(samples: DataFrame, keys: Sequence[str], stamp: str, value: str, now: int, oldest: int, least: int = 2) -> DataFrame:
    """keys, estimate: the best of the recent samples, null of fewer than `least`."""
    recent = F.col(stamp).between(now - oldest, now)
    return samples.groupBy(*keys).agg(F.when(F.count_if(recent) >= least, F.max(F.when(recent, F.col(value)))).alias("estimate"))


def nested(rows: DataFrame, header: Sequence[str], entry: Sequence[str]) -> DataFrame:
    """One row per header with its sorted entries."""
    return rows.groupBy(*header).agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("entries"))


def expanded(rows: DataFrame, header: Sequence[str]) -> DataFrame:
    """The inverse of nested()."""
    return rows.select(*header, F.explode("entries").alias("e")).select(*header, "e.*")


def by_signature(rows: DataFrame, alias: str, entry: Sequence[str]) -> DataFrame:
    """Aliases that have the same set of entries, together."""
    sig = rows.groupBy(alias).agg(F.array_sort(F.collect_set(F.struct(*entry))).alias("entries"))
    return sig.groupBy("entries").agg(F.array_sort(F.collect_list(alias)).alias("aliases"))


def receipt(requested: DataFrame, confirmed: DataFrame, kind: str, key: str) -> DataFrame:
    """kind, requested, confirmed, missing."""
    both = requested.select(kind, key).distinct().join(confirmed.select(kind, key, F.lit(1).alias("ok")).distinct(), [kind, key], "left")
    return both.groupBy(kind).agg(F.count("*").alias("requested"), F.count("ok").alias("confirmed"), F.count_if(F.col("ok").isNull()).alias("missing"))


def by_region(rows: DataFrame, keys: Sequence[str], region: str, value: str, preferred: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The value of the first preferred region that has one, else the first of any."""
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col(region))
    rank = F.when(at > 0, at).otherwise(F.lit(len(preferred) + 1))
    return rows.filter(F.trim(value) != "").groupBy(*keys).agg(F.min_by(F.struct(region, value), F.struct(rank.alias("r"), *order)).alias("b")).select(*keys, f"b.{region}", f"b.{value}")


def first_true(df: DataFrame, keys: Sequence[str], tests: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The row of each key that passes the earliest tests: compared test by test, then by order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*((~F.coalesce(t, F.lit(False))).alias(f"t{i}") for i, t in enumerate(tests)), *order)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in rest))


def version_key(text: Column) -> Column:
    """A comparable value of `major.minor.patch[-pre.release]`: numbers below words, a prerelease below its release."""
    plain = F.regexp_replace(F.trim(text), r"^[vV]|\+.*$", "")
    core, pre = F.split(F.split_part(plain, F.lit("-"), F.lit(1)), r"\."), F.regexp_extract(plain, r"^[^-]*-(.*)$", 1)
    number = lambda i: F.coalesce(F.get(core, F.lit(i)).try_cast("long"), F.lit(0))
    part = lambda p: F.struct((~p.rlike(r"^\d+$")).alias("word"), F.length(F.when(p.rlike(r"^\d+$"), F.regexp_replace(p, "^0+(?=.)", "")).otherwise("")).alias("digits"), F.when(p.rlike(r"^\d+$"), F.regexp_replace(p, "^0+(?=.)", "")).otherwise(p).alias("text"))
    parts = F.when(pre == "", F.array().cast("array<struct<word: boolean, digits: int, text: string>>")).otherwise(F.transform(F.split(pre, r"\."), part))
    return F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"), (pre == "").alias("release"), parts.alias("pre"))


def recent_queries(history: DataFrame, keys: Sequence[str], query: str, stamp: str, n: int) -> DataFrame:
    """The last n different queries of each key, compared in lower case."""
    last = history.groupBy(*keys, F.lower(F.trim(query)).alias("q")).agg(F.max(stamp).alias("at")).filter("q <> ''")
    w = Window.partitionBy(*keys).orderBy(F.desc("at"), "q")
    return last.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def initial_and_deferred(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """deferred: whether a row comes after the first n of its key."""
    return df.withColumn("deferred", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > n)


def seeded_sample(df: DataFrame, keys: Sequence[str], of: str, seed: str, n: int) -> DataFrame:
    """n rows of each key in an order that the seed fixes."""
    at = F.md5(F.concat(F.lit(seed), F.col(of).cast("string")))
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(at, of))).filter(F.col("__r") <= n).drop("__r")


def availability(groups: DataFrame, cache: DataFrame, key: str, eligible: Column) -> DataFrame:
    """groups with state: CACHED, NOT_CACHED or UNKNOWN, asked once per distinct key; null where not eligible."""
    asked = groups.filter(eligible & F.col(key).isNotNull()).select(key).distinct()
    known = asked.join(cache.select(key, "cached").groupBy(key).agg(F.max("cached").alias("cached")), key, "left")
    state = known.select(key, F.when(F.col("cached"), "CACHED").when(~F.col("cached"), "NOT_CACHED").otherwise("UNKNOWN").alias("state"))
    return groups.join(state, key, "left").withColumn("state", F.when(eligible, F.col("state")))


def unique_match(wanted: DataFrame, files: DataFrame, keys: Sequence[str], name: str, wanted_id: str, file_id: str) -> DataFrame:
    """The file of the wanted name, else the only file of its key."""
    exact = wanted.join(files.groupBy(*keys, name).agg(F.min(file_id).alias("__exact")), [*keys, name], "left")
    only = files.groupBy(*keys).agg(F.min(file_id).alias("__lo"), F.max(file_id).alias("__hi")).filter(F.col("__lo") == F.col("__hi")).select(*keys, F.col("__lo").alias("__only"))
    return exact.join(only, list(keys), "left").select(wanted_id, F.coalesce("__exact", "__only").alias(file_id))


def word_anchors(heard: DataFrame, cues: DataFrame, keys: Sequence[str], word: str, most: int = 6) -> DataFrame:
    """keys, both positions and weight of equal words: one over the cues' occurrences (at most `most`), plus one for each
    neighbour that agrees."""
    w = lambda df: df.withColumn("p", F.lag(word).over(Window.partitionBy(*keys).orderBy("at"))).withColumn("n", F.lead(word).over(Window.partitionBy(*keys).orderBy("at")))
    few = cues.groupBy(*keys, word).agg(F.count("*").alias("times")).filter(F.col("times") <= most)
    c = w(cues).join(few, [*keys, word]).select(*keys, word, F.col("at").alias("cue_at"), F.col("p").alias("cp"), F.col("n").alias("cn"), "times")
    both = w(heard).join(c, [*keys, word])
    agree = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))
    return both.select(*keys, "at", "cue_at", (F.lit(1.0) / F.col("times") + agree("p", "cp") + agree("n", "cn")).alias("weight"))


def timing_classes(cues: DataFrame, track: str) -> DataFrame:
    """Tracks of exactly the same times, together."""
    times = cues.groupBy(track).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("times"))
    return times.groupBy("times").agg(F.array_sort(F.collect_list(track)).alias("tracks")).select("tracks", F.size("times").alias("cues"))
