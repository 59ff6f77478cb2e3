"""Ordered scans over time or position, as window functions within a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[str | Column]


def _w(keys: Sequence[str], order: Order):
    return Window.partitionBy(*keys).orderBy(*order)


def following(df: DataFrame, keys: Sequence[str], order: Order, columns: Sequence[str], prefix: str = "next_") -> DataFrame:
    """The columns of the next row."""
    w = _w(keys, order)
    return df.select("*", *(F.lead(c).over(w).alias(prefix + c) for c in columns))


def before_target(df: DataFrame, targets: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows ordered before the target row of their key; all rows where the key has none."""
    t = targets.select(*keys, F.struct(*order).alias("__target"))
    return df.join(t, list(keys), "left").filter(F.col("__target").isNull() | (F.struct(*order) < F.col("__target"))).drop("__target")


def next_after_seed(df: DataFrame, seeds: DataFrame, keys: Sequence[str], order: Sequence[str], eligible: Column) -> DataFrame:
    """The first eligible row of each key after its seed row; the seed's columns are in `seed`."""
    s = seeds.select(*keys, F.struct(*order).alias("seed"))
    later = df.join(s, list(keys)).filter((F.struct(*order) > F.col("seed")) & eligible)
    rest = [c for c in later.columns if c not in keys]
    best = later.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def all_done(members: DataFrame, done: DataFrame, keys: Sequence[str], member: Sequence[str]) -> DataFrame:
    """Keys that have members, all of which are done."""
    d = done.select(*keys, *member).distinct().withColumn("__done", F.lit(1))
    return members.select(*keys, *member).distinct().join(d, [*keys, *member], "left").groupBy(*keys).agg(F.min(F.coalesce("__done", F.lit(0))).alias("__all")).filter("__all = 1").select(*keys)


def without_late_groups(df: DataFrame, keys: Sequence[str], group: str, order: Sequence[str], bad_start: Column) -> DataFrame:
    """Without the groups whose first row fails."""
    first = df.withColumn("__bad", bad_start).groupBy(*keys, group).agg(F.min_by("__bad", F.struct(*order)).alias("__bad")).filter("__bad").select(*keys, group)
    return df.join(first, [*keys, group], "left_anti")


def sliding_median(df: DataFrame, keys: Sequence[str], order: Order, value: str, radius: int) -> Column:
    """The upper median of up to `radius` rows to either side, truncated at the ends."""
    w = _w(keys, order).rowsBetween(-radius, radius)
    got = F.array_sort(F.collect_list(value).over(w))
    return F.get(got, F.floor(F.size(got) / 2).cast("int"))


def without_outliers(df: DataFrame, keys: Sequence[str], order: Order, value: str, radius: int = 3, within: float = 250, least: int = 7) -> DataFrame:
    """Rows no further than `within` from their sliding median; keys of fewer than `least` rows are left alone."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__m", sliding_median(df, keys, order, value, radius)).withColumn("__n", n).filter((F.col("__n") < least) | (F.abs(F.col(value) - F.col("__m")) <= within)).drop("__m", "__n")


def monotonic(df: DataFrame, keys: Sequence[str], order: Order, start: str, name: str = "repaired") -> DataFrame:
    """name: the largest start so far."""
    return df.withColumn(name, F.max(start).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def trimmed_overlaps(df: DataFrame, keys: Sequence[str], order: Order, old: tuple[str, str], new: tuple[str, str], name: str = "trimmed_end") -> DataFrame:
    """name: the new end, cut to the next new start where the old pair did not overlap."""
    w = _w(keys, order)
    next_old, next_new = F.lead(old[0]).over(w), F.lead(new[0]).over(w)
    cut = (F.col(old[1]) <= next_old) & (F.col(new[1]) > next_new)
    return df.withColumn(name, F.when(F.coalesce(cut, F.lit(False)), next_new).otherwise(F.col(new[1])))


def runs(df: DataFrame, keys: Sequence[str], order: Order, starts: Column, name: str = "run") -> DataFrame:
    """name: number of the run each row is in; a run begins where `starts` holds."""
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def longest_run(df: DataFrame, keys: Sequence[str], order: Order, holds: Column) -> DataFrame:
    """keys, length of the longest run of rows for which `holds`; 0 where none does."""
    marked = runs(df.withColumn("__ok", F.coalesce(holds, F.lit(False))), keys, order, ~F.col("__ok"), "__run")
    per = marked.groupBy(*keys, "__run").agg(F.count_if("__ok").alias("n"))
    return per.groupBy(*keys).agg(F.max("n").alias("length"))


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], stamp: str, gap: int) -> DataFrame:
    """session: rows further than gap from the row before begin one."""
    w = _w(keys, order)
    return runs(df.withColumn("__was", F.lag(stamp).over(w)), keys, order, F.col("__was").isNull() | (F.col(stamp) - F.col("__was") > gap), "session").drop("__was")


def change_point(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """keys and the row from which the sum of values to the end is largest; the earliest of equals."""
    w = _w(keys, order).rowsBetween(0, Window.unboundedFollowing)
    summed = df.withColumn("suffix", F.sum(value).over(w))
    rest = [c for c in summed.columns if c not in keys]
    best = summed.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col("suffix")).alias("__s"), *order)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Order, value: str, name: str = "prefix") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def densest_window(df: DataFrame, keys: Sequence[str], at: str, weight: str, part: str, width: int, most_parts: int) -> DataFrame:
    """keys and the window of the width that ends at a row and scores most: its weight times its share of most_parts parts."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-width, 0)
    scored = df.withColumn("mass", F.sum(weight).over(w)).withColumn("parts", F.size(F.collect_set(part).over(w)))
    scored = scored.withColumn("score", F.col("mass") * F.least(F.col("parts"), F.lit(most_parts)) / F.lit(float(most_parts)))
    return scored.groupBy(*keys).agg(F.min_by(F.struct(F.col(at).alias("ends"), "score"), F.struct((-F.col("score")).alias("s"), at)).alias("r")).select(*keys, "r.ends", "r.score")


def peak(df: DataFrame, keys: Sequence[str], at: str, value: str, apart: int) -> DataFrame:
    """keys, the place of the largest value (the first of equals), its value, and the best value further than `apart` from it."""
    top = df.groupBy(*keys).agg(F.min_by(F.struct(F.col(at).alias("at"), F.col(value).alias("top")), F.struct((-F.col(value)).alias("v"), at)).alias("p")).select(*keys, F.col("p.at").alias("__at"), F.col("p.top").alias("__top"))
    other = df.join(top, list(keys)).groupBy(*keys, "__at", "__top").agg(F.max(F.when(F.abs(F.col(at) - F.col("__at")) > apart, F.col(value))).alias("runner_up"))
    return other.select(*keys, F.col("__at").alias("at"), F.col("__top").alias("top"), "runner_up")


def refined_peak(df: DataFrame, keys: Sequence[str], at: str, value: str, apart: int) -> DataFrame:
    """peak() with refined: the place of the parabola through the peak and the rows one before and one after it, half a
    step away at most; the peak's own place where either is missing. One window of a group's rows, so at and value are read once."""
    group = Window.partitionBy(*keys)
    own = df.select(*keys, F.col(at).alias("at"), F.col(value).alias("value"))
    own = own.withColumn("p", F.min_by(F.struct("at", F.col("value").alias("top")), F.struct((-F.col("value")).alias("v"), "at")).over(group))
    away = F.col("at") - F.col("p.at")
    beside = lambda k: F.max(F.when(away == k, F.col("value")))
    per = own.groupBy(*keys).agg(F.first("p").alias("p"), F.max(F.when(F.abs(away) > apart, F.col("value"))).alias("runner_up"), beside(-1).alias("left"), beside(1).alias("right"))
    curve = F.col("left") - 2 * F.col("p.top") + F.col("right")
    step = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("left") - F.col("right")) / F.nullif(curve, F.lit(0.0))))
    return per.select(*keys, "p.at", "p.top", "runner_up", (F.col("p.at") + F.coalesce(F.when(curve < 0, step), F.lit(0.0))).alias("refined"))


def fold_newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], stamp: str, complete: str, tolerance: int) -> DataFrame:
    """One row per key by a pairwise rule that is no order: in arrival order, a row replaces the held one if it is later,
    but between a complete and an open row the open one wins unless it is older by more than the tolerance.

    The rule depends on what is held, so a key's rows are folded in order inside one aggregate expression.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("__o"), *rest)))

    def pick(held, new):
        later = new[stamp] - held[stamp]
        mixed = held[complete] != new[complete]
        better = F.when(mixed, F.when(new[complete], later > tolerance).otherwise(later >= -tolerance)).otherwise(later > 0)
        return F.when(better, new).otherwise(held)

    best = df.groupBy(*keys).agg(rows.alias("__rows")).withColumn("__best", F.aggregate(F.slice("__rows", 2, 1_000_000_000), F.get("__rows", F.lit(0)), pick))
    return best.select(*keys, *(F.col(f"__best.{c}").alias(c) for c in rest))
