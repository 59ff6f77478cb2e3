"""Lookups of points in time series and intervals.

As-of lookups are one sort of both sides together: no range join. Interval lookups deal both sides into bins of fixed
width, so that points meet only the intervals near them; the width should be about that of an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], forward: bool = False, clamp: bool = False) -> DataFrame:
    """left with `found`, the values of the last right row of its key at or before `at` (forward: the first at or after).

    clamp: points before all right rows take the first one. Of right rows at one time, the largest values count.
    """
    r = right.groupBy(*keys, at).agg(F.max(F.struct(F.col(at).alias("at"), *values)).alias("__r"))
    both = left.withColumn("__l", F.struct(*left.columns)).select(*keys, at, "__l").unionByName(r.select(*keys, at, "__r"), allowMissingColumns=True)
    side = F.col("__r").isNull().cast("int")
    w = Window.partitionBy(*keys).orderBy(*((F.col(at).desc(), side) if forward else (F.col(at), side))).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("__r", ignorenulls=True).over(w)
    if clamp:
        found = F.coalesce(found, F.first("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return both.withColumn("found", found).filter("__l is not null").select("__l.*", "found")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, within: int) -> DataFrame:
    """left with `off`, the distance to the nearest right row of its key, null beyond `within`."""
    back = as_of(left, right, keys, at, []).withColumnRenamed("found", "__b")
    both = as_of(back, right, keys, at, [], forward=True)
    off = F.least(F.col(at) - F.col("__b.at"), F.col("found.at") - F.col(at))
    return both.select(*left.columns, F.when(off <= within, off).alias("off"))


def _bins(start: Column, end: Column, width: int) -> Column:
    """Bins that [start, end) touches."""
    return F.sequence(F.floor(start / width), F.greatest(F.floor((end - 1) / width), F.floor(start / width)))


def points_in(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of a point and a half-open span [start, end) of its key that holds it. Empty spans hold none."""
    p = points.withColumn("__bin", F.floor(F.col(at) / width))
    s = spans.filter(F.col(end) > F.col(start)).withColumn("__bin", F.explode(_bins(F.col(start), F.col(end), width)))
    return p.join(s, [*keys, "__bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], l: tuple[str, str], r: tuple[str, str], width: int) -> DataFrame:
    """Pairs of overlapping half-open spans of a key, each once: they meet in the bin of the later start."""
    a = left.withColumn("__bin", F.explode(_bins(F.col(l[0]), F.col(l[1]), width)))
    b = right.withColumn("__bin", F.explode(_bins(F.col(r[0]), F.col(r[1]), width)))
    both = a.join(b, [*keys, "__bin"]).filter((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])))
    return both.filter(F.col("__bin") == F.floor(F.greatest(l[0], r[0]) / width)).drop("__bin")


def trimmed_at(spans: DataFrame, marks: DataFrame, keys: Sequence[str], start: str, end: str, mark: str, width: int) -> DataFrame:
    """Spans cut at the first mark inside them; those left empty go."""
    named = spans.withColumn("__n", F.struct(start, end))
    hits = points_in(marks.select(*keys, mark), named.select(*keys, start, end), keys, mark, start, end, width).groupBy(*keys, start, end).agg(F.min(mark).alias("__cut"))
    cut = spans.join(hits, [*keys, start, end], "left").withColumn(end, F.coalesce("__cut", end)).drop("__cut")
    return cut.filter(F.col(end) > F.col(start)).select(*spans.columns)


def one_per_category(spans: DataFrame, keys: Sequence[str], category: str, priority: str, order: Sequence[str]) -> DataFrame:
    """The span of the best priority for each category."""
    rest = [c for c in spans.columns if c not in (*keys, category)]
    best = spans.groupBy(*keys, category).agg(F.min_by(F.struct(*rest), F.struct(priority, *order)).alias("__s"))
    return best.select(*keys, category, *(F.col(f"__s.{c}").alias(c) for c in rest))
