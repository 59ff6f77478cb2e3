"""Filter, rank and quota selection of candidate rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.patterns import compiles

GB = 1024**3


@dataclass(frozen=True)
class Wanted:
    """Required and excluded values of a fact; an empty list asks nothing."""

    required: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def _listed(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def preference_filter(scalars: dict[str, Wanted], labels: dict[str, Wanted], languages: tuple[str, Wanted] | None = None, group: tuple[str, Wanted] | None = None, size: tuple[str, float, float] | None = None) -> Column:
    """All clauses at once. Excluded languages reject only where all of a row's languages are excluded; a null size passes."""
    out = F.lit(True)
    for c, w in scalars.items():
        if w.required:
            out = out & F.coalesce(F.col(c).isin(w.required), F.lit(False))
        if w.excluded:
            out = out & ~F.coalesce(F.col(c).isin(w.excluded), F.lit(False))
    for c, w in labels.items():
        have = F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>")))
        if w.required:
            out = out & F.arrays_overlap(have, _listed(w.required))
        if w.excluded:
            out = out & ~F.arrays_overlap(have, _listed(w.excluded))
    if languages:
        have = F.array_compact(F.coalesce(F.col(languages[0]), F.array().cast("array<string>")))
        if languages[1].required:
            out = out & F.arrays_overlap(have, _listed(languages[1].required))
        if languages[1].excluded:
            out = out & ~((F.size(have) > 0) & F.forall(have, lambda x: x.isin(languages[1].excluded)))
    if group:
        name = F.lower(F.coalesce(F.col(group[0]), F.lit("")))
        if group[1].required:
            out = out & name.isin([x.lower() for x in group[1].required])
        if group[1].excluded:
            out = out & ~name.isin([x.lower() for x in group[1].excluded])
    if size:
        c, least, most = size
        if least > 0:
            out = out & F.coalesce(F.col(c) >= least * GB, F.lit(True))
        if most > 0:
            out = out & F.coalesce(F.col(c) <= most * GB, F.lit(True))
    return out


def criteria_order(criteria: Sequence[tuple[str, str]], ord_: Sequence[str]) -> list[Column]:
    """Sort keys of (key, ASC or DESC): DESC puts the best rank first; size is a number, null as 0; the group ignores direction."""
    out = []
    for key, direction in criteria:
        if key == "group":
            out.append(F.lower(F.coalesce(F.col(key), F.lit(""))).asc())
        elif key == "size":
            c = F.coalesce(F.col(key), F.lit(0))
            out.append(c.asc() if direction == "ASC" else c.desc())
        else:
            out.append(F.col(key).desc() if direction == "ASC" else F.col(key).asc())
    return [*out, *(F.col(c).asc() for c in ord_)]


def quota(df: DataFrame, keys: Sequence[str], per: str, order: Sequence[Column], n: int, total: int = 0) -> DataFrame:
    """The first n rows of each value of `per` within keys, and of those the first `total` (0: all)."""
    w = Window.partitionBy(*keys, per).orderBy(*order)
    kept = df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")
    if total:
        w = Window.partitionBy(*keys).orderBy(*order)
        kept = kept.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= total).drop("__rank")
    return kept


def two_quotas(df: DataFrame, keys: Sequence[str], first: tuple[str, int], second: tuple[str, int], order: str, total: int = 0) -> DataFrame:
    """Greedy in order: a row is kept if neither of its two values is full; one that is not kept fills neither.

    This depends on every row before, so it runs per key; only rows that could be kept are sent there: at most as many
    of each pair of values as the smaller quota.
    """
    (a, na), (b, nb) = first, second
    w = Window.partitionBy(*keys, a, b).orderBy(order)
    small = df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= min(na, nb)).drop("__rank")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows, held, keep = rows.sort_values(order), {}, []
        for x, y in zip(rows[a], rows[b], strict=True):
            ok = held.get(("a", x), 0) < na and held.get(("b", y), 0) < nb and not (total and sum(keep) >= total)
            keep.append(ok)
            if ok:
                held["a", x], held["b", y] = held.get(("a", x), 0) + 1, held.get(("b", y), 0) + 1
        return rows[keep]

    return small.groupBy(*keys).applyInPandas(greedy, df.schema)


def connection_fit(size: Column, minutes: Column, mbps: Column) -> tuple[Column, Column]:
    """(bucket, bitrate): 0 fits with half as much again to spare, 1 unknown, 2 exceeds.

    A bitrate is plausible between 0.2 and 200 for files of 50 MiB and runtimes of 10 to 600 minutes.
    """
    rate = size * 8.0 / (minutes * 60.0) / 1_000_000.0
    rate = F.when(minutes.between(10, 600) & (size >= 50 * 1024 * 1024) & rate.between(0.2, 200.0), rate)
    return F.when(rate.isNull(), 1).when(rate * 1.5 > mbps, 2).otherwise(0), rate


def badges(df: DataFrame, text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names of the rules, in order and each once, whose pattern is found. Rules are part of the plan: no join, no cross product."""
    fine = [(name, pattern) for name, pattern in rules if compiles(f"(?i){pattern}")]
    return F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in fine)))) if fine else F.array().cast("array<string>")
