"""Ordered primitives: which row of a key counts is always fixed by an explicit total order.

Lists in an application have an order that tables lack. Every operator here takes it as columns, and ends ties with
them, so that the result does not depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str | Column]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_by(df: DataFrame, keys: Sequence[str], order: Cols) -> DataFrame:
    """The first row of each key: partial aggregation of one struct, so a hot key costs a row per task.

    order holds ascending columns; give descending ones negated. Nulls come first, as in an ascending sort.
    """
    return _extreme(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: Sequence[str], order: Cols) -> DataFrame:
    """The last row of each key."""
    return _extreme(df, keys, order, F.max_by)


def _extreme(df: DataFrame, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*(_col(c).alias(f"o{i}") for i, c in enumerate(order)))).alias("__row"))
    return picked.select(*(F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns))


def ranked(df: DataFrame, keys: Sequence[str], order: Cols, name: str = "rank") -> DataFrame:
    """1-based place of each row within its key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*map(_col, order))))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Cols, n: int) -> DataFrame:
    """The first n rows of each key. Spark turns the rank filter into a group limit below the shuffle."""
    return ranked(df, keys, order, "__rank").filter(F.col("__rank") <= n).drop("__rank")


def take_while(df: DataFrame, keys: Sequence[str], order: Cols, keep: Column) -> DataFrame:
    """The rows of each key before the first that fails."""
    w = Window.partitionBy(*keys).orderBy(*map(_col, order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__ok", F.min(F.coalesce(keep, F.lit(False)).cast("int")).over(w)).filter("__ok = 1").drop("__ok")


def chunked(df: DataFrame, keys: Sequence[str], order: Cols, size: int) -> DataFrame:
    """chunk: the 0-based number of the fixed-size batch each row falls into."""
    return ranked(df, keys, order, "__rank").withColumn("chunk", F.floor((F.col("__rank") - 1) / size)).drop("__rank")


def distinct_until_changed(df: DataFrame, keys: Sequence[str], order: Cols, value: str) -> DataFrame:
    """Rows whose value differs from that of the row before; null equals null."""
    w = Window.partitionBy(*keys).orderBy(*map(_col, order))
    return df.withColumn("__first", F.row_number().over(w)).withColumn("__was", F.lag(value).over(w)).filter((F.col("__first") == 1) | ~F.col(value).eqNullSafe(F.col("__was"))).drop("__first", "__was")


def round_robin(df: DataFrame, source: str, order: Cols, cap: int) -> DataFrame:
    """Rows interleaved round by round over sources, in order of source; place is 1-based.

    Whole rounds are taken until cap is reached, and the last may pass it only by finishing its round.
    """
    rows = ranked(df, [source], order, "round").filter(F.col("round") <= cap)  # each round before the last has a row at least
    per_round = rows.groupBy("round").agg(F.count("*").alias("n"))  # a row per round, summed below the shuffle
    before = per_round.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = rows.join(before.filter(F.col("before") < cap).select("round", "before"), "round")
    within = Window.partitionBy("round").orderBy(source)
    return kept.withColumn("place", F.col("before") + F.row_number().over(within)).drop("before")


def pinned_first(df: DataFrame, keys: Sequence[str], pinned: str, order: Cols) -> DataFrame:
    """place: 0-based, pinned rows first, each part in order."""
    w = Window.partitionBy(*keys).orderBy(F.col(pinned).desc(), *map(_col, order))
    return df.withColumn("place", F.row_number().over(w) - 1)
