"""Fits of one timeline to another: how good one is, which of two holds, which references nobody confirms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a confident fit, of two fits that agree, of references that can be judged; weights of the score.
MATCHED, COVERAGE, COST, SKIPPED, APART_MS, SOURCES = 20, 0.84, 2.35, 12, 300.0, 3
TARGET_SHARE, REFERENCE_SHARE, COST_SHARE, SIMPLE_SHARE, RUN_PENALTY, RUN_COUNTED, SDH_PENALTY = 0.42, 0.15, 0.23, 0.20, 0.004, 20, 0.010
SHAPES = ("1:1", "1:2", "2:1", "1:3", "3:1", "2:2")


def fit_quality(groups: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, target_coverage, reference_coverage, skipped_target, skipped_reference, skip_run, cost, shapes, residual, confident.

    groups: keys, target_start (index), target_n, reference_n, cost, residual, in order of target_start without overlap;
    sizes: keys, target_size, reference_size. shapes counts the six kinds; residual is the upper median.
    """
    ordered = Window.partitionBy(*keys).orderBy("target_start")
    gap = F.col("target_start") - F.coalesce(F.lag(F.col("target_start") + F.col("target_n")).over(ordered), F.lit(0))
    shape = F.concat_ws(":", F.col("reference_n").cast("string"), F.col("target_n").cast("string"))
    per = groups.withColumn("gap", gap).groupBy(*keys).agg(
        F.sum("target_n").alias("t"), F.sum("reference_n").alias("r"), F.max("gap").alias("gap"), F.max(F.col("target_start") + F.col("target_n")).alias("end"),
        F.avg("cost").alias("cost"), F.array(*(F.count_if(shape == s) for s in SHAPES)).alias("shapes"), F.sort_array(F.collect_list(F.abs("residual"))).alias("all"),
    )
    both = per.join(sizes, keys).withColumn("skip_run", F.greatest("gap", F.col("target_size") - F.col("end")))
    share = F.col("t") / F.col("target_size")
    fine = (F.col("t") >= F.least(F.lit(MATCHED), "target_size")) & (share >= COVERAGE) & (F.col("cost") <= COST) & (F.col("skip_run") <= SKIPPED)
    return both.select(
        *keys, share.alias("target_coverage"), (F.col("r") / F.col("reference_size")).alias("reference_coverage"), (F.col("target_size") - F.col("t")).alias("skipped_target"),
        (F.col("reference_size") - F.col("r")).alias("skipped_reference"), "skip_run", "cost", "shapes", F.get("all", F.floor(F.size("all") / 2).cast("int")).alias("residual"), fine.alias("confident"),
    )


def fit_score(target: Column, reference: Column, cost: Column, simple: Column, skip_run: Column, sdh: Column) -> Column:
    """A fit's score by coverage, cost and the share of simple groups, less for a long run of skipped cues and for SDH references."""
    whole = target * TARGET_SHARE + reference * REFERENCE_SHARE + COST_SHARE / (F.greatest(cost, F.lit(0.0)) + 1) + simple * SIMPLE_SHARE
    return whole - F.least(skip_run, F.lit(RUN_COUNTED)) * RUN_PENALTY - F.when(sdh, SDH_PENALTY).otherwise(0.0)


def tighter_fit(a: dict[str, Column], b: dict[str, Column], first: Column, last: Column) -> Column:
    """Whether a holds against b: both confident and apart somewhere on the target, the smaller residual does; null where that decides nothing.

    a, b: confident, scale, intercept, residual; first, last: the target's first and last start.
    """
    gap = lambda t: F.abs((a["scale"] - b["scale"]) * t + a["intercept"] - b["intercept"])
    open_ = a["confident"] & b["confident"] & (F.greatest(gap(first), gap(last)) > APART_MS) & (a["residual"] != b["residual"])
    return F.when(open_, a["residual"] < b["residual"])


def outlier_references(sources: DataFrame, agreements: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """keys, source of those that no other source confirms while two others confirm each other; of three sources or more.

    agreements: keys, a, b, a pair once or both ways. Every source is judged, however many there are.
    """
    pairs = agreements.filter("a <> b")
    counts = sources.groupBy(*keys).agg(F.countDistinct(source).alias("n")).filter(F.col("n") >= SOURCES)
    judged = counts.join(pairs.select(*keys).distinct(), keys, "left_semi").select(*keys)
    confirmed = pairs.select(*keys, F.explode(F.array("a", "b")).alias(source)).distinct()
    return sources.select(*keys, source).distinct().join(judged, keys, "left_semi").join(confirmed, [*keys, source], "left_anti")
