"""Alignment of interval time series by activity in bins.

A track's intervals become the set of bins they touch. Two tracks match at an offset as well as their bins do; all
offsets are tried at once on arrays of a pair's bins. A track counts up to TIMELINE_MS, which bounds those arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scores.
LONGEST_MS, COARSE_MS, TIMELINE_MS = 20_000, 500, 8 * 3_600_000
WORD_BINS = 60  # bins of a word, the sign bit left out
# Ratios of 23.976, 24 and 25 frames a second; scales that are likely; how far apart two are; offsets; a partial target.
SCALES = (1.0, 25 / 23.976, 23.976 / 25, 25 / 24, 24 / 25, 24 / 23.976, 23.976 / 24)
SCALE_RANGE, SCALE_APART, OFFSET_MS, PARTIAL = (0.94, 1.06), 0.00035, 180_000, 0.75
PRECISION, RECALL, VISIBLE_BASE, VISIBLE = 0.72, 0.28, 0.85, 0.15


def normalised(cues: DataFrame, track: str = "track") -> DataFrame:
    """Each start, end and text of a track once."""
    return cues.groupBy(track, "start", "end", "text").agg(F.min("ord").alias("ord"))


def activity(cues: DataFrame, width: int = COARSE_MS, track: str = "track") -> DataFrame:
    """track, bin: the bins a track is active in; an interval counts for LONGEST_MS at most."""
    end = F.least(F.col("end"), F.col("start") + LONGEST_MS, F.lit(TIMELINE_MS))
    spans = cues.filter((F.col("end") > F.col("start")) & (F.col("start") < TIMELINE_MS))
    return spans.select(track, F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))).alias("bin")).distinct()


def activity_words(cues: DataFrame, width: int = COARSE_MS, track: str = "track") -> DataFrame:
    """track, word, bits: activity()'s bins, WORD_BINS of them as the bits of one number, so an interval is a row or two."""
    end = F.least(F.col("end"), F.col("start") + LONGEST_MS, F.lit(TIMELINE_MS))
    spans = cues.filter((F.col("end") > F.col("start")) & (F.col("start") < TIMELINE_MS))
    spans = spans.select(track, F.floor(F.col("start") / width).cast("long").alias("a"), F.floor((end - 1) / width).cast("long").alias("z"))
    # sequence() counts down where the last bin is the smaller.
    spans = spans.select(track, F.least("a", "z").alias("a"), F.greatest("a", "z").alias("z"))
    word = lambda c: F.floor(F.col(c) / WORD_BINS).cast("long")
    each = spans.select(track, "a", "z", F.explode(F.sequence(word("a"), word("z"))).alias("word"))
    first, last = F.greatest("a", F.col("word") * WORD_BINS) - F.col("word") * WORD_BINS, F.least("z", F.col("word") * WORD_BINS + WORD_BINS - 1) - F.col("word") * WORD_BINS
    bits = each.select(track, "word", first.alias("first"), last.alias("last")).select(track, "word", F.expr("shiftleft(shiftleft(1L, cast(last - first + 1 as int)) - 1L, cast(first as int))").alias("bits"))
    return bits.groupBy(track, "word").agg(F.bit_or("bits").alias("bits"))


def word_jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """bin_jaccard() of sides whose bins are words of activity_words()."""
    sides = a.select(*keys, "word", F.col("bits").alias("x"), F.lit(0).cast("long").alias("y")).unionByName(b.select(*keys, "word", F.lit(0).cast("long").alias("x"), F.col("bits").alias("y")))
    per = sides.groupBy(*keys, "word").agg(F.bit_or("x").alias("x"), F.bit_or("y").alias("y"))
    n = lambda c: F.sum(F.bit_count(c))
    return per.groupBy(*keys).agg((n(F.col("x").bitwiseAND(F.col("y"))) / n(F.col("x").bitwiseOR(F.col("y")))).alias("jaccard"))


def bin_jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, jaccard of the bins of two sides."""
    both = a.select(*keys, "bin", F.lit(1).alias("x")).unionByName(b.select(*keys, "bin", F.lit(2).alias("x")))
    per = both.groupBy(*keys, "bin").agg(F.sum("x").alias("x"))
    return per.groupBy(*keys).agg((F.count_if(F.col("x") == 3) / F.count("*")).alias("jaccard"))


def activity_score(shared: Column, visible: Column, target: Column, reference: Column) -> Column:
    """Precision among the target's visible bins and recall of the reference, less for a target mostly out of sight."""
    precision = shared / F.nullif(visible, F.lit(0))
    return (PRECISION * precision + RECALL * shared / reference) * (VISIBLE_BASE + VISIBLE * visible / target)


def offset_scores(reference: DataFrame, target: DataFrame, keys: list[str], largest: int) -> DataFrame:
    """keys, offset, shared, score for the offsets (bins) up to largest at which any bin is shared."""
    sides = reference.select(*keys, "bin", F.lit(True).alias("ref")).unionByName(target.select(*keys, "bin", F.lit(False).alias("ref")))
    lists = sides.groupBy(*keys).agg(*(F.collect_list(F.when(F.col("ref") == x, F.col("bin"))).alias(n) for n, x in (("r", True), ("t", False)))).filter((F.size("r") > 0) & (F.size("t") > 0))
    offsets = np.arange(-largest, largest + 1)

    def count(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            rows, found = [], []
            for i, (r, t) in enumerate(zip(b["r"], b["t"], strict=True)):
                r, t = np.asarray(r.values, np.int64), np.sort(np.asarray(t.values, np.int64))
                lo, hi = r.min(), r.max()
                # The reference as a row of marks with room for every offset on both sides; bins beyond it share nothing.
                marks = np.zeros(hi - lo + 1 + 4 * largest, np.int32)
                marks[r - lo + 2 * largest] = 1
                near = t[(t >= lo - largest) & (t <= hi + largest)]
                shared = sum((marks[part[:, None] - lo + 2 * largest + offsets].sum(axis=0) for part in np.array_split(near, len(near) // 8192 + 1)), np.zeros(len(offsets), np.int64))
                visible = np.searchsorted(t, hi - offsets, side="right") - np.searchsorted(t, lo - offsets)
                hit = np.flatnonzero(shared)
                rows.append(np.full(len(hit), i))
                found.append(np.stack([offsets[hit], shared[hit], visible[hit], np.full(len(hit), len(t)), np.full(len(hit), len(r))]))
            numbers = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
            named = table.select(keys).take(pa.array(np.concatenate(rows) if rows else [], pa.int64()))
            for name, column in zip(("offset", "shared", "visible", "t", "r"), numbers, strict=True):
                named = named.append_column(name, pa.array(column, pa.int64()))
            yield from named.combine_chunks().to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lists.select(*keys).schema.fields)
    out = lists.mapInArrow(count, f"{kinds}, offset long, shared long, visible long, t long, r long")
    return out.select(*keys, F.col("offset").cast("int").alias("offset"), "shared", activity_score(F.col("shared"), F.col("visible"), F.col("t"), F.col("r")).alias("score"))


def scale_candidates(reference_span: Column, target_span: Column) -> Column:
    """Scales between frame rates, and the ratio of the spans where it is likely, ascending; near ones count once."""
    ratio = F.when((reference_span > 0) & (target_span > 0), reference_span.cast("double") / target_span)
    likely = F.filter(F.array(*map(F.lit, SCALES), ratio), lambda x: F.coalesce(x.between(*SCALE_RANGE), F.lit(False)))
    add = lambda held, x: F.when(F.exists(held, lambda y: F.abs(y - x) < SCALE_APART), held).otherwise(F.concat(held, F.array(x)))
    return F.aggregate(F.array_sort(likely), F.array().cast("array<double>"), add)


def offset_range(reference: tuple[Column, Column], target: tuple[Column, Column], width: int = COARSE_MS) -> tuple[Column, Column]:
    """The least and the largest offset to try, in bins, of tracks between their first and last active bins: a target that
    covers part of its reference alone may lie anywhere in it."""
    base = OFFSET_MS // width
    whole = (target[1] - target[0]) >= (reference[1] - reference[0]) * PARTIAL
    low, high = F.least(F.lit(-base), reference[0] - target[0] - base), F.greatest(F.lit(base), reference[1] - target[1] + base)
    return F.when(whole, F.lit(-base)).otherwise(low), F.when(whole, F.lit(base)).otherwise(high)


def best_offset(scores: DataFrame, keys: list[str], apart: int) -> DataFrame:
    """keys, offset, score and margin over the best offset more than `apart` away."""
    best = scores.groupBy(*keys).agg(F.min_by(F.struct("offset", "score"), F.struct((-F.round("score", 9)).alias("s"), F.abs("offset").alias("d"), "offset")).alias("b")).select(*keys, F.col("b.offset").alias("best"), F.col("b.score").alias("top"))
    far = scores.join(best, keys).groupBy(*keys, "best", "top").agg(F.max(F.when(F.abs(F.col("offset") - F.col("best")) > apart, F.col("score"))).alias("other"))
    return far.select(*keys, F.col("best").alias("offset"), F.col("top").alias("score"), (F.col("top") - F.coalesce("other", F.lit(0.0))).alias("margin"))


def affine(t: Column, scale: float, intercept: float) -> Column:
    """A stretched and shifted time, rounded half up and not below 0."""
    return F.greatest(F.lit(0), F.floor(t * scale + intercept + 0.5)).cast("long")


def constant_shift(a: DataFrame, b: DataFrame, keys: list[str], within: int = 0) -> DataFrame:
    """keys, shift of pairs of tracks of equal length whose starts and ends all differ by one shift (within a tolerance)."""
    left = a.select(*keys, "ord", F.col("start").alias("s1"), F.col("end").alias("e1"))
    right = b.select(*keys, "ord", F.col("start").alias("s2"), F.col("end").alias("e2"))
    both = left.join(right, [*keys, "ord"], "full")
    d1, d2 = F.col("s2") - F.col("s1"), F.col("e2") - F.col("e1")
    per = both.groupBy(*keys).agg(F.min(F.least(d1, d2)).alias("lo"), F.max(F.greatest(d1, d2)).alias("hi"), F.count_if(d1.isNull()).alias("odd"))
    return per.filter((F.col("odd") == 0) & (F.col("hi") - F.col("lo") <= within)).select(*keys, F.col("lo").alias("shift"))
