"""Retiming: the cues of one track are grouped with those of a reference and moved onto its times.

A seed (scale and intercept) brings the target near the reference. Groups of up to three cues on either side are then
matched by a dynamic program over a band of BAND reference cues around each target cue's expected place; a pair of tracks
is one row of arrays, as its cues bound them. All that follows from the groups is joins and windows over the cues of a
pair: shifts, outliers among neighbouring groups, order, overlaps, late replies, quality and the verdict.

Tracks are tables of keys, ord, start, end (milliseconds; of a reference also estimated, true where a cue's end is
inferred). Cues count in order of start and ord. Tracks of fewer than LEAST cues and seeds beyond SEED_SCALE give no
rows; cues with a null start or end are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.operators import fits as Q
from reelforge.operators import search as S
from reelforge.operators.align import affine
from reelforge.settled import settled
from reelforge.shipping import ship

# Sizes, costs and weights of the matching.
LEAST, BAND, SEED_SCALE = 4, 28, (0.85, 1.15)
AT_ONCE = 50_000  # target cues of the pairs that are matched together
SKIP_REFERENCE, SKIP_TARGET, COMPLEXITY, LARGEST = 1.35, 1.85, 0.10, 8.0
EDGE_MS, MIDDLE_MS, DURATION_MS = 1250.0, 1500.0, 2000.0
WEIGHTS, ESTIMATED_WEIGHTS = (0.34, 0.34, 0.18, 0.14), (0.58, 0.16, 0.16, 0.10)
# Shifts of neighbouring groups; late replies; thirds of a track; segmentation.
NEIGHBOURS, DEVIATION_MS = 3, 250
REPLY_GAP_MS, REPLY_EARLY_MS, REPLY_LATE_MS, REPLY_EDGE_MS, REPLY_SUPPORT_MS, REPLY_LEFT_MS = 500, 250, 1250, 200, 500, 800
THIRD_COVERAGE, THIRD_COST, THIRD_GROUPS = 0.72, 1.35, 4
IMBALANCE, ENOUGH_COVERAGE = 1.60, 0.80
# Limits of a discovered result: usual ones, and those of tracks of fewer than FEW cues.
FEW, SCORE, FEW_SCORE, MARGIN, FEW_MARGIN, THIRDS, FEW_THIRDS = 8, 0.55, 0.72, 0.02, 0.03, 3, 2
COVERAGE, COST, SIMPLE = 0.90, 1.10, 0.55

#: What may end at a cell, in the order in which it is tried: (target cues, reference cues).
STEPS = ((3, 1), (2, 2), (2, 1), (1, 3), (1, 2), (1, 1), (1, 0))


def _costs(r0: np.ndarray, r1: np.ndarray, odd: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """Costs of groups from r0 to r1 of the reference, odd where an end is estimated, and from t0 to t1 of the target."""
    edges = np.abs(r0 - t0) / EDGE_MS, np.abs(r1 - t1) / EDGE_MS
    middle = np.abs((r0 + r1) * 0.5 - (t0 + t1) * 0.5) / MIDDLE_MS
    duration = np.abs(np.maximum(1.0, r1 - r0) - np.maximum(1.0, t1 - t0)) / DURATION_MS
    cost = lambda w: edges[0] * w[0] + edges[1] * w[1] + middle * w[2] + duration * w[3]
    return np.where(odd, cost(ESTIMATED_WEIGHTS), cost(WEIGHTS))


def matched_groups(starts, ends, estimated, t_starts, t_ends, band: int = BAND):
    """Columns reference_start, reference_n, target_start, target_n, cost of the cheapest path's groups; times of the target are transformed."""
    return matched_pairs([(starts, ends, estimated, t_starts, t_ends)], band)[0]


def matched_pairs(pairs, band: int = BAND) -> list[list[tuple[int, int, int, int, float]]]:
    """matched_groups() of several pairs at once: a row of the program is a row of cells of each pair, longest targets first.

    Of the program only what ended at each cell is kept, a byte a cell; the costs of the groups on the path are worked out again.
    """
    out: list = [[] for _ in pairs]
    turn = sorted(range(len(pairs)), key=lambda k: -len(pairs[k][3]))
    own = [pairs[k] for k in turn]
    m, n = (np.array([len(p[i]) for p in own]) for i in (0, 3))
    # Tracks one after another in flat arrays; of a cue beyond a track's end nothing is used.
    at_r, at_t, flat = np.append(0, np.cumsum(m))[:-1], np.append(0, np.cumsum(n))[:-1], [np.concatenate([np.asarray(p[i], np.float64) for p in own]) for i in (0, 1, 3, 4)]
    counts = np.concatenate([np.append(0, np.cumsum(p[2])) for p in own])  # of estimated ends; a track has one more than cues
    at_c = at_r + np.arange(len(own))
    low, size = np.zeros((len(own), n[0] + 1), np.int64), np.zeros((len(own), n[0] + 1), np.int64)
    for k, (starts, _, _, t_starts, t_ends) in enumerate(own):
        centre = np.searchsorted(starts, np.maximum(0, np.floor(np.append(t_starts, t_ends[-1]) + 0.5)))
        first = np.maximum(0, centre - band)
        first[0] = 0
        low[k, : n[k] + 1], size[k, : n[k] + 1] = first, np.minimum(m[k], centre + band) - first + 1
    rows, hows, last = [], [], np.zeros(len(own), np.int64)
    reference = lambda i, k: flat[i][np.minimum(at_r[:k, None] + cols[i], len(flat[i]) - 1)]
    for t in range(n[0] + 1):
        k = int(np.searchsorted(-n, -t, side="right"))  # pairs whose target is long enough
        lo, wide = low[:k, t, None], size[:k, t, None]
        width = int(wide.max())  # the band's; of row 0 all that lies before it too
        cells = np.arange(width)
        here, inside = lo + cells, cells < wide
        best, how = np.full((k, width), np.inf), np.full((k, width), -1, np.int8)
        if t == 0:
            best[:, 0] = 0.0
        for step, (b, a) in enumerate(STEPS):
            if b > t:
                continue
            # Cells whose group begins at a cell of row t - b.
            back = here - a - low[:k, t - b, None]
            known = inside & (back >= 0) & (back < size[:k, t - b, None])
            if not known.any():
                continue
            come = np.where(known, np.take_along_axis(rows[-b][:k], np.clip(back, 0, rows[-b].shape[1] - 1), axis=1), np.inf)
            if a:
                i = np.clip(here - a, 0, m[:k, None] - 1)
                cols = (i, np.minimum(i + a - 1, m[:k, None] - 1))
                c = at_c[:k, None]
                odd = counts[c + np.minimum(i + a, m[:k, None])] != counts[c + i]
                j = at_t[:k] + t - b
                cost = _costs(reference(0, k), reference(1, k), odd, flat[2][j][:, None], flat[3][j + b - 1][:, None])
                come = np.where(cost <= LARGEST, come + cost + COMPLEXITY * (a + b - 2), np.inf)
            else:
                come = come + SKIP_TARGET
            better = come + 1e-9 < best
            best, how = np.where(better, come, best), np.where(better, np.int8(step), how)
        for r in range(1, width):
            skip = best[:, r - 1] + SKIP_REFERENCE
            fewer = (skip + 1e-9 < best[:, r]) & inside[:, r]
            best[fewer, r], how[fewer, r] = skip[fewer], len(STEPS)
        rows = [*rows[-2:], best]
        hows.append(how)
        for x in np.flatnonzero(n[:k] == t):
            end = best[x, : size[x, t]]
            last[x] = low[x, t] + end.argmin() if np.isfinite(end.min()) else -1
    for x, k in enumerate(turn):
        found, t, r = [], int(n[x]), int(last[x])
        while r >= 0 and (t or r):
            step = hows[t][x, r - low[x, t]]
            b, a = STEPS[step] if step < len(STEPS) else (0, 1)
            if a and b:
                found.append((r - a, a, t - b, b))
            t, r = t - b, r - a
        out[k] = _with_costs(own[x], found[::-1])
    return out


def _with_costs(pair, groups: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    if not groups:
        return []
    starts, ends, estimated, t_starts, t_ends = (np.asarray(x) for x in pair)
    i, a, j, b = np.array(groups).T
    counts = np.append(0, np.cumsum(estimated))
    costs = _costs(starts[i], ends[i + a - 1], counts[i + a] != counts[i], t_starts[j], t_ends[j + b - 1])
    return [(*g, c) for g, c in zip(groups, costs.tolist(), strict=True)]


def numbered(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cues with idx, their place in the track from 0."""
    own = cues.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    return own.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "ord")) - 1)


def cue_groups(reference: DataFrame, target: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, reference_start, reference_n, target_start, target_n, cost: the matched groups of each pair of numbered tracks."""
    ship(reference.sparkSession)
    side = lambda df, more: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "start", "end", *more))).alias("c"))
    listed = lambda df, names, more=(): side(df, more).select(*keys, *(F.col(f"c.{n}").alias(f"{names}_{n}") for n in ("start", "end", *more)))
    pairs = listed(reference, "r", ("estimated",)).join(listed(target, "t"), [*keys]).join(seeds, [*keys])
    pairs = pairs.filter((F.size("r_start") >= LEAST) & (F.size("t_start") >= LEAST) & F.col("scale").between(*SEED_SCALE) & (F.abs("intercept") < F.lit(float("inf"))))

    def match(batches):
        # Pairs of so many cells at a time that what is held does not grow with a batch.
        for b in (whole.slice(i, n) for whole in batches for i, n in _runs(whole["t_start"])):
            one = lambda name, i, kind=np.float64: np.asarray(b[name][i].values.to_numpy(zero_copy_only=False), kind)  # noqa: B023, E731
            pairs = []
            for i in range(len(b)):
                scale, intercept = b["scale"][i].as_py(), b["intercept"][i].as_py()
                pairs.append((one("r_start", i), one("r_end", i), one("r_estimated", i, np.int64), one("t_start", i) * scale + intercept, one("t_end", i) * scale + intercept))
            per = matched_pairs(pairs)
            found, at = [g for x in per for g in x], [i for i, x in enumerate(per) for _ in x]
            named = pa.Table.from_batches([b]).select(list(keys)).take(pa.array(at, pa.int64()))
            for c, (name, kind) in enumerate(GROUP_COLUMNS):
                named = named.append_column(name, pa.array([g[c] for g in found], kind))
            yield from named.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields)
    columns = [*keys, "r_start", "r_end", "r_estimated", "t_start", "t_end", F.col("scale").cast("double"), F.col("intercept").cast("double")]
    return pairs.select(*columns).mapInArrow(match, f"{kinds}, reference_start int, reference_n int, target_start int, target_n int, cost double")


def _runs(lists: pa.ListArray) -> list[tuple[int, int]]:
    """(first, number) of runs of rows whose longest list times their number stays within AT_ONCE cues."""
    out, first, longest = [], 0, 0
    for i, x in enumerate(pc.list_value_length(lists).to_pylist()):
        longest = max(longest, x)
        if i > first and longest * (i + 1 - first) > AT_ONCE:
            out.append((first, i - first))
            first, longest = i, x
    return [*out, (first, len(lists) - first)] if len(lists) else []


GROUP_COLUMNS = (("reference_start", pa.int32()), ("reference_n", pa.int32()), ("target_start", pa.int32()), ("target_n", pa.int32()), ("cost", pa.float64()))


def _moved(time: Column) -> Column:
    return affine(time, F.col("scale"), F.col("intercept"))


def shifted_groups(groups: DataFrame, reference: DataFrame, target: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """groups with residual (what a group's start still lacks), own (its shift) and shift: own, or the median of the
    groups around it where it is further than DEVIATION_MS from that."""
    r = reference.select(*keys, F.col("idx").alias("reference_start"), F.col("start").alias("r_start"))
    t = target.select(*keys, F.col("idx").alias("target_start"), F.col("start").alias("t_start"))
    both = groups.join(r, [*keys, "reference_start"]).join(t, [*keys, "target_start"]).join(seeds, [*keys])
    both = both.withColumn("residual", F.abs(F.col("r_start") - (F.col("t_start") * F.col("scale") + F.col("intercept")))).withColumn("own", F.col("r_start") - _moved(F.col("t_start")))
    pair = Window.partitionBy(*keys)
    around = F.sort_array(F.collect_list("own").over(pair.orderBy("target_start").rowsBetween(-NEIGHBOURS, NEIGHBOURS)))
    median = F.get(around, F.floor(F.size(around) / 2).cast("int"))
    few = F.count("*").over(pair) < 2 * NEIGHBOURS + 1
    shift = F.when(few | (F.abs(F.col("own") - median) <= DEVIATION_MS), F.col("own")).otherwise(median)
    return both.withColumn("shift", shift).drop("r_start", "t_start", "scale", "intercept")


def retimed_cues(target: DataFrame, shifted: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with new_start, new_end: groups are moved as a whole, what is unmatched by the seed alone; starts never fall, and cues that did not overlap do not."""
    last = F.col("target_start") + F.col("target_n") - 1
    of = shifted.select(*keys, "shift", F.explode(F.sequence("target_start", last)).alias("idx"))
    in_order = Window.partitionBy(*keys).orderBy("idx")
    base, end = _moved(F.col("start")), F.greatest(_moved(F.col("end")), _moved(F.col("start")) + 1)
    moved = target.join(seeds, [*keys]).join(of, [*keys, "idx"], "left")
    moved = moved.withColumn("s", F.when(F.col("shift").isNull(), base).otherwise(F.greatest(F.lit(0), base + F.col("shift"))))
    moved = moved.withColumn("e", F.when(F.col("shift").isNull(), end).otherwise(F.col("s") + end - base))
    moved = moved.withColumn("s", F.max("s").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    moved = moved.withColumn("e", F.greatest("e", F.col("s") + 1))
    following, apart = F.lead("s").over(in_order), F.col("end") <= F.lead("start").over(in_order)
    cut = apart & (F.col("e") > following) & (following > F.col("s"))
    return moved.select(*target.columns, F.col("s").alias("new_start"), F.when(cut, following).otherwise(F.col("e")).alias("new_end"))


def fit(shifted: DataFrame, reference: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """fit_quality of the groups with thirds (passed thirds of the target), simple (share of simple groups), target_size, reference_size."""
    size = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = size(reference, "reference_size").join(size(target, "target_size"), [*keys])
    quality = Q.fit_quality(shifted, sizes, keys)
    # A group belongs to the third of its middle cue, each of its cues to the cue's own.
    parts = shifted.join(sizes, [*keys])
    n = F.col("target_size")
    edge = lambda k: F.floor(k * n / 3)
    third = F.least(F.floor((F.col("target_start") + F.floor((F.col("target_n") - 1) / 2)) * 3 / n), F.lit(2))
    stop = F.col("target_start") + F.col("target_n")
    inside = lambda k: F.sum(F.greatest(F.lit(0), F.least(stop, edge(k + 1)) - F.greatest("target_start", edge(k))))
    per = parts.groupBy(*keys, "target_size").agg(
        *(inside(k).alias(f"in{k}") for k in range(3)), *(F.avg(F.when(third == k, F.col("cost"))).alias(f"cost{k}") for k in range(3)), *(F.count_if(third == k).alias(f"n{k}") for k in range(3)),
    )
    length = lambda k: F.greatest(F.lit(1), edge(k + 1) - edge(k))
    passed = F.lit(0)
    for k in range(3):
        good = (F.col(f"in{k}") / length(k) >= THIRD_COVERAGE) & F.coalesce(F.col(f"cost{k}") <= THIRD_COST, F.lit(False)) & (F.col(f"n{k}") >= F.least(F.lit(THIRD_GROUPS), length(k)))
        passed = passed + good.cast("int")
    both = quality.join(per.select(*keys, passed.alias("thirds")), [*keys]).join(sizes, [*keys])
    count = lambda shape: F.get("shapes", F.lit(Q.SHAPES.index(shape)))
    enough = (F.col("target_coverage") >= ENOUGH_COVERAGE) & (F.col("reference_coverage") >= ENOUGH_COVERAGE)
    simple = count("1:1") + count("1:2") + count("2:1") + count("2:2")
    simple = simple + F.when(enough & (F.col("reference_size") / F.col("target_size") >= IMBALANCE), count("3:1")).otherwise(0)
    simple = simple + F.when(enough & (F.col("target_size") / F.col("reference_size") >= IMBALANCE), count("1:3")).otherwise(0)
    every = F.aggregate("shapes", F.lit(0).cast("long"), lambda x, y: x + y)
    return both.withColumn("simple", simple / every)


def rejections(fits: DataFrame, relaxed: Column | None = None) -> DataFrame:
    """fits (of fit(), with score and margin of the search) with reasons, an array of what speaks against a discovered result, and accepted.

    relaxed: where a margin too small is no reason. One long run of skipped cues alone is none either, if all else is well.
    """
    few, n = F.col("target_size") < FEW, F.col("target_size")
    text = lambda x: (F.floor(x * 1000 + 0.5) / 1000).cast("string")
    matched = n - F.col("skipped_target")
    least = F.least(F.lit(Q.MATCHED), n)
    own = [
        F.when(matched < least, F.concat(F.lit("matchedTarget="), matched.cast("string"), F.lit("<"), least.cast("string"))),
        F.when(F.col("target_coverage") < Q.COVERAGE, F.concat(F.lit("targetCoverage="), text(F.col("target_coverage")), F.lit(f"<{Q.COVERAGE}"))),
        F.when(F.col("cost") > Q.COST, F.concat(F.lit("avgGroupCost="), text(F.col("cost")), F.lit(f">{Q.COST}"))),
        F.when((F.col("skip_run") > Q.SKIPPED), F.concat(F.lit("targetSkipRun="), F.col("skip_run").cast("string"), F.lit(f">{Q.SKIPPED}"))),
    ]
    run_only = (F.col("skip_run") > Q.SKIPPED) & own[0].isNull() & own[1].isNull() & own[2].isNull()
    below = lambda name, value, limit: F.when(value < limit, F.concat(F.lit(f"{name}="), text(value) if name != "coverageSegments" else value.cast("string"), F.lit("<"), limit.cast("string")))
    by_size = lambda small, usual: F.when(few, small).otherwise(usual)
    margin = below("activityMargin", F.col("margin"), by_size(FEW_MARGIN, MARGIN))
    found = [
        below("activityScore", F.col("score"), by_size(FEW_SCORE, SCORE)),
        margin if relaxed is None else F.when(~relaxed, margin),
        below("coverageSegments", F.col("thirds"), by_size(FEW_THIRDS, THIRDS)),
        below("targetCoverage", F.col("target_coverage"), F.lit(COVERAGE)),
        F.when(F.col("cost") > COST, F.concat(F.lit("avgGroupCost="), text(F.col("cost")), F.lit(f">{COST}"))),
        below("simpleRatio", F.col("simple"), F.lit(SIMPLE)),
    ]
    joined = F.array_distinct(F.filter(F.array(*(F.when(~run_only, x) for x in own), *found), lambda x: x.isNotNull()))
    return fits.withColumn("reasons", joined).withColumn("accepted", F.size("reasons") == 0).withColumn("run_ignored", F.col("accepted") & run_only)


def late_replies(retimed: DataFrame, shifted: DataFrame, reference: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """retimed with the start of a group's second cue moved to its reference's where two cues answer two, the reference has
    a clear gap between them, and the nearest simple groups on both sides agree with the group's shift.

    For pairs whose result is accepted.
    """
    in_order, by_group = Window.partitionBy(*keys).orderBy("idx"), Window.partitionBy(*keys).orderBy("target_start")
    cue = lambda k: F.lead(F.struct("start", "end"), k).over(in_order) if k >= 0 else F.lag(F.struct("start", "end"), -k).over(in_order)
    valid = lambda c: (c["start"] >= 0) & (c["end"] > c["start"])
    r = reference.select(*keys, F.col("idx").alias("reference_start"), F.col("start").alias("r1s"), F.col("end").alias("r1e"), cue(1).alias("r2"), (F.col("estimated") | F.lead("estimated").over(in_order)).alias("inferred"), F.array(cue(-2), cue(-1), cue(2), cue(3)).alias("near"))
    t = target.select(*keys, F.col("idx").alias("target_start"), F.col("start").alias("t1s"), F.col("end").alias("t1e"), F.lag("end").over(in_order).alias("before"), cue(1).alias("t2"), F.lead("start", 2).over(in_order).alias("after"))
    out = retimed.select(*keys, F.col("idx").alias("target_start"), F.col("new_start").alias("o1s"), F.col("new_end").alias("o1e"), F.lead(F.struct(F.col("new_start").alias("start"), F.col("new_end").alias("end"))).over(in_order).alias("o2"), F.lead("new_start", 2).over(in_order).alias("next"))
    g = shifted.join(r, [*keys, "reference_start"]).join(t, [*keys, "target_start"]).join(out, [*keys, "target_start"])
    fine = lambda s, e: (F.col(s) >= 0) & (F.col(e) > F.col(s))
    single = (F.col("reference_n") == 1) & (F.col("target_n") == 1) & fine("r1s", "r1e") & fine("t1s", "t1e")
    g = g.withColumn("single", F.when(single, F.col("own")))
    support = lambda f: F.abs(F.coalesce(f("single", 1).over(by_group), f("single", 2).over(by_group)) - F.col("own")) <= REPLY_SUPPORT_MS
    g = g.withColumn("supported", support(F.lag) & support(F.lead))
    r2, t2, o2 = F.col("r2"), F.col("t2"), F.col("o2")
    clear = ~F.exists("near", lambda c: c.isNotNull() & (~valid(c) | ((c["start"] < r2["start"]) & (c["end"] > F.col("r1e"))) | (F.abs(c["start"] - r2["start"]) <= REPLY_EDGE_MS)))
    gap = (F.col("r1s") < r2["start"]) & (r2["start"] - F.col("r1e") >= REPLY_GAP_MS) & clear & ~F.col("inferred")
    plain = (F.col("t1s") < t2["start"]) & (F.col("t1e") <= t2["start"]) & F.coalesce(F.col("before") <= F.col("t1s"), F.lit(True)) & F.coalesce(t2["end"] <= F.col("after"), F.lit(True))
    ends = (F.abs(F.col("o1s") - F.col("r1s")) <= REPLY_EDGE_MS) & (F.abs(o2["end"] - r2["end"]) <= REPLY_EDGE_MS) & (F.col("o1e") <= o2["start"]) & fine("o1s", "o1e") & valid(o2)
    early = (r2["start"] - o2["start"]).between(REPLY_EARLY_MS, REPLY_LATE_MS)
    free = (r2["start"] >= F.col("o1e")) & (r2["start"] < o2["end"]) & F.coalesce(r2["start"] < F.col("next"), F.lit(True))
    left = o2["end"] - r2["start"]
    long_enough = (left >= REPLY_LEFT_MS) & (left * 2 >= o2["end"] - o2["start"])
    two = (F.col("reference_n") == 2) & (F.col("target_n") == 2) & fine("r1s", "r1e") & fine("t1s", "t1e") & valid(r2) & valid(t2)
    moves = g.filter(two & gap & plain & ends & early & F.col("supported") & free & long_enough).select(*keys, (F.col("target_start") + 1).alias("idx"), r2["start"].alias("reply"))
    return retimed.join(moves, [*keys, "idx"], "left").withColumn("new_start", F.coalesce("reply", "new_start")).drop("reply").select(*retimed.columns)


def delayed(target: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with new_start, new_end moved by the one offset of each pair; a cue keeps a millisecond at least."""
    start = F.greatest(F.lit(0), F.col("start") + F.col("offset"))
    both = target.join(offsets.select(*keys, "offset"), [*keys])
    return both.select(*target.columns, start.alias("new_start"), F.greatest(F.col("end") + F.col("offset"), start + 1).alias("new_end"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _numbered(reference: DataFrame, target: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return numbered(reference, keys).withColumn("estimated", F.coalesce("estimated", F.lit(False))), numbered(target, keys)


def seeded(reference: DataFrame, target: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Target cues with new_start, new_end by given seeds (keys, scale, intercept), and fit() of each pair; confident fits
    are corrected for late replies."""
    reference, target = _numbered(reference, target, keys)
    shifted = settled(shifted_groups(cue_groups(reference, target, seeds, keys), reference, target, seeds, keys), "groups")
    fits = settled(fit(shifted, reference, target, keys), "fits")
    moved = retimed_cues(target, shifted, seeds, keys)
    sure = fits.filter("confident").select(*keys)
    mended = late_replies(moved.join(sure, [*keys], "left_semi"), shifted, reference, target, keys)
    return _union([mended, moved.join(fits.select(*keys, "confident").filter("not confident").select(*keys), [*keys], "left_semi")]), fits


def retimed(reference: DataFrame, target: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Target cues with new_start, new_end of each pair, and its verdict: scale, intercept, score, margin, delay (a delay
    alone was found), fit()'s columns, reasons, accepted, run_ignored.

    An accepted delay moves all cues alike, another accepted result is corrected for late replies. What several steps read
    (tracks, seeds, groups, verdicts) is written as a table once.
    """
    reference, target = (settled(x, "tracks") for x in _numbered(reference, target, keys))
    found = settled(S.searched(reference, target, keys), "offsets")
    near_unit = found.filter(F.abs(F.col("scale") - 1.0) <= S.DELAY_SCALE).select(*keys)
    unit = S.delays(S.searched(reference.join(near_unit, [*keys], "left_semi"), target, keys, F.array(F.lit(1.0))))
    unit = unit.select(*keys, F.struct(F.lit(1.0).alias("scale"), "intercept", "score", "margin", "stable").alias("unit"))
    chosen = found.join(unit, [*keys], "left")
    better = [F.coalesce(F.col(f"unit.{c}"), F.col(c)).alias(c) for c in ("scale", "intercept", "score", "margin")]
    chosen = settled(chosen.select(*keys, *better, F.col("unit").isNotNull().alias("delay"), F.coalesce("unit.stable", F.lit(False)).alias("stable")), "seeds")
    seeds = chosen.select(*keys, "scale", F.col("intercept").cast("double").alias("intercept"))
    shifted = settled(shifted_groups(cue_groups(reference, target, seeds, keys), reference, target, seeds, keys), "groups")
    verdict = settled(rejections(fit(shifted, reference, target, keys).join(chosen, [*keys]), F.col("stable")), "verdicts")
    moved = retimed_cues(target, shifted, seeds, keys)
    way = verdict.select(*keys, F.col("intercept").alias("offset"), F.when(~F.col("accepted"), "seed").when(F.col("delay"), "delay").otherwise("groups").alias("way"))
    ways = {"delay": delayed(target, way, keys), "groups": late_replies(moved, shifted, reference, target, keys), "seed": moved}
    return _union([rows.join(way.filter(F.col("way") == name).select(*keys), [*keys], "left_semi") for name, rows in ways.items()]), verdict
