"""Search for the scale and the offset that bring a track onto a reference.

A track's cues become the set of bins they are active in. Every scale that is likely for a pair is tried with every offset
in bins of COARSE_MS, the best is refined in bins of FINE_MS within RADIUS_MS, and its margin is what it has over the best
candidate that differs from it by APART_MS somewhere on the target. A delay alone is accepted if its thirds agree.

A pair is one row of its cues; its bins, bounded by TIMELINE_MS, and all scores of its scales and offsets are held while it
is searched, and its best candidate alone is a row again. Tracks are tables of keys, start, end. Pairs that share no bin give no row, and tracks of
fewer than LEAST cues or longer than TIMELINE_MS have no timeline.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelforge.operators.align import COARSE_MS, LONGEST_MS, OFFSET_MS, PARTIAL, PRECISION, RECALL, TIMELINE_MS, VISIBLE, VISIBLE_BASE, scale_candidates
from reelforge.shipping import ship

# Fixed values of the search and of a delay that is accepted.
LEAST, FINE_MS, RADIUS_MS, APART_MS = 4, 100, 750, 3000
THIRD_RADIUS, THIRD_APART, THIRD_SCORE = 10, 5, 0.68  # fine bins
DIRECT, ROWS = 64, 200  # offsets counted one by one; rows worked on at a time
DELAY_SCORE, DELAY_MARGIN, DELAY_SCALE, FEW = 0.78, 0.02, 0.0015, 8

Timeline = tuple[np.ndarray, int]  # active bins, ascending; number of bins


def listed(cues: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """keys, <name>_cues (those with a start and an end), <name>_span of starts, <name>_end of each track."""
    c = cues.select(*keys, F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"))
    whole = F.when(F.col("s").isNotNull() & F.col("e").isNotNull(), F.struct("s", "e"))
    return c.groupBy(*keys).agg(F.collect_list(whole).alias(f"{name}_cues"), (F.max("s") - F.min("s")).alias(f"{name}_span"), F.max("e").alias(f"{name}_end"))


def timeline(cues: tuple[np.ndarray, np.ndarray], width: int, scale: float = 1.0) -> Timeline | None:
    """The active bins of a track's starts and ends; None for a track of too few cues or too long a one."""
    half_up = lambda x: np.floor(x * scale + 0.5).astype(np.int64)
    s = np.maximum(cues[0], 0)
    e = np.minimum(np.maximum(cues[1], s + 1), s + LONGEST_MS)
    if len(s) < LEAST or half_up(e.max()) > TIMELINE_MS:
        return None
    s, e = half_up(s), half_up(e)
    e = np.maximum(e, s + 1)
    size = -(-(int(e.max()) + 1) // width)
    steps = np.bincount(s // width, minlength=size + 1) - np.bincount((e - 1) // width + 1, minlength=size + 1)
    return np.flatnonzero(np.cumsum(steps) > 0), size


def _within(sorted_bins: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.searchsorted(sorted_bins, high, side="right") - np.searchsorted(sorted_bins, low))


def _shared(marks: np.ndarray, bins: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bins meet a mark at each of consecutive offsets; many offsets are correlated by FFT, whose counts round to whole ones."""
    if len(offsets) > DIRECT:
        size = 1 << int(len(marks) + bins[-1]).bit_length()
        own = np.zeros(size)
        own[bins] = 1.0
        all_ = np.rint(np.fft.irfft(np.fft.rfft(marks.astype(float), size) * np.conj(np.fft.rfft(own)), size)).astype(np.int64)
        return np.where((offsets >= -bins[-1]) & (offsets < len(marks)), all_[offsets % size], 0)
    out = np.zeros(len(offsets), np.int64)
    for part in np.array_split(bins, len(bins) // 4096 + 1):
        at = part[:, None] + offsets
        out += (marks[np.clip(at, 0, len(marks) - 1)] & (at >= 0) & (at < len(marks))).sum(axis=0)
    return out


def _marks(reference: Timeline) -> np.ndarray:
    out = np.zeros(reference[1], bool)
    out[reference[0]] = True
    return out


def offset_scores(reference: Timeline, target: Timeline, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared bins and score (NaN where nothing can be seen) of each offset."""
    (r, size), (t, _) = reference, target
    shared = _shared(_marks(reference), t, offsets)
    seen = _within(t, -offsets, size - 1 - offsets)
    wanted = _within(r, np.maximum(0, t[0] + offsets), np.minimum(size - 1, t[-1] + offsets))
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (shared / seen * PRECISION + shared / wanted * RECALL) * (VISIBLE_BASE + VISIBLE * np.clip(seen / len(t), 0.0, 1.0))
    return shared, np.where((seen > 0) & (wanted > 0), score, np.nan)


def thirds(reference: Timeline, target: Timeline, offset: int) -> tuple[int, int]:
    """Thirds of the target whose best offset nearby is good and near `offset`, and those covered at `offset`."""
    (r, size), (t, _) = reference, target
    marks, span, near = _marks(reference), int(t[-1] - t[0] + 1), offset + np.arange(-THIRD_RADIUS, THIRD_RADIUS + 1)
    agreed = covered = 0
    for k in range(3):
        first, last = t[0] + span * k // 3, t[-1] if k == 2 else t[0] + span * (k + 1) // 3 - 1
        own = t[(t >= first) & (t <= last)]
        if not len(own):
            continue
        covered += _shared(marks, own, np.array([offset]))[0] / len(own) >= THIRD_SCORE
        shared, wanted = _shared(marks, own, near), _within(r, np.maximum(0, first + near), np.minimum(size - 1, last + near))
        score = np.where(wanted > 0, shared / len(own) * PRECISION + shared / np.maximum(wanted, 1) * RECALL, -np.inf)
        agreed += bool(score.max() >= THIRD_SCORE and abs(near[score.argmax()] - offset) <= THIRD_APART)
    return int(agreed), int(covered)


def _coarse(reference: Timeline, target: Timeline) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in milliseconds and scores of all offsets at which any bin is shared."""
    base, (r, t) = OFFSET_MS // COARSE_MS, (reference[0], target[0])
    low, high = -base, base
    if t[-1] - t[0] < (r[-1] - r[0]) * PARTIAL:  # a part of the reference may lie anywhere in it
        low, high = min(low, r[0] - t[0] - base), max(high, r[-1] - t[-1] + base)
    offsets = np.arange(low, high + 1)
    shared, score = offset_scores(reference, target, offsets)
    hit = np.flatnonzero((shared > 0) & ~np.isnan(score))
    return offsets[hit] * COARSE_MS, score[hit]


def best_of_pair(r: tuple[np.ndarray, np.ndarray], t: tuple[np.ndarray, np.ndarray], t_end: float, scales: Sequence[float]) -> tuple | None:
    """scale, intercept, score, margin, agreed, covered of a pair's starts and ends; None where no bin is ever shared."""
    reference = timeline(r, COARSE_MS)
    found = [(x, own) for x in scales if reference and (own := timeline(t, COARSE_MS, x))]
    scored = [(np.full(len(k), x), k, score) for x, own in found for k, score in [_coarse(reference, own)] if len(k)]
    if not scored:
        return None
    by, coarse, score = map(np.concatenate, zip(*scored, strict=True))
    ties = np.flatnonzero(score == score.max())
    top = ties[np.lexsort((coarse[ties], by[ties]))[0]]
    apart = np.maximum(np.abs(coarse - coarse[top]), np.abs(t_end * by[top] + coarse[top] - (t_end * by + coarse))) >= APART_MS
    margin = float(score[top] - (score[apart].max() if apart.any() else 0.0))
    scale, intercept, best = float(by[top]), int(coarse[top]), float(score[top])
    fine = timeline(r, FINE_MS), timeline(t, FINE_MS, scale)
    offsets = np.floor((intercept - RADIUS_MS + np.arange(0, 2 * RADIUS_MS + 1, FINE_MS)) / FINE_MS + 0.5).astype(np.int64)
    _, scores = offset_scores(*fine, offsets)
    if not np.isnan(scores).all():
        at = int(np.nanargmax(scores))
        intercept, best = int(offsets[at]) * FINE_MS, float(scores[at])
    return scale, intercept, best, margin, *thirds(*fine, (2 * intercept + FINE_MS) // (2 * FINE_MS))


def _mapped(df: DataFrame, keys: Sequence[str], work, columns: Sequence[tuple[str, str, pa.DataType]]) -> DataFrame:
    """work(row) gives tuples of `columns` for each row of df; the result has the row's keys before them."""
    ship(df.sparkSession)

    def run(batches):
        # A few rows at a time, so that what is held does not grow with a batch.
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, len(whole), ROWS)):
            found, at = [], []
            for i, row in enumerate(b.drop_columns(list(keys)).to_pylist()):
                own = work(row)
                found += own
                at += [i] * len(own)
            named = pa.Table.from_batches([b]).select(list(keys)).take(pa.array(at, pa.int64()))
            for c, (name, _, kind) in enumerate(columns):
                named = named.append_column(name, pa.array([f[c] for f in found], kind))
            yield from named.combine_chunks().to_batches()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields] + [f"{name} {kind}" for name, kind, _ in columns]
    return df.mapInArrow(run, ", ".join(kinds))


def _best_row(row: dict) -> list[tuple]:
    cues = lambda name: (np.array(row[f"{name}_s"]), np.array(row[f"{name}_e"]))
    found = best_of_pair(cues("r"), cues("t"), row["t_end"], [x for x in row["scales"] or () if x is not None])
    return [(*found, len(row["t_s"]))] if found else []


FOUND = (("scale", "double", pa.float64()), ("intercept", "long", pa.int64()), ("score", "double", pa.float64()), ("margin", "double", pa.float64()), *((n, "int", pa.int32()) for n in ("agreed", "covered", "target_n")))


def searched(reference: DataFrame, target: DataFrame, keys: Sequence[str], scales: Column | None = None) -> DataFrame:
    """keys, scale, intercept, score, margin, agreed, covered (thirds), target_n of the best candidate of each pair.

    scales: an array of the scales to try from the spans of starts r_span, t_span; without it, those likely for the pair.
    """
    both = listed(reference, keys, "r").join(listed(target, keys, "t"), [*keys]).filter((F.size("r_cues") >= LEAST) & (F.size("t_cues") >= LEAST))
    tried = (scale_candidates(F.col("r_span"), F.col("t_span")) if scales is None else scales).cast("array<double>")
    arrays = [F.col(f"{x}_cues.{k}").alias(f"{x}_{k}") for x in "rt" for k in "se"]
    return _mapped(both.select(*keys, *arrays, "t_end", tried.alias("scales")), keys, _best_row, FOUND)


def delays(unit: DataFrame, ambiguous: bool = False) -> DataFrame:
    """Those of searched() at scale 1 alone whose delay holds for the whole track, with passed (thirds) and stable: the
    margin is too small and the thirds alone speak for it. ambiguous: margins count for nothing, thirds only need cover."""
    passed = F.col("covered" if ambiguous else "agreed")
    needed = F.when(F.col("target_n") < FEW, 2).otherwise(3)
    return unit.filter((F.col("score") >= DELAY_SCORE) & (passed >= needed)).withColumn("passed", passed).withColumn("stable", (F.col("margin") < DELAY_MARGIN) & F.lit(not ambiguous))
