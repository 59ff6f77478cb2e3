"""Cues against what was heard: votes of recognised words, and correlation with detected speech.

Word votes are joins and windows: a heard word votes for the difference of its time and that of each equal word of the
cues, and the densest window of votes wins. A group's votes pass by once, sorted; its windows at all scales are running
sums over their arrays, and one row for each scale leaves them. Correlation with speech is one FFT a track and scale over
arrays of frames, which a track's length bounds; a track's rows pass by once, sorted, and the peak of its values alone is
a row again.

Cues are keys, ord, start, end (ms), text; words are keys, ord, at (seconds), text, segment. Null and empty texts have no
words, cues without a start or end are left out; pairs without a common word or without speech give no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.shipping import ship

# Fixed values of the votes.
STOP_WORDS = (
    "the a an and or but to of in on at for is it i you he she we they me my your our his her its "
    "be are was were am do did not no yes so that this with as what who how why oh uh um"
).split()
SHORTEST, MOST_TIMES, WINDOW_S, FAR_S, MOST_SEGMENTS, MOST_SHIFT_S = 3, 6, 0.7, 2.0, 6, 60.0
UNITS = math.lcm(*range(1, MOST_TIMES + 1))  # a vote's weight is a whole number of these parts of one
RATE_SPAN_S, RATE_SEGMENTS, RATE_MARGIN, LOCAL_S = 180.0, 5, 1.3, 120.0
SURE_SEGMENTS, SURE_SCORE, SURE_RATIO, LEAST_RUNNER_UP = 3, 3.0, 2.5, 0.5
# Fixed values of the correlation: scales, the frame, the detector's delay, what counts as near a peak and near an edge.
SCALES = (1.0, 24_000 / 23_976, 23_976 / 24_000, 25 / 23.976, 23.976 / 25, 25 / 24, 24 / 25)
FRAME_MS, DELAY_MS, NEAR_MS, EDGE_MS, UNIT_MARGIN, UNIT_RANGE, LONGEST_MS = 32, 100.0, 2500.0, 1500.0, 0.01, 0.002, 20_000


# ---- words -----------------------------------------------------------------------------------------------------------


def normalised(word: Column) -> Column:
    """Lower-cased letters, digits and inner apostrophes of a word."""
    return F.btrim(F.regexp_replace(F.lower(word), r"[^\p{L}\p{Nd}']", ""), F.lit("'"))


def normalised_words(text: Column) -> Column:
    """normalised() of the words of a text, without empty ones: its patterns pass once over the text and not over each word."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}'\s]+", ""), r"(?<!\S)'+|'+(?!\S)", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def words_of(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, ord, k (place in the cue), at (seconds), word, first, cue_before, cue_after (the words beside it, of other cues too): a cue's words spread evenly over it."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"<[^>]+>|\{[^}]*\}", " ")
    own = cues.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).select(*keys, "ord", "start", F.greatest(F.lit(1), F.col("end") - F.col("start")).alias("length"), normalised_words(plain).alias("words"))
    # What all words of a cue share is a column before they are rows: beside them it would be worked out for each, from all of them.
    # Cues without words are passed over, not left out before: such a filter goes below the shuffle, and takes the texts apart there too.
    n, by = F.col("n"), ", ".join(f"`{k}`" for k in keys)
    nearest = lambda f, word: F.expr(f"{f}({word}) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY start, ord)")
    own = own.withColumn("n", F.size("words")).withColumn("last", nearest("lag", "get(words, n - 1)")).withColumn("next", nearest("lead", "get(words, 0)")).filter(n > 0)
    beside = [F.concat(F.array("last"), F.slice("words", F.lit(1), n - 1)).alias("before"), F.concat(F.slice("words", F.lit(2), n - 1), F.array("next")).alias("after")]
    rows = own.select(*keys, "ord", "start", "length", "n", F.arrays_zip("words", *beside).alias("z")).select(*keys, "ord", "start", "length", "n", F.posexplode("z").alias("k", "z"))
    at = (F.col("start") + F.col("length") * F.col("k").cast("double") / n) / 1000.0
    return rows.select(*keys, "start", "ord", "k", at.alias("at"), F.col("z.words").alias("word"), (F.col("k") == 0).alias("first"), F.col("z.before").alias("cue_before"), F.col("z.after").alias("cue_after"))


def anchors(heard: DataFrame, cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, media, sub (seconds), weight, segment, first: a vote for each pair of equal words.

    A word that the cues hold MOST_TIMES at most counts one over that, and one more for each neighbour that agrees too.
    """
    tells = (F.length("word") >= SHORTEST) & ~F.col("word").isin(STOP_WORDS)
    c = words_of(cues, keys).filter(tells).withColumn("times", F.count("*").over(Window.partitionBy(*keys, "word"))).filter(F.col("times") <= MOST_TIMES)
    v = Window.partitionBy(*keys).orderBy("ord")
    h = heard.select(*keys, "ord", F.col("at").alias("media"), normalised(F.coalesce("text", F.lit(""))).alias("word"), "segment")
    beside = lambda f: F.when(f("segment").over(v) == F.col("segment"), f("word").over(v))
    h = h.withColumn("before", beside(F.lag)).withColumn("after", beside(F.lead)).filter(tells)
    both = h.join(c.select(*keys, "word", F.col("at").alias("sub"), "first", "cue_before", "cue_after", "times"), [*keys, "word"])
    agree = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return both.select(*keys, "media", "sub", (1.0 / F.col("times") + agree("before", "cue_before") + agree("after", "cue_after")).alias("weight"), "segment", "first")


def windows(d: np.ndarray, units: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of votes sorted by d: first and end of the window of WINDOW_S up to each vote and its equals, its units, its segments (those below 0 are none)."""
    n = len(d)
    lo, hi = np.searchsorted(d, d - WINDOW_S), np.searchsorted(d, d, "right")
    total = np.append(0, np.cumsum(units))
    # A vote is its segment's first in the windows that hold it but not the segment's vote before.
    turn = np.argsort(segment, kind="stable")
    before = np.full(n, -1)
    again = segment[turn[1:]] == segment[turn[:-1]]
    before[turn[1:][again]] = turn[:-1][again]
    own = np.flatnonzero(segment >= 0)
    begin = np.maximum(np.searchsorted(d, d[own]), np.searchsorted(lo, before[own], "right"))
    parts = np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(np.searchsorted(lo, own, "right"), minlength=n + 1))[:n]
    return lo, hi, total[hi] - total[lo], parts


def densest_window(d: np.ndarray, units: np.ndarray, segment: np.ndarray, first: np.ndarray, media: np.ndarray) -> tuple:
    """shift, score, segments, runner_up, span, anchor of the votes of one group, in any order."""
    turn = np.argsort(d, kind="stable")
    d, units, segment, first, media = (x[turn] for x in (d, units, segment, first, media))
    lo, hi, mass, parts = windows(d, units, segment)
    own = np.round(mass / UNITS * np.minimum(parts, MOST_SEGMENTS) / MOST_SEGMENTS, 9)
    best = int(own.argmax())
    inside = slice(lo[best], hi[best])
    starts = d[inside][first[inside]]
    shift = float(np.median(starts if len(starts) >= 2 else d[inside]))
    far = np.abs(d - shift) > FAR_S
    x, at = d[far], media[inside]
    total = np.append(0, np.cumsum(units[far]))
    other = total[np.searchsorted(x, x, "right")] - total[np.searchsorted(x, x - WINDOW_S)]
    return shift, float(own[best]), int(parts[best]), other.max(initial=0) / UNITS, float(at.max() - at.min()), float(np.median(at))


def _starts(rows: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where the groups of sorted rows begin."""
    new = np.arange(len(rows)) == 0
    for k in keys:
        codes = pc.dictionary_encode(rows[k], null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups: the last group of a batch waits for what follows."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        at = int(_starts(b, keys)[-1])
        goes_on = waiting and not at and len(_starts(pa.Table.from_batches([waiting[-1].slice(0, 1), b.slice(0, 1)]), keys)) == 1
        if not goes_on:
            if waiting or at:
                yield pa.Table.from_batches([*waiting, b.slice(0, at)]).combine_chunks()
            waiting = []
        waiting.append(b.slice(at))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


FOUND = (("turn", pa.int32()), ("shift", pa.float64()), ("score", pa.float64()), ("segments", pa.int32()), ("runner_up", pa.float64()), ("span", pa.float64()), ("anchor", pa.float64()))


def densest(votes: DataFrame, keys: Sequence[str], scales: Sequence[float] = (1.0,), most: float = MOST_SHIFT_S) -> DataFrame:
    """keys, turn (the scale's place), shift, score, segments, runner_up, span, anchor, sure of the densest window of votes of each group and scale.

    votes: anchors(). Scales but the first are tried where votes span RATE_SPAN_S or more. A window of WINDOW_S scores its
    weight times its share of MOST_SEGMENTS segments; its shift is the median of cue starts in it, or of all where fewer
    than two are; the runner-up lies beyond FAR_S. Weights count in UNITS, so sums are the same in any order.
    """
    ship(votes.sparkSession)

    def fit(batches):
        for rows in _whole_groups(batches, keys):
            at = _starts(rows, keys)
            column = lambda name: rows[name].combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            media, sub, units, first = (column(n) for n in ("media", "sub", "units", "first"))
            segment = pc.dictionary_encode(rows["segment"].combine_chunks()).indices.fill_null(-1).to_numpy()
            of, found = [], []
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(rows)], strict=True):
                span = media[a:z].max() - media[a:z].min()
                for turn, scale in enumerate(scales[:1] if span < RATE_SPAN_S else scales):
                    d = media[a:z] - scale * sub[a:z]
                    near = np.abs(d) <= most
                    if near.any():
                        found.append((turn, *densest_window(d[near], *(x[a:z][near] for x in (units, segment, first, media)))))
                        of.append(a)
            named = rows.select(list(keys)).take(pa.array(of, pa.int64()))
            for c, (name, kind) in enumerate(FOUND):
                named = named.append_column(name, pa.array([x[c] for x in found], kind))
            yield from named.combine_chunks().to_batches()

    units = F.round(F.col("weight") * UNITS).cast("long").alias("units")
    own = votes.filter(F.col("media").isNotNull()).select(*keys, "media", "sub", units, "segment", F.coalesce("first", F.lit(False)).alias("first"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keys).schema.fields)
    out = own.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fit, f"{kinds}, turn int, shift double, score double, segments int, runner_up double, span double, anchor double")
    sure = (F.col("segments") >= SURE_SEGMENTS) & (F.col("score") >= SURE_SCORE) & (F.col("score") >= SURE_RATIO * F.greatest("runner_up", F.lit(LEAST_RUNNER_UP)))
    return out.withColumn("sure", sure)


def word_fit(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, scale and densest()'s columns: the unit scale, unless words from RATE_SPAN_S or more speak far better for another."""
    names = ["scale", "shift", "score", "segments", "runner_up", "span", "anchor", "sure"]
    fits = densest(votes, keys, SCALES).withColumn("scale", F.get(F.array(*map(F.lit, SCALES)), F.col("turn")))
    listed = fits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", *names))).alias("f"))
    unit = F.get("f", F.lit(0))
    better = lambda best, x: F.when((x["segments"] >= RATE_SEGMENTS) & (x["score"] > best["score"] * RATE_MARGIN) & (x["score"] > unit["score"] * RATE_MARGIN), x).otherwise(best)
    return listed.filter(unit["turn"] == 0).select(*keys, F.aggregate(F.slice("f", 2, len(SCALES)), unit, better).alias("b")).select(*keys, *(f"b.{n}" for n in names))


def local_fits(votes: DataFrame, keys: Sequence[str], scale: Column) -> DataFrame:
    """keys, region and densest()'s columns of the sure fits of each LOCAL_S of the film: where a scene was put in or left out, they differ."""
    regions = votes.withColumn("sub", scale * F.col("sub")).withColumn("region", (F.col("media") / LOCAL_S).cast("long"))
    return densest(regions, [*keys, "region"]).filter("sure").drop("turn")


# ---- speech ----------------------------------------------------------------------------------------------------------


def rendered(starts: np.ndarray, ends: np.ndarray, first: int, n: int, scale: float) -> np.ndarray:
    """Share of each of n frames from `first` that cues cover, at most 1."""
    a = np.clip(starts * scale / FRAME_MS - first, 0, n)
    b = np.clip(ends * scale / FRAME_MS - first, 0, n)
    # A ramp from a to b: whole frames by a running sum, its two ends by what they cover.
    i, j = np.floor(a).astype(np.int64), np.floor(b).astype(np.int64)
    out = np.zeros(n + 3)
    np.add.at(out, i + 1, 1.0)
    np.add.at(out, j, -1.0)
    np.cumsum(out, out=out)
    np.add.at(out, i, i + 1 - a)
    np.add.at(out, j, b - j)
    return np.clip(out[:n], 0.0, 1.0, out=out[:n])


def fast_length(n: int) -> int:
    """The least even product of 2, 3 and 5 that is n or more."""
    best, fives = 1 << max(1, (n - 1).bit_length()), 1
    while fives < best:
        odd = fives
        while odd < best:
            best = min(best, odd << max(1, (-(-n // odd) - 1).bit_length()))
            odd *= 3
        fives *= 5
    return best


RUNS_A_FFT = 8  # stretches of known speech, times lags, for each number of an FFT up to which running sums are used


def correlations(speech: np.ndarray, cues: np.ndarray) -> np.ndarray:
    """Pearson's correlation of speech (NaN where unknown) with each stretch of its length of each row of cues, by FFT; NaN where undefined.

    Stretches end with the row, so one turn of the FFT of its length has them; sums over stretches of known speech are
    running sums where these are few.
    """
    known = ~np.isnan(speech)
    n, lags = int(known.sum()), cues.shape[-1] - len(speech) + 1
    centred = np.where(known, speech - speech[known].mean(), 0.0) if n else np.zeros(len(speech))
    norm = np.sqrt((centred * centred).sum())
    size = fast_length(cues.shape[-1])
    spectrum = lambda x: np.fft.rfft(x, size)
    of = lambda x, g: np.fft.irfft(x * g, size)[:lags]
    heard = np.conj(spectrum(centred))
    edges = np.flatnonzero(np.diff(known, prepend=False, append=False)).reshape(-1, 2).tolist()
    few = len(edges) * lags <= RUNS_A_FFT * size
    mask = None if few else np.conj(spectrum(known.astype(float)))

    def sums(x):
        """Of x and of its squares, which go as one complex number."""
        both, total = np.zeros(len(x) + 1, np.complex128), np.zeros(lags, np.complex128)
        both.real[1:], both.imag[1:] = np.cumsum(x), np.cumsum(x * x)
        for begin, end in edges:
            total += both[end : end + lags]
            total -= both[begin : begin + lags]
        return total.real, total.imag

    def one(x):
        g = spectrum(x)
        cross, (mean, square) = of(heard, g), sums(x) if few else (of(mask, g), of(mask, spectrum(x * x)))
        variance = square - mean * mean / max(n, 1)
        fine = (variance > 1e-6 * n) & (mean > 0.5) & (norm * norm > 1e-9) & (n >= 2)
        return np.where(fine, cross / (norm * np.sqrt(np.where(fine, variance, 1.0))) if norm else np.nan, np.nan)

    return one(cues) if cues.ndim == 1 else np.stack([one(x) for x in cues])


def peak_of(value: np.ndarray, apart: int) -> tuple[int, float, float | None, float] | None:
    """refined_peak() of one row of correlations, NaN where undefined: at, top, runner_up, refined; None where all are."""
    fine = ~np.isnan(value)
    if not fine.any():
        return None
    at = int(np.nanargmax(value))
    far = np.concatenate([value[: max(0, at - apart)], value[at + apart + 1 :]])
    far = far[~np.isnan(far)]
    refined, top = float(at), float(value[at])
    if 0 < at < len(value) - 1 and fine[at - 1] and fine[at + 1]:
        left, right = float(value[at - 1]), float(value[at + 1])
        curve = left - 2 * top + right
        if curve < 0:
            refined = at + max(-0.5, min(0.5, 0.5 * (left - right) / curve))
    return at, top, float(far.max()) if len(far) else None, refined


TASK_ROWS = 100_000  # of speech and cues that a task gets


def speech_peaks(speech: DataFrame, cues: DataFrame, keys: Sequence[str], shift_ms: tuple[float, float], scales: Sequence[float] = SCALES) -> DataFrame:
    """keys, scale, at, top, runner_up, refined (frames below the largest lag); speech: keys, frame (of its first), probabilities
    (array, null where unknown).

    Stretches of speech that overlap count by their larger value. Of the correlations of all lags the peak alone is a row.
    """
    ship(speech.sparkSession)
    low, high = (int(np.floor((x + DELAY_MS + 0.5) // FRAME_MS)) for x in shift_ms)
    high += 1
    columns = (("scale", pa.float64()), ("at", pa.int64()), ("top", pa.float64()), ("runner_up", pa.float64()), ("refined", pa.float64()))

    def work(batches):
        for rows in _whole_groups(batches, keys):
            at = _starts(rows, keys)
            column = lambda name: rows[name].combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            begin, end = column("__begin"), column("__end")
            parts = rows["__parts"].combine_chunks()
            offsets, values = np.asarray(parts.offsets), parts.values.to_numpy(zero_copy_only=False)
            heard = offsets[1:] > offsets[:-1]
            found, of = [], []
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(rows)], strict=True):
                own, said = np.flatnonzero(~heard[a:z]) + a, np.flatnonzero(heard[a:z]) + a
                if not len(own) or not len(said):
                    continue
                first, last = int(begin[said].min()), int(end[said].max())
                frames = np.full(last - first, np.nan)
                for k in said.tolist():
                    place = frames[begin[k] - first : end[k] - first]
                    np.fmax(place, values[offsets[k] : offsets[k + 1]], out=place)
                own = own[np.lexsort((end[own], begin[own]))]
                starts, ends = begin[own].astype(np.float64), end[own].astype(np.float64)
                covered = np.stack([rendered(starts, ends, first - high, last - first + high - low, scale) for scale in scales])
                for scale, value in zip(scales, correlations(frames, covered), strict=True):
                    if peak := peak_of(value, int(NEAR_MS / FRAME_MS)):
                        found.append((scale, *peak))
                        of.append(a)
            named = rows.select(list(keys)).take(pa.array(of, pa.int64()))
            for c, (name, kind) in enumerate(columns):
                named = named.append_column(name, pa.array([x[c] for x in found], kind))
            yield from named.combine_chunks().to_batches()

    there = lambda df: df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    frame, parts = F.col("frame").cast("long"), F.col("probabilities").cast("array<double>")
    said = there(speech).filter(F.col("frame").isNotNull() & (F.size("probabilities") > 0)).select(*keys, frame.alias("__begin"), (frame + F.size("probabilities")).alias("__end"), parts.alias("__parts"))
    fine = there(cues).filter((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") - F.col("start") < LONGEST_MS))
    own = fine.select(*keys, F.col("start").cast("long").alias("__begin"), F.col("end").cast("long").alias("__end"), F.array().cast("array<double>").alias("__parts"))
    tasks = max(speech.sparkSession.sparkContext.defaultParallelism, -(-(speech.count() + cues.count()) // TASK_ROWS))
    both = said.unionByName(own)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*keys).schema.fields)
    return both.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(work, f"{kinds}, scale double, at long, top double, runner_up double, refined double")


def speech_fit(speech: DataFrame, cues: DataFrame, keys: Sequence[str], shift_ms: tuple[float, float], scales: Sequence[float] = SCALES) -> DataFrame:
    """keys, scale, shift_ms, peak, prominence, at_edge of the scale with the largest peak; the unit scale where it is
    hardly less and the other close to it."""
    low, high = (int(np.floor((x + DELAY_MS + 0.5) // FRAME_MS)) for x in shift_ms)
    high += 1
    peaks = speech_peaks(speech, cues, keys, shift_ms, scales)
    edge, lags = int(EDGE_MS / FRAME_MS), high - low + 1
    peaks = peaks.select(
        *keys, "scale", ((high - F.col("refined")) * FRAME_MS - DELAY_MS).alias("shift_ms"), F.col("top").alias("peak"),
        (F.col("top") - F.coalesce("runner_up", F.lit(0.0))).alias("prominence"), ((F.col("at") < edge) | (F.col("at") >= lags - edge)).alias("at_edge"),
    )
    names = ["scale", "shift_ms", "peak", "prominence", "at_edge"]
    turn = F.array_position(F.array(*map(F.lit, scales)), F.col("scale"))
    best = peaks.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct((-F.col("peak")).alias("p"), turn.alias("t"))).alias("b"), F.first(F.when(F.col("scale") == 1.0, F.struct(*names)), ignorenulls=True).alias("u"))
    unit = (F.col("u.peak") >= F.col("b.peak") - UNIT_MARGIN) & (F.abs(F.col("b.scale") - 1.0) < UNIT_RANGE)
    return best.select(*keys, F.when(unit, F.col("u")).otherwise(F.col("b")).alias("c")).select(*keys, "c.*")
