"""Correlation with speech against sums over frames, word votes by hand, and Python functions on workers without the package."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelforge.operators import sequence, speech

TOP = Path(__file__).resolve().parents[1]


def covered(cues, first, n, scale):
    out = np.zeros(n)
    for i in range(n):
        a, b = first + i, first + i + 1
        out[i] = min(1.0, sum(max(0.0, min(b, e * scale / 32) - max(a, s * scale / 32)) for s, e in cues))
    return out


def test_rendered_equals_overlaps_of_frames():
    rng = np.random.default_rng(1)
    starts = np.sort(rng.integers(0, 6000, 25)).astype(float)
    ends = starts + rng.integers(1, 400, 25)
    for first, n, scale in ((0, 200, 1.0), (-30, 120, 25 / 24), (50, 90, 0.96)):
        assert np.allclose(speech.rendered(starts, ends, first, n, scale), covered(list(zip(starts, ends, strict=True)), first, n, scale))


def test_correlations_equal_direct_sums():
    rng = np.random.default_rng(2)
    p = rng.random(150)
    p[rng.random(150) < 0.3] = np.nan
    g = np.clip(rng.random(260) * 2 - 0.6, 0, 1)
    g[:40] = 0  # lags at which little is covered
    got, known = speech.correlations(p, g), ~np.isnan(p)
    assert len(got) == 111
    for k in range(111):
        x, y = p[known], g[k : k + 150][known]
        want = np.nan if y.var() <= 1e-6 or y.sum() <= 0.5 else np.corrcoef(x, y)[0, 1]
        assert got[k] == pytest.approx(want, abs=1e-9, nan_ok=True)
    assert np.isnan(speech.correlations(np.full(5, np.nan), g)).all()
    assert np.isnan(speech.correlations(np.full(5, 0.5), g)).all()


def test_speech_fit(spark):
    rng = np.random.default_rng(3)
    starts = np.cumsum(rng.integers(1500, 6000, 80))
    cues = [(f, i, int(s), int(s + 1200 + 7 * i), "x") for f in ("plain", "slow", "silent") for i, s in enumerate(starts)] + [("plain", 99, 5, 1, "odd"), ("mute", 0, 100, 900, "x")]
    parts = []
    for film, scale, shift in (("plain", 1.0, 4000), ("slow", 25 / 24, -3000)):
        for _, _, s, e, _ in cues[:80]:
            a = int((s * scale + shift + speech.DELAY_MS) / 32)
            if a >= 0:
                parts.append((film, a, [0.9] * max(1, int((e - s) * scale / 32)) + [0.0] * 10))
    parts += [("silent", 0, None), ("silent", 3, [])]
    heard = spark.createDataFrame(parts, "film string, frame long, probabilities array<double>").repartition(3)
    got = {r.film: r for r in speech.speech_fit(heard, spark.createDataFrame(cues, "film string, ord long, start long, end long, text string"), ["film"], (-9000.0, 9000.0)).collect()}
    assert set(got) == {"plain", "slow"}
    assert (got["plain"].scale, got["slow"].scale) == (1.0, 25 / 24)
    assert abs(got["plain"].shift_ms - 4000) < 40
    assert abs(got["slow"].shift_ms + 3000) < 40
    assert all(r.peak > 0.8 and r.prominence > 0.3 and not r.at_edge for r in got.values())


def test_refined_peak(spark):
    rows = [("a", 0, 1.0), ("a", 1, 4.0), ("a", 2, 3.0), ("a", 9, 2.0), ("b", 5, 1.0), ("c", 1, 2.0), ("c", 2, 2.0), ("c", 3, 2.0)]
    got = {r.k: r for r in sequence.refined_peak(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", 3).collect()}
    assert (got["a"].at, got["a"].top, got["a"].runner_up) == (1, 4.0, 2.0)
    assert got["a"].refined == pytest.approx(1 + 0.5 * (1 - 3) / (1 - 8 + 3))
    assert (got["b"].refined, got["b"].runner_up) == (5.0, None)
    assert (got["c"].at, got["c"].refined) == (1, 1.0)


def test_word_votes_by_hand(spark):
    cues = spark.createDataFrame([("f", 0, 0, 4000, "<i>Hello</i> there, {x}big World"), ("f", 1, 10_000, 12_000, "the 'Hello' again"), ("f", 2, 20_000, 21_000, None), ("g", 0, 0, 1000, "")], "film string, ord long, start long, end long, text string")
    assert [(r.at, r.word, r.first) for r in speech.words_of(cues, ["film"]).orderBy("at").collect()] == [
        (0.0, "hello", True), (1.0, "there", False), (2.0, "big", False), (3.0, "world", False), (10.0, "the", True), (10.0 + 2 / 3, "hello", False), (10.0 + 4 / 3, "again", False)]
    heard = spark.createDataFrame([("f", 0, 5.0, "HELLO!", 1), ("f", 1, 5.5, "there", 1), ("f", 2, 9.0, "World", 2), ("f", 3, 9.5, "the", 2), ("f", 4, 9.9, None, 2)], "film string, ord long, at double, text string, segment long")
    votes = sorted((r.media, r.sub, r.weight) for r in speech.anchors(heard, cues, ["film"]).collect())
    assert votes == [(5.0, 0.0, 1.5), (5.0, 10.0 + 2 / 3, 0.5), (5.5, 1.0, 2.0), (9.0, 3.0, 2.0)]
    fit = speech.word_fit(speech.anchors(heard, cues, ["film"]), ["film"]).collect()[0]
    assert (fit.scale, fit.score, fit.segments, fit.sure) == (1.0, pytest.approx(3.5 / 6), 1, False)
    assert fit.shift == 4.75
    assert speech.local_fits(speech.anchors(heard, cues, ["film"]), ["film"], speech.F.lit(1.0)).count() == 0


def voted(votes, scale):
    """Shift, score, segments, runner-up, span and anchor of votes (media, sub, sixtieths, segment, first) by trying each window."""
    v = [(m - scale * s, u, g, f, m) for m, s, u, g, f in votes if abs(m - scale * s) <= speech.MOST_SHIFT_S]
    if not v:
        return None
    window = lambda rows, d: [x for x in rows if d - speech.WINDOW_S <= x[0] <= d]
    parts = lambda rows: len({x[2] for x in rows if x[2] is not None})
    score = lambda rows: round(sum(x[1] for x in rows) / 60 * min(parts(rows), 6) / 6, 9)
    best = min((x[0] for x in v), key=lambda d: (-score(window(v, d)), d))
    rows = window(v, best)
    starts = [x[0] for x in rows if x[3]]
    shift = float(np.median(starts if len(starts) >= 2 else [x[0] for x in rows]))
    far, media = [x for x in v if abs(x[0] - shift) > speech.FAR_S], [x[4] for x in rows]
    return shift, score(rows), parts(rows), max((sum(y[1] for y in window(far, x[0])) / 60 for x in far), default=0.0), max(media) - min(media), float(np.median(media))


def test_densest_window_equals_trying_each(spark):
    pick, rows = np.random.default_rng(7), []
    for k in range(60):
        # Times of a tenth make equal differences and edges of windows; films of 200 s have all scales, those of 100 s one.
        for _ in range(int(pick.integers(1, 60))):
            media, sub = (float(x) for x in np.round(pick.random(2) * (200 if k % 2 else 100), 1))
            if pick.random() < 0.4:
                sub = round(media - float(pick.integers(-30, 30)) / 10, 1)
            segment = None if pick.random() < 0.1 else int(pick.integers(0, 9))
            rows.append((None if k == 0 else f"f{k}", media, sub, int(pick.choice([10, 12, 15, 20, 30, 60, 75, 180])), segment, bool(pick.random() < 0.3)))
    votes = spark.createDataFrame([(f, m, s, u / 60, g, h) for f, m, s, u, g, h in rows] + [("none", None, 1.0, 1.0, 1, True), ("far", 500.0, 1.0, 1.0, 1, True)], "film string, media double, sub double, weight double, segment long, first boolean")
    want = {}
    for f in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == f]
        for turn, scale in enumerate(speech.SCALES if max(x[0] for x in own) - min(x[0] for x in own) >= 180 else speech.SCALES[:1]):
            if (found := voted(own, scale)) is not None:
                want[f, turn] = found
    assert len({t for _, t in want}) == len(speech.SCALES)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for rows_at_once in ("7", "100000"):
        before = spark.conf.get(size)
        spark.conf.set(size, rows_at_once)  # a film's votes lie in many batches, or many films' in one
        try:
            got = {(r.film, r.turn): (r.shift, r.score, r.segments, r.runner_up, r.span, r.anchor) for r in speech.densest(votes.repartition(3), ["film"], speech.SCALES).collect()}
        finally:
            spark.conf.set(size, before)
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_local_fits_equal_trying_each_window_of_a_region(spark):
    pick, rows = np.random.default_rng(8), []
    for film, scale in (("a", 1.0), ("b", 25 / 24)):
        for media in np.round(np.sort(pick.random(150)) * 360, 1).tolist():
            far = pick.random() < 0.2
            shift = float(pick.integers(-50, 50)) if far else 3.0 + media // 120 * 7 + float(pick.integers(0, 4)) / 10
            rows.append((film, media, scale, (media - shift) / scale, 60, int(media // 10), bool(pick.random() < 0.2)))
    votes = spark.createDataFrame([(f, m, x, s, u / 60, g, h) for f, m, x, s, u, g, h in rows], "film string, media double, of double, sub double, weight double, segment long, first boolean")
    fits = speech.local_fits(votes, ["film"], speech.F.col("of"))
    got = {(r.film, r.region): (r.shift, r.score, r.segments, r.runner_up, r.span, r.anchor) for r in fits.collect()}
    want = {(f, k): voted([(m, x * s, u, g, h) for n, m, x, s, u, g, h in rows if n == f and m // 120 == k], 1.0) for f in "ab" for k in range(3)}
    want = {k: v for k, v in want.items() if v[2] >= 3 and v[1] >= 3 and v[1] >= 2.5 * max(v[3], 0.5)}
    assert len(want) >= 4
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_words_beside_a_word_are_of_other_cues_too(spark):
    cues = spark.createDataFrame([("f", 0, 0, 100, "One, two"), ("f", 1, 100, 200, "-- ''"), ("f", 2, 200, 300, "'three'"), ("f", 3, 300, 400, None), ("f", 4, 400, 500, "don't <b>stop</b>"), ("g", 0, 0, 100, "Alone")], "film string, ord long, start long, end long, text string")
    got = [(r.word, r.cue_before, r.cue_after) for r in speech.words_of(cues, ["film"]).orderBy("film", "start", "k").collect()]
    assert got == [("one", None, "two"), ("two", "one", "three"), ("three", "two", "don't"), ("don't", "three", "stop"), ("stop", "don't", None), ("alone", None, None)]


def test_python_runs_on_workers_without_the_package(tmp_path):
    """Workers start in another folder and know nothing of the driver's path."""
    for p in ("reelforge", "__spark_entry__.py"):
        (shutil.copytree if (TOP / p).is_dir() else shutil.copy)(TOP / p, tmp_path / p)
    shutil.rmtree(tmp_path / "reelforge/llm", ignore_errors=True)
    (tmp_path / "elsewhere").mkdir()
    code = f"""
import sys
sys.path.insert(0, {str(tmp_path)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "1g").getOrCreate()
def here():
    import importlib.util
    return importlib.util.find_spec("reelforge") is not None
from reelforge.sources.scrapers import scraped
from reelforge.plans import registry
q = registry.queries()
for name in ("repeated_writes", "rate_limited", "ass_cues", "vtt_cues", "collapsed_cues", "two_quotas", "resolved_identities", "cue_groups", "delay_only"):
    assert q[name](s, "/root/testdata/sf0.001").count() > 0, name
req = s.createDataFrame([(1, "a", "movie", None, None)], "request long, id string, type string, season int, episode int")
assert scraped(req, lambda *a: [{{"url": "x", "title": "t"}}]).count() == 1
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "elsewhere", check=True, timeout=300, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "PATH", "SPARK_LOCAL_IP")})


def test_correlations_of_long_tracks_take_an_fft_of_their_length():
    """In stretches of known speech as in frames that come and go; rows of cues give what each alone does."""
    rng = np.random.default_rng(5)
    g = np.clip(rng.random((3, 700)) * 2 - 0.6, 0, 1)
    p = rng.random(600)
    p[100:180] = p[400:430] = np.nan
    broken = np.where(rng.random(600) < 0.5, np.nan, p)
    for x in (p, broken):
        known, got = ~np.isnan(x), speech.correlations(x, g)
        assert got.shape == (3, 101)
        for row, own in zip(g, got, strict=True):
            assert np.allclose(own, [np.corrcoef(x[known], row[k : k + 600][known])[0, 1] for k in range(101)], atol=1e-9)
            assert np.allclose(own, speech.correlations(x, row), atol=1e-12)
    assert [speech.fast_length(n) for n in (1, 2, 7, 23, 151, 700, 20_576)] == [2, 2, 8, 24, 160, 720, 20_736]


def test_rows_of_a_track_pass_by_sorted_and_no_list_of_them_is_made(spark):
    cues = spark.range(90).select((F.col("id") % 3).alias("film"), (F.col("id") * 900).alias("start"), (F.col("id") * 900 + 700).alias("end"))
    heard = cues.select("film", F.floor(F.col("start") / 32).alias("frame"), F.concat(F.array_repeat(F.lit(0.9), 20), F.array_repeat(F.lit(0.05), 16)).alias("probabilities"))
    peaks = speech.speech_peaks(heard, cues, ["film"], (-9000.0, 9000.0))
    assert "collect_list" not in peaks._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # tracks go over the ends of batches
    try:
        cut = sorted(map(tuple, peaks.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == sorted(map(tuple, speech.speech_peaks(heard, cues, ["film"], (-9000.0, 9000.0)).collect()))
    assert len(cut) == 3 * len(speech.SCALES)
