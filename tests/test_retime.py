"""Retiming against a program without a band, the search against sets of bins, and whole cases of two tracks."""

import functools
import itertools
import math
import random

import numpy as np
import pytest

from reelforge.operators import retime, search

CUES = "film string, ord long, start long, end long"


def timeline(count, seed=1, start=20_000):
    pick, out = random.Random(seed), []
    for _ in range(count):
        out.append((start, start + pick.randrange(900, 2600)))
        start += pick.randrange(1500, 5800)
    return out


def moved(cues, by):
    return [(s + by, e + by) for s, e in cues]


def sides(spark, cases):
    """{name: (reference, target)} or with the reference's estimated places, as two tables."""
    r = [(k, i, *c, i in (v[2] if len(v) > 2 else ())) for k, v in cases.items() for i, c in enumerate(v[0])]
    t = [(k, i, *c) for k, v in cases.items() for i, c in enumerate(v[1])]
    return spark.createDataFrame(r, CUES + ", estimated boolean").repartition(3), spark.createDataFrame(t, CUES).repartition(2)


def by_film(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.film, r.idx)):
        out.setdefault(r.film, []).append((r.new_start, r.new_end))
    return out


def path_without_band(starts, ends, estimated, t_starts, t_ends):
    """Least cost of any way through both tracks, and its groups, by recursion."""
    def cost(i, a, j, b):
        r0, r1, t0, t1 = starts[i], ends[i + a - 1], t_starts[j], t_ends[j + b - 1]
        parts = abs(r0 - t0) / 1250, abs(r1 - t1) / 1250, abs((r0 + r1) / 2 - (t0 + t1) / 2) / 1500, abs(max(1, r1 - r0) - max(1, t1 - t0)) / 2000
        w = (0.58, 0.16, 0.16, 0.10) if any(estimated[i : i + a]) else (0.34, 0.34, 0.18, 0.14)
        return sum(p * q for p, q in zip(parts, w, strict=True))

    @functools.cache
    def best(i, j):
        if i == 0 and j == 0:
            return 0.0, ()
        ways = []
        if i:
            ways.append((best(i - 1, j)[0] + 1.35, best(i - 1, j)[1]))
        if j:
            ways.append((best(i, j - 1)[0] + 1.85, best(i, j - 1)[1]))
        for a, b in ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2)):
            if a <= i and b <= j and (c := cost(i - a, a, j - b, b)) <= 8:
                before = best(i - a, j - b)
                ways.append((before[0] + c + 0.1 * (a + b - 2), (*before[1], (i - a, a, j - b, b, c))))
        return min(ways, key=lambda w: w[0])

    return min((best(i, len(t_starts)) for i in range(len(starts) + 1)), key=lambda w: w[0])


@pytest.mark.parametrize("seed", range(30))
def test_groups_equal_a_program_without_a_band(seed):
    pick = random.Random(seed)
    reference = timeline(pick.randrange(4, 14), seed)
    target = []
    for s, e in reference:
        kind = pick.randrange(6)
        if kind == 0:
            continue
        by = pick.randrange(-900, 900)
        if kind == 1:
            target += [(s + by, (s + e) // 2 + by), ((s + e) // 2 + by, e + by)]
        elif kind == 2 and target:
            target[-1] = (target[-1][0], e + by)
        else:
            target.append((s + by, e + by))
    target = target or [(50, 60)]
    arrays = lambda cues: (np.array([c[0] for c in cues], float), np.array([c[1] for c in cues], float))
    estimated = np.array([pick.random() < 0.2 for _ in reference], int)
    got = retime.matched_groups(*arrays(reference), estimated, *arrays(target), band=100)
    _, want = path_without_band(*map(list, arrays(reference)), estimated.tolist(), *map(list, arrays(target)))
    assert [g[:4] for g in got] == [g[:4] for g in want]
    assert np.allclose([g[4] for g in got], [g[4] for g in want])


def test_the_band_follows_the_target():
    cues = timeline(300, 5)
    s, e = (np.array(x, float) for x in zip(*cues, strict=True))
    got = retime.matched_groups(s, e, np.zeros(300, int), s, e)
    assert [g[:4] for g in got] == [(i, 1, i, 1) for i in range(300)]
    late = retime.matched_groups(s, e, np.zeros(300, int), s[200:], e[200:])  # begins far from the first reference cue
    assert [g[:4] for g in late][2:] == [(200 + i, 1, i, 1) for i in range(2, 100)]


def test_scores_equal_sets_of_bins():
    pick = random.Random(7)
    for _ in range(20):
        r, t = (sorted(pick.sample(range(90), pick.randrange(1, 40))) for _ in range(2))
        size = r[-1] + 1 + pick.randrange(2)
        offsets = np.arange(-120, 121)
        shared, score = search.offset_scores((np.array(r), size), (np.array(t), t[-1] + 1), offsets)
        for k, n, x in zip(offsets.tolist(), shared.tolist(), score.tolist(), strict=True):
            both = {b + k for b in t} & set(r)
            assert n == len(both)
            seen = [b for b in t if 0 <= b + k < size]
            wanted = [b for b in r if t[0] + k <= b <= t[-1] + k]
            if seen and wanted:
                assert x == pytest.approx((0.72 * n / len(seen) + 0.28 * n / len(wanted)) * (0.85 + 0.15 * len(seen) / len(t)))
            else:
                assert math.isnan(x)


REPLIES = [(5000, 6000), (10_000, 11_000), (13_000, 14_000), (18_000, 19_000)]
ANSWERS = [(5000, 6000), (10_000, 12_000), (12_000, 14_000), (18_000, 19_000)]


def test_given_seeds(spark):
    usual, uneven = timeline(60, 3), timeline(60, 3)
    uneven[20], uneven[30] = moved(uneven, 150)[20], moved(uneven, 900)[30]
    cases = {
        "reply": (REPLIES, ANSWERS),
        "one side": (REPLIES[1:] + [(22_000, 23_000)], ANSWERS[1:] + [(22_000, 23_000)]),
        "inferred": (REPLIES, ANSWERS, {1}),
        "far": ([*REPLIES[:2], (13_500, 14_500), REPLIES[3]], [*ANSWERS[:2], (12_000, 14_500), ANSWERS[3]]),
        "uneven": (uneven, usual),
        "short": (REPLIES[:3], ANSWERS[:3]),
        "overlap": ([(11_000, 12_900), (13_500, 14_900), (16_800, 18_000), (19_800, 21_000)], [(10_000, 13_000), (13_100, 15_500), (16_000, 18_500), (19_000, 21_500)]),
    }
    r, t = sides(spark, cases)
    seeds = spark.createDataFrame([(k, 1.0, 800.0 if k == "overlap" else 0.0) for k in cases] + [("absent", 1.0, 0.0)], "film string, scale double, intercept double")
    cues, fits = retime.seeded(r, t, seeds, ["film"])
    got, fit = by_film(cues), {x.film: x for x in fits.collect()}
    assert set(got) == set(fit) == set(cases) - {"short"}
    assert all(fit[k].confident for k in fit)
    assert got["reply"] == [(5000, 6000), (10_000, 12_000), (13_000, 14_000), (18_000, 19_000)]
    for k in ("one side", "inferred", "far"):
        assert got[k] == cases[k][1]
    assert got["uneven"][20] == (usual[20][0] + 150, usual[20][1] + 150)
    assert got["uneven"][30] == usual[30]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(got["overlap"]))
    assert fit["reply"].shapes[retime.Q.SHAPES.index("2:2")] == 1


def test_whole_search(spark):
    film, scale = timeline(220, 11), 25 / 23.976
    far = film[130][0] - 4000
    merged = timeline(180, 12)
    gaps = itertools.accumulate(((2000, 3200, 2300, 4100, 2200, 3600, 2900)[i % 7] + i % 5 * 70 for i in range(259)), initial=30_000)
    beat = [(s, s + 1000 + i % 4 * 190) for i, s in enumerate(gaps)]
    cases = {
        "constant": (film, moved(film, -4000)),
        "uneven delay": ([(s + d, e + d) for (s, e), d in zip(film, itertools.cycle((-300, 200, 0, 300, -100)))], moved(film, -4000)),
        "drift": (film, [(int(s / scale), int(e / scale)) for s, e in film]),
        "part": (film, moved(film[130:], -far)),
        "no ends": (film, moved(film[25:195], -8000)),
        "six": (timeline(6, 13), moved(timeline(6, 13), -2200)),
        "merged": (merged, [(g[0][0], g[-1][1]) for g in (merged[i : i + 3] for i in range(0, 180, 3))]),
        "other": (film, timeline(205, 99)),
        "broken": (film, film[:110] + moved(film[110:], -5000)),
        "beat": (beat, moved(beat, -12_750)),
        "extras": (film, sorted([(5000 + i * 1050, 5600 + i * 1050) for i in range(14)] + film)),
        "few": (film, film[:3]),
    }
    r, t = sides(spark, cases)
    cues, verdicts = retime.retimed(r, t, ["film"])
    v, got = {x.film: x for x in verdicts.collect()}, by_film(cues)
    assert "few" not in v
    assert {k for k in v if v[k].accepted} == set(cases) - {"few", "other", "broken", "beat"}, {k: v[k].reasons for k in v}
    assert all(v[k].reasons for k in ("other", "broken", "beat"))
    for k, by in (("constant", 4000), ("uneven delay", 4000), ("part", far), ("no ends", 8000)):
        assert abs(v[k].intercept - by) <= 500
        assert v[k].delay
        assert {(a - s, b - e) for (a, b), (s, e) in zip(got[k], cases[k][1], strict=True)} == {(v[k].intercept, v[k].intercept)}
    assert abs(v["drift"].scale - scale) < 0.0015
    assert not v["drift"].delay
    assert max(abs(a - s) for (a, _), (s, _) in zip(got["drift"], film, strict=True)) <= 1
    assert v["merged"].shapes[retime.Q.SHAPES.index("3:1")] > 40
    assert v["extras"].run_ignored
    assert v["extras"].skip_run > 12
    assert set(got) == set(v)
    assert all(len(got[k]) == len(cases[k][1]) for k in got)


def test_margin_counts_for_nothing_where_it_may(spark):
    film = timeline(120, 17)
    r, t = sides(spark, {"a": (film, moved(film, -4200)), "b": (film, moved(timeline(120, 18), 0))})
    unit = search.searched(r, t, ["film"], search.F.array(search.F.lit(1.0)))
    plain, wide = (search.delays(unit, x).collect() for x in (False, True))
    assert [(x.film, x.intercept, x.stable, x.passed) for x in plain] == [("a", 4200, False, 3)]
    assert [(x.film, x.intercept, x.stable, x.passed) for x in wide] == [("a", 4200, False, 3)]
    assert search.searched(r.limit(0), t, ["film"]).count() == 0
