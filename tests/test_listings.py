"""Signatures against big integers, reference tracks against plain loops, and the odd cases of lists."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from reelforge.functions import signature as G
from reelforge.operators import listings as L
from reelforge.sources.json_rows import batched_ratings


def mixed(values):
    h = 0xCBF29CE484222325
    for v in values:
        h = ((h ^ (v % 2**64)) * 1099511628211) % 2**64
    return f"{h:x}"


def units(text):
    raw = (text or "").encode("utf-16-be")
    codes = [int.from_bytes(raw[i : i + 2]) for i in range(0, len(raw), 2)]
    return [len(codes), *codes]


def test_signatures_wrap_like_64_bit_numbers(spark):
    pick = random.Random(1)
    rows = [(pick.choice([None, "", "a", "é😀", "x" * pick.randrange(40)]), pick.choice([None, True, False]), pick.choice([None, 0, -1, 2**31 - 1, -(2**31)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "t string, f boolean, n int")
    got = df.select("t", "f", "n", G.signature(G.of_text(F.col("t")), G.of_flag(F.col("f")), G.of_number(F.col("n"))).alias("s")).collect()
    for r in got:
        assert r.s == mixed([*units(r.t), int(bool(r.f)), -(2**31) if r.n is None else r.n])
    edges = [2**63 - 1, -(2**63), -1, 0, 1, 0x7FFFFFFF, -0x80000000]
    out = spark.createDataFrame([(h,) for h in edges], "h long").select("h", G.multiplied(F.col("h")).alias("m")).collect()
    assert all(r.m % 2**64 == r.h * 1099511628211 % 2**64 for r in out)


def affinity_by_loop(reference, target):
    def sampled(x, most):
        if len(x) <= most:
            return list(x)
        return list(dict.fromkeys(x[i * (len(x) - 1) // (most - 1)] for i in range(most)))

    r, t = sampled(reference, 24), sampled(target, 32)
    scales = [1.0, 25 / 23.976, 23.976 / 25, 25 / 24, 24 / 25, 24 / 23.976, 23.976 / 24]
    ratio = (reference[-1] - reference[0]) / (target[-1] - target[0])
    if 0.94 <= ratio <= 1.06 and all(abs(s - ratio) >= 0.00035 for s in scales):
        scales.append(ratio)
    best = 0.0
    for s in scales:
        for k in range(4):
            offset = r[k * (len(r) - 1) // 3] - math.floor(t[k * (len(t) - 1) // 3] * s + 0.5)
            near = [min(abs(x - math.floor(y * s + 0.5) - offset) for x in reference) for y in t]
            hits = [n for n in near if n <= 1800]
            if hits:
                best = max(best, len(hits) / len(t) * 0.8 + math.exp(-sum(hits) / len(hits) / 900) * 0.2)
    return min(best, 1.0)


def test_affinity_equals_a_loop():
    rng = np.random.default_rng(2)
    for n, m in ((4, 4), (10, 50), (90, 33), (30, 30)):
        a = np.sort(rng.integers(0, 400_000, n))
        b = np.sort(np.concatenate([a[: m // 2] + 3000, rng.integers(0, 400_000, m)]))[:m]
        assert abs(L.affinity(a, b) - affinity_by_loop(a.tolist(), b.tolist())) < 1e-12
    assert L.affinity(a[:3], b) == 0.0
    assert L.affinity(a, a) == 1.0


def test_reference_tracks_in_order(spark):
    pick = random.Random(3)
    film, at = [], 1000
    for _ in range(40):
        film.append((at, at + pick.randrange(900, 2000)))
        at += pick.randrange(2500, 7000)
    tracks = {"b": film, "a": film, "c": [(s + 200, e + 200) for s, e in film], "d": [(s * 2, e * 2) for s, e in film[::3]]}
    refs = spark.createDataFrame([("f", k, s, e) for k, v in tracks.items() for s, e in v] + [("g", "z", 5, 9)], "film string, track string, start long, end long")
    labels = spark.createDataFrame([("f", "a", "English [SDH]", False), ("f", "b", None, None), ("f", "c", None, True), ("f", "d", "x", False), ("g", "z", None, None)], "film string, track string, label string, sound boolean")
    target = spark.createDataFrame([("f", s, e) for s, e in film], "film string, start long, end long")
    got = L.ranked_references(refs, labels, target, "film", F.lit(False)).orderBy("place").collect()
    assert [(r.track, r.sdh) for r in got] == [("b", False), ("c", True), ("d", False)]  # a has b's times, and is for the hard of hearing
    assert [round(r.affinity, 6) for r in got][:2] == [1.0, 1.0]
    assert abs(got[0].suitability - 1.0) < 1e-12
    wanted = L.ranked_references(refs, labels, target, "film", F.col("track") == "d").orderBy("place").first()
    assert wanted.track == "d"


def test_odd_lists(spark):
    kind = "source long, enabled boolean, active boolean, catalogs array<struct<type:string,id:string,name:string,extra:array<struct<name:string,required:boolean,options:array<string>>>>>"
    rows = [
        (1, True, True, [("movie", "a", "A", None), ("movie", "b", "B", [("search", True, None)]), ("tv", "c", "C", [("genre", True, ["x"]), ("genre", False, ["y"]), ("skip", None, None)])]),
        (2, False, True, [("movie", "d", "D", [])]), (3, True, False, None), (4, True, None, []),
    ]
    df = spark.createDataFrame(rows, kind)
    assert [tuple(r) for r in L.flat_catalogs(df).orderBy("place").collect()] == [(1, 0, "movie", "a", "A", [], False), (1, 2, "tv", "c", "C", ["x"], True)]
    assert tuple(L.overview(df).first()) == (4, 2, 3)
    assert tuple(L.overview(df.limit(0)).first()) == (0, 0, 0)
    r = spark.createDataFrame([(1, "v1.2.0", None, False, False), (2, "x", "1.10", None, None), (3, "2.0.0-rc.1", None, False, False), (4, "3.0", "Some beta", False, False), (5, "9", None, True, False), (6, None, None, False, False), (7, "4.0", None, False, True)], "i int, tag string, name string, draft boolean, prerelease boolean").withColumn("k", F.lit(1))
    assert [x.i for x in L.eligible_releases(r, ["k"], F.lit(False), ["i"]).orderBy("place").collect()] == [2, 1]
    assert [x.i for x in L.eligible_releases(r, ["k"], F.lit(True), ["i"]).orderBy("place").collect()] == [7, 4, 3, 2, 1]
    p = spark.createDataFrame([(1, "a", " "), (2, "b", "1999-01-01"), (3, " ", "1990-01-01"), (4, "c", None), (5, None, "1980")], "i int, title string, release_date string").withColumn("k", F.lit(1))
    assert [x.i for x in L.collection_parts(p, ["k"], ["i"]).orderBy("place").collect()] == [2, 1, 4]


def test_batched_ratings(spark):
    payload = '[{"imdb_id":"tt1","ratings":[{"source":"imdb","value":7}]},{"ids":{"tmdb":3,"imdb":"tt2"},"ratings":[{"source":"mal","value":"8"}]},{"imdbid":"tt1","ratings":[{"source":"imdb","value":9}]},{"ratings":[{"source":"imdb","value":1}]},{"imdb_id":"tt3"}]'
    df = spark.createDataFrame([(1, payload), (2, "nonsense"), (3, None)], "k int, payload string")
    assert sorted(map(tuple, batched_ratings(df, ["k"]).collect())) == [(1, "tt1", "imdb", 9.0), (1, "tt2", "mal", 8.0)]
