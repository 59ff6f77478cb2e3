import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from reelforge.llm import language_id, sort_means, vector_codes, whole_vectors

ODD = [None, [], [0.5] * 3, [None] + [0.1] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
SCHEMA = "vec_id long, embedding array<double>, label string, cluster string, x int, v string, code string"


def vectors(rng, n):
    """Clustered vectors with repeats, ties and one far from all."""
    centres = rng.normal(size=(9, 64)) / 4
    rows = [centres[rng.integers(9)] + rng.normal(size=64) / 12 for _ in range(n)]
    rows += [rows[0]] * 30 + [np.zeros(64), np.full(64, 3e5), np.full(64, -1e300)]
    return [[float(c) for c in r] for r in rows]


def table(spark, rows, ids=None, labels=None):
    ids = ids or list(range(len(rows)))
    labels = labels or [str(i % 3) for i in range(len(rows))]
    return spark.createDataFrame([(i, v, k, "a", 1, "b", "c") for i, v, k in zip(ids, rows, labels, strict=True)], SCHEMA)


def clusters_by_loop(data, k, rounds):
    """Every vector with every centroid, in Python's integers."""
    top = whole_vectors.limit_of(64)
    x = [(i, [max(-top, min(top, math.floor(256 * c))) for c in v]) for i, v in data]
    sha = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [list(v) for _, v in sorted(x, key=lambda r: (sha(r[0]), r[1]))[:k]]
    for r in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in x]
        if r == rounds:
            break
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(x, best, strict=True) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sums = defaultdict(int)
    for d, n in best:
        sums[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    cap = whole_vectors.capped
    return sorted((i is None, i or 0, n, d, cap(sums[n]), cap(sum(sums.values())), digest[n]) for (i, _), (d, n) in zip(x, best, strict=True))


def found_clusters(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_equal_a_full_comparison(spark):
    rows = vectors(np.random.default_rng(1), 260)
    ids = [*range(len(rows) - 2), None, 7]  # a null id, and one id of two vectors
    df = table(spark, rows + ODD, ids + list(range(900, 900 + len(ODD))))
    got = found_clusters(sort_means.clustered(df.repartition(3)))
    assert got == clusters_by_loop(list(zip(ids, rows, strict=True)), sort_means.K, sort_means.ROUNDS)
    assert len(got) == len(rows)


def test_few_and_equal_and_no_vectors_cluster(spark):
    rows = vectors(np.random.default_rng(2), 5)[:4] + [[0.25] * 64] * 6
    got = found_clusters(sort_means.clustered(table(spark, rows)))
    assert got == clusters_by_loop(list(enumerate(rows)), sort_means.K, sort_means.ROUNDS)
    empty = sort_means.clustered(table(spark, ODD))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_a_scan_stops_strictly_beyond_twice_the_distance():
    centroids = np.array([[0, 0], [4, 0], [0, -4], [100, 0]])
    others, quarter = sort_means.orders(centroids)
    assert others[0].tolist() == [1, 2, 3]
    x = np.array([[2, 0], [2, 0], [0, -2], [3, 0], [60, 0]])  # the first three lie as near to two centroids
    cluster, distance = sort_means.nearest(x, centroids, others, quarter, np.array([1, 0, 2, 0, 0]))
    assert cluster.tolist() == [0, 0, 0, 1, 3]
    assert distance.tolist() == [4, 4, 4, 1, 1600]


@pytest.mark.parametrize("top", [300, 1 << 23, 1 << 27])
def test_distances_are_exact(top):
    rng = np.random.default_rng(3)
    x, c = rng.integers(-top, top + 1, (40, 64)), rng.integers(-top, top + 1, (7, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
    assert whole_vectors.squared(x, c).tolist() == want


def codes_by_loop(data, rounds=vector_codes.ROUNDS):
    """Codebooks of each length from sums made anew, in Python's integers."""
    out, sums, groups = [], defaultdict(int), defaultdict(list)
    for i, v, label in data:
        top = whole_vectors.limit_of(len(v))
        w = [max(-top, min(top, math.floor(4096 * c))) for c in v]
        w += [0] * (-len(w) % 8)
        n = len(w) // 8
        groups[len(v)].append((i, [w[p * n : p * n + n] for p in range(8)], label))
    for rows in groups.values():
        first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
        books = [[list(r[1][p]) for r in first] for p in range(8)]
        for t in range(rounds + 1):
            best = [[min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p])) for p, part in enumerate(r[1])] for r in rows]
            if t < rounds:
                for p in range(8):
                    for k in range(len(first)):
                        own = [r[1][p] for r, b in zip(rows, best, strict=True) if b[p][1] == k]
                        if own:
                            books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
        for (i, _, label), b in zip(rows, best, strict=True):
            error = sum(d for d, _ in b)
            sums[label] += error
            out.append((i, "".join(f"{k:02x}" for _, k in b), error, label, sha))
    return sorted((i is None, i or 0, c, e, min(sums[label], (1 << 63) - 1), s) for i, c, e, label, s in out)


def found_codes(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes_equal_sums_made_anew(spark):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 200) + [[float(c) for c in rng.normal(size=13)] for _ in range(40)] + [[], [1.5]]
    ids = [*range(len(rows) - 3), None, None, 5]
    labels = [None if i % 5 == 0 else str(i % 2) for i in range(len(rows))]
    wrong = [v for v in ODD if v is None or any(c is None or not math.isfinite(c) for c in v)]
    df = table(spark, rows + wrong, ids + [900] * len(wrong), labels + ["z"] * len(wrong))
    got = found_codes(vector_codes.compressed(df.repartition(3)))
    assert got == codes_by_loop(list(zip(ids, rows, labels, strict=True)))


def test_few_equal_and_no_vectors_are_coded(spark):
    rows = vectors(np.random.default_rng(5), 4)[:3] + [[0.25] * 64] * 5
    got = found_codes(vector_codes.compressed(table(spark, rows)))
    assert got == codes_by_loop([(i, v, str(i % 3)) for i, v in enumerate(rows)])
    empty = vector_codes.compressed(table(spark, [None]))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_many_labels_are_summed_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 2)
    rows = vectors(np.random.default_rng(6), 60)
    labels = [str(i) if i % 3 else None for i in range(len(rows))]
    got = found_codes(vector_codes.compressed(table(spark, rows, labels=labels)))
    assert got == codes_by_loop([(i, v, labels[i]) for i, v in enumerate(rows)])


def test_only_changed_parts_are_sent(spark):
    """After the first round, what tasks send is smaller than all sums and still adds up to them."""
    x = np.random.default_rng(7).integers(-99, 99, (50, 24))
    part, old = vector_codes.parts_of(x), np.random.default_rng(8).integers(0, 4, (50, 8))
    new = old.copy()
    new[:5, 2] = (new[:5, 2] + 1) % 4
    delta = vector_codes.changes(part, old, new, 4)
    assert not delta[[0, 1, 3, 4, 5, 6, 7]].any()
    none = np.full_like(old, -1)
    assert (vector_codes.changes(part, none, old, 4) + delta == vector_codes.changes(part, none, new, 4)).all()
    assert (delta[2].sum(axis=0) == 0).all()


WORDS = {
    "aa": "the and of to in thing other nation every then that hand bread".split(),
    "bb": "der die das und nicht ein heit keit schlagen über wäre können".split(),
    "cc": "не что это был как она только время люди дело".split(),
}


@pytest.fixture(scope="module")
def spoken(spark):
    pick, rows = random.Random(9), []
    for i in range(900):
        lang = pick.choice(list(WORDS))
        words = [pick.choice(WORDS[lang]) for _ in range(pick.choice([1, 5, 40, 300]))]
        rows.append((i, " ".join(w.upper() if pick.random() < 0.1 else w for w in words), lang if i % 7 else None, lang))
    odd = [(None, "the other thing", "aa", "aa"), (5000, None, "bb", None), (5001, "", "bb", None), (5002, "12 $$ 34\n_", "aa", None), (5003, "время " * 120_000, None, "cc"), (5004, "x" * 700_000, None, None), rows[3], rows[3]]
    return rows + odd, spark.createDataFrame([(i, t, k, "s", True) for i, t, k, _ in rows + odd], "doc_id long, text string, lang string, score string, held_out boolean")


def test_languages_of_held_out_documents(spoken):
    rows, docs = spoken
    got = language_id.identified(docs).collect()
    assert len(got) == len(rows)
    text = {i: (t, lang) for i, t, _, lang in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert r.lang_pred in (*WORDS, "und")
        if text[r.doc_id][0] is None or not any(c.isalpha() for c in text[r.doc_id][0]):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred != "und"
    fold = [r for r in got if r.held_out and text[r.doc_id][1]]
    assert np.mean([r.lang_pred == text[r.doc_id][1] for r in fold]) > 0.97
    sure = [r for r in fold if not r.rejected]
    assert len(sure) > 0.9 * len(fold)
    assert np.mean([r.lang_pred == text[r.doc_id][1] for r in sure]) >= 0.98
    assert next(r for r in got if r.doc_id == 5003).lang_pred == "cc"
    assert {(r.lang_pred, r.score) for r in got if r.doc_id == 3} == {next((r.lang_pred, r.score) for r in got if r.doc_id == 3)}


def test_held_out_labels_are_not_learnt(spoken, spark):
    rows, docs = spoken
    hidden = docs.filter(language_id.held_out(docs.doc_id) | docs.doc_id.isNull() | docs.lang.isNull() | docs.text.isNull())
    assert hidden.filter("lang is not null").count() > 50
    model = language_id.trained(hidden)
    assert model.langs == ()
    assert {(r.lang_pred, r.score, r.rejected) for r in language_id.identified(hidden).collect()} == {("und", 0.0, True)}
    swapped = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 5 = 0 then 'zz' else lang end as lang")
    assert (language_id.trained(swapped).table == language_id.trained(docs).table).all()


def test_scores_do_not_depend_on_windows_or_neighbours(spoken, monkeypatch):
    rows, docs = spoken
    model = language_id.trained(docs)
    texts = [t for _, t, _, _ in rows if t is None or len(t) < 5000]
    whole, count = model.logits(texts)
    alone = [model.logits([t]) for t in texts]
    assert np.allclose(whole, np.concatenate([a for a, _ in alone]))
    assert count.tolist() == [int(c[0]) for _, c in alone]
    monkeypatch.setattr(language_id, "_TOGETHER", 400)
    monkeypatch.setattr("reelforge.llm.words.WINDOW", 97)
    cut, again = model.logits(texts)
    assert np.allclose(cut, whole)
    assert (again == count).all()


def test_subwords_by_hand():
    got, owner = language_id.together(["Ab c", "", "7 d"])
    assert [len(x) for x in got] == [4, 7, 4, 1, 0]  # of _ab_c_d_
    assert np.concatenate(owner).tolist().count(2) == 4  # d, _d, d_ and _d_
    assert np.concatenate(owner).tolist().count(0) == 12
    same, _ = language_id.together(["ab", "AB"])
    assert all((x[: len(x) // 2] == x[len(x) // 2 :]).all() for x in same)


def test_tagged_keeps_columns_and_calibration_rejects(spoken, spark):
    rows, docs = spoken
    model = language_id.trained(docs)
    out = language_id.tagged(docs, model)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.columns[len(docs.columns) :] == ["lang_pred", "score_", "rejected"]
    assert language_id.tagged(docs.limit(0), model).count() == 0
    assert language_id.identified(docs.limit(0)).count() == 0
    y = np.array([0, 0, 1, 1])
    fit = language_id.calibrated(model, np.array([[9.0, 0, 0], [8.0, 0, 0], [0, 7.0, 0], [1.0, 0.9, 0]]), y)
    assert fit.threshold > language_id.softmax(np.array([[1.0, 0.9, 0]]) / fit.temperature).max()
    assert fit.threshold <= language_id.softmax(np.array([[0, 7.0, 0]]) / fit.temperature).max()
    one = spark.createDataFrame([(1, "abc", "aa"), (2, "...", "aa"), (3, "дом", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identified(one).collect()} == {1: ("aa", 1.0), 2: ("und", 0.0), 3: ("aa", 1.0)}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_small_tables_are_learnt_too(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    fold = [r for r in language_id.identified(docs).collect() if r.held_out]
    assert len(fold) > 20
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in fold]) > 0.97
