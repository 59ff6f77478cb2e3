import itertools
import math
import random
from collections import defaultdict

import numpy as np

from reelforge.llm import embedding_dedup, minhash, shared, simhash, words


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_equal_union_find(spark):
    pick = random.Random(2)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = components(real, {x for e in real for x in e})
    assert got == want
    assert shared.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_summed_vectors(spark):
    def rows(batches):
        for b in batches:
            x = np.zeros(9000, np.int64)
            for i in b["id"].to_pylist():
                x[i * 7 % 9000] += i
            yield shared.vector_rows(1, x)

    got = shared.summed_vectors(spark.range(0, 5000, 1, 7).mapInArrow(rows, shared.VECTOR_SCHEMA), 2, 9000)
    want = np.zeros(9000, np.int64)
    for i in range(5000):
        want[i * 7 % 9000] += i
    assert not got[0].any()
    assert (got[1] == want).all()


def near(base, degrees, rng):
    side = rng.normal(size=len(base))
    side -= side @ base * base
    return math.cos(math.radians(degrees)) * base + math.sin(math.radians(degrees)) * side / np.linalg.norm(side)


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x)
    rows = [unit(rng.normal(size=24)) for _ in range(400)]
    base = unit(rng.normal(size=24))
    rows += [near(base, rng.uniform(5, 24), rng) for _ in range(60)] + [rows[0]] * 5 + [rows[1] * 3] + [near(rows[k], 25, rng) for k in range(10, 40)]
    data = [(i, [float(v) for v in np.float32(x)], "x") for i, x in enumerate(rows)]
    odd = [(900, None, "x"), (901, [0.0] * 24, "x"), (902, [float("nan")] * 24, "x"), (903, [None] * 24, "x"), (904, [1.0, 2.0], "x"), (None, [1.0] * 24, "x"), (905, [float("inf")] * 24, "x"), (906, [], "x")]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, rep string")).collect()}
    assert len(got) == len(data) + len(odd)
    x = np.array([d[1] for d in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = x @ x.T >= 0.9
    edges = [(i, j) for i, j in zip(*np.nonzero(hits), strict=True) if i < j]
    comp = components(edges, range(len(x)))
    linked = sum(got[i].n_links == hits[i].sum() - 1 for i in range(len(x)))
    assert linked >= 0.97 * len(x)  # pairs just at the limit may share too few pivots
    assert sum(r.n_links for i, r in got.items() if i is not None) >= 0.97 * (hits.sum() - len(x))
    assert all(got[i].n_links <= hits[i].sum() - 1 for i in range(len(x)))
    assert sum(got[i].component_id == comp[i] for i in range(len(x))) >= 0.97 * len(x)
    for i, _, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embedding_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    base /= np.linalg.norm(base)
    rows = [near(base, rng.uniform(0, 20), rng) for _ in range(90)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array(rows)
    assert got == {i: int((x[i] @ x.T >= 0.9).sum() - 1) for i in range(90)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_lists_are_dealt_in_waves_whose_bytes_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    x[250:] = x[:250] + rng.normal(size=(250, 16)).astype(np.float32) * 0.05
    x[7] = 0
    x[7, 3] = 1
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    df = df.unionByName(df.filter("vec_id = 7").selectExpr("1007L as vec_id", "transform(embedding, x -> cast(-0.0 as float) + x) as embedding"))
    whole = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    u = np.concatenate([x, x[7:8]]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert [r[1] for r in whole] == ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()
    names, made = [], embedding_dedup.durable
    monkeypatch.setattr(embedding_dedup, "durable", lambda t, name: names.append(name) or made(t, name))
    monkeypatch.setattr(embedding_dedup, "WAVE_BYTES", 1_000_000)
    index = embedding_dedup.described(embedding_dedup.classes_of(df), embedding_dedup.pivots_of(embedding_dedup.classes_of(df), 500))
    copies = index.selectExpr("sum(size(near))").first()[0]
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == whole
    assert names.count("links") == -(-copies * (64 + 128) // 1_000_000) > 2


def test_a_long_list_is_sent_once_for_each_block_of_those_at_home(spark, monkeypatch):
    """And not once for each block of all its vectors: beyond the most pivots, lists grow with the table."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[300:] = x[:300] + rng.normal(size=(300, 24)).astype(np.float32) * 0.1
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    names, made = [], embedding_dedup.durable
    monkeypatch.setattr(embedding_dedup, "durable", lambda t, name: names.append(name) or made(t, name))
    monkeypatch.setattr(embedding_dedup, "WAVE_BYTES", 2_000_000)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 256)
    classes = embedding_dedup.classes_of(df)
    near = [r.near for r in embedding_dedup.described(classes, embedding_dedup.pivots_of(classes, 600)).collect()]
    blocks = {p: -(-sum(p in r for r in near) // 256) for p in range(64)}
    all_in_blocks = sum(blocks[p] for r in near for p in r) * (96 + 128)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()))
    assert max(blocks.values()) > 1
    assert 1 < names.count("links") < all_in_blocks // 2_000_000


def test_embeddings_of_each_length_are_linked(spark):
    rng = np.random.default_rng(8)
    rows, at = [], 0
    for d, n in ((16, 30), (8, 12), (5, 1), (3, 1)):
        base = rng.normal(size=d)
        base /= np.linalg.norm(base)
        rows += [(at + i, [float(v) for v in near(base, rng.uniform(0, 20), rng)]) for i in range(n)]
        at += 100
    rows += [(290, rows[-2][1]), (100, rows[0][1])]  # a copy, and an id of two lengths
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = []
    for i, v in rows:
        same = [(j, u) for j, u in rows if len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9]
        want.append((i, len(same) - 1, min(j for j, _ in same)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)


def test_tight_cluster_loses_no_link(spark):
    rng = np.random.default_rng(5)
    base = np.zeros(64)
    base[0] = 1
    tight = [base + rng.normal(size=64) * 0.3246 / 8 for _ in range(1200)]
    loose = [rng.normal(size=64) for _ in range(400)]
    mixed = [0.866 * base + 0.5 * u / np.linalg.norm(u) for u in rng.normal(size=(300, 64))]  # apart, around one centre
    mixed += [0.866 * base + 0.5 * (0.8 * (m - 0.866 * base) / 0.5 + 0.6 * u / np.linalg.norm(u)) for m, u in zip(mixed, rng.normal(size=(300, 64)), strict=True)]
    x = np.array(tight + loose + mixed)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    exact = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, pivots=1).collect()}
    assert exact == dict(enumerate(want.tolist()))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_vectors_with_a_common_direction_lose_no_link(spark, monkeypatch):
    """Pivots of a large table: 8,192 of other vectors of the kind, all about as far from each vector."""
    rng = np.random.default_rng(7)
    d, n, share = 384, 3000, 0.75  # share: the cosine of two of the vectors
    mean = np.zeros(d)
    mean[0] = math.sqrt(share)

    def sides(count):
        x = rng.normal(size=(count, d))
        x[:, 0] = 0
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    a, b = sides(n // 2), sides(n // 2)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    t = (0.905 - share) / (1 - share)
    x = np.concatenate([mean + math.sqrt(1 - share) * y for y in (a, t * a + math.sqrt(1 - t * t) * b)])
    pivots = mean + math.sqrt(1 - share) * sides(8192)
    monkeypatch.setattr(embedding_dedup, "pivots_of", lambda *_: pivots / np.linalg.norm(pivots, axis=1, keepdims=True))
    df = spark.createDataFrame(list(zip(range(n), x.tolist(), strict=True)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert want.sum() >= n
    assert got == dict(enumerate(want.tolist()))


VOCABULARY = [f"w{i}" for i in range(3000)]


def corpus(seed):
    pick = random.Random(seed)
    texts = [" ".join(pick.choices(VOCABULARY, k=pick.randrange(3, 160))) for _ in range(120)]
    for k in range(0, 40, 2):
        w = texts[k].split()
        for _ in range(1 + k // 12):
            w[pick.randrange(len(w))] = pick.choice(VOCABULARY)
        texts.append(" ".join(w))
    base = " ".join(pick.choices(VOCABULARY, k=200)).split()
    for _ in range(30):  # a family around a text that is not there
        w = list(base)
        for _ in range(pick.randrange(1, 7)):
            w[pick.randrange(200)] = pick.choice(VOCABULARY)
        texts.append(" ".join(w))
    return [*texts, texts[0], texts[0].upper(), "same passage here " * 50, "one two", "one two"]


def test_minhash_groups_equal_brute_force(spark):
    texts = corpus(7)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (501, "", "x"), (502, " .. ", "x"), (None, texts[0], "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, samples string")
    own = docs.select("doc_id", "text").filter("doc_id is not null").withColumnRenamed("doc_id", "id")
    idf = minhash.fitted_idf(docs)
    sets = {i: minhash.weighted_set(t) for i, t in enumerate(texts)}
    shared_by = defaultdict(list)
    for i, (s, _) in sets.items():
        for x in s.tolist():
            shared_by[x].append(i)
    pairs = {p for v in shared_by.values() for p in itertools.combinations(v, 2)}
    want = components([p for p in pairs if minhash.similarity(sets[p[0]], sets[p[1]], idf) >= 0.8], range(len(texts)))
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert own.count() == len(rows) - 1
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 500}
    assert {i: by[i].component_id for i in range(len(texts))} == want
    assert sum(r.kept for r in got if r.doc_id == 3) <= 1
    for i in (500, 501, 502, None):
        assert next(r for r in got if r.doc_id == i).kept
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.filter("doc_id < 500").collect())
    assert ids == sorted(set(want.values()))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.deduplicated(docs.limit(0)).count() == 0


def test_minhash_takes_each_text_of_an_id(spark):
    pick = random.Random(12)
    a, b, c = (" ".join(pick.choices(VOCABULARY, k=60)) for _ in range(3))
    rows = [(1, a), (1, b), (1, c), (2, a + " more"), (3, b + " more"), (4, c.upper()), (1, c), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, False), *[(1, 1, True)] * 3, (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True), (5, 5, True)]
    kept = minhash.deduplicated(docs).collect()
    assert sorted((r.doc_id, r.text or "-") for r in kept) == sorted([(1, a), (1, b), (1, c), (5, "-"), (5, "-")])
    # Texts of one id that are near each other are one group, of which one stays.
    near = spark.createDataFrame([(1, a), (1, a + " more"), (1, b), (2, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in minhash.near_duplicates(near).collect()) == [(1, False), (1, True), (1, True), (2, False)]
    assert minhash.deduplicated(near).count() == 2


def test_minhash_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(corpus(9))), "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want


def test_samples_estimate_weighted_similarity():
    rng, sampler = np.random.default_rng(1), minhash.Sampler()
    for target in (0.5, 0.8):
        off = []
        for _ in range(60):
            n = 300
            k = round(2 * n * target / (1 + target))
            s = rng.integers(0, 1 << 63, 2 * n - k, dtype=np.int64).astype(np.uint64)
            w = dict(zip(s.tolist(), rng.choice([1.0, 2.0, 4.0], len(s)), strict=True))
            a, b = np.sort(s[:n]), np.sort(s[n - k :])
            wa, wb = (np.array([w[x] for x in y.tolist()]) for y in (a, b))
            both = sum(w[x] for x in s[n - k : n].tolist())
            off.append((sampler(a, wa) == sampler(b, wb)).mean() - both / (wa.sum() + wb.sum() - both))
        assert abs(np.mean(off)) < 0.02


def test_words_and_windows(monkeypatch):
    import re

    text = "Ärger, straße_9  ÉTÉ\n" * 50
    whole = words.word_hashes(text)
    assert len(whole) == len(re.findall(r"\w+", text.lower()))
    monkeypatch.setattr(words, "WINDOW", 64)
    words._powers.cache_clear()
    assert (words.word_hashes(text) == whole).all()
    words._powers.cache_clear()
    assert not len(words.word_hashes(None))
    assert len(words.shingle_hashes(whole[:3], 5)) == 1
    assert not len(words.shingle_hashes(whole[:0], 5))


def test_simhash_edits_and_likeness(spark):
    import hashlib

    pick = random.Random(5)
    texts = [" ".join(pick.choices(VOCABULARY, k=pick.randrange(1, 60))) for _ in range(40)] + ["", None, "é" * 9, "x" * 5000]
    ids = pick.sample(range(1000), len(texts))
    rows = [*zip(ids, texts, ["x"] * len(texts), strict=True), (None, "no id here at all", "x"), (ids[0], texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.compared(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((i is not None, i or 0, t or "") for i, t, _ in rows))
    want = []
    for k, (_, i, t) in enumerate(order):
        other, half = order[k - 1][2], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    fp = {}
    for r in got:
        t = next((t or "") for i, t, _ in rows if i == r.doc_id)
        assert fp.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_edited == 1 - bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1") / 64
    for k, (_, i, t) in enumerate(order[1:], 1):
        r = next(r for r in got if (r.doc_id or 0) == i and r.n_chars == len(t))
        if i != ids[0]:
            assert r.near_next == 1 - bin(int(fp[t], 16) ^ int(fp[order[k - 1][2]], 16)).count("1") / 64
    assert simhash.compared(docs.limit(0)).count() == 0
    one = simhash.compared(docs.filter(f"doc_id = {ids[3]}")).collect()
    assert one[0].near_next == 1.0


def test_near_fingerprints_are_counted(spark):
    pick = random.Random(11)
    base = pick.choices(VOCABULARY, k=400)
    texts = [" ".join(pick.choices(VOCABULARY, k=30)) for _ in range(20)] + ["", "", None] + [" ".join(base)] * 3
    for k in range(12):
        texts.append(" ".join([*base[: 390 + k % 3], "x", *base[395:]]))
    got = simhash.fingerprinted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert len(got) == len(texts)
    for r in got:
        assert r.n_near == sum(bin(fps[r.doc_id] ^ f).count("1") <= 3 for f in fps.values()) - 1
    assert max(r.n_near for r in got) > 3


def test_simhash_votes(spark):
    import pyspark.sql.functions as F

    rows = [(1, "a b c d e f g"), (2, "a b"), (3, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    hashes = {r.id: r.t for r in df.select("id", simhash.terms(F.col("text")).alias("t")).collect()}
    assert [len(hashes[i]) for i in (1, 2, 3)] == [3, 1, 0]
    for r in simhash.fingerprints(df, "text", ["id"]).collect():
        t = hashes[r.id]
        assert r.fp % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum((x % (1 << 64)) >> b & 1 for x in t) > len(t))


def test_fingerprints_within_radius(spark):
    pick = random.Random(6)
    fps = [pick.getrandbits(64) for _ in range(150)]
    for k in range(60):
        x = fps[k]
        for b in pick.sample(range(64), k % 5):
            x ^= 1 << b
        fps.append(x)
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    df = spark.createDataFrame([(x,) for x in signed + signed[:5]] + [(None,)], "fp long")
    for radius in (0, 1, 3):
        want = {(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) % (1 << 64)).count("1") <= radius}
        assert {(r.a, r.b) for r in simhash.within_radius(df, radius).collect()} == want
