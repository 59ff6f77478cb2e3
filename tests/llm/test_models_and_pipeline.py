import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from reelforge.llm import minhash, mixing, quality, secrets, sentencepiece_scan
from reelforge.llm.shared import read_table
from reelforge.llm.vocab import vocabulary

SMALL = "/root/testdata/sf0.001"
COMMON, RARE = [f"the{i}" for i in range(60)], [f"r{i}" for i in range(4000)]


def prose(pick, n):
    return " ".join(pick.choice(COMMON) if pick.random() < 0.6 else pick.choice(RARE) for _ in range(n))


def made(seed, n):
    """(doc_id, text, quality, toxic): junk is upper case with marks or repeats; toxic prose holds some of ten words."""
    pick, out = random.Random(seed), []
    for i in range(n):
        text, q, t = prose(pick, pick.randrange(30, 200)), 1, 0
        if i % 7 == 0:
            q, text = 0, " ".join(f"{w.upper()}!!" for w in text.split()) if i % 3 else " ".join([pick.choice(RARE)] * 60)
        elif i % 7 == 1:
            w = text.split()
            for _ in range(6):
                w.insert(pick.randrange(len(w)), f"bad{pick.randrange(10)}")
            text, t = " ".join(w), 1
        out.append((i, text, q, t))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = made(1, 900)
    odd = [(2000, None, 1, 0), (2001, "", 1, 0), (2002, " \n ", 1, 0), (None, prose(random.Random(2), 50), 1, 0), (5, rows[5][1], 1, 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows + odd], "doc_id long, text string, __times string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i % 2 == 0] + [(4, 0, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_quality_held_out(labelled):
    rows, docs, labels = labelled
    got = {r.doc_id: r for r in quality.resampled(docs, labels).collect()}
    held = [(q, got[i].kept) for i, _, q, _ in rows if i % 2 == 1]
    assert np.mean([k for q, k in held if q]) > 0.98
    assert np.mean([not k for q, k in held if not q]) > 0.95
    assert not any(got[i].kept for i in (2000, 2001, 2002))
    kept = quality.selected(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in quality.resampled(docs, labels).filter("kept").collect())
    assert quality.selected(docs.limit(0), labels).count() == 0
    assert quality.resampled(docs, labels.limit(0)).filter("kept").count() == len(rows) + 2


def test_quality_counts_equal_a_loop(labelled):
    _, docs, labels = labelled
    table, prior = quality.fitted(docs, labels)
    sample = {r.doc_id for r in quality.labelled(labels)[0].collect()}
    sums = np.zeros((2, quality.WIDTH), np.int64)
    for r in docs.collect():
        x = np.bincount(quality.ngrams(r.text), minlength=quality.WIDTH)
        sums[0] += x
        sums[1] += x if r.doc_id in sample else 0
    assert np.allclose(table, quality.log_ratio(sums[1], sums[0]))
    assert 0.8 < prior < 0.9


def test_quality_rows_equal_a_loop(labelled):
    _, docs, labels = labelled
    table, prior = quality.fitted(docs, labels)
    got = quality.resampled(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    scored = [r for r in got if r.log_weight is not None]
    assert all(r.log_weight == pytest.approx(table[quality.ngrams(texts[r.doc_id])].sum()) for r in scored)
    assert all(not len(quality.ngrams(texts[r.doc_id])) for r in got if r.log_weight is None)
    k = round(sum(min(1.0, prior * np.exp(min(r.log_weight, 50.0))) for r in scored))
    cut = sorted((r.gumbel_key for r in scored), reverse=True)[k - 1]
    assert all(r.kept == (r.log_weight is not None and r.gumbel_key >= cut) for r in got)
    assert len({r.gumbel_key - r.log_weight for r in scored}) > 0.9 * len(scored)


def test_kth_largest(spark):
    values = [random.Random(3).choice([1.5, 2.5, 7.0]) if i % 3 else i * 0.37 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 700, 1999, 2000):
        assert quality.kth_largest(df, "v", k, bins=16, few=20) == sorted(values, reverse=True)[k - 1]


def test_mixing_meets_targets(labelled):
    rows, docs, labels = labelled
    got = mixing.rated(docs, labels).toPandas()
    w = got.tokens * got.rate
    for k, share in mixing.TARGETS.items():
        assert (w * got[f"p_{k}"]).sum() / w.sum() == pytest.approx(share, abs=0.02)
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    names = list(mixing.DOMAINS)
    right = [max(names, key=lambda k: by.loc[i, f"p_{k}"]) == next(k for k, v in mixing.DOMAINS.items() if v == (q, t)) for i, _, q, t in rows if i % 2 == 1]
    assert np.mean(right) > 0.93
    assert (got.rate >= 0).all()
    clean = [by.loc[i, "rate"] for i, _, q, t in rows if (q, t) == (1, 0)]
    assert np.mean(clean) == pytest.approx(1, abs=0.05)
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    assert out.count() == pytest.approx(got.rate.sum(), rel=0.05)
    for empty in (mixing.rated(docs.limit(0), labels), mixing.mixed(docs.limit(0), labels)):
        assert empty.count() == 0
    assert set(mixing.rated(docs, labels.limit(0)).toPandas().rate.round(9)) == {1.0}


def test_mixing_rates_equal_a_loop(labelled):
    _, docs, labels = labelled
    got = mixing.rated(docs, labels).toPandas()
    p, n = got[[f"p_{k}" for k in mixing.DOMAINS]].to_numpy(), got.tokens.to_numpy()
    x, best = np.ones(len(n)), None
    want = np.array(list(mixing.TARGETS.values()))
    have = (n[:, None] * p).sum(axis=0)
    want = np.where(have > 0, want, 0)
    want /= want.sum()
    goal = want * have[want.argmax()] / want.max()
    steps = []
    for _ in range(mixing.STEPS):
        x = np.ones(len(n))
        for u in steps:
            x = np.maximum(0, x - p @ u)
        off = ((x * n)[:, None] * p).sum(axis=0) - goal
        size = np.abs(off).sum() / goal.sum()
        if best is not None and size > best[0]:
            steps[-1] = steps[-1] / 2
            continue
        best = (size, x)
        if size < mixing.CLOSE:
            break
        on = x > 0
        steps.append(np.linalg.lstsq((p[on] * n[on, None]).T @ p[on], off, rcond=1e-12)[0])
    assert np.allclose(got.rate, best[1], atol=1e-6)


def test_names_of_other_columns_never_clash(spark, labelled):
    rows, docs, labels = labelled
    names = ["__log_weight", "__p", "__id", "__row", "__tokens", "__w", "__s", "__e", "__copy", "__at", "id", "h", "id_", "h_", "at", "k1", "rep", "samples", "target", "block", "a.b"]
    wide = docs.select("doc_id", "text", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for out, plain in ((quality.selected(wide, labels), quality.selected(docs, labels)), (mixing.mixed(wide, labels), mixing.mixed(docs, labels)), (minhash.deduplicated(wide), minhash.deduplicated(docs)), (secrets.redacted(wide), secrets.redacted(docs))):
        got = out.collect()
        assert out.columns == wide.columns
        assert len(got) == plain.count()
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in got)


def test_pipeline_stages_against_loops(spark):
    docs = read_table(spark, SMALL, "documents")
    kept = corpus_pipeline.quality_classifier(spark, docs, SMALL)
    labels = {r.doc_id: r.quality for r in read_table(spark, SMALL, "labels").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in ids) == bool(q) for i, q in labels.items()]) > 0.95
    rows = {r.doc_id: r.text for r in kept.collect()}
    idf = minhash.fitted_idf(kept)
    sets = {i: minhash.weighted_set(t) for i, t in rows.items()}
    parent = {i: i for i in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and minhash.similarity(sets[a], sets[b], idf) >= 0.8:
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    once = corpus_pipeline.near_duplicates(spark, kept, SMALL)
    assert {r.doc_id for r in once.collect()} == {i for i in rows if parent[i] == i}
    clean = corpus_pipeline.secret_scan(spark, once, SMALL)
    for r in clean.collect():
        assert r.text == secrets.redact(rows[r.doc_id])
        assert r.n_chars == len(r.text)
        assert not secrets.find(r.text)
    mixed = corpus_pipeline.mix(spark, clean, SMALL)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.tokens(spark, mixed, SMALL).collect()
    assert len(out) == mixed.count()
    assert all(r.round_trip for r in out)
    p = sentencepiece_scan.pieces(vocabulary("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert all(p.decode(np.array(r.token_ids))[1:].decode() == texts[r.doc_id] for r in out)
    assert all(len(r.token_ids) == r.n_tokens for r in out)


def test_run_equals_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "secrets", "mixing", "sentencepiece"]
    docs = read_table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    key = lambda df: sorted((r.doc_id, r.ids_crc32) for r in df.collect())
    assert key(docs) == key(corpus_pipeline.run(spark, SMALL))
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {x if x == "pipeline" else x.split("_")[0] + "_" for x in __spark_entry__.queries()}
