"""Mixing to target weights by soft membership, with DataFrame functions alone.

A naive Bayes classifier over the presence of words, fitted on at most SAMPLE labelled rows and on the words whose
presence differs most surely between domains, gives every document a probability of each domain; a domain is a pair of
labels. Rates x >= 0 are then fitted so that the expected tokens of each domain,
sum(x * tokens * probability), come as near to the targets as least squares can: projected gradient steps, each scaled
by the Gram matrix of the domains over the documents whose rate is not 0, from rates of 1. A step is one pass over a
table of tokens and probabilities; a document's rate is a fold over the steps so far, so rates are never moved about,
and the driver sees one row of sums per step.

Cases: null and blank texts have no tokens, the prior's probabilities and a rate like others; null ids are kept;
repeated rows have equal rates; contradicting labels are left out; a domain without labels takes no part, its target
is shared among the others; without labels all documents are of the first domain; an empty table gives no rows; extra
columns are not read by rated() and kept by mixed() under any names.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelforge.llm.shared import drop_durable, durable

SAMPLE = 20_000
TERMS = 4096
LEAST_Z, LEAST_DOCS = 7.0, 5  # how surely, and in how many labelled documents, a term must differ
FILTER_BITS = 20
AGAIN = 1  # the term that stands for a word four times in a row
SEED = 61
#: (quality, toxic) of each domain, and the default share of tokens it should have.
DOMAINS = {"clean": (1, 0), "toxic": (1, 1), "junk": (0, 0), "junk_toxic": (0, 1)}
TARGETS = {"clean": 0.94, "toxic": 0.05, "junk": 0.01, "junk_toxic": 0.0}
STEPS, CLOSE = 12, 1e-9


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"\s+"), lambda w: w != "")


def terms_of(text: Column, split: Column) -> Column:
    """Hashes of a text's words, with repeats, and AGAIN."""
    again = F.when(text.rlike(r"(?:^|\s)(\S+)(?:\s+\1){3}(?:\s|$)"), F.array(F.lit(AGAIN).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.concat(F.transform(split, lambda w: F.xxhash64(w)), F.coalesce(again, F.array().cast("array<long>")))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, domain of at most SAMPLE labelled ids, the same ones each time."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
    agreed = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("q").alias("q"), F.max("q").alias("q1"), F.min("t").alias("t"), F.max("t").alias("t1")).filter("q = q1 and t = t1")
    domain = F.coalesce(*(F.when((F.col("q") == q) & (F.col("t") == t), F.lit(d)) for d, (q, t) in enumerate(DOMAINS.values())))
    return agreed.select("doc_id", domain.alias("domain")).filter("domain is not null").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(SAMPLE)


class Model:
    """Terms, what the presence of each adds to each domain's score, what the absence of all does, and where scores start.

    Scores are log odds against the first domain that has labels.
    """

    def __init__(self, n: np.ndarray, terms: list[int], counts: np.ndarray):
        total = n.sum()
        self.present = [d for d in range(len(n)) if n[d]] or [0]
        self.zero = zero = self.present[0]
        self.start = {d: float(np.log(n[d] / n[zero])) if total else 0.0 for d in self.present}
        self.without = dict.fromkeys(self.present, 0.0)
        self.terms, self.gains = terms, {}
        for d in self.present[1:]:
            share, base = counts[d] / n[d], counts[zero] / n[zero]
            mean = np.clip((counts[d] + counts[zero]) / (n[d] + n[zero]), 1e-9, 1 - 1e-9)
            sure = (share - base) / np.sqrt(mean * (1 - mean) * (1 / n[d] + 1 / n[zero])) >= LEAST_Z
            self.gains[d] = np.where(sure, np.log((counts[d] + 0.5) / (n[d] + 1)) - np.log((counts[zero] + 0.5) / (n[zero] + 1)), 0.0)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labelled(labels)), "doc_id")
    own = durable(own.select("domain", F.array_distinct(terms_of(F.col("text"), words(F.col("text")))).alias("terms")), "labelled-terms")
    n = np.zeros(len(DOMAINS))
    for r in own.groupBy("domain").count().collect():
        n[r.domain] = r["count"]
    found = own.select("domain", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), *(F.count_if(F.col("domain") == d).alias(f"d{d}") for d in range(len(n)))).filter(F.col("df") >= LEAST_DOCS)
    total, z = float(n.sum()), []
    for d, size in enumerate(n):
        if 0 < size < total:
            share, rest, mean = F.col(f"d{d}") / float(size), (F.col("df") - F.col(f"d{d}")) / float(total - size), F.col("df") / total
            z.append((share - rest) / F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-12)) * (1 / size + 1 / (total - size))))
    best = found.withColumn("z", F.greatest(*z, F.lit(0.0))).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(TERMS).collect() if len(z) > 1 else []
    # Of terms that share the bits by which they are found, the surest stays.
    slots: dict[int, object] = {}
    for r in best:
        slots.setdefault(r.term & ((1 << FILTER_BITS) - 1), r)
    best = [slots[k] for k in sorted(slots)]
    model = Model(n, [r.term for r in best], np.array([[r[f"d{d}"] for r in best] for d in range(len(n))], float).reshape(len(n), len(best)))
    if best:
        scored = hit(own, "terms", model)
        none = {r.domain: r for r in scored.groupBy("domain").agg(*(F.count_if(gain(model, d) == 0).alias(f"n{d}") for d in model.present[1:])).collect()}
        for d in model.present[1:]:
            log = [float(np.log((none[e][f"n{d}"] + 0.5) / (n[e] + 1))) for e in (d, model.zero)]
            model.without[d] = log[0] - log[1]
    drop_durable(own)
    return model


def literal(values, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once per row: later columns cannot be merged through a generator into it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def hit(docs: DataFrame, terms: str, model: Model) -> DataFrame:
    """docs with __t, the places in the model's list of the distinct terms that a document holds.

    A term's place is the number of set bits before its own in a map of one bit per hash value: no search.
    """
    bits = np.zeros(1 << FILTER_BITS >> 6, np.uint64)
    for t in model.terms:
        at = t & ((1 << FILTER_BITS) - 1)
        bits[at >> 6] |= np.uint64(1 << (at & 63))
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))[:-1]])
    mask, start, names = literal(bits.view(np.int64).tolist(), "array<long>"), literal(before.tolist(), "array<int>"), literal(model.terms, "array<long>")
    low = lambda h: h.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int")
    word, bit = (lambda h: F.shiftright(low(h), 6)), (lambda h: low(h).bitwiseAND(F.lit(63)))
    is_set = lambda h: F.getbit(F.get(mask, word(h)), bit(h)) == 1
    lower = lambda h: F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit(h)))
    place = lambda h: F.get(start, word(h)) + F.bit_count(F.get(mask, word(h)).bitwiseAND(lower(h)))
    held = once(docs, "__h", F.array_distinct(F.filter(terms, is_set)))
    return once(held, "__t", F.transform(F.filter("__h", lambda h: F.get(names, place(h)) == h), place))


def gain(model: Model, d: int) -> Column:
    values = literal(np.round(model.gains[d], 9).tolist(), "array<double>")
    return F.aggregate("__t", F.lit(0.0), lambda s, i: s + F.get(values, i))


def members(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __tokens and __p, the probability of each domain."""
    held = once(docs, "__w", words(F.col("text")))
    held = once(held, "__all", terms_of(F.col("text"), F.col("__w")))
    held = hit(held, "__all", model).withColumn("__tokens", F.size("__w").cast("long")).drop("__w", "__all", "__h")

    def score(d: int) -> Column:
        if d not in model.present:
            return F.lit(None).cast("double")
        if d == model.zero or not model.terms:
            return F.lit(model.start[d])
        found = gain(model, d)
        return F.lit(model.start[d]) + F.when(found == 0, F.lit(model.without[d])).otherwise(found)

    scored = once(held, "__s", F.array(*(score(d) for d in range(len(DOMAINS))))).drop("__t")
    raised = once(scored, "__e", F.transform("__s", lambda s: F.coalesce(F.exp(s - F.array_max("__s")), F.lit(0.0))))
    total = once(raised, "__sum", F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))
    return once(total, "__p", F.transform("__e", lambda e: e / F.col("__sum"))).drop("__s", "__e", "__sum")


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate after the steps: each takes off p . step and stops at 0."""
    dot = lambda u: F.aggregate(F.zip_with(p, u, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(literal(steps, "array<array<double>>"), F.lit(1.0), lambda x, u: F.greatest(F.lit(0.0), x - dot(u)))


def fitted_steps(table: DataFrame, targets: dict[str, float]) -> list[list[float]]:
    """Steps for rate(); table: __tokens, __p."""
    n, names = len(DOMAINS), list(DOMAINS)
    p = [F.get("__p", F.lit(d)) for d in range(n)]
    steps: list[list[float]] = []
    goal = best = None
    for _ in range(STEPS):
        x = rate(F.col("__p"), steps)
        rows = table.withColumn("__x", x)
        sums = [F.sum(F.col("__x") * F.col("__tokens") * p[d]).alias(f"t{d}") for d in range(n)]
        gram = [F.sum(F.when(F.col("__x") > 0, F.col("__tokens") * p[d] * p[e])).alias(f"g{d}_{e}") for d in range(n) for e in range(d, n)]
        r = rows.agg(*sums, *gram).first()
        have = np.array([r[f"t{d}"] or 0.0 for d in range(n)])
        g = np.array([[r[f"g{min(d, e)}_{max(d, e)}"] or 0.0 for e in range(n)] for d in range(n)])
        if goal is None:
            want = np.array([targets[k] if have[d] > 0 else 0.0 for d, k in enumerate(names)])
            if not want.any():
                return []
            want /= want.sum()
            # As many tokens as leave the domain of the largest share whole.
            goal = want * (have[want.argmax()] / want.max())
        off = have - goal
        size = float(np.abs(off).sum() / goal.sum())
        if best is not None and size > best[0]:  # too far: half the step that led here
            steps[-1] = [u / 2 for u in steps[-1]]
            continue
        best = (size, list(steps))
        if size < CLOSE:
            break
        u = np.linalg.lstsq(g, off, rcond=1e-12)[0]
        steps = [*steps, [float(v) if math.isfinite(v) else 0.0 for v in u]]
    return best[1]


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, a probability for each domain, and the rate of each document."""
    model = fitted(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = durable(members(own, model).select("doc_id", "__tokens", "__p"), "members")
    steps = fitted_steps(held, targets or TARGETS)
    shares = [F.get("__p", F.lit(d)).alias(f"p_{k}") for d, k in enumerate(DOMAINS)]
    return held.select("doc_id", F.col("__tokens").alias("tokens"), *shares, rate(F.col("__p"), steps).alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs, each as often as its rate says: the whole part always, and once more with the chance of the rest, which its id and text fix."""
    model = fitted(docs, labels)
    held = durable(members(docs.select("text"), model).select("__tokens", "__p"), "members")
    steps = fitted_steps(held, targets or TARGETS)
    u = F.pmod(F.xxhash64(F.lit(SEED), F.col("__row.doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(rate(F.col("__p"), steps) + u).cast("int")
    # The row goes along as one value, so that none of its names meets those used here.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "text")
    return members(own, model).select("__row", F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).select("__row.*")
