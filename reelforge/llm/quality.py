"""Quality classifier: importance resampling.

Two generative models of hashed n-grams are fitted, of the target (labelled rows of quality 1) and of all raw text. The
log of their ratio, summed over a text's n-grams, is its log importance weight; the documents with the largest weight
plus Gumbel noise are kept, which draws without replacement in proportion to the weights. The number kept is the
expected number of target documents among the raw ones, sum(min(1, prior * weight)), with the labelled share of
quality 1 as the prior.

N-grams are words, pairs of words and triples of token shapes; a token is a run of word characters or of other visible
characters, its shape says its kind of letters and whether it repeats the word before it. The target model is fitted on
at most SAMPLE labelled rows; the raw model, the weights and the threshold on all rows.

Cases: a null or blank text has no n-grams and is never kept; rows of equal id and text have one key and are kept
together; labels that contradict each other are left out; without a row of quality 1, all documents with a token are
kept; an empty table gives no rows; extra columns are kept by selected() under any names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelforge.llm.shared import drop_durable, durable, held, new_run, plainly_named, summed_vectors, unused, vector_rows
from reelforge.llm.words import codes_of, mix, runs_hashed, windows, word_chars

SAMPLE = 20_000
WORDS, PAIRS, SHAPES = 8192, 8192, 4096
WIDTH = WORDS + PAIRS + SHAPES
FAMILIES = ((0, WORDS), (WORDS, WORDS + PAIRS), (WORDS + PAIRS, WIDTH))
PRIOR_PER_BUCKET = 50  # counts by which a bucket of the target model leans to the raw one
SEED = 20_241
_U = np.uint64


@cache
def _lower() -> np.ndarray:
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 and not 0xD800 <= c < 0xE000 else c for c in range(0x110000)), np.uint32, 0x110000)


@cache
def _kinds() -> np.ndarray:
    """0 blank, 1 other visible, 2 other word character, 3 upper-case letter, 4 digit."""
    out = np.where(word_chars(), 2, 1).astype(np.int8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            out[c] = 0
        elif ch.isupper():
            out[c] = 3
        elif ch.isdigit():
            out[c] = 4
    return out


def _tokens(part: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape of each token."""
    codes = codes_of(part)
    kind = _kinds()[codes]
    group = np.minimum(kind, 2)
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(cut[1:], len(codes))
    keep = group[cut] > 0
    starts, ends = cut[keep], ends[keep]
    if not len(starts):
        return np.empty(0, _U), np.empty(0, _U)
    h = runs_hashed(_lower()[codes], starts, ends)
    many = lambda x: np.append(0, np.cumsum(x))
    upper, digit = many(kind == 3), many(kind == 4)
    n, up, dig = ends - starts, upper[ends] - upper[starts], digit[ends] - digit[starts]
    word = group[starts] == 2
    shape = np.where(dig > 0, 4, np.where((up == n) & (n > 1), 3, np.where(up > 0, 2, 1)))
    shape = np.where(word, shape, 8 + (h & _U(63)).astype(np.int64))
    return h, shape.astype(_U)


def ngrams(text: str | None) -> np.ndarray:
    """Bucket numbers of all n-grams of a text, with repeats."""
    out, tail_h, tail_s = [], np.empty(0, _U), np.empty(0, _U)
    for part in windows(text or ""):
        h, s = _tokens(part)
        if not len(h):
            continue
        again = len(tail_h)
        h, s = np.concatenate([tail_h, h]), np.concatenate([tail_s, s])
        words = h[s < 8]
        same = np.zeros(len(h), _U)
        at = np.flatnonzero(s < 8)
        same[at[1:]] = words[1:] == words[:-1]
        shapes = s * _U(2) + same
        out.append((h[again:] % _U(WORDS)).astype(np.int64))
        pairs = mix(h[:-1] * _U(3) + h[1:])[max(0, again - 1) :]
        out.append((pairs % _U(PAIRS)).astype(np.int64) + WORDS)
        triples = mix((shapes[:-2] * _U(4096) + shapes[1:-1]) * _U(4096) + shapes[2:])[max(0, again - 2) :]
        out.append((triples % _U(SHAPES)).astype(np.int64) + WORDS + PAIRS)
        tail_h, tail_s = h[-2:], s[-2:]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target model / raw model) of each bucket; each family of n-grams is a model of its own."""
    out = np.zeros(WIDTH)
    if not target.any():
        return out
    for a, b in FAMILIES:
        p = (raw[a:b] + 1) / (raw[a:b].sum() + b - a)
        lean = PRIOR_PER_BUCKET * (b - a)
        out[a:b] = np.log((target[a:b] + lean * p) / (target[a:b].sum() + lean)) - np.log(p)
    return out


def labelled(labels: DataFrame) -> tuple[DataFrame, float]:
    """At most SAMPLE ids of quality 1, the same ones each time, and the labelled share of quality 1."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    agreed = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    good, n = agreed.agg(F.sum("quality"), F.count("*")).first()
    sample = agreed.filter("quality = 1").select("doc_id").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(SAMPLE)
    return sample, (good or 0) / n if n else 1.0


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log-ratio table and the prior; one pass over all texts fits both models."""
    sample, prior = labelled(labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = own.join(F.broadcast(sample.withColumn("target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    run = new_run()

    def count(batches):
        held(run, dict)  # frees what another operator left here
        sums = np.zeros((2, WIDTH), np.int64)
        for b in batches:
            for text, target in zip(b["text"], b["target"].to_pylist(), strict=True):
                x = np.bincount(ngrams(text.as_py()), minlength=WIDTH)
                sums[0] += x
                if target:
                    sums[1] += x
        for kind in (0, 1):
            yield vector_rows(kind, sums[kind])

    raw, target = summed_vectors(marked.mapInArrow(count, "kind int, slice int, counts binary"), 2, WIDTH)
    return log_ratio(target, raw), prior if target.any() else 1.0


def weighted(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """docs and, last, under WEIGHT or a name of its own, the log importance weight of each text: null without n-grams."""
    names = [*docs.columns, unused(docs, WEIGHT)]
    at = names.index("text")

    def score(batches):
        for b in batches:
            found = [table[x].sum() if len(x := ngrams(t.as_py())) else None for t in b.column(at)]
            yield pa.record_batch([*(b.column(i) for i in range(b.num_columns)), pa.array(found, pa.float64())], names=names)

    return plainly_named(docs).mapInArrow(score, _with(docs, names[-1]))


WEIGHT = "__log_weight"


def _with(docs: DataFrame, name: str):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])


def gumbel_key(weight: Column, *of: Column) -> Column:
    """weight plus Gumbel noise that the columns fix."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return weight - F.log(-F.log(u))


def kth_largest(keys: DataFrame, col: str, k: int, bins: int = 4096, few: int = 4096) -> float:
    """The k-th largest value, found by counting in ever finer bins; the driver sees at most `bins` counts or `few` values."""
    lo, hi = keys.agg(F.min(col), F.max(col)).first()
    above = 0
    while lo < hi:
        inside = keys.filter((F.col(col) >= lo) & (F.col(col) <= hi))
        width = (hi - lo) / bins
        counts = {r.b: (r.n, r.lo, r.hi) for r in inside.groupBy(F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            n, lo, hi = counts[b]
            if above + n >= k:
                break
            above += n
        if n <= few:
            return sorted((r[0] for r in keys.filter((F.col(col) >= lo) & (F.col(col) <= hi)).select(col).collect()), reverse=True)[k - above - 1]
    return lo


def threshold(keys: DataFrame, prior: float) -> float:
    """The key from which documents are kept; keys: log_weight, gumbel_key."""
    k = round(keys.agg(F.sum(F.least(F.lit(1.0), F.exp(F.least(F.col("log_weight"), F.lit(50.0))) * prior))).first()[0] or 0)
    return kth_largest(keys, "gumbel_key", k) if k else float("inf")


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept of each document."""
    table, prior = fitted(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = weighted(own, table).select("doc_id", F.col(WEIGHT).alias("log_weight"), gumbel_key(F.col(WEIGHT), F.col("doc_id"), F.col("text")).alias("gumbel_key"))
    scored = durable(scored, "importance")
    cut = threshold(scored.filter("log_weight is not null"), prior)
    return scored.withColumn("kept", F.coalesce(F.col("gumbel_key") >= cut, F.lit(False)))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns. Weights are made twice, which costs less than to move the texts."""
    table, prior = fitted(docs, labels)
    key = lambda weight: gumbel_key(weight, F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored, weight = weighted(docs.select("doc_id", "text"), table), F.col(WEIGHT)
    keys = durable(scored.filter(weight.isNotNull()).select(weight.alias("log_weight"), key(weight).alias("gumbel_key")), "importance")
    cut = threshold(keys, prior)
    drop_durable(keys)
    rows, weight = weighted(docs, table), F.col(unused(docs, WEIGHT))
    return rows.filter(weight.isNotNull() & (key(weight) >= cut)).select(*(F.col(f"`{c}`") for c in docs.columns))
