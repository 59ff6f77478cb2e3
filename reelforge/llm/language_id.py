"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text's subwords are all runs of 1 to LONGEST characters of its lower-cased words, a word's edges counting as one
character each. Each is hashed to one of BUCKETS embeddings; a text is the mean of its subwords' embeddings, and a linear
softmax over the mean gives each language's probability.

The model is fitted on a bounded sample: SAMPLE documents at most on average, as each is drawn by a hash with the chance
that gives its language an even part; of each at most WINDOWS windows of WINDOW characters, spread over its whole text. Embeddings and weights are fitted in numpy by
stochastic gradient descent on batches of windows, the same way each time, in EPOCHS rounds or as many as LEAST_STEPS need. A second sample of CALIBRATION documents, read
whole, fits the temperature by which scores are divided (least log loss) and the score below which a prediction is
rejected: the lowest one above which at least PRECISION of the predictions of that sample are right. The driver sees the
windows of the one sample and a row of numbers for each document of the other.

For prediction embeddings and weights are folded into one row of numbers for each bucket, and a batch of texts is scored
by array operations over its characters; a long text is read in windows cut between words, so memory is bounded.

Cases: null texts and those without a letter are `und` with score 0 and rejected, as is everything if no document is labelled; one
label gives it to every text with a letter; null labels and null ids are not learnt from, a null id is in no fold;
repeated rows are predicted one by one and learnt from once; languages beyond the MOST most frequent are not learnt; extra columns of any name are kept by tagged().
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.shared import held, new_run, plainly_named, ship, unused
from reelforge.llm.words import codes_of, mix, windows

BUCKETS, DIMENSIONS, LONGEST = 1 << 15, 16, 5
SAMPLE, WINDOWS, WINDOW = 4000, 2, 256
CALIBRATION, PRECISION = 4000, 0.99
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 500, 64, 10.0  # a small sample is gone through more often
MOST = 128  # languages; the broadcast table has a number for each bucket and language
FOLDS = 5
SEED = 31
UNKNOWN = "und"
_U = np.uint64
_TOGETHER = 1 << 19  # characters scored at a time


@cache
def letters() -> np.ndarray:
    """The lower-cased letter of each code point, 0 for what is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def subwords(codes: np.ndarray, owner: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length of subword, buckets and owners, in order. codes: letters, 0 for what is none; owner: a number for
    each, not falling. The character that ends a subword says whose it is, so texts share the 0 between them."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)  # one 0 between words
    s, owner = codes[keep].astype(_U), owner[keep]
    ids, owners, h = [], [], np.zeros(len(s), _U)
    inside = np.ones(len(s), bool)
    for n in range(1, LONGEST + 1):
        if len(s) < n:
            break
        last = s[n - 1 :]
        h = h[: len(last)] * _U(0x100000001B3) + last + _U(n)
        if n > 2:
            inside = inside[: len(last)] & (s[n - 2 : -1] > 0)  # 0 only at the ends
        good = inside[: len(last)] if n > 1 else last > 0
        ids.append((mix(h[good]) % _U(BUCKETS)).astype(np.int32))
        owners.append(owner[n - 1 :][good])
    return ids, owners


def together(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Subwords of short texts; the owner is the text's place in the list."""
    size = np.array([len(t) + 2 for t in texts])
    codes = letters()[codes_of("".join(f" {t} " for t in texts))]
    return subwords(codes, np.repeat(np.arange(len(texts), dtype=np.int32), size))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # buckets x languages: embeddings times weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean logits of each text before the temperature, and its number of subwords."""
        sums, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held_, places, size = [], [], 0

        def add() -> None:
            if held_:
                at = np.array(places)
                for ids, owner in zip(*together(held_), strict=True):
                    if len(ids):
                        first = np.flatnonzero(np.diff(owner, prepend=-1))
                        np.add.at(sums, at[owner[first]], np.add.reduceat(self.table[ids], first, axis=0))
                        np.add.at(count, at[owner[first]], np.diff(first, append=len(ids)))

        for i, text in enumerate(texts):
            for part in windows(text or ""):
                if size + len(part) > _TOGETHER:
                    add()
                    held_, places, size = [], [], 0
                held_.append(part)
                places.append(i)
                size += len(part) + 2
        add()
        return sums / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, count = self.logits(texts)
        p = softmax(logits / self.temperature)
        score = np.where(count > 0, p.max(axis=1), 0.0)
        return [self.langs[k] if n else UNKNOWN for k, n in zip(p.argmax(axis=1), count, strict=True)], score, (count == 0) | (score < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def chance(salt: int, *of: Column) -> Column:
    """A number from 0 to 1 that the columns fix."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED + salt), *of), 11) / F.lit(float(1 << 53))


def sampled(docs: DataFrame) -> tuple[list[str], DataFrame, DataFrame]:
    """Languages in order of name, and (lang, text) of the fitting and of the calibration sample."""
    own = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.filter("id is not null and lang is not null and text is not null").filter(~held_out(F.col("id")))
    found = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST).collect()
    langs = sorted(r.lang for r in found)
    share = {r.lang: min(1.0, (SAMPLE + CALIBRATION) / len(found) / r.n) for r in found}
    own = own.filter(F.col("lang").isin(langs))
    u, of = chance(0, F.col("id"), F.col("text")), F.lit(0.0)
    for name, s in share.items():
        of = F.when(F.col("lang") == name, s).otherwise(of)
    fit = SAMPLE / (SAMPLE + CALIBRATION)
    picked = own.filter(u < of).select("lang", "text", (u < of * fit).alias("fit")).distinct()  # copies would count many times
    return langs, picked.filter("fit").drop("fit"), picked.filter("not fit").drop("fit")


def spread(text: Column) -> Column:
    """WINDOWS windows of a text, evenly spread over it; of a short text one, all of it."""
    n = F.length(text)
    at = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substring(text, (F.floor((n - WINDOW) * i / max(1, WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW)))
    return F.when(n <= WINDOW, F.array(text)).otherwise(at)


def fitted(rows: list[tuple[int, str]], langs: list[str]) -> Model:
    """The model of windows with the numbers of their languages."""
    rng = np.random.default_rng(SEED)
    y = np.array([k for k, _ in rows], np.int64)
    ids, owner = (np.concatenate(x) for x in together([t for _, t in rows])) if rows else (np.empty(0, np.int32), np.empty(0, np.int32))
    order = np.argsort(owner, kind="stable")
    ids, ends = ids[order], np.searchsorted(owner[order], np.arange(len(rows) + 1))
    some = np.flatnonzero(np.diff(ends))  # windows with a letter
    e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, bias = np.zeros((DIMENSIONS, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    per_epoch = max(1, -(-len(some) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        pick = rng.permutation(some)
        for at in range(0, len(pick), BATCH):
            own, rate = pick[at : at + BATCH], RATE * (1 - step / steps)
            share = np.zeros((len(own), BUCKETS), np.float32)  # of each bucket in a window
            for i, r in enumerate(own):
                share[i] = np.bincount(ids[ends[r] : ends[r + 1]], minlength=BUCKETS) / (ends[r + 1] - ends[r])
            mean = share @ e
            off = softmax(mean @ w + bias)
            off[np.arange(len(own)), y[own]] -= 1
            off *= rate / len(own)
            e -= share.T @ (off @ w.T)
            w -= mean.T @ off
            bias -= 0.01 * off.sum(axis=0)
            step += 1
    return Model(tuple(langs), (e @ w).astype(np.float64), bias.astype(np.float64))


def calibrated(model: Model, logits: np.ndarray, y: np.ndarray) -> Model:
    """The model with the temperature of least log loss and the threshold of wanted precision on given logits."""
    if not len(y):
        return model

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()

    temperature = min(np.geomspace(0.02, 20, 121), key=loss)
    p = softmax(logits / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    threshold = score[order[good[-1]]] if len(good) else 1.0
    return Model(model.langs, model.table, model.bias, float(temperature), float(threshold))


def trained(docs: DataFrame) -> Model:
    """The calibrated model of a table's labelled documents outside the held-out fold."""
    ship(docs.sparkSession)
    langs, fit, rest = sampled(docs)
    number = {name: k for k, name in enumerate(langs)}
    rows = sorted((number[r.lang], r.w) for r in fit.select("lang", F.explode(spread(F.col("text"))).alias("w")).collect())
    model = fitted(rows, langs)
    if not langs:
        return model

    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches):
        for b in batches:
            logits, count = shipped.value.logits(b["text"].to_pylist())
            at = np.flatnonzero(count)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * logits.shape[1], pa.int32()), pa.array(logits[at].ravel()))
            yield pa.record_batch([b["lang"].take(pa.array(at)), x], names=["lang", "logits"])

    seen = sorted((number[r.lang], r.logits) for r in rest.select("lang", "text").mapInArrow(look, "lang string, logits array<double>").collect())
    return calibrated(model, np.array([x for _, x in seen]).reshape(len(seen), len(langs)), np.array([k for k, _ in seen], np.int64))


def tagged(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs and, last, the predicted language, its score and whether it is rejected; a name that docs has is made longer."""
    fields, names = list(docs.schema.fields), list(names)
    at = docs.columns.index("text")
    for i, name in enumerate(names):
        names[i] = unused(docs, name)
    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    shipped, run = docs.sparkSession.sparkContext.broadcast(model), new_run()

    def tag(batches):
        held(run, dict)  # frees what another operator left here
        model = shipped.value
        for b in batches:
            langs, score, rejected = model.predict(b.column(at).to_pylist())
            yield pa.record_batch([*(b.column(i) for i in range(b.num_columns)), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[f.name for f in schema.fields])

    return plainly_named(docs).mapInArrow(tag, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each document."""
    model = trained(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = tagged(own, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
