"""MinHash near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words. A shingle weighs its count in the text times its idf. Document frequencies are counted
over all documents in a fixed table of two rows of hashed counters (the smaller of a shingle's two counters is its
frequency, less the mean load); idf runs from 1 for a shingle in every document to 2 for one in at most COMMON of them,
so no similarity strays far from that of plain counts. Samples are banded; in every bucket the member that shares most
buckets leads, and the others are compared with it: one comparison per member joins a group of copies however large.
Buckets that several groups still share are dealt into blocks of members, and each two blocks are compared by their
samples and then exactly (pairs with so few equal samples that the threshold is out of reach but once in 1e9 times are
not; a parameter compares these too), in one task that returns only the links that join groups: no pair of a bucket is lost, and
none is emitted that is no link. A link needs a weighted Jaccard similarity of THRESHOLD or more, on whole texts.
Texts with the same words are one class from the start.

Cases: null and wordless texts link with nothing; a text of fewer than five words has one shingle; null ids link with
nothing; different texts of one id are documents of their own, named by the id and a hash of the text; repeated rows are
one document; an empty table gives no rows; other columns are not read by grouped() and kept by deduplicated() under any
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.llm.shared import connected_components, counted_out, drop_durable, durable, held, new_run, summed_vectors, unused, vector_rows
from reelforge.llm.words import mix, sequence_key, shingle_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5  # an isolated pair at THRESHOLD shares no band once in about 13,700 times
SAMPLES = BANDS * ROWS
COUNTERS = 1 << 18
COMMON = 0.01
LIKELY = 0.55  # share of equal samples that a pair needs to be verified; one at THRESHOLD has fewer with a chance of 1e-9; 0: verify all
BLOCK_MEMBERS = 256
BROADCAST_IDS = 1_000_000
BLOCK = 2048
_U = np.uint64


def weighted_set(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their counts."""
    return np.unique(shingle_hashes(word_hashes(text), SHINGLE), return_counts=True)


def _counters(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (shingles % _U(COUNTERS)).astype(np.int64), ((shingles >> _U(32)) % _U(COUNTERS)).astype(np.int64)


class Idf:
    """idf by hashed document frequency: two rows of COUNTERS entries, of one size for any corpus."""

    def __init__(self, counts: np.ndarray, docs: int):
        share = np.maximum(0, counts - counts.mean(axis=1, keepdims=True)) / max(1, docs)
        self.rows = np.clip(share, COMMON, 1).astype(np.float32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        a, b = _counters(shingles)
        return 1 + np.log(np.minimum(self.rows[0][a], self.rows[1][b])) / np.float32(np.log(COMMON))


def fitted_idf(docs: DataFrame) -> Idf:
    def add(sums, kept):
        for row, at in zip(sums, _counters(np.concatenate([np.empty(0, _U), *kept])), strict=True):
            row += np.bincount(at, minlength=COUNTERS)
        kept.clear()

    run = new_run()

    def count(batches):
        held(run, dict)  # frees what another operator left here
        sums, n, kept = np.zeros((2, COUNTERS), np.int64), 0, []
        for batch in batches:
            for text in batch["text"]:
                kept.append(weighted_set(text.as_py())[0])
                n += len(kept[-1]) > 0
                if sum(map(len, kept[-64:])) > 1 << 20 or len(kept) == 1024:
                    add(sums, kept)
        add(sums, kept)
        for kind in (0, 1):
            yield vector_rows(kind, sums[kind])
        yield vector_rows(2, np.array([n], np.int64))

    counts = summed_vectors(docs.select("text").mapInArrow(count, "kind int, slice int, counts binary"), 3, COUNTERS)
    return Idf(counts[:2], int(counts[2, 0]))


class Sampler:
    """Consistent samples of weighted sets. One 64-bit hash of a shingle serves two samples, 32 bits each.

    The variates are quantiles: 8 bits name the Gamma(2, 1) one of the steps, 8 the uniform shift, 16 the Gamma(2, 1)
    one that ranks; a tie goes to the smaller shingle. Equal shingles draw equally everywhere, so samples stay consistent.
    """

    def __init__(self, samples: int = SAMPLES):
        x = np.linspace(0, 60, 200_001)
        cdf = 1 - (1 + x) * np.exp(-x)
        gamma = lambda bits: np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), cdf, x)
        self.r, self.log_c = gamma(8).astype(np.float32), np.log(gamma(16)).astype(np.float32)
        self.one_over_r = 1 / self.r
        self.samples = samples
        self.seeds = mix(np.arange(1, samples // 2 + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))

    def _block(self, shingles, log_w):
        bits = (shingles[None, :] ^ self.seeds[:, None]) * _U(0xBF58476D1CE4E5B9)
        bits ^= bits >> _U(29)
        bits *= _U(0x94D049BB133111EB)
        bits ^= bits >> _U(32)
        parts = bits.view(np.uint8).reshape(len(self.seeds), len(shingles), 8)
        words = bits.view(np.uint16).reshape(len(self.seeds), len(shingles), 4)
        out = []
        for half in (0, 1):
            ri = parts[:, :, 4 * half + 2]
            r, beta = self.r[ri], parts[:, :, 4 * half + 3] * np.float32(1 / 256)
            t = np.floor(log_w[None, :] * self.one_over_r[ri] + beta)
            a = self.log_c[words[:, :, 2 * half]] - r * (t - beta + 1)
            k = a.argmin(axis=1)
            at = np.arange(len(k))
            out.append((a[at, k], shingles[k], t[at, k]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def __call__(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 32-bit value per sample, equal with the probability of the sets' weighted Jaccard similarity."""
        log_w, best = np.log(weights).astype(np.float32), None
        for i in range(0, len(shingles), BLOCK):
            a, s, t = self._block(shingles[i : i + BLOCK], log_w[i : i + BLOCK])
            if best is None:
                best = [a, s, t]
            else:
                less = a < best[0]
                for old, new in zip(best, (a, s, t), strict=True):
                    old[less] = new[less]
        return (mix(best[1] + best[2].astype(np.int64).astype(_U) * _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, idf: Idf) -> DataFrame:
    """id, hash of the text, two halves of the key of its words, and samples, of each document with an id and a word."""

    run = new_run()

    def sign(batches):
        sampler = held(run, Sampler)
        for b in batches:
            rows = []
            for i, h, text in zip(b["id"], b["h"], b["text"], strict=True):
                words = word_hashes(text.as_py())
                if len(words) and i.as_py() is not None:
                    shingles, counts = np.unique(shingle_hashes(words, SHINGLE), return_counts=True)
                    rows.append((i.as_py(), h.as_py(), *sequence_key(words), sampler(shingles, counts * idf(shingles))))
            flat = np.concatenate([r[4] for r in rows]) if rows else np.empty(0, np.int32)
            samples = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * SAMPLES, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([*(pa.array([r[j] for r in rows], pa.int64()) for j in range(4)), samples], names=["id", "h", "k1", "k2", "samples"])

    return docs.mapInArrow(sign, "id long, h long, k1 long, k2 long, samples array<int>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    w = idf(shared).astype(np.float64)
    least = (np.minimum(a[1][i], b[1][j]) * w).sum()
    return float(least / ((a[1] * idf(a[0]).astype(np.float64)).sum() + (b[1] * idf(b[0]).astype(np.float64)).sum() - least))


def _packed(s: np.ndarray, n: np.ndarray) -> bytes:
    """Shingles and, unless all are 1, counts; the last byte says which."""
    once = len(n) == 0 or n.max() == 1
    return s.astype("<u8").tobytes() + (b"" if once else n.astype("<u4").tobytes()) + (b"\1" if once else b"\0")


def _unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    if x[-1]:
        n = len(x) // 8
        return np.frombuffer(x, "<u8", n), np.ones(n, np.uint32)
    n = len(x) // 12
    return np.frombuffer(x, "<u8", n), np.frombuffer(x, "<u4", n, 8 * n)


def set_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and weighted set of the wanted classes (rep, id, h). Few go to the documents; many meet them in a shuffle."""
    few = wanted.count() <= BROADCAST_IDS
    own = docs.join(F.broadcast(wanted) if few else wanted, ["id", "h"]).select("rep", "text")

    def make(batches):
        for b in batches:
            yield pa.record_batch([b["rep"], pa.array([_packed(*weighted_set(t.as_py())) for t in b["text"]], pa.binary())], names=["rep", "set"])

    return own.mapInArrow(make, "rep long, set binary").dropDuplicates(["rep"])


def verified(pairs: DataFrame, sets: DataFrame, idf: Idf) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""

    def compare(batches):
        for b in batches:
            keep = [similarity(_unpacked(x.as_py()), _unpacked(y.as_py()), idf) >= THRESHOLD for x, y in zip(b["set_a"], b["set_b"], strict=True)]
            yield pa.record_batch([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def likely(pairs: DataFrame, samples: DataFrame, share: float) -> DataFrame:
    """The pairs of which at least a share of the samples is equal."""
    x, y = (samples.select(F.col("rep").alias(k), F.col("samples").alias(f"s{k}")) for k in "ab")
    same = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, e: n + e)
    return pairs.join(x, "a").join(y, "b").filter(same >= share * SAMPLES).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, idf: Idf, share: float = LIKELY) -> DataFrame:
    """Verified links (a, b) between classes (rep, id, h, samples): all pairs of a bucket that no chain of links joins are compared."""
    band = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), *(F.get("samples", F.lit(i * ROWS + j)) for j in range(ROWS))).alias("key")) for i in range(BANDS)]
    cells = classes.select("rep", F.explode(F.array(*band)).alias("c")).select("rep", "c.band", F.xxhash64("c.band", "c.key").alias("bucket"))
    sizes = cells.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cells.join(sizes, "bucket")
    central = shared.groupBy("rep").agg(F.sum("n").alias("central"))
    members = durable(shared.join(central, "rep").select("bucket", "band", "rep", "central"), "members")
    samples = classes.join(members.select("rep").distinct(), "rep", "left_semi")
    lead = members.groupBy("bucket").agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("a"))
    first = members.join(lead, "bucket").filter("rep <> a").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    pairs = durable(likely(first, samples, share), "pairs")
    named = classes.select("rep", "id", "h")
    sets = durable(set_table(docs, named.join(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "rep", "left_semi")), "sets")
    found = durable(verified(pairs, sets, idf), "links")
    drop_durable(pairs, sets)
    # Buckets that several groups still share: their pairs across groups are compared in cells of two blocks of members.
    groups = connected_components(found, "a", "b")
    state = members.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = state.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("bucket", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    open_ = durable(state.join(mixed, "bucket").select("bucket", "blocks", "band", "rep", "component"), "open")
    sets = durable(set_table(docs, named.join(open_.select("rep").distinct(), "rep", "left_semi")).join(samples.select("rep", "samples"), "rep"), "sets")
    dealt = open_.join(sets, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    each = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = each.select("bucket", "band", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "rep", "component", "samples", "set")

    def work(key, t):
        _, band, first, second = (k.as_py() for k in key)
        rows = cell_links(np.asarray(t["rep"]), np.asarray(t["component"]), np.asarray(t["samples"].combine_chunks().flatten()).reshape(len(t), SAMPLES), t["set"].to_pylist(), np.asarray(t["block"]), band, first, second, idf, share)
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    more = cells.groupBy("bucket", "band", "first", "second").applyInArrow(work, "a long, b long")
    out = durable(found.union(more), "links")
    drop_durable(found, groups, open_, sets, members)
    return out


def cell_links(reps, components, samples, sets, block, band: int, first: int, second: int, idf, share: float = LIKELY) -> list[tuple[int, int]]:
    """Links between members of different components, enough to join all that a cell's links join.

    A pair is compared in the first band whose samples agree, and there only; likely pairs come first.
    """
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    parent = {int(c): int(c) for c in components}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out, unpacked = [], {}
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        same = samples[rows][:, None, :] == samples[right][None, :, :]
        count = same.sum(axis=2)
        bands = same.reshape(len(rows), len(right), BANDS, ROWS).all(axis=3)
        i, j = np.nonzero((count >= share * SAMPLES) & (bands.argmax(axis=2) == band) & bands.any(axis=2))
        order = np.argsort(-count[i, j], kind="stable")
        for x, y in zip(rows[i[order]].tolist(), right[j[order]].tolist(), strict=True):
            cx, cy = root(int(components[x])), root(int(components[y]))
            if cx == cy or (first == second and x >= y):
                continue
            for k in (x, y):
                if k not in unpacked:
                    unpacked[k] = _unpacked(sets[k])
            if similarity(unpacked[x], unpacked[y], idf) >= THRESHOLD:
                parent[max(cx, cy)] = min(cx, cy)
                out.append((int(min(reps[x], reps[y])), int(max(reps[x], reps[y]))))
    return out


def _named(docs: DataFrame) -> list[Column]:
    """What names a document of docs: id and h, a hash of its text."""
    return [docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("h")]


def grouped(docs: DataFrame, share: float = LIKELY) -> DataFrame:
    """id, h, component_id (smallest id of its group, itself included), first (one document of each group), of every document.

    share: the equal samples that a pair of a bucket needs to be verified; 0 verifies every pair of every bucket.
    """
    own = docs.select(*_named(docs), F.col("text").cast("string").alias("text"))
    idf = fitted_idf(own)
    signs = durable(signed(own, idf), "samples")
    least = signs.groupBy("k1", "k2").agg(F.min(F.struct("id", "h")).alias("m"), F.min_by("samples", F.struct("id", "h")).alias("samples"))
    # Numbers, as an id may stand for several classes; they hold once they are written.
    classes = durable(least.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "m.id", "m.h", "samples"), "classes")
    found = links(own, classes, idf, share)
    groups = connected_components(found, "a", "b")
    of = classes.select("rep", "k1", "k2", F.struct("id", "h").alias("m")).join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = of.join(of.groupBy("component").agg(F.min("m").alias("top")), "component").select("k1", "k2", "top")
    rows = signs.select("id", "h", "k1", "k2").distinct().join(named, ["k1", "k2"])
    return durable(rows.select("id", "h", F.col("top.id").alias("component_id"), (F.struct("id", "h") == F.col("top")).alias("first")), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id, kept of every row; documents without words or id are groups of their own."""
    rows = docs.select(*_named(docs)).groupBy("id", "h").agg(F.count("*").alias("n"))
    named = rows.join(grouped(docs), ["id", "h"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    each = counted_out(named.select(F.col("id").alias("doc_id"), "component_id", "first", "n"), F.col("n"), "copy")
    return each.select("doc_id", "component_id", (F.col("doc_id").isNull() | F.coalesce("first", F.lit(True)) & (F.col("copy") == 0)).alias("kept"))


def _without(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """docs without, or only with, some documents (id, h); a checked few of them are broadcast."""
    few, (i, h), (own_id, own_h) = names.count() <= BROADCAST_IDS, _named(docs), (unused(docs, x) for x in ("id_", "h_"))
    named = names.select(F.col("id").alias(own_id), F.col("h").alias(own_h))
    return docs.join(F.broadcast(named) if few else named, (i == F.col(own_id)) & (h == F.col(own_h)), how)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, the first by id; all columns stay. Of its rows one stays."""
    kept = _without(docs, grouped(docs).filter("not first"), "left_anti")
    twice = durable(docs.select(*_named(docs)).groupBy("id", "h").count().filter("count > 1 and id is not null").select("id", "h"), "repeated")
    if not twice.limit(1).count():
        return kept
    rows = _without(kept, twice, "left_semi")
    at = unused(rows, "at")
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(*_named(rows)).orderBy("text")))
    return _without(kept, twice, "left_anti").unionByName(rows.filter(F.col(at) == 1).drop(at))
