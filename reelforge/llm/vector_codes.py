"""Vector code compression: product codes whose codebooks come from a delta-maintained Lloyd iteration.

A vector is cut into PARTS equal consecutive parts, and each part is named by its nearest entry of that position's
codebook. Kept from round to round are each vector's code and, for every entry, the sum and number of its parts. A round
shuffles only what a task's changed parts take from their old entries and add to their new ones, one row of plus and minus
for each entry touched; added to the running sums they give the next entries. When no entry moves, later rounds would
change nothing and are left out. All arithmetic is in whole numbers, so the sums never drift from those made anew.

Vectors stay where they are: each round is one pass that reads vectors with their codes and writes both anew, the changes
in a column of their own. The driver holds the codebooks: for each length of vector ENTRIES entries of that length.

Cases: null vectors and those with null or non-finite components are left out; vectors of each length have codebooks of
their own, a length that PARTS does not divide is filled up with zeros at the end, and an empty vector has code 0 and
error 0; fewer vectors than ENTRIES give as many entries; null ids are coded and start an entry only after all others,
equal ids start entries in the order of their vectors; components beyond the limit of whole_vectors are taken as it;
null labels share one sum; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelforge.llm.shared import BROADCAST_ROWS, VECTOR_SCHEMA, VECTOR_SLICE, drop_durable, durable, hot_joined, ship, summed_rows, vector_rows
from reelforge.llm.whole_vectors import LONGEST, blocks, finite, lists, squared, whole

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
STATE = "vec_id long, label string, x array<int>, code binary, error long, " + VECTOR_SCHEMA
NAMES = [part.split()[0] for part in STATE.split(", ")]
TYPES = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.int64())

#: Codebooks of each length of vector: whole numbers by part, entry and position within the part.
Books = dict[int, np.ndarray]


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label as a key that is never null, and v as doubles, of each vector that is coded."""
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return own.filter(finite("v"))


def parts_of(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers as (part, row, position)."""
    fill = -x.shape[1] % PARTS
    return np.pad(x, ((0, 0), (0, fill))).reshape(len(x), PARTS, (x.shape[1] + fill) // PARTS).swapaxes(0, 1)


def starts(own: DataFrame) -> Books:
    """Codebooks of the smallest ids of each length; tasks pass on ENTRIES rows a length, not their vectors."""
    order = Window.partitionBy(F.size("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v")
    found: dict[int, list] = {}
    for r in own.select("vec_id", "v", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= ENTRIES).collect():
        found.setdefault(len(r.v), []).append((r.rank, r.v))
    return {d: parts_of(whole(np.array([v for _, v in sorted(rows)], np.float64).reshape(len(rows), d), SCALE)) for d, rows in found.items()}


def changes(x: np.ndarray, old: np.ndarray, new: np.ndarray, entries: int) -> np.ndarray:
    """(part, entry, position and last the count): what rows of x (part, row, position) add to new entries and take from old ones."""
    at = np.arange(entries)[:, None]
    out = np.zeros((len(x), entries, x.shape[2] + 1), np.int64)
    for p in range(len(x)):
        rows = np.flatnonzero(old[:, p] != new[:, p])
        sign = (new[rows, p] == at).astype(np.float64) - (old[rows, p] == at)
        out[p, :, :-1], out[p, :, -1] = sign @ x[p, rows], sign.sum(axis=1)
    return out


def coded(rows: DataFrame, books: Books, scale: int) -> DataFrame:
    """STATE rows: vectors (column v, doubles or whole numbers if scale is 0) with new codes, then each task's changes."""
    numbers = {d: i for i, d in enumerate(sorted(books))}

    def code(batches):
        sums: dict[int, np.ndarray] = {}
        for t in blocks(batches, "v"):
            column = t["v"].combine_chunks()
            flat, offset = np.asarray(column.flatten()), np.asarray(column.offsets)
            lengths, before = np.diff(offset), np.asarray([np.frombuffer(c, np.uint8) if c else np.full(PARTS, -1) for c in t["code"].to_pylist()], np.int64)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = flat[(offset[at] - offset[0])[:, None] + np.arange(d)]
                x = whole(x, scale) if scale else x.astype(np.int64)
                part, book = parts_of(x), books[d]
                distance = squared(part, book)
                new = distance.argmin(axis=2).T
                error = distance.min(axis=2).sum(axis=0)
                sums[d] = sums.get(d, 0) + changes(part, before[at], new, book.shape[1])
                names = pa.array([c.tobytes() for c in new.astype(np.uint8)], pa.binary())
                none = [pa.nulls(len(at), kind) for kind in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.record_batch([t["vec_id"].combine_chunks().take(pa.array(at)), t["label"].combine_chunks().take(pa.array(at)), lists(x), names, pa.array(error, pa.int64()), *none], names=NAMES)
        for d, found in sums.items():
            for p in range(PARTS):
                for e in range(found.shape[1]):
                    b = vector_rows((numbers[d] * PARTS + p) * ENTRIES + e, found[p, e])
                    yield pa.record_batch([*(pa.nulls(len(b), kind) for kind in TYPES), *b.columns], names=NAMES)

    return rows.select("vec_id", "label", "v", "code").mapInArrow(code, STATE)


def moved(running: DataFrame, books: Books) -> Books:
    """The codebooks after a round: floors of the means of each entry's parts; unused entries stay."""
    out, lengths = {d: b.copy() for d, b in books.items()}, sorted(books)
    sums: dict[int, np.ndarray] = {}
    for r in running.collect():  # a row for each entry, its vector of a part's length
        d = lengths[r.kind // (PARTS * ENTRIES)]
        own = sums.setdefault(r.kind, np.zeros(books[d].shape[2] + 1, np.int64))
        x = np.frombuffer(r.counts, "<i8")
        own[r.slice * VECTOR_SLICE : r.slice * VECTOR_SLICE + len(x)] = x
    for kind, s in sums.items():
        if s[-1] > 0:
            out[lengths[kind // (PARTS * ENTRIES)]][kind // ENTRIES % PARTS, kind % ENTRIES] = s[:-1] // s[-1]
    return out


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that is coded."""
    spark = vectors.sparkSession
    ship(spark)
    own = kept(vectors)
    books = starts(own)
    state = durable(coded(own.withColumn("code", F.lit(None).cast("binary")), books, SCALE), "codes")
    running = None
    for _ in range(rounds):
        deltas = state.filter("counts is not null").select("kind", "slice", "counts")
        old = running
        running = durable(summed_rows(deltas if old is None else old.unionByName(deltas)), "running-sums")
        if old is not None:
            drop_durable(old)
        new = moved(running, books)
        if all((new[d] == books[d]).all() for d in books):
            break
        books, before = new, state
        state = durable(coded(before.filter("x is not null").select("vec_id", "label", F.col("x").alias("v"), "code"), books, 0), "codes")
        drop_durable(before)
    if running is not None:
        drop_durable(running)
    rows = state.filter("x is not null").select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", F.size("x").alias("d"))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONGEST).cast("decimal(30,0)")).cast("long")
    labels = durable(rows.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n")), "label-errors")
    shas = spark.createDataFrame([(d, digest(b)) for d, b in books.items()], "d int, codebooks_sha256 string")
    named = rows.join(F.broadcast(shas), "d")
    few = labels.count() <= BROADCAST_ROWS
    out = named.join(F.broadcast(labels.drop("n")), "label") if few else hot_joined(named, labels, "label", "n")
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
