"""Embedding near-duplicates by a pivot-permutation index.

Vectors are described by their nearest pivots of a bounded sample, in order of angle; pivots are at least APART from each
other, so a dense cluster has few and its members share them. An inverted list holds the vectors that name a pivot; those
that have it among their HOME nearest are at home in it. Each of these is compared to each vector of the list, so a pair
is met if a home of either is named by the other. Products in single precision, whose error is bounded, leave out what is
below the limit; the rest is verified by its cosine in double precision.

A vector names the pivots within twice the linking angle of its nearest one's, NEAREST at most. By the triangle
inequality a vector linked to it names its nearest pivot too, so no link of it is lost unless its list was cut at
NEAREST; with one pivot all pairs are compared, which is the exact mode. Vectors with a strong common direction cut
their lists most, as all pivots are about as far: see the figures in the README.

Those at home in a list and all its vectors are dealt out in blocks of BLOCK, and its pairs in cells of two, so that no
task holds a list; a pair is counted in one list alone, of the first home of its smaller vector that the other names.
Cells return counts and a spanning forest of their links, not pairs. Equal vectors are one class with a count. The number of pivots grows with the number
of vectors up to MOST_PIVOTS, so lists keep their length until then. Vectors of each length have an index of their own.

A vector is in NEAREST lists at most, so all lists together are many times the table. They are dealt out in waves of some of
the pivots each, whose bytes the table's own bound, and a wave's shuffle files go before the next begins; vectors travel in
the table's own width, pivots as short numbers, and ids meet their classes by a SHA-256 of the vector.

Cases: null, zero and non-finite vectors and those with null components link with nothing; null ids link with nothing and are returned once per row; equal ids are one vector each for its own value;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.shared import connected_components, drop_durable, durable, hot_joined, shuffles_freed

COSINE = 0.9
NEAREST, HOME = 64, 24  # pivots that a vector names, and those it is at home with
APART = 0.8  # the largest cosine of two pivots
LIST_LENGTH, LEAST_PIVOTS, MOST_PIVOTS = 640, 64, 8192
SAMPLE = 4  # vectors looked at for each pivot wanted
BLOCK, BLOCK_BYTES = 8192, 1 << 24  # the most vectors of a block, and bytes of them as doubles
WAVE_BYTES, WAVE_SHARE = 1 << 28, 2.0  # of the rows of a wave's lists: the least, and the share of the table's vectors
SEED = 7


def _rows(column, d: int) -> np.ndarray:
    """Vectors of a batch, each as its bytes, as rows of doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, f"<f{len(raw) // (d * len(column))}").reshape(len(column), d).astype(np.float64)


def _value(vectors: DataFrame) -> Column:
    """The vector in its own width: floats stay floats."""
    kind = vectors.schema["embedding"].dataType
    return F.col("embedding").cast("array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>")


def _key(v: Column) -> Column:
    """What stands for a vector where ids meet classes: equal vectors have equal keys, zeros of both signs too."""
    return F.unhex(F.sha2(F.to_json(F.struct(F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).alias("v"))).cast("binary"), 256))


def classes_of(vectors: DataFrame) -> DataFrame:
    """rep (smallest vec_id), n, the vector and its key, of each distinct vector that can link."""
    own = vectors.select(F.col("vec_id").cast("long").alias("id"), _value(vectors).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    fine = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    return fine.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "v", _key(F.col("v")).alias("key"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots_of(classes: DataFrame, count: int, most: int = MOST_PIVOTS) -> np.ndarray:
    """Unit vectors of the pivots, chosen one after another from a sample of the classes, the same each time."""
    k = int(min(most, max(min(most, LEAST_PIVOTS), count * NEAREST // LIST_LENGTH), max(1, count)))
    rows = classes.select("rep", "v").orderBy(F.xxhash64(F.lit(SEED), F.col("v").cast("array<double>")), "rep").limit(SAMPLE * k).collect()
    x, out = _unit(np.array([r.v for r in rows], np.float64)), []
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        free = (part @ np.array(out).T).max(axis=1) <= APART if out else np.ones(len(part), bool)
        fresh: list[np.ndarray] = []
        for u in part[free]:
            if len(out) + len(fresh) < k and (not fresh or (np.array(fresh) @ u).max() <= APART):
                fresh.append(u)
        out += fresh
    return np.array(out)


def described(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rep, n, key, the vector as its bytes and the nearest pivots, nearest first, of each class."""
    k, reach = min(NEAREST, len(pivots)), 2 * np.arccos(COSINE) + 1e-6
    kind, number = ("smallint", pa.int16()) if len(pivots) <= 1 << 15 else ("int", pa.int32())

    def describe(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.asarray(b["v"].flatten()).reshape(len(b), -1)
            for i in range(0, len(x), 1024):
                u = _unit(x[i : i + 1024].astype(np.float64))
                cos = u @ pivots.T
                near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cos, near, axis=1), axis=1, kind="stable"), axis=1)
                angle = np.arccos(np.clip(np.take_along_axis(cos, near, axis=1), -1, 1))
                named = angle <= angle[:, :1] + reach
                perm = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(named.sum(axis=1))), pa.int32()), pa.array(near[named], number))
                own = [b[c][i : i + 1024] for c in ("rep", "n", "key")]
                yield pa.record_batch([*own, pa.array([r.tobytes() for r in x[i : i + 1024]], pa.binary()), perm], names=["rep", "n", "key", "raw", "near"])

    return classes.select("rep", "n", "key", "v").mapInArrow(describe, f"rep long, n long, key binary, raw binary, near array<{kind}>")


def _counted_here(near: np.ndarray, a: np.ndarray, b: np.ndarray, own_pivot: int) -> np.ndarray:
    """Whether own_pivot is the first home of a that b names or, where there is none, the first home of b that a names."""
    first = near[a, 0]
    direct = (first[:, None] == near[b]).any(axis=1)
    out = direct & (first == own_pivot)
    rest = np.flatnonzero(~direct)
    if len(rest):
        x, y = near[a[rest]], near[b[rest]]
        pivot = np.full(len(rest), -1, near.dtype)
        for of, other in ((y, x), (x, y)):
            hit = (of[:, :HOME, None] == other[:, None, :]).any(axis=2) & (of[:, :HOME] >= 0)
            some = hit.any(axis=1)
            pivot[some] = of[some, hit[some].argmax(axis=1)]
        out[rest] = pivot == own_pivot
    return out


LEFT, RIGHT, AT_HOME = 1, 2, 4  # what a vector is in a cell


def cell_links(reps, n, units, near, role, own_pivot: int):
    """(rep, links, parent): copies linked to each vector of a cell, and a spanning forest of the cell's links.

    near: pivots, nearest first, filled up with -1. Those LEFT are compared to those RIGHT; where both are at home, the
    smaller one is the left one.
    """
    left, right = np.flatnonzero(role & LEFT), np.flatnonzero(role & RIGHT)
    links, parent, home = np.zeros(len(reps), np.int64), np.arange(len(reps)), (role & AT_HOME) > 0
    low, least = units.astype(np.float32), np.float32(COSINE - (units.shape[1] + 8) * 2.0**-23)
    others = np.ascontiguousarray(low[right].T)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.divmod(np.flatnonzero(low[rows] @ others >= least), max(1, len(right)))
        i, j = rows[i], right[j]
        once = ~home[j] | (reps[i] < reps[j])
        i, j = i[once], j[once]
        for part in range(0, len(i), 1 << 12):
            a, b = i[part : part + (1 << 12)], j[part : part + (1 << 12)]
            good = np.einsum("ij,ij->i", units[a], units[b]) >= COSINE
            a, b = a[good], b[good]
            turned = reps[a] > reps[b]
            a, b = np.where(turned, b, a), np.where(turned, a, b)
            here = _counted_here(near, a, b, own_pivot)
            a, b = a[here], b[here]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    if reps[x] < reps[y]:
                        parent[y] = x
                    else:
                        parent[x] = y
    for k in np.flatnonzero(links):
        yield int(reps[k]), int(links[k]), int(reps[root(k)])


def linked(index: DataFrame, d: int) -> list[DataFrame]:
    """rep, links, parent rows of all cells of all inverted lists of vectors of length d: a durable table for each wave."""
    row = index.agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("bytes")).first()
    named = index.select(F.posexplode("near").alias("k", "pivot")).groupBy("pivot")
    sizes = named.agg(F.count("*").alias("c"), F.count_if(F.col("k") < HOME).alias("h")).collect()  # a row for each pivot
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * d)))
    parts = lambda c: max(1, -(-c // block))
    copies = sum(r.c * parts(r.h) + r.h * (parts(r.c) - 1) for r in sizes)
    waves = -(-copies * (row.bytes + 2 * NEAREST) // int(max(WAVE_BYTES, WAVE_SHARE * row.n * row.bytes))) if copies else 0
    most = max((r.pivot for r in sizes), default=-1) + 1

    def of(counts):
        return F.get(F.from_json(F.lit(str([counts.get(p, 1) for p in range(most)])), "array<int>"), F.col("pivot").cast("int"))

    def work(key, t):
        column = t["near"].combine_chunks()
        size = np.diff(np.asarray(column.offsets))
        near = np.full((len(t), size.max()), -1, np.int32)
        near[np.arange(size.max()) < size[:, None]] = np.asarray(column.flatten())
        units = _unit(_rows(t["raw"].combine_chunks(), d))
        rows = list(cell_links(np.asarray(t["rep"]), np.asarray(t["n"]), units, near, np.asarray(t["role"]), key[0].as_py()))
        return pa.table({"rep": pa.array([r[0] for r in rows], pa.int64()), "links": pa.array([r[1] for r in rows], pa.int64()), "parent": pa.array([r[2] for r in rows], pa.int64())})

    # Cell i * blocks + j: those at home of block i, and all of block j.
    home, own, blocks, homes = (F.col(c) for c in ("home", "own", "blocks", "homes"))
    along = F.transform(F.sequence(F.lit(0), homes - 1), lambda i: i * blocks + F.col("block"))
    across = F.when(home, F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: own * blocks + j)).otherwise(F.array().cast("array<int>"))
    cell = F.when((blocks == 1) & (homes == 1), F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(along, across)))
    is_left, is_right = home & (own == F.floor(F.col("cell") / blocks)), F.col("block") == F.col("cell") % blocks
    role = F.when(is_left, LEFT).otherwise(0) + F.when(is_right, RIGHT).otherwise(0) + F.when(home, AT_HOME).otherwise(0)
    dealt_by = F.xxhash64("rep")
    out = []
    for w in range(waves):
        lists = index.select("rep", "n", "raw", "near", F.explode(F.filter("near", lambda p: p % waves == w)).alias("pivot"))  # noqa: B023
        lists = lists.withColumn("home", F.array_position(F.slice("near", 1, HOME), F.col("pivot")) > 0)
        lists = lists.withColumn("blocks", of({r.pivot: parts(r.c) for r in sizes})).withColumn("homes", of({r.pivot: parts(r.h) for r in sizes}))
        lists = lists.withColumn("block", F.pmod(dealt_by, blocks).cast("int")).withColumn("own", F.pmod(dealt_by, homes).cast("int"))
        cells = lists.withColumn("cell", F.explode(cell)).select("pivot", "cell", "rep", "n", "raw", "near", role.cast("int").alias("role"))
        out.append(durable(cells.groupBy("pivot", "cell").applyInArrow(work, "rep long, links long, parent long"), "links"))
    return out


def near_duplicates(vectors: DataFrame, pivots: int = MOST_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. pivots: the most there may be; 1 compares all pairs."""
    with shuffles_freed(vectors.sparkSession):
        return _near_duplicates(vectors, pivots)


def _near_duplicates(vectors: DataFrame, pivots: int) -> DataFrame:
    classes = durable(classes_of(vectors), "vectors")
    size = F.size("v")
    lengths = classes.groupBy(size.alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    # A vector that is the only one of its length links with its copies alone.
    lone = classes.filter(size.isin([r.d for r in lengths if r.n == 1])).select("key", "n", (F.col("n") - 1).alias("n_links"), F.col("rep").alias("component_id"))
    parts = [durable(lone, "lone")]
    indexes = {}
    for r in lengths:
        if r.n > 1:
            own = classes.filter(size == r.d)
            indexes[r.d] = durable(described(own, pivots_of(own, r.n, pivots)), "index")
    drop_durable(classes)
    for d, index in indexes.items():
        waves = linked(index, d)
        found = waves[0]
        for x in waves[1:]:
            found = found.union(x)
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        groups = connected_components(found, "rep", "parent")
        more = index.select("rep", "n", "key").join(links, "rep", "left").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
        parts.append(durable(more.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named"))
        drop_durable(index, groups, *waves)
    named = parts[0]
    for x in parts[1:]:
        named = named.unionByName(x)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _key(_value(vectors)).alias("key"))
    out = hot_joined(rows, named, "key", "n")
    out = durable(_finished(out.withColumn("linked", F.col("vec_id").isNotNull() & F.col("n_links").isNotNull())), "classes")
    drop_durable(*parts)
    return out


def _finished(rows: DataFrame) -> DataFrame:
    out = rows.select("vec_id", F.when(F.col("linked"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
