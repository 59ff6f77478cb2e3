"""What several operators need: durable tables in the cluster's shared folder, vector sums, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_HELD: dict = {}
_HELD_BY: list[str] = []


def held(run: str, make, *args):
    """make(*args), kept in this Python worker while tasks of one run follow each other. Tasks of another run free it:
    workers live on between stages, and what they keep counts against their executor."""
    if _HELD_BY != [run]:
        _HELD.clear()
        _HELD_BY[:] = [run]
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)
    if (make, args) not in _HELD:
        _HELD[make, args] = make(*args)
    return _HELD[make, args]


def new_run() -> str:
    return uuid.uuid4().hex


BATCH_ROWS = 500  # rows of an Arrow batch: texts are long, and an executor's Python workers share little memory


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that their Python finds it wherever they run; bounds Arrow batches."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_reelforge_shipped", None) is None:
        top = Path(__file__).resolve().parents[1]
        packed = Path(tempfile.mkdtemp(prefix="reelforge-code-")) / f"{top.name}.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        sc.addPyFile(str(packed))
        sc._reelforge_shipped = packed


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if getattr(sc, "_reelforge_dir", None) is None:
        one_machine = sc.master == "local" or sc.master.startswith("local[")
        sc._reelforge_dir = f"file://{tempfile.mkdtemp(prefix='reelforge-')}" if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_reelforge"
    return sc._reelforge_dir


def clean(spark: SparkSession) -> None:
    """Deletes every table and file this package has left in the shared folder; results not yet written elsewhere go too."""
    delete_path(spark, f"{shared_dir(spark)}/reelforge")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/reelforge/{uuid.uuid4().hex[:12]}-{name}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and no executor's loss costs it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files go when the write that made them ends, not when the driver's memory happens to be cleaned."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def drop_durable(*tables: DataFrame) -> None:
    """Deletes tables of durable() that nothing reads any more."""
    for t in tables:
        delete_path(t.sparkSession, t._durable_path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one, that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plainly_named(df: DataFrame) -> DataFrame:
    """df with its columns numbered: functions over batches take no names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- sums of count vectors -------------------------------------------------------------------------------------------

VECTOR_SLICE = 4096
VECTOR_SCHEMA = "kind int, slice int, counts binary"


def vector_rows(kind: int, counts: np.ndarray) -> pa.RecordBatch:
    """One task's int64 counts as rows of VECTOR_SLICE entries each; slices without a count are left out."""
    parts = [(i, counts[i * VECTOR_SLICE : (i + 1) * VECTOR_SLICE]) for i in range(-(-len(counts) // VECTOR_SLICE))]
    parts = [(i, x) for i, x in parts if x.any()]
    return pa.record_batch(
        [pa.array([kind] * len(parts), pa.int32()), pa.array([i for i, _ in parts], pa.int32()), pa.array([x.astype("<i8").tobytes() for _, x in parts], pa.binary())],
        names=["kind", "slice", "counts"],
    )


def _sum_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for kind, part, blob in zip(b["kind"].to_pylist(), b["slice"].to_pylist(), b["counts"].to_pylist(), strict=True):
            x = np.frombuffer(blob, "<i8")
            held[kind, part] = held[kind, part] + x if (kind, part) in held else x
    keys = list(held)
    yield pa.record_batch(
        [pa.array([k for k, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()), pa.array([held[k].astype("<i8").tobytes() for k in keys], pa.binary())],
        names=["kind", "slice", "counts"],
    )


def summed_rows(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of one vector for each kind and slice: the sums of all tasks' vectors. A task holds the slices dealt to it."""
    n = partitions_for(rows.sparkSession)
    return rows.repartition(min(n, most or n), "kind", "slice").mapInArrow(_sum_slices, VECTOR_SCHEMA)


def summed_vectors(rows: DataFrame, kinds: int, width: int) -> np.ndarray:
    """Sum of every task's vectors, kinds x width; the driver gets the fixed-size total."""
    out = np.zeros((kinds, width), np.int64)
    for r in summed_rows(rows, kinds * -(-width // VECTOR_SLICE)).collect():
        x = np.frombuffer(r.counts, "<i8")
        out[r.kind, r.slice * VECTOR_SLICE : r.slice * VECTOR_SLICE + len(x)] += x
    return out


BROADCAST_ROWS = 500_000  # of two longs: 8 MB


def joined(left: DataFrame, right: DataFrame, on: str, rows: int, how: str = "left") -> DataFrame:
    """left joined to right, whose counted rows decide whether it is broadcast or both are shuffled."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def hot_joined(left: DataFrame, right: DataFrame, on: str, n: str) -> DataFrame:
    """left with the columns of right (one row for each value of on, and in n how often left has it), null where right has none.

    Values with so many rows that a partition would feel them are few; they go to their rows, the rest is shuffled.
    """
    many = F.col(n) > max(1000, (right.agg(F.sum(n)).first()[0] or 0) // (16 * partitions_for(left.sparkSession)))
    hot = right.filter(many).drop(n)
    if not hot.limit(1).count():
        return left.join(right.drop(n), on, "left")
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.filter(~many).drop(n), on, "left")
    return left.join(F.broadcast(hot), on).unionByName(rest)


def counted_out(df: DataFrame, n: Column, name: str, block: int = 65_536) -> DataFrame:
    """Each row of df n times, numbered from 0; no array holds more than `block` numbers however large n is."""
    at = unused(df, "block")
    blocks = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / F.lit(block)))).alias(at))
    first = F.col(at) * block
    return blocks.select(*df.columns, F.explode(F.sequence(first, F.least(first + block, n.cast("long")) - 1)).alias(name))


# ---- connected components --------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of an edge, the smallest node it reaches.

    Contraction: each node hooks to its smallest neighbour, hooks are halved by one jump, edges are rewritten to the
    hooked ends and loops go. The edges shrink each round; rounds end when none is left. All state is in durable
    tables, and the driver sees only counts. Null ends and loops are no edges; no edges give an empty result.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u is not null and v is not null and u < v").distinct()
    e = durable(e, "edges")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    state = durable(nodes.select("node", F.col("node").alias("root")), "roots")
    while e.limit(1).count():
        hook = durable(e.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("p")), "hooks")
        rows = hook.count()
        up = hook.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        jump = durable(joined(hook, up, "p", rows).select("n", F.coalesce("pp", "p").alias("p")), "jumps")
        pu, pv, moved = (jump.select(F.col("n").alias(x), F.col("p").alias(f"p{x}")) for x in ("u", "v", "root"))
        ends = joined(joined(e, pu, "u", rows), pv, "v", rows).select(F.coalesce("pu", "u").alias("x"), F.coalesce("pv", "v").alias("y"))
        e2 = durable(ends.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        state2 = durable(joined(state, moved, "root", rows).select("node", F.coalesce("proot", "root").alias("root")), "roots")
        drop_durable(e, state, hook, jump)
        e, state = e2, state2
    drop_durable(e)
    out = state.select("node", F.col("root").alias("component"))
    out._durable_path = state._durable_path
    return out
