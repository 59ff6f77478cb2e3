"""Change logs as streams: each micro-batch is applied to a versioned table of state.

State lies in one folder per version; a batch reads the newest version below its own and writes its own, so a batch
that is run again after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reelforge.operators.merge import apply_change_log


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, ascending."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def current(spark: SparkSession, path: str, schema: StructType, below: int | None = None) -> DataFrame:
    found = [v for v in versions(spark, path) if below is None or v < below]
    return spark.read.schema(schema).parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def applied(path: str, keys: list[str], schema: StructType, event_id: str = "event_id", operation: str = "operation") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch."""

    def step(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        state = current(spark, path, schema, batch)
        apply_change_log(state, events, keys, event_id, operation).select(*schema.names).write.mode("overwrite").parquet(f"{path}/v{batch}")

    return step


def start(events: DataFrame, path: str, keys: list[str], schema: StructType, checkpoint: str, **trigger) -> StreamingQuery:
    """Applies a stream of events; trigger: as DataStreamWriter.trigger takes it, by default all there is and then stop."""
    writer = events.writeStream.foreachBatch(applied(path, keys, schema)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
