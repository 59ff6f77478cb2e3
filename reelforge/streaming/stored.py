"""Sinks that may be asked twice, and state kept as JSON that is upgraded when it is read.

A batch sink cuts the rows of each key into chunks of bounded size and hands every chunk over once: chunks are named by
batch, key and number, and those already noted as sent are passed over when a batch is run again.

A stored payload holds a key's entries, what is not yet sent, and the cursor of its log. Older ones lack completion flags
or keys; reading fills them in, keeps the newest entry of a key and forgets unsent keys that have no entry. A payload that
cannot be read is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelforge.functions.progress import clamped_percent, completion
from reelforge.operators.order import chunked
from reelforge.shipping import ship

CHUNK = 500  # rows of a chunk, a fixed value

Send = Callable[[str, Sequence[dict]], None]  # a chunk's name, its rows


def chunks_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = CHUNK) -> DataFrame:
    """rows with chunk (from 0), in order within a key."""
    return chunked(rows, keys, list(order), size)


def sink(send: Send, sent: str, keys: Sequence[str], order: Sequence[str], size: int = CHUNK) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. send runs in executors, one call a chunk; sent: a folder that notes what was handed over.

    A task that fails between send and note sends its chunk again under the same name, by which the receiver knows it.
    """

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        ship(spark)
        name = F.concat_ws("/", F.lit(str(batch)), *(F.col(k).cast("string") for k in keys), F.col("chunk").cast("string"))
        named = chunks_of(rows, keys, order, size).withColumn("name", name)
        path = f"{sent}/batch={batch}"
        try:
            done = spark.read.schema("name string").parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], "name string")
        left = named.join(done, "name", "left_anti")
        columns = [c for c in left.columns if c not in ("name", "chunk")]

        def work(key: tuple, group):
            import pandas as pd

            send(key[0], group.sort_values(list(order))[columns].to_dict("records"))
            return pd.DataFrame({"name": [key[0]]})

        left.groupBy("name").applyInPandas(work, "name string").write.mode("append").parquet(path)

    return step


ENTRY = "id string, season int, episode int, progress_key string, position long, duration long, percent double, complete boolean, updated long"
PAYLOAD = f"entries array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in ENTRY.split(', '))}>>, pushed long, cursor long, initialized boolean, dirty array<string>"


def progress_key(key: Column, id_: Column, season: Column, episode: Column) -> Column:
    """The stored key, or one made of id, season and episode."""
    own = F.when(season.isNotNull() & episode.isNotNull(), F.concat(id_, F.lit("_s"), season.cast("string"), F.lit("e"), episode.cast("string"))).otherwise(id_)
    return F.coalesce(F.when(F.trim(key) != "", key), own)


def decoded(payloads: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(key and upgraded entries, the newest of each progress key; key, pushed, cursor, initialized, dirty)."""
    read = payloads.select(key, F.from_json(payload, PAYLOAD, {"mode": "PERMISSIVE"}).alias("p"))
    rows = read.select(key, F.posexplode("p.entries").alias("at", "e")).filter("e.id is not null").select(key, "at", "e.*")
    rows = rows.withColumn("complete", completion(F.col("complete"), F.col("percent"), F.coalesce("position", F.lit(0)), F.coalesce("duration", F.lit(0))))
    rows = rows.withColumn("progress_key", progress_key(F.col("progress_key"), F.col("id"), F.col("season"), F.col("episode")))
    rows = rows.withColumn("position", F.greatest(F.coalesce("position", F.lit(0)), F.lit(0))).withColumn("duration", F.coalesce("duration", F.lit(0)))
    rows = rows.withColumn("percent", F.coalesce(clamped_percent(F.col("percent")), F.when(F.col("complete") & (F.col("duration") <= 0), 100.0)))
    least = F.lit(-(2**31))
    fresh = F.struct(F.coalesce("updated", F.lit(0)), "position", "duration", "id", F.coalesce("season", least), F.coalesce("episode", least), "complete", F.coalesce("percent", F.lit(float("-inf"))), -F.col("at"))
    names = [c.split()[0] for c in ENTRY.split(", ")]
    newest = rows.groupBy(key, "progress_key").agg(F.max_by(F.struct(*names), fresh).alias("e")).select(key, "e.*")
    kept = newest.groupBy(key).agg(F.collect_set("progress_key").alias("keys"))
    none = F.array().cast("array<string>")
    meta = read.join(kept, key, "left").select(
        key, F.coalesce("p.pushed", F.lit(0)).alias("pushed"), F.coalesce("p.cursor", F.lit(0)).alias("cursor"), F.coalesce("p.initialized", F.lit(False)).alias("initialized"),
        F.array_sort(F.array_intersect(F.coalesce("p.dirty", none), F.coalesce("keys", none))).alias("dirty"),
    )
    return newest, meta


def encoded(entries: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """key, payload: entries newest first, and the rest, as JSON."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    newest_first = F.transform(F.sort_array(F.collect_list(F.struct("updated", "progress_key", F.struct(*names).alias("e"))), asc=False), lambda x: x["e"])
    both = meta.join(entries.groupBy(key).agg(newest_first.alias("entries")), key, "left")
    none = F.array().cast(entries.groupBy(key).agg(newest_first.alias("e")).schema["e"].dataType)
    return both.select(key, F.to_json(F.struct(F.coalesce("entries", none).alias("entries"), "pushed", "cursor", "initialized", "dirty")).alias("payload"))
