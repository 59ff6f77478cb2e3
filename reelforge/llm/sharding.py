"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots; bytes and rows are summed per slot; a versioned map, at most one row per
slot, says which shard holds each slot. The map is made by giving the largest slots first to the emptiest shard, and is
edited, never made anew, when shards are added or loads drift: an edit moves as few slots as it can. Only DataFrame
functions run on the records; the driver sees one row per slot.

Cases: null text has no bytes (size 1) and the checksum of an empty text; null ids are hashed by their text's checksum
alone; repeated rows are kept and take consecutive positions; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelforge.llm.shared import counted_out, durable, fresh_path

SLOTS = 4096


def in_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each document; the text is read here and nowhere else."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn(
        "vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")
    )


def first_map(load: dict[int, int], slots: int, shards: int) -> list[int]:
    """Shard of each slot: largest slots first, each to the shard with the fewest bytes so far."""
    out, heap = [0] * slots, [(0, s) for s in range(shards)]
    for slot in sorted(range(slots), key=lambda v: (-load.get(v, 0), v)):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + load.get(slot, 0), shard))
    return out


def edited_map(old: list[int], load: dict[int, int], shards: int, slack: float = 0.02) -> list[int]:
    """old, with slots moved from shards above the mean to the emptiest ones until all are within slack of the mean.

    When shards were added and loads were even, slots move to the new shards alone.
    """
    out, held, own = list(old), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(old):
        held[shard] += load.get(slot, 0)
        own[shard].append(slot)
    mean = sum(held) / shards
    if all(abs(h - mean) <= mean * slack for h in held):
        return out
    for shard in sorted(range(shards), key=lambda s: (-held[s], s)):
        for slot in sorted(own[shard], key=lambda v: (-load.get(v, 0), v)):
            size, to = load.get(slot, 0), min(range(shards), key=lambda s: (held[s], s))
            # A move brings both shards nearer to the mean, or is none.
            if size and held[shard] - size / 2 > mean and held[to] + size / 2 < mean:
                out[slot], held[shard], held[to] = to, held[shard] - size, held[to] + size
    return out


def constant(values, kind: str):
    """A literal array; it is parsed once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(list(values))), kind)


def save_map(spark: SparkSession, mapping: list[int], url: str, version: int) -> None:
    """Stores a version of the map, a table (slot, shard), under url; a version is never written twice."""
    rows = spark.range(1).select(F.posexplode(constant(mapping, "array<int>")).alias("slot", "shard"))
    rows.coalesce(1).write.parquet(f"{url}/version={version}")


def versions(spark: SparkSession, url: str) -> list[int]:
    """The versions stored whole under url, oldest first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(url)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{url}/version=*/_SUCCESS")) or []
    return sorted(int(str(f.getPath().getParent().getName()).split("=")[1]) for f in found)


def load_map(spark: SparkSession, url: str, version: int) -> list[int]:
    return [r.shard for r in spark.read.parquet(f"{url}/version={version}").orderBy("slot").collect()]  # one row for each slot


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, url: str | None = None, law: str = "bytes") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (position in the shard, gapless from 0), vslot, map_version, grown_shard.

    url: where the map's versions lie. The newest one is applied; where shards were added or loads have drifted it is
    edited and stored as the next version. Without one, a map is made from the bytes per slot and stored as version 1.
    """
    spark, url = docs.sparkSession, url or fresh_path(docs.sparkSession, "slot-map")
    # Equal rows are counted, not carried one by one: a row that repeats without end is no hot slot.
    rows = durable(in_slots(docs, slots).groupBy("vslot", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "slot-rows")
    per = rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")).collect()  # one row for each slot
    load, stored = {r.vslot: r.bytes for r in per}, versions(spark, url)
    old = load_map(spark, url, stored[-1]) if stored else None
    if old is not None and len(old) != slots:
        raise ValueError("the number of slots is fixed")
    mapping = first_map(load, slots, shards) if old is None else edited_map(old, load, shards)
    version = stored[-1] if mapping == old else stored[-1] + 1 if stored else 1
    if mapping != old:
        save_map(spark, mapping, url, version)
    counts, starts, filled = {r.vslot: r.rows for r in per}, [0] * slots, [0] * shards
    for slot, shard in enumerate(mapping):
        starts[slot] = filled[shard]
        filled[shard] += counts.get(slot, 0)
    w = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    first = F.get(constant(starts, "array<long>"), F.col("vslot")) + F.sum("n").over(w) - F.col("n")
    return counted_out(rows.withColumn("first", first), F.col("n"), "copy").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        F.get(constant(mapping, "array<int>"), F.col("vslot")).alias("shard"),
        (F.col("first") + F.col("copy")).alias("slot"),
        "vslot",
        F.lit(version).alias("map_version"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
