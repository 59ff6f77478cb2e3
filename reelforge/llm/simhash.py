"""Document fingerprints by SimHash, with DataFrame functions alone.

Terms are runs of five words of the lower-cased text, weighted by their count; each term's 64-bit hash votes on every
bit of the fingerprint. Votes are counted two bits to a long, in lanes of 32 bits, so a document's votes are 32 sums.
Fingerprints within a Hamming radius are found by tables of permuted blocks: with more blocks than the radius, two such
fingerprints agree on all blocks outside some choice of `radius` of them, so one table per choice finds every pair.

The document before another in ascending order is found without a global sort: ids are cut into buckets at quantiles,
the last document of each bucket is also put before the next bucket's first, and windows run within buckets.

Cases: null and blank texts have no terms and the fingerprint 0; a text of fewer than five words is one term; null ids
sort first; rows of equal id are ordered by text, and repeated rows follow each other; a single document is its own
next; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.llm.shared import durable, hot_joined, partitions_for

SHINGLE = 5
LANES = 0x0000000100000001


def terms(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of `size` words, with repeats; of all words if they are fewer; none without a word."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
    few = lambda h: F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))
    # The words are hashed once: transform over an array of one array gives them a name.
    return F.flatten(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= size, runs(h)).otherwise(few(h))))


def votes(term: Column) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(term, j).bitwiseAND(F.lit(LANES))).alias(f"v{j}") for j in range(32)]


def fingerprint(n: str = "terms") -> Column:
    """The bits for which more than half of the votes are; to select after aggregating votes() and a count of terms."""
    bits = []
    for j in range(32):
        v = F.coalesce(F.col(f"v{j}"), F.lit(0))
        for shift, count in ((j, v.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(v, 32))):
            bits.append(F.when(count * 2 > F.col(n), F.shiftleft(F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long")))
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def fingerprints(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys and fp (long) of each row; keys name a row."""
    exploded = rows.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    summed = exploded.groupBy(*keys).agg(F.count("term").alias("terms"), *votes(F.col("term")))
    return summed.select(*keys, fingerprint().alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def tables(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of the bits on which each table's pairs agree."""
    blocks = blocks or (1 if radius < 1 else radius + 3)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    mask = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [sum(m for i, m in enumerate(mask) if i not in out) for out in combinations(range(blocks), radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b, distance), a < b, of distinct values of fp at most `radius` bits apart; documents join them by fp."""
    distinct = fps.select("fp").filter("fp is not null").distinct()
    keys = F.array(*(F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(tables(radius))))
    cells = distinct.select("fp", F.explode(keys).alias("key")).select("key.table", "key.bits", "fp")
    other = cells.withColumnRenamed("fp", "b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    pairs = cells.withColumnRenamed("fp", "a").join(other, ["table", "bits"]).filter("a < b")
    # Several tables may find a pair: it counts in the first of them.
    first = F.coalesce(*(F.when(differing.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(i)) for i, m in enumerate(tables(radius))))
    return pairs.filter((F.bit_count(differing) <= radius) & (F.col("table") == first)).select("a", "b", F.bit_count(differing).alias("distance"))


# ---- each document beside its next -----------------------------------------------------------------------------------


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most value: a binary search in a literal array; null is before all."""
    if not bounds:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps(bounds)), "array<long>")
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= value, at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def in_order(docs: DataFrame) -> DataFrame:
    """bucket, pos, doc_id, text, next_text of each document, and for each bucket, at pos 0, the document before its first."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = 4 * partitions_for(docs.sparkSession)
    cuts = own.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 100 * count).alias("q")).first().q
    bounds = sorted(set(cuts or []))
    own = own.withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    tops = {r.bucket: r.top for r in own.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}  # a row for each bucket
    order = sorted(tops)
    before = {b: tops[order[i - 1]] for i, b in enumerate(order)}
    ids = sorted({x for x in before.values() if x is not None})
    # All ids of a bucket are null only where no id is set, and then there is one bucket.
    wanted = own.filter(F.col("doc_id").isin(ids) if ids else F.col("doc_id").isNull())
    last = wanted.groupBy("doc_id").agg(F.max("text").alias("text"))
    follows: dict = {}
    for b, x in before.items():
        follows.setdefault(x, []).append(b)
    pairs = json.dumps([{"id": x, "b": bs} for x, bs in follows.items()])
    targets = F.from_json(F.lit(pairs), "array<struct<id: long, b: array<int>>>")
    mine = F.flatten(F.transform(F.filter(targets, lambda t: t["id"].eqNullSafe(F.col("doc_id"))), lambda t: t["b"]))
    ghosts = last.select("doc_id", "text", F.explode(mine).alias("bucket"), F.lit(0).alias("real"))
    both = own.withColumn("real", F.lit(1)).unionByName(ghosts)
    w = Window.partitionBy("bucket").orderBy("real", F.col("doc_id").asc_nulls_first(), "text")
    return both.select("bucket", (F.row_number().over(w) - 1).alias("pos"), "doc_id", "text", F.lag("text").over(w).alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """text with its last half, rounded down, replaced by as much of the start of next_text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), half))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    rows = in_order(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    both = rows.select(
        "bucket",
        "pos",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("tag"), F.col("text")), F.struct(F.lit(1).alias("tag"), F.col("edited").alias("text")))).alias("t"),
    ).select("bucket", "pos", "doc_id", "n_chars", "edited_sha256", "t.tag", "t.text")
    fps = fingerprints(both, "text", ["bucket", "pos", "tag", "doc_id", "n_chars", "edited_sha256"])
    # Each position has two rows, of the text and of the edited text; a position's next document stands one position before.
    w = Window.partitionBy("bucket").orderBy("pos", "tag")
    near = fps.select("pos", "tag", "doc_id", "n_chars", "edited_sha256", "fp", F.lead("fp").over(w).alias("edited_fp"), F.lag("fp", 2).over(w).alias("next_fp"))
    return near.filter("tag = 0 and pos > 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "fp",
    )


def fingerprinted(docs: DataFrame, radius: int = 3) -> DataFrame:
    """compared() and n_near: the other documents whose fingerprints are at most `radius` bits away, equal texts included.

    The search runs over distinct fingerprints; copies are counted.
    """
    rows = durable(compared(docs), "fingerprints")
    sizes = rows.groupBy("fp").agg(F.count("*").alias("n"))
    pairs = within_radius(sizes, radius)
    both = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    others = both.join(sizes.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("others"))
    near = durable(sizes.join(others, "fp", "left").select("fp", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")), "near")
    return hot_joined(rows, near, "fp", "n").drop("fp")
