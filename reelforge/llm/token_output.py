"""Token-ID output: independent zstandard frames, a seek table at the end and a checksum for each frame.

A shard file holds one frame per document, in order of id, each the document's token ids as little-endian unsigned
32-bit integers; then a skippable frame with the document ids; then the seek table of zstandard's seekable format
(sizes and the low 32 bits of XXH64 of the content of each frame). Any zstandard tool can decompress a file whole; a
reader of one document reads the two tables and that document's frame alone.

Cases: a null text counts as empty and holds the end id alone; a null id sorts first and is kept; rows with equal ids
are kept, ordered by the first 64 characters of their text and then by a hash of it; an empty table gives no rows and a manifest without shards; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelforge.llm.files import committed, open_fs, put_json
from reelforge.llm.shared import drop_durable, durable, fresh_path, held, new_run, partitions_for

# Fixed values of zstandard's seekable format and of this file's own skippable frame.
SEEK_SKIPPABLE, IDS_SKIPPABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
NO_ID = -(1 << 63)  # a null id in the table of ids
END_ID = 2
STRETCHES = 4096  # distinct stretches that the library gets as one text
BATCH_BYTES = 8 << 20  # of texts whose stretches are made distinct together
SHARD_BYTES = 256 << 20  # of frames, after which a task rolls over to its next file
# White space by Unicode and by Python, in the classes of RE2; texts in which a blank stands beside white space or an edge.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = f"^$|^{_SPACE}|{_SPACE}$| {_SPACE}|{_SPACE} "
BETWEEN = re.compile(r"(?<=\S) (?=\S)").split


class Encoder:
    """Token ids of whole texts by a byte-level BPE file of the tokenizers library, as bytes of 32-bit integers.

    The library merges nothing across a single blank between two visible characters, so a text's ids are those of its
    stretches between such blanks, in order. Each distinct stretch of a batch goes through the library once, many in
    one text; the first stretch of a text, which no blank leads, and what else a text's edges change go through it alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A byte-level token has a character per byte, so ids say how many bytes of a text they stand for.
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.whole = any(" " in t.content or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values())

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def stretches(self, distinct: pa.Array) -> pa.Array:
        """Ids of each stretch, led by a blank, as large binaries."""
        n = len(distinct)
        groups = np.append(np.arange(0, n, STRETCHES), n)
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(groups, pa.int64()), distinct), pa.scalar(" ", distinct.type))
        ids = [self.library([f" {t}"])[0] for t in texts.to_pylist()]  # a text at a time, for their memory
        ids = np.concatenate(ids) if ids else np.empty(0, "<u4")
        ends = np.cumsum(np.asarray(pc.binary_length(distinct), np.int64) + 1)
        cuts = 4 * np.searchsorted(np.cumsum(self.widths[ids]), ends, side="right")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, cuts).astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])

    def encode(self, text: str) -> bytes:
        return self.encoded(pa.array([text]))[0]

    def encoded(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; none is null."""
        texts = texts.cast(pa.large_string())
        if self.whole:
            return [x.tobytes() for t in texts.to_pylist() for x in self.library([t])]
        odd = np.asarray(pc.match_substring_regex(texts, ODD))
        parts = pc.split_pattern(texts, " ")
        tails = [""] * len(texts)
        if odd.any():  # cut by the longer rule; their last stretch depends on the text's end
            lists = parts.to_pylist()
            for i in np.flatnonzero(odd).tolist():
                lists[i] = BETWEEN(texts[i].as_py())
                if len(lists[i]) > 1:
                    tails[i] = " " + lists[i].pop()
            parts = pa.array(lists, pa.large_list(pa.large_string()))
        heads = self.library(pc.list_element(parts, 0).to_pylist())
        ends = self.library(tails)
        at = np.asarray(parts.offsets, np.int64)
        own = parts.flatten().dictionary_encode()
        taken = self.stretches(own.dictionary).take(own.indices)
        _, offsets, data = taken.buffers()
        where = np.frombuffer(offsets, "<i8")[taken.offset :]
        data = memoryview(data or b"")
        return [b"".join((head.tobytes(), data[where[a + 1] : where[b]], tail.tobytes())) for head, tail, a, b in zip(heads, ends, at[:-1].tolist(), at[1:].tolist(), strict=True)]


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together until they hold about so many bytes: more of a batch's stretches are then equal."""
    held_, n = [], 0
    for b in batches:
        held_.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(held_)
            held_, n = [], 0
    if held_:
        yield pa.Table.from_batches(held_)


def write_shard(url: str, documents: Iterable[tuple[int | None, bytes]], most: int = SHARD_BYTES) -> tuple[int, int]:
    """Writes documents until the shard's frames hold `most` bytes; returns how many it took and their tokens."""
    pack, ids, table, tokens, size = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True), [], [], 0, 0
    with committed(url) as out:
        for doc_id, content in documents:  # a list or an iterator that the next shard goes on with
            frame = pack.compress(content)
            out.write(frame)
            ids.append(NO_ID if doc_id is None else doc_id)
            table.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            tokens += len(content) // 4
            size += len(frame)
            if size >= most:
                break
        body = np.asarray(ids, "<i8").tobytes()
        out.write(struct.pack("<II", IDS_SKIPPABLE, len(body)) + body)
        body = b"".join(table) + struct.pack("<IBI", len(table), CHECKSUMS, SEEK_MAGIC)
        out.write(struct.pack("<II", SEEK_SKIPPABLE, len(body)) + body)
    return len(ids), tokens


def read_tables(f) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, frame offsets (one more than frames) and rows of (packed size, size, checksum)."""
    f.seek(f.size() - 9)
    n, kind, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_MAGIC or kind != CHECKSUMS:
        raise ValueError("no seek table with checksums")
    tail = 12 * n + 9 + 8
    f.seek(f.size() - tail - 8 * n - 8)
    body = f.read(8 * n + 8 + tail)
    if struct.unpack_from("<II", body) != (IDS_SKIPPABLE, 8 * n) or struct.unpack_from("<I", body, 8 * n + 8)[0] != SEEK_SKIPPABLE:
        raise ValueError("no table of document ids")
    table = np.frombuffer(body, "<u4", 3 * n, 8 * n + 16).reshape(n, 3)
    return np.frombuffer(body, "<i8", n, 8), np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)]), table


def frames(f, wanted: Iterable[int], offsets: np.ndarray, table: np.ndarray) -> Iterator[bytes]:
    """The contents of the wanted frames; each is checked against the table."""
    unpack = zstandard.ZstdDecompressor()
    for i in wanted:
        f.seek(int(offsets[i]))
        content = unpack.decompress(f.read(int(table[i, 0])), max_output_size=int(table[i, 1]))
        if len(content) != table[i, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != table[i, 2]:
            raise ValueError(f"frame {i}: wrong checksum")
        yield content


def read_documents(url: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """Token ids of the requested documents of a shard; no other frame is read."""
    system, path = open_fs(url)
    with system.open_input_file(path) as f:
        ids, offsets, table = read_tables(f)
        at = np.flatnonzero(np.isin(ids, np.asarray(list(doc_ids), np.int64)))
        return {int(ids[i]): np.frombuffer(x, "<u4") for i, x in zip(at, frames(f, at, offsets, table), strict=True)}


def write_tokens(docs: DataFrame, url: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes docs (doc_id, text) under url in ascending id; returns the manifest (shard, url, docs, tokens, start).

    Ranges are cut by id, then text, then row, so that rows of one id, or of none, are no single task's; each range
    rolls its files by size.
    """
    spark = docs.sparkSession
    n, end, run = parts or partitions_for(spark), struct.pack("<I", end_id), new_run()

    def write(batches):
        part = TaskContext.get().partitionId()

        def documents():
            own = held(run, Encoder, tokenizer)
            for t in gathered(batches, BATCH_BYTES):
                yield from zip(t["doc_id"].to_pylist(), (x + end for x in own.encoded(t["text"].combine_chunks())), strict=True)

        rows, k = documents(), 0
        while (first := next(rows, None)) is not None:
            out = f"{url}/shard-{part:06d}-{k:04d}.zst"
            done, tokens = write_shard(out, chain([first], rows), shard_bytes)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([out]), pa.array([done], pa.int64()), pa.array([tokens], pa.int64())], names=["part", "k", "url", "docs", "tokens"])
            k += 1

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = own.select("*", F.substring("text", 1, 64).alias("lead"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("lead"), F.col("h"), F.col("row")]
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = durable(ordered.mapInArrow(write, "part int, k int, url string, docs long, tokens long"), "token-manifest")
    found, start = [], 0
    for r in manifest.orderBy("part", "k").toLocalIterator():  # a row for each file
        found.append({"shard": len(found), "url": r.url, "docs": r.docs, "tokens": r.tokens, "start": start})
        start += r.tokens
    drop_durable(manifest)
    put_json(f"{url}/manifest.json", {"end_id": end_id, "shards": found})
    return spark.createDataFrame(found or [], "shard int, url string, docs long, tokens long, start long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest, read from the files."""

    def read(batches):
        for b in batches:
            for url, start in zip(b["url"].to_pylist(), b["start"].to_pylist(), strict=True):
                system, path = open_fs(url)
                with system.open_input_file(path) as f:
                    ids, offsets, table = read_tables(f)
                    sizes = table[:, 1].astype(np.int64) // 4
                    sums = [zlib.crc32(x) for x in frames(f, range(len(ids)), offsets, table)]
                starts = start + np.cumsum(sizes) - sizes
                yield pa.record_batch([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, partitions_for(manifest.sparkSession))
    return manifest.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes, writes to the shared folder and reads back."""
    return read_tokens(write_tokens(docs, fresh_path(docs.sparkSession, "tokens"), tokenizer))
