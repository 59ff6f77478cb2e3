"""WARC: a deterministic sharded writer and a reader.

Pages are dealt by range of page_id and sorted, so files hold ascending ids; a file is closed when its compressed bytes
pass a limit; every record is its own gzip member with headers, record id and digests made anew from the payload. Files
are written under temporary names, renamed, and count once a manifest names them. The same pages give the same bytes.

Of records with equal payloads of at least `least_bytes` bytes, that of the largest page_id is a response and the others
are revisits to it; smaller ones are all responses. Cases: null html counts as empty; a null page_id sorts first and
loses to any other; of rows with equal page_id and equal payload one is the response and the rest revisit it; an empty
table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelforge.llm.files import committed, open_fs, put_json
from reelforge.llm.shared import durable, fresh_path, partitions_for

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_urn(page_id: int | None, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, copy: int = 0) -> bytes:
    """A response or revisit record, uncompressed."""
    digest = b32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id, copy)}",
        f"WARC-Date: {DATE}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        *([f"WARC-Target-URI: {clean}"] if (clean := "".join((url or "").split())) else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)  # its header holds no name and no time
    return pack.compress(data) + pack.flush()


def write_warc(pages: DataFrame, url: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, shards: int | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) under url; returns the manifest (url, records, bytes)."""
    spark = pages.sparkSession
    n = shards or partitions_for(spark)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = own.select("page_id", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= least_bytes)
    groups = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1").select("digest", "refers_to")
    # A row for each copy, with the page it refers to; it carries no text, and meets its page by the same range of page_id.
    copies = digests.join(groups, "digest").select("page_id", "digest", "refers_to").distinct()
    both = own.select("page_id", "url", "html", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind")).unionByName(
        copies.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to", F.lit(0).alias("kind"))
    )
    ordered = both.repartitionByRange(n, F.col("page_id").asc_nulls_first()).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "kind", "html", "url")

    def write(batches):
        task = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "kind")), strict=True))
        row, part = next(rows, None), 0
        group, seen, copy, now = {}, set(), 0, object()
        while row is not None:
            name, records, size = f"{url}/part-{task:06d}-{part:04d}.warc.gz", 0, 0
            with committed(name) as out:
                while row is not None and size < file_bytes:
                    page_id, address, html, digest, refers_to, kind = row
                    if page_id != now:
                        group, seen, copy, now = {}, set(), 0, page_id
                    if kind == 0:
                        group[digest] = refers_to
                    else:
                        payload = html.encode()
                        d = hashlib.sha1(payload).digest()
                        target = group.get(d, page_id)
                        revisit = d in group and (target != page_id or d in seen)
                        seen.add(d)
                        data = gzip_member(record(page_id, address, payload, target, revisit, copy))
                        out.write(data)
                        records, size, copy = records + 1, size + len(data), copy + 1
                    row = next(rows, None)
            yield pa.record_batch([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["url", "records", "bytes"])
            part += 1

    manifest = durable(ordered.mapInArrow(write, "url string, records long, bytes long"), "warc-manifest")
    put_json(f"{url}/manifest.json", [r.asDict() for r in manifest.orderBy("url").toLocalIterator()])  # a row for each file
    return manifest


def members(f, step: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    rest, done = f.read(step), False
    while rest:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = f.read(step)
                if not rest:
                    raise ValueError("a gzip member is cut short")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        yield b"".join(parts)
        rest = rest or f.read(step)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{b32(hashlib.sha1(block).digest())}":
        raise ValueError("not a whole record")
    return fields, block


def read_warc(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the files of a manifest."""

    def read(batches):
        for b in batches:
            for url in b["url"].to_pylist():
                system, path = open_fs(url)
                rows: list[tuple] = []
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
                    for data in members(f):
                        fields, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != said or b32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"page {fields['X-Page-ID']}: another payload than its headers say")
                        own, other = fields["X-Page-ID"].strip(), fields.get("X-Refers-To-Page-ID", "").strip()
                        rows.append((int(own) if own else None, said, digest, fields["WARC-Type"], int(other) if other else None))
                        if len(rows) == 10_000:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, partitions_for(manifest.sparkSession))
    return manifest.filter("records > 0").select("url").repartition(n, "url").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes to the shared folder and reads back."""
    return read_warc(write_warc(pages, fresh_path(pages.sparkSession, "warc"), least_bytes))
