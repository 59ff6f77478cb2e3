"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into the pieces of a SentencePiece model whose scores have the largest sum; of equal sums the path wins
that, read from the end, has the longest piece where they first differ. Scores are rounded to 1/65536, so that sums are
exact and a text has the same ids however it is chunked.

A document longer than CHUNK is split into chunks. The state at a boundary is how far the piece that crosses it reaches
into the next chunk. A chunk yields a matrix: the best score from each state at its start to each state at its end.
Matrices combine by max-plus products, which are associative: a tree of products, FAN to a node, gives every chunk the
best scores of its entry states. With them a chunk says from which entry the path to each of its leave states came;
these maps combine by composition, in a tree again, and each chunk then traces its own pieces back between the states
it was given. Chunks of all documents are dealt out alike, so a giant document is no giant task.

Between characters that stand side by side in no piece every path has a cut; stretches between such places are encoded
once while a bounded cache holds them. Characters without a piece become their UTF-8 bytes' pieces, at the model's
least score less 10 each, so decoding gives back every text exactly, a literal U+2581 included.

The public model here is of BPE type: its pieces and scores are used as a best-path model's, which is what this method
computes; the ids are those of the library where the same file is read as a unigram model, not those of merging pair by
pair.

Cases: null counts as empty, and the empty text is the lone prefix blank; repeated rows give equal rows; null ids are
kept; an empty table gives no rows; other columns are not read by encoded() and kept by tokenized().
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelforge.llm.shared import drop_durable, durable, held, new_run, partitions_for

CHUNK = 65_536
FAN = 64  # matrices or maps that one node of a tree combines
EXACT = 65_536  # scores are multiples of one over this
CACHED = 450_000
BLANK, LITERAL = "▁", "\ud800"  # the model's blank; what stands for a literal U+2581, and in no text
UNKNOWN_LESS = 10.0
NEVER = float("-inf")


class Pieces:
    """A model's pieces, scores and byte pieces, and best paths over them."""

    def __init__(self, path: str, cached: int = CACHED):
        import sentencepiece

        self.cached = cached

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        score = [round(model.get_score(i) * EXACT) / EXACT for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.id = {self.text[i]: i for i in plain}
        #: score of each piece; None for what only begins one
        self.node: dict[str, float | None] = {}
        for i in plain:
            for k in range(1, len(self.text[i])):
                self.node.setdefault(self.text[i][:k])
        for i in plain:
            self.node[self.text[i]] = score[i]
        self.longest = max(len(self.text[i]) for i in plain)
        self.unknown = min(score[i] for i in plain) - UNKNOWN_LESS
        self.inner = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        # Stretches are found by a regex where blanks only lead pieces and line ends are in none.
        self.split = not any(x[1] == BLANK and x[0] != BLANK or "\n" in x for x in self.inner)
        # Marks that follow no Latin letter within a piece: a stretch ends before them where they follow one.
        latin = "A-Za-zÀ-ÖØ-öø-ÿ"
        after = {b for a, b in self.inner if re.match(f"[{latin}]", a)}
        m = re.escape("".join(x for x in "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~" if x not in after)) or LITERAL
        self.stretches = re.compile(f"\n|{BLANK}*[^{BLANK}\n{latin}]*[{latin}]*(?:[^{BLANK}\n{latin}{m}][^{BLANK}\n{latin}]*[{latin}]*)*").findall
        self.known: dict[str, bytes] = {}
        # What an id adds to a path's score: a character without a piece counts once, with its first byte.
        self.worth = np.zeros(size)
        for i in plain:
            self.worth[i] = score[i]
        for b, i in self.byte_id.items():
            self.worth[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown
        self.raw: list[bytes | None] = [None] * size
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        for i in plain:
            self.raw[i] = self.text[i].replace(BLANK, " ").encode()

    def forward(self, s: str, entry: dict[int, float], stop: int) -> tuple[list[float], list[int]]:
        """Best scores of each place of s by pieces that start before stop, and where the last piece starts.

        entry: places at which paths come in, and their scores; a place whose best path comes in there has the start -1.
        """
        node, n, most = self.node, len(s), self.longest
        best, back = [NEVER] * (n + 1), [-1] * (n + 1)
        for at, score in entry.items():
            best[at] = score
        for i in range(min(stop, n)):
            b = best[i]
            if b == NEVER:
                continue
            single = False
            for j in range(i + 1, min(i + most, n) + 1):
                sub = s[i:j]
                if sub not in node:
                    break
                score = node[sub]
                if score is not None:
                    single = single or j == i + 1
                    if b + score > best[j]:
                        best[j], back[j] = b + score, i
            if not single and b + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = b + self.unknown, i
        return best, back

    def _one(self, s: str) -> bytes:
        """Ids of the best path through s: forward() for whole texts, kept short as every new stretch passes here."""
        n, most, get, unknown = len(s), self.longest, self.node.get, self.unknown
        best, back = [NEVER] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b = best[i]
            if b == NEVER:
                continue
            score = get(s[i])
            score = unknown if score is None else score
            if b + score > best[i + 1]:
                best[i + 1], back[i + 1] = b + score, i
            for j in range(i + 2, min(i + most, n) + 1):
                score = get(s[i:j], 1.0)  # scores are at most 0: 1 stands for what begins no piece
                if score is None:
                    continue
                if score > 0:
                    break
                if b + score > best[j]:
                    best[j], back[j] = b + score, i
        out, j = [], n
        while j:
            i = back[j]
            sub = s[i:j]
            if self.node.get(sub) is not None:
                out.append(self.id[sub])
            else:
                out.extend(self.byte_id[b] for b in reversed((BLANK if sub == LITERAL else sub).encode()))
            j = i
        return np.array(out[::-1], "<u4").tobytes()

    def ids(self, s: str) -> bytes:
        """Ids of an escaped text as bytes."""
        parts, known = self.stretches(s) if self.split else [s], self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > self.cached:  # what is common soon comes back
                known.clear()
            for p in set(parts).difference(known):
                known[p] = self._one(p)
            return b"".join(map(known.__getitem__, parts))

    def score(self, s: str) -> float:
        return self.forward(s, {0: 0.0}, len(s))[0][len(s)]

    def cuts(self, before: str, s: str, after: str) -> tuple[int, int] | None:
        """The first and the last place of a chunk that no piece crosses; before and after are the text around it."""
        whole, lead = before[-1:] + s + after[:1], len(before[-1:])
        is_cut = lambda p: whole[lead + p - 1 : lead + p + 1] not in self.inner
        places = range(0 if lead else 1, len(s) + (1 if after else 0))
        first = next((p for p in places if is_cut(p)), None)
        if not after:
            return (len(s) if first is None else first), len(s)
        return None if first is None else (first, next(p for p in reversed(places) if is_cut(p)))

    def transfer(self, before: str, s: str, after: str) -> np.ndarray:
        """The chunk's matrix, less its largest entry: states are 0 to longest - 1 characters."""
        k, n = self.longest, len(s)
        after = after[: k - 1]
        out = np.full((k, k), NEVER)
        if found := self.cuts(before, s, after):
            first, last = found
            head = [self.forward(s[:first], {i: 0.0}, first)[0][first] if i <= first else NEVER for i in range(k)]
            best = self.forward(s[last:] + after, {0: 0.0}, n - last)[0]
            tail = [best[n - last + j] if n - last + j < len(best) else NEVER for j in range(k)] if n > last else [0.0] + [NEVER] * (k - 1)
            out = np.array(head)[:, None] + np.array(tail)[None, :]  # what lies between the cuts is the same for all
        else:
            for i in range(min(k, n)):
                best = self.forward(s + after, {i: 0.0}, n)[0]
                for j in range(min(k, len(after) + 1)):
                    out[i, j] = best[n + j]
        return less_largest(out)

    def entries(self, front: np.ndarray, before: str, s: str, after: str) -> np.ndarray:
        """For each leave state the entry state from which its best path comes; front: scores of the entry states."""
        k, n = self.longest, len(s)
        after, found = after[: k - 1], self.cuts(before, s, after)
        end = found[0] if found else n
        part = s[:end] if found else s + after
        _, back = self.forward(part, {i: float(x) for i, x in enumerate(front) if x > NEVER and i <= len(part)}, end)

        def start(j: int) -> int:
            while back[j] >= 0:
                j = back[j]
            return min(j, k - 1)

        return np.array([start(end)] * k if found else [start(min(n + j, len(part))) for j in range(k)], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


def escaped(text: str) -> str:
    return text.replace(BLANK, LITERAL).replace(" ", BLANK)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def less_largest(m: np.ndarray) -> np.ndarray:
    """Only differences count, and small numbers stay exact."""
    most = m.max()
    return m - most if most > NEVER else m


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of matrices, or of a vector and a matrix."""
    return less_largest((a[..., :, None] + b).max(axis=-2))


def _swept(rows: DataFrame, most: int, combine, start, step, out: str) -> DataFrame:
    """An exclusive scan along each document: row, at and out (binary), what the rows before `at` make of start.

    rows: row, at from 0 to most - 1, value (binary). combine(a, b): a node's value; step(x, value): the next out.
    Values go up a tree of FAN to a node until a document has one node at most, and the outs come down it again.
    """
    level, levels = rows, [rows]
    node = F.floor(F.col("at") / F.lit(FAN)).cast("int")

    def up(key, t):
        values = t.sort_by("at")["value"].to_pylist()
        for v in values[1:]:
            values[0] = combine(values[0], v)
        return pa.table({"row": pa.array([key[0].as_py()]), "at": pa.array([key[1].as_py()], pa.int32()), "value": pa.array(values[:1], pa.binary())})

    def down(t):
        t = t.sort_by("at")
        x, got = t["given"][0].as_py(), []
        for v in t["value"].to_pylist():
            got.append(x)
            x = step(x, v)
        return pa.table({"row": t["row"], "at": t["at"], out: pa.array(got, pa.binary())})

    while most > FAN:
        level = durable(level.withColumn("node", node).groupBy("row", "node").applyInArrow(up, "row string, at int, value binary"), "tree")
        levels.append(level)
        most = -(-most // FAN)
    given = None
    for level in reversed(levels):
        if given is None:
            ready = level.withColumn("given", F.lit(start)).withColumn("node", F.lit(0))
        else:
            parents = given.select("row", F.col("at").alias("node"), F.col(out).alias("given"))
            ready = level.withColumn("node", node).join(parents, ["row", "node"])
        given = ready.select("row", "node", "at", "value", "given").groupBy("row", "node").applyInArrow(down, f"row string, at int, {out} binary")
    return given


def _chunks(docs: DataFrame, chunk: int, reach: int) -> DataFrame:
    """row, at, of, before, body, after of each chunk of each document that is longer than a chunk; a text is cut in one pass."""
    kinds = "row string, at int, of int, before string, body string, after string"

    def cut(batches):
        for b in batches:
            for row, text in zip(b["row"].to_pylist(), b["text"], strict=True):
                text = text.as_py()
                of = -(-len(text) // chunk)
                for at in range(of):
                    a, z = at * chunk, (at + 1) * chunk
                    yield pa.RecordBatch.from_pylist([{"row": row, "at": at, "of": of, "before": text[max(0, a - 1) : a], "body": text[a:z], "after": text[z : z + reach]}], schema)

    schema = pa.schema([pa.field(x.split()[0], pa.int32() if x.endswith("int") else pa.string()) for x in kinds.split(", ")])
    return docs.filter(F.length("text") > chunk).select("row", "text").mapInArrow(cut, kinds)


def _body(at: int, text: str) -> str:
    return (BLANK if at == 0 else "") + escaped(text)


def encoded(docs: DataFrame, model: str, chunk: int = CHUNK, run: str | None = None, cached: int = CACHED) -> DataFrame:
    """row, doc_id, ids (little-endian unsigned 32-bit integers) and chunks of each document; docs: row, doc_id, text.

    row names a row; it is only moved about for documents longer than a chunk. A text of one chunk has no boundary:
    its ids are those of the scan for any smaller chunk too.
    """
    n, reach, run = partitions_for(docs.sparkSession), pieces(model).longest, run or new_run()
    if chunk < reach:
        raise ValueError("a chunk holds at least the longest piece")

    def whole(batches):
        own = held(run, Pieces, model, cached)
        for b in batches:
            ids = [own.ids(_body(0, t.as_py())) for t in b["text"]]
            yield pa.record_batch([b["row"], b["doc_id"], pa.array(ids, pa.binary()), pa.array([1] * len(b), pa.int32())], names=["row", "doc_id", "ids", "chunks"])

    small = docs.filter(F.length("text") <= chunk).select("row", "doc_id", "text").mapInArrow(whole, "row string, doc_id long, ids binary, chunks int")
    long_ = durable(_chunks(docs, chunk, reach).repartition(n, "row", "at"), "chunks")
    most = long_.agg(F.max("of")).first()[0]
    if not most:
        return small
    around = ("at", "before", "body", "after")

    def matrix(batches):
        own = held(run, Pieces, model, cached)
        for b in batches:
            got = [own.transfer(escaped(x.as_py()), _body(i.as_py(), y.as_py()), escaped(z.as_py())).astype("<f8").tobytes() for i, x, y, z in zip(*(b[c] for c in around), strict=True)]
            yield pa.record_batch([b["row"], b["at"], pa.array(got, pa.binary())], names=["row", "at", "value"])

    def read(x: bytes) -> np.ndarray:
        return np.frombuffer(x, "<f8").reshape(-1, reach)

    start = np.where(np.arange(reach) == 0, 0.0, NEVER).tobytes()
    times = lambda a, b: product(read(a), read(b)).tobytes()
    matrices = durable(long_.mapInArrow(matrix, "row string, at int, value binary"), "matrices")
    fronts = _swept(matrices, most, times, start, times, "front")

    def entries(batches):
        own = held(run, Pieces, model, cached)
        for b in batches:
            got = [own.entries(read(f.as_py())[0], escaped(x.as_py()), _body(i.as_py(), y.as_py()), escaped(z.as_py())).astype("<i4").tobytes() for i, x, y, z, f in zip(*(b[c] for c in (*around, "front")), strict=True)]
            yield pa.record_batch([b["row"], b["at"], b["of"], pa.array(got, pa.binary())], names=["row", "at", "of", "value"])

    maps = durable(long_.join(fronts, ["row", "at"]).mapInArrow(entries, "row string, at int, of int, value binary"), "maps")
    follow = lambda a, b: np.frombuffer(b, "<i4")[np.frombuffer(a, "<i4")].tobytes()
    # From the end of each document: what the chunks behind a chunk make of the last state, 0, is where it is left.
    back = maps.select("row", (F.col("of") - 1 - F.col("at")).alias("at"), "value")
    leaves = _swept(back, most, follow, np.zeros(1, "<i4").tobytes(), follow, "leave").join(maps.select("row", "of").distinct(), "row")
    ends = maps.join(leaves.select("row", (F.col("of") - 1 - F.col("at")).alias("at"), "leave"), ["row", "at"])

    def trace(batches):
        own = held(run, Pieces, model, cached)
        for b in batches:
            ids = []
            for at, body, after, value, leave in zip(*(b[c] for c in ("at", "body", "after", "value", "leave")), strict=True):  # a text at a time
                leave = int(np.frombuffer(leave.as_py(), "<i4")[0])
                entry = int(np.frombuffer(value.as_py(), "<i4")[leave])
                ids.append(own.ids(_body(at.as_py(), body.as_py())[entry:] + escaped(after.as_py())[:leave]))
            yield pa.record_batch([b["row"], b["at"], pa.array(ids, pa.binary())], names=["row", "at", "ids"])

    traced = long_.join(ends.select("row", "at", "value", "leave"), ["row", "at"]).select("row", "at", "body", "after", "value", "leave").mapInArrow(trace, "row string, at int, ids binary")

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        return pa.table({"row": t["row"][:1], "ids": pa.array([b"".join(t["ids"].to_pylist())], pa.binary()), "chunks": pa.array([len(t)], pa.int32())})

    one = durable(traced.groupBy("row").applyInArrow(joined, "row string, ids binary, chunks int"), "long-ids")
    drop_durable(long_, matrices, maps)
    # doc_id comes from the row's own table, which holds the long documents alone.
    names = docs.filter(F.length("text") > chunk).select("row", "doc_id")
    return small.unionByName(one.join(names, "row").select("row", "doc_id", "ids", "chunks"))


def with_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, text: row names a document by its id and text; equal rows are numbered by their count."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return own.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha1("text"), F.length("text").cast("string")).alias("row"), "doc_id", "text")


def tokenized(docs: DataFrame, model: str, chunk: int = CHUNK, cached: int = CACHED, with_ids: bool = False) -> DataFrame:
    """doc_id, n_chars, n_tokens, chunks, ids_crc32, decoded_sha256, round_trip of each document: encoded, then decoded.

    cached: how many stretches a Python worker remembers, about 170 bytes each. with_ids: token_ids, the ids, come last.

    Long documents that repeat as whole rows are encoded once and counted.
    """
    rows = with_rows(docs)
    long_ = rows.filter(F.length("text") > chunk)
    copies = long_.groupBy("row").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    once = durable(copies, "long-documents")
    run = new_run()
    out = encoded(rows.filter(F.length("text") <= chunk).unionByName(once.select("row", "doc_id", "text")), model, chunk, run, cached)

    def decode(batches):
        own = held(run, Pieces, model, cached)
        for b in batches:
            got = []
            for ids in b["ids"].to_pylist():
                text = own.decode(np.frombuffer(ids, "<u4"))[1:]  # without the prefix blank
                got.append((len(text.decode()), len(ids) // 4, zlib.crc32(ids), hashlib.sha1(text).hexdigest(), hashlib.sha256(text).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [b["row"], b["doc_id"], b["chunks"], *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))]
            if with_ids:
                raw = b["ids"].to_pylist()
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) // 4 for x in raw])), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())))
            yield pa.record_batch(columns, names=names)

    schema = "row string, doc_id long, chunks int, n_chars long, n_tokens long, ids_crc32 long, sha1 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    done = out.mapInArrow(decode, schema)
    # The row's name ends with the text's digest and length, which the decoded text must give again.
    said = F.concat(F.col("sha1"), F.lit(":"), F.col("n_chars").cast("string"))
    done = done.withColumn("round_trip", F.substring_index("row", ":", -2) == said)
    many = once.filter("copies > 1").select("row", "copies")
    if many.limit(1).count():
        done = done.join(many, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
        done = done.select("*", F.explode(F.array_repeat(F.lit(0), F.when(F.col("chunks") > 1, F.col("copies")).otherwise(F.lit(1)).cast("int"))))
    return done.select("doc_id", "n_chars", "n_tokens", "chunks", "ids_crc32", "decoded_sha256", "round_trip", *(["token_ids"] if with_ids else []))
