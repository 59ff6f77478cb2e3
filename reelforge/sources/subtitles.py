"""Subtitle files as cue rows: track, ord, start, end (ms), text.

SubRip and TTML are cut and parsed by built-in functions. WebVTT and SSA carry state from line to line, so each file is
one call of a function over Arrow batches, which never sees more than a batch of files.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelforge.functions.text import clean_cue, timestamp_ms, trimmed
from reelforge.shipping import ship

CUES = "track string, ord int, start long, end long, text string"


def kind_of(text: Column, name: Column) -> Column:
    """srt, vtt, ass or ttml by the name's ending, then by content."""
    path, head = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[?#].*$", "")), F.lower(F.substring(text, 1, 512))
    ends = lambda *x: path.rlike(rf"\.({'|'.join(x)})$")
    return (
        F.when(ends("vtt") | F.startswith(trimmed(head), F.lit("webvtt")), "vtt")
        .when(ends("ass", "ssa") | F.contains(head, F.lit("[script info]")) | (F.contains(F.lower(text), F.lit("[events]")) & F.contains(F.lower(text), F.lit("dialogue:"))), "ass")
        .when(ends("ttml", "dfxp", "xml") | head.rlike(r"<tt[\s>]"), "ttml")
        .otherwise("srt")
    )


def _worked_out(df: DataFrame, *columns: Column) -> DataFrame:
    """df with columns that no later step or filter works out again: a generator of one row is where plans are not merged."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def srt(files: DataFrame, track: str = "track", text: str = "text") -> DataFrame:
    """Blocks between blank lines: an optional number, a line with the times, then text. Empty and backward cues go."""
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    blocks = files.select(track, F.posexplode(F.split(plain, r"\n\s*\n")).alias("ord", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), trimmed), lambda x: x != "")
    rows = blocks.withColumn("lines", lines).filter(F.size("lines") > 0)
    skip = F.when(F.get("lines", F.lit(0)).rlike(r"^\d+$") & (F.size("lines") > 1), 1).otherwise(0)
    timed = rows.withColumn("skip", skip).withColumn("timing", F.get("lines", F.col("skip")))
    side = lambda i: F.split_part(trimmed(F.split_part("timing", F.lit("-->"), F.lit(i))), F.lit(" "), F.lit(1))
    two = F.size(F.split("timing", "-->")) == 2
    out = timed.filter(two).select(track, "ord", timestamp_ms(side(1)).alias("start"), timestamp_ms(side(2)).alias("end"), clean_cue(F.array_join(F.slice("lines", F.col("skip") + 2, F.size("lines")), "\n")).alias("text"))
    return out.filter("end > start and text <> ''")


def ttml(files: DataFrame, track: str = "track", text: str = "text") -> DataFrame:
    """`<p begin|start end|dur>` elements; a cue without an end lasts three seconds.

    Clocks are times with a fraction or with frames of the root's rate (30 unless it names one), or numbers with a unit.
    """
    attr = lambda c, n: F.nullif(F.regexp_extract(c, rf"(?i)(?<![\w:-]){n}\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    number = lambda c: c.try_cast("double")
    root = F.regexp_extract(text, r"(?is)<tt\b([^>]*)>", 1)
    ratio = F.split(trimmed(attr(root, "(?:ttp:)?frameRateMultiplier")), r"\s+")
    times = F.when((F.size(ratio) == 2) & (number(F.get(ratio, F.lit(1))) > 0), number(F.get(ratio, F.lit(0))) / number(F.get(ratio, F.lit(1))))
    rate = F.coalesce(number(attr(root, "(?:ttp:)?frameRate")), F.lit(30.0)) * F.coalesce(times, F.lit(1.0))
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?is)(<p\b[^>]*>.*?</p>)"), 1)
    rows = files.select(track, F.when(rate > 0, rate).otherwise(30.0).alias("rate"), F.posexplode(found).alias("ord", "p"))

    def clock(first: Column) -> Column:
        frames = F.split(F.regexp_extract(first, r"^(\d+:\d+:\d+:[\d.]+)$", 1), ":")
        part = lambda i: number(F.get(frames, F.lit(i)))
        framed = ((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + part(3) * 1000 / F.col("rate")
        unit = F.lower(F.regexp_extract(first, r"(?i)^\d+(?:\.\d+)?(ms|h|m|s)$", 1))
        long_ = F.when(unit == "h", F.lit(3_600_000.0)).when(unit == "m", 60_000.0).when(unit == "s", 1000.0).when(unit == "ms", 1.0)
        counted = number(F.regexp_extract(first, r"^([\d.]+)", 1)) * long_
        return F.coalesce(framed.cast("long"), timestamp_ms(first), counted.cast("long"))  # fractions of a millisecond go

    # Each step's columns are worked out once: what a later one reads several times would else be copied into it.
    rows = _worked_out(rows, F.regexp_extract("p", r"(?is)^<p\b([^>]*)>", 1).alias("opening"))
    begin = F.coalesce(attr(F.col("opening"), "begin"), attr(F.col("opening"), "start"))
    first = lambda c: F.split_part(trimmed(c), F.lit(" "), F.lit(1))
    rows = _worked_out(rows, first(begin).alias("s"), first(attr(F.col("opening"), "end")).alias("e"), first(attr(F.col("opening"), "dur")).alias("d"))
    body = clean_cue(F.regexp_replace(F.regexp_replace(F.regexp_extract("p", r"(?is)^<p\b[^>]*>(.*)</p>$", 1), r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", ""))
    rows = _worked_out(rows, clock(F.col("s")).alias("start"), clock(F.col("e")).alias("stop"), clock(F.col("d")).alias("dur"), body.alias("body"))
    end = F.coalesce(F.col("stop"), F.col("start") + F.col("dur"), F.col("start") + 3000)
    return rows.select(track, "ord", "start", end.alias("end"), F.col("body").alias("text")).filter("end > start and text <> ''")


def _ms(raw: str) -> int | None:
    m = re.fullmatch(r"(?:(\d+):)?(\d{1,2}):(\d{2})(?:[.,](\d+))?", raw.strip())
    return m and ((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int((m[4] or "0").ljust(3, "0")[:3])


def vtt_cues(text: str):
    """(start, end, text) of a WebVTT file; NOTE, STYLE and REGION blocks are passed over."""
    for block in re.split(r"\n[ \t]*\n", re.sub(r"\r\n?", "\n", text.removeprefix("﻿"))):
        lines = [x for x in block.split("\n") if x.strip()]
        at = next((i for i, x in enumerate(lines[:3]) if "-->" in x), None)
        if at is None or (at > 0 and re.match(r"(NOTE|STYLE|REGION)\b", lines[0]) and at > 1):
            continue
        a, b = (x.strip().split(" ")[0] for x in lines[at].split("-->", 1))
        start, end = _ms(a), _ms(b)
        if start is not None and end is not None and end > start:
            yield start, end, "\n".join(lines[at + 1 :])


def ass_cues(text: str):
    """(start, end, text) of `Dialogue:` lines by the columns that the last Format line of [Events] names."""
    fields, inside = ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"], False
    for line in text.splitlines():
        low = line.strip().lower()
        if low.startswith("["):
            inside = low == "[events]"
        elif inside and low.startswith("format:"):
            fields = [x.strip().lower() for x in line.split(":", 1)[1].split(",")]
        elif inside and low.startswith("dialogue:") and {"start", "end", "text"} <= set(fields):
            parts = line.split(":", 1)[1].split(",", len(fields) - 1)
            if len(parts) == len(fields):
                row = dict(zip(fields, parts, strict=True))
                start, end = _ms(row["start"]), _ms(row["end"])
                if start is not None and end is not None and end > start:
                    yield start, end, re.sub(r"\{[^}]*\}", "", row["text"]).replace("\\N", "\n").replace("\\n", "\n").replace("\\h", " ")


def by_line(files: DataFrame, kind: str, track: str = "track", text: str = "text") -> DataFrame:
    """Cues of vtt or ass files."""
    ship(files.sparkSession)
    parse = {"vtt": vtt_cues, "ass": ass_cues}[kind]

    def rows(batches):
        for b in batches:
            out = [(t, i, *cue) for t, x in zip(b["track"], b["text"], strict=True) for i, cue in enumerate(parse(x or ""))]
            yield pd.DataFrame(out, columns=["track", "ord", "start", "end", "text"])

    cues = files.select(F.col(track).cast("string").alias("track"), F.col(text).alias("text")).mapInPandas(rows, CUES)
    return cues.withColumn("text", clean_cue(F.col("text"))).filter("text <> ''")


def sprite_tiles(files: DataFrame, track: str = "track", text: str = "text") -> DataFrame:
    """track, start, end, sheet, x, y, w, h of a sprite index; malformed tiles are passed over."""
    lines = F.posexplode(F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), trimmed), lambda x: x != ""))
    from pyspark.sql import Window

    rows = files.select(track, lines.alias("i", "line")).withColumn("payload", F.lead("line").over(Window.partitionBy(track).orderBy("i"))).filter(F.contains("line", F.lit("-->")))
    form = r"^(.*)#xywh=(\d+),(\d+),(\d+),(\d+)$"
    part = lambda k: F.regexp_extract("payload", form, k)
    side = lambda i: timestamp_ms(F.split_part(trimmed(F.split_part("line", F.lit("-->"), F.lit(i))), F.lit(" "), F.lit(1)))
    out = rows.filter(F.col("payload").rlike(form)).select(track, side(1).alias("start"), side(2).alias("end"), part(1).alias("sheet"), *(part(k + 2).cast("int").alias(n) for k, n in enumerate("xywh")))
    return out.filter("end > start and w > 0 and h > 0")


# ---- the timing codec ------------------------------------------------------------------------------------------------

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def encoded_timing(cues: DataFrame, track: str = "track") -> DataFrame:
    """track, code: `start delta.duration` in base 36, cues joined by blanks; `~` marks an estimated end."""
    from pyspark.sql import Window

    w = Window.partitionBy(track).orderBy("start", "ord")
    delta = F.col("start") - F.coalesce(F.lag("start").over(w), F.lit(0))
    one = F.concat(base36(delta), F.lit("."), base36(F.col("end") - F.col("start")), F.when(F.col("estimated"), "~").otherwise(""))
    rows = cues.withColumn("one", one).withColumn("at", F.row_number().over(w))
    return rows.groupBy(track).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "one"))), lambda x: x["one"]), " ").alias("code"))


def decoded_timing(codes: DataFrame, track: str = "track") -> DataFrame:
    """The inverse: track, ord, start, end, estimated."""
    from pyspark.sql import Window

    rows = codes.select(track, F.posexplode(F.split("code", " ")).alias("ord", "one"))
    number = lambda c: F.conv(c, 36, 10).cast("long")
    w = Window.partitionBy(track).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(number(F.split_part("one", F.lit("."), F.lit(1)))).over(w)
    plain = F.replace(F.split_part("one", F.lit("."), F.lit(2)), F.lit("~"), F.lit(""))
    return rows.select(track, "ord", start.alias("start"), (start + number(plain)).alias("end"), F.endswith("one", F.lit("~")).alias("estimated"))
