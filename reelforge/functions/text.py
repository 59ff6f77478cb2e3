"""Facts read from free text, and text normalising, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
LAST_RANK = 2147483647

# Vocabularies and the forms that stand for them, in the order in which they are tried.
RESOLUTIONS = {"2160": ("2160p?", "4k", "uhd"), "1440": ("1440p?", "2k"), "1080": ("1080p?", "fhd"), "720": ("720p?", "hd"), "576": ("576p?",), "480": ("480p?", "sd"), "360": ("360p?",)}
QUALITY_PARTS = {"BLURAY_REMUX": ("remux",), "BLURAY": ("blu-ray", "bluray", "bdrip", "brrip"), "WEB_DL": ("web-dl", "webdl"), "WEBRIP": ("webrip", "web-rip"), "HDRIP": ("hdrip",), "HD_RIP": ("hd-rip", "hcrip"), "DVDRIP": ("dvdrip",), "HDTV": ("hdtv",)}
QUALITY_TOKENS = {"CAM": "cam", "TS": "ts", "TC": "tc", "SCR": "scr"}
DOLBY_VISION, HIGH_RANGE = r"dv|dovi|dolby[ ._-]?vision", r"hdr|hdr10|hdr10plus|hdr10\+|hlg"
AUDIO = {"ATMOS": ("t:atmos",), "DD_PLUS": ("dd+", "ddp", "dolby digital plus"), "DD": ("t:dd", "ac3", "dolby digital"), "DTS_X": ("dts:x", "dtsx"), "DTS_HD_MA": ("dts-hd ma", "dtshd ma"), "DTS_HD": ("dts-hd", "dtshd"), "DTS_ES": ("dts-es", "dtses"), "DTS": ("t:dts",), "TRUEHD": ("truehd", "true hd"), "OPUS": ("t:opus",), "FLAC": ("t:flac",), "AAC": ("t:aac",)}
CHANNELS = {"CH_7_1": ("t:7.1",), "CH_6_1": ("t:6.1",), "CH_5_1": ("t:5.1", "t:6ch"), "CH_2_0": ("t:2.0",)}
ENCODES = {"AV1": ("av1",), "HEVC": ("hevc", "h265", "x265"), "AVC": ("avc", "h264", "x264"), "XVID": ("xvid",), "DIVX": ("divx",)}


def token_regex(*forms: str) -> str:
    """Any of the forms with no letter or digit beside it."""
    return f"(^|[^a-z0-9])({'|'.join(forms)})([^a-z0-9]|$)"


def has_token(text: Column, token: str) -> Column:
    return F.lower(text).rlike(token_regex(token.replace(".", r"\.").replace("+", r"\+")))


def search_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def _chain(cases: list[tuple[Column, str]], otherwise: Column) -> Column:
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for test, value in cases[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(otherwise)


def resolution(*values: Column) -> Column:
    """From the first value that names one."""
    each = [_chain([(F.lower(v).rlike(token_regex(*forms)), r) for r, forms in RESOLUTIONS.items()], F.lit(None).cast("string")) for v in values]
    return F.coalesce(*each, F.lit(UNKNOWN))


def quality(*parts: Column) -> Column:
    text = search_text(*parts)
    cases = [(_any([F.contains(text, F.lit(p)) for p in parts_]), q) for q, parts_ in QUALITY_PARTS.items()]
    return _chain([*cases, *((has_token(text, t), q) for q, t in QUALITY_TOKENS.items())], F.lit(UNKNOWN))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _labels(cases: list[tuple[Column, str]]) -> Column:
    found = F.array_compact(F.array(*(F.when(test, F.lit(v)) for test, v in cases)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNKNOWN)))


def _by_forms(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    test = lambda f: has_token(text, f[2:]) if f.startswith("t:") else F.contains(text, F.lit(f))
    return _labels([(_any([test(f) for f in forms]), v) for v, forms in table.items()])


def audio_tags(*parts: Column) -> Column:
    return _by_forms(search_text(*parts), AUDIO)


def audio_channels(*parts: Column) -> Column:
    return _by_forms(search_text(*parts), CHANNELS)


def visual_tags(*parts: Column) -> Column:
    text = search_text(*parts)
    dv, hdr = text.rlike(token_regex(DOLBY_VISION)), text.rlike(token_regex(HIGH_RANGE))
    has = lambda x: F.contains(text, F.lit(x))
    return _labels(
        [
            (dv & hdr, "HDR_DV"),
            (dv & ~hdr, "DV_ONLY"),
            (hdr & ~dv, "HDR_ONLY"),
            (has("hdr10+") | has("hdr10plus"), "HDR10_PLUS"),
            (has("hdr10"), "HDR10"),
            (dv, "DV"),
            (hdr, "HDR"),
            (has_token(text, "hlg"), "HLG"),
            (has("10bit") | has("10 bit"), "TEN_BIT"),
            (has_token(text, "3d"), "THREE_D"),
            (has_token(text, "imax"), "IMAX"),
            (has_token(text, "ai"), "AI"),
            (has_token(text, "sdr"), "SDR"),
            (has("h-ou"), "H_OU"),
            (has("h-sbs"), "H_SBS"),
        ]
    )


def encode(*parts: Column) -> Column:
    text = search_text(*parts)
    return _chain([(text.rlike(token_regex(*forms)), e) for e, forms in ENCODES.items()], F.lit(UNKNOWN))


def release_group(text: Column) -> Column:
    """What follows the first hyphen that leads to the end or a dot; empty if none does."""
    return F.regexp_extract(text, r"(?i)-([a-z0-9][a-z0-9._]{1,24})($|\.)", 1)


def rank(value: Column, preferred: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, preferred)) if preferred else F.array().cast("array<string>"), value)
    return F.when(at > 0, at - 1).otherwise(F.lit(LAST_RANK)).cast("int")


def rank_any(values: Column, preferred: list[str]) -> Column:
    """The best rank of any; last if there are none."""
    return F.coalesce(F.array_min(F.transform(values, lambda v: rank(v, preferred))), F.lit(LAST_RANK))


def info_hash(text: Column) -> Column:
    """What a magnet names after its marker, or a torrent address if it is 40 hexadecimal or 32 base-32 characters."""
    t = trimmed(text)
    magnet = trimmed(F.regexp_extract(t, r"(?i)^magnet:.*?btih:([^&]*)", 1))
    torrent = trimmed(F.regexp_extract(t, r"(?i)^torrent://([^/?]*)", 1))
    return F.coalesce(F.when(magnet != "", magnet), F.when(torrent.rlike(r"(?i)^([0-9a-f]{40}|[a-z2-7]{32})$"), torrent))


def trackers(sources: Column) -> Column:
    """The addresses of `tracker:` sources, each once, in order."""
    named = F.transform(F.filter(sources, lambda s: F.startswith(s, F.lit("tracker:"))), lambda s: trimmed(F.substring(s, 9, 1_000_000)))
    return F.array_distinct(F.filter(named, lambda s: s != ""))


def trimmed(text: Column) -> Column:
    """Without white space at both ends: Unicode's separators, and what ASCII has, with its four separators of files to units."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\p{Z}]+|[\s\x1c-\x1f\p{Z}]+$", "")


def clean_cue(text: Column) -> Column:
    """Without inline times and tags, with five entities resolved, blanks joined, and blank lines gone."""
    out = F.regexp_replace(text, r"<(?:\d+:)?\d{1,2}:\d{2}(?:[.,]\d+)?>", "")
    out = F.regexp_replace(out, r"</?[a-zA-Z0-9._-]+(?: [^>]*)?>", "")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):  # in this order
        out = F.replace(out, F.lit(a), F.lit(b))
    lines = F.transform(F.split(out, r"\r\n|\n|\r"), lambda x: trimmed(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def title_sort_key(title: Column) -> Column:
    """Lower case without a leading article."""
    return F.lower(F.regexp_replace(trimmed(title), r"(?i)^(the|an|a)\s+", ""))


def matches_terms(text: Column, query: str) -> Column:
    """Every term of the query is in the text."""
    terms = query.lower().split()
    return F.lit(True) if not terms else F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))


def has_spoilers(text: Column) -> Column:
    return text.rlike(r"(?is)\[spoiler\].*?\[/spoiler\]")


def without_spoiler_marks(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?i)\[/?spoiler\]", ""))


def timestamp_ms(text: Column) -> Column:
    """Milliseconds of [h:]m:ss[.,fraction]; null for other text."""
    form = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})(?:[.,](\d+))?\s*$"
    part = lambda i: F.regexp_extract(text, form, i)
    number = lambda c: F.when(c == "", F.lit(0)).otherwise(c).cast("long")
    ms = number(F.substring(F.rpad(part(4), 3, "0"), 1, 3))
    return F.when(text.rlike(form), ((number(part(1)) * 60 + number(part(2))) * 60 + number(part(3))) * 1000 + F.when(part(4) == "", F.lit(0)).otherwise(ms))


def list_or_csv(value: Column) -> Column:
    """A JSON array of strings, or a text with commas; blank items go."""
    array = F.from_json(value, "array<string>")
    split = F.split(value, ",")
    items = F.when(F.startswith(trimmed(value), F.lit("[")), array).otherwise(split)
    return F.filter(F.transform(items, trimmed), lambda x: F.coalesce(x != "", F.lit(False)))


def episode_title(text: Column) -> Column:
    """Lower case letters and digits, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes, without tags."""
    plain = F.lower(F.regexp_replace(text, r"<[^>]*>", " "))
    return F.filter(F.transform(F.split(plain, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}']", "")), lambda w: w != "")
