"""Languages of tracks: normalised codes, matches, forced tracks, the language of a country."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelforge.functions.text import trimmed

# Codes and what they stand for, in lower case.
CODES = {
    "pt-pt": "pt", "pt-br": "pt-br", "br": "pt-br", "pob": "pt-br", "eng": "en", "spa": "es", "es-419": "es-419", "es-la": "es-419",
    "es-lat": "es-419", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "ita": "it", "por": "pt", "rus": "ru", "jpn": "ja", "kor": "ko",
    "zho": "zh", "chi": "zh", "zht": "zh-tw", "zhs": "zh-cn", "chi-tw": "zh-tw", "chi-cn": "zh-cn", "zh-tw": "zh-tw", "zh-cn": "zh-cn", "ara": "ar",
    "hin": "hi", "nld": "nl", "dut": "nl", "pol": "pl", "swe": "sv", "nor": "no", "dan": "da", "fin": "fi", "tur": "tr", "ell": "el", "gre": "el",
    "heb": "he", "tha": "th", "vie": "vi", "ind": "id", "msa": "ms", "may": "ms", "ces": "cs", "cze": "cs", "hun": "hu", "ron": "ro", "rum": "ro",
    "ukr": "uk", "bul": "bg", "hrv": "hr", "srp": "sr", "slk": "sk", "slo": "sk", "slv": "sl", "cat": "ca", "alb": "sq", "sqi": "sq", "bos": "bs",
    "mac": "mk", "mkd": "mk", "lav": "lv", "lit": "lt", "est": "et", "isl": "is", "ice": "is", "glg": "gl", "baq": "eu", "eus": "eu", "wel": "cy",
    "cym": "cy", "gle": "ga", "ben": "bn", "tam": "ta", "tel": "te", "mal": "ml", "kan": "kn", "mar": "mr", "pan": "pa", "guj": "gu", "urd": "ur",
    "fas": "fa", "per": "fa", "amh": "am", "swa": "sw", "zul": "zu", "afr": "af", "mlt": "mt", "bel": "be", "geo": "ka", "tgl": "tl", "fil": "tl",
}
# English names and their codes.
NAMES = {
    "afrikaans": "af", "albanian": "sq", "amharic": "am", "arabic": "ar", "armenian": "hy", "azerbaijani": "az", "basque": "eu", "belarusian": "be",
    "bengali": "bn", "bosnian": "bs", "bulgarian": "bg", "burmese": "my", "catalan": "ca", "chinese": "zh", "mandarin": "zh", "croatian": "hr",
    "czech": "cs", "danish": "da", "dutch": "nl", "english": "en", "estonian": "et", "filipino": "tl", "finnish": "fi", "french": "fr",
    "galician": "gl", "georgian": "ka", "german": "de", "greek": "el", "gujarati": "gu", "hebrew": "he", "hindi": "hi", "hungarian": "hu",
    "icelandic": "is", "indonesian": "id", "irish": "ga", "italian": "it", "japanese": "ja", "kannada": "kn", "kazakh": "kk", "khmer": "km",
    "korean": "ko", "lao": "lo", "latvian": "lv", "lithuanian": "lt", "macedonian": "mk", "malay": "ms", "malayalam": "ml", "maltese": "mt",
    "marathi": "mr", "mongolian": "mn", "nepali": "ne", "norwegian": "no", "persian": "fa", "polish": "pl", "punjabi": "pa", "romanian": "ro",
    "russian": "ru", "serbian": "sr", "sinhala": "si", "slovak": "sk", "slovenian": "sl", "swahili": "sw", "swedish": "sv", "tamil": "ta",
    "telugu": "te", "thai": "th", "turkish": "tr", "ukrainian": "uk", "urdu": "ur", "uzbek": "uz", "vietnamese": "vi", "welsh": "cy", "zulu": "zu",
}
# Words that name Portuguese and Spanish, and those that name a region.
PORTUGUESE, BRAZIL = ("portuguese", "portugues"), ("brazil", "brasil", "brazilian", "brasileiro", "pt br", "ptbr", "pob", "(br)")
SPANISH, LATIN = ("spanish", "espanol", "castellano"), ("latin", "latino", "latinoamerica", "latinoamericano", "lat am", "latam", "es 419", "es419", "(419)")
# Languages of countries by two letters, three letters and name.
COUNTRIES = {
    "jp": "ja", "kr": "ko", "cn": "zh", "tw": "zh", "fr": "fr", "de": "de", "it": "it", "es": "es", "pt": "pt", "br": "pt", "ru": "ru", "in": "hi",
    "tr": "tr", "pl": "pl", "nl": "nl", "se": "sv", "no": "no", "dk": "da", "fi": "fi", "th": "th", "il": "he", "cz": "cs", "ro": "ro", "hu": "hu",
    "ua": "uk", "gr": "el", "jpn": "ja", "kor": "ko", "chn": "zh", "twn": "zh", "fra": "fr", "deu": "de", "ita": "it", "esp": "es", "prt": "pt",
    "bra": "pt", "rus": "ru", "ind": "hi", "tur": "tr", "pol": "pl", "nld": "nl", "swe": "sv", "nor": "no", "dnk": "da", "fin": "fi", "tha": "th",
    "isr": "he", "cze": "cs", "rou": "ro", "hun": "hu", "ukr": "uk", "grc": "el", "japan": "ja", "korea": "ko", "china": "zh", "taiwan": "zh",
    "france": "fr", "germany": "de", "italy": "it", "spain": "es", "portugal": "pt", "brazil": "pt", "russia": "ru", "india": "hi", "turkey": "tr",
    "poland": "pl", "netherlands": "nl", "sweden": "sv", "norway": "no", "denmark": "da", "finland": "fi", "thailand": "th", "israel": "he",
    "romania": "ro", "hungary": "hu", "ukraine": "uk", "greece": "el", "south korea": "ko",
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def language_code(language: Column) -> Column:
    """A code with lower-case subtags: by regional words, then by code, by name, by the longest name among the words, by the primary subtag."""
    raw = F.nullif(F.lower(F.replace(trimmed(language), F.lit("_"), F.lit("-"))), F.lit(""))
    has = lambda words, values: reduce(or_, (F.contains(words, F.lit(v)) for v in values))
    by_length = [f" {n} " for n in sorted(NAMES, key=len, reverse=True)]  # stable: equal lengths keep the table's order

    def named(words):
        found = lambda spaced: F.get(F.filter(F.from_json(F.lit(json.dumps(by_length)), "array<string>"), lambda n: F.contains(spaced, n)), F.lit(0))
        return _looked_up({f" {k} ": v for k, v in NAMES.items()}, _bound(F.concat(F.lit(" "), words, F.lit(" ")), found))

    def by_subtag(raw):
        def of(parts):
            primary, known = parts["primary"], parts["known"]
            suffix, main = F.substring(raw, F.length(primary) + 2, F.length(raw)), F.coalesce(known, primary)
            return F.when((trimmed(suffix) == "") | F.contains(F.coalesce(known, F.lit("")), F.lit("-")), main).otherwise(F.concat(main, F.lit("-"), suffix))

        primary = F.substring_index(raw, "-", 1)
        return _bound(F.struct(primary.alias("primary"), _looked_up(CODES, primary).alias("known")), of)

    def code(raw):
        def by_words(words):
            return (
                F.when(has(words, PORTUGUESE), F.when(has(words, BRAZIL), "pt-br").otherwise("pt"))
                .when(has(words, SPANISH), F.when(has(words, LATIN), "es-419").otherwise("es"))
                .otherwise(F.coalesce(_looked_up(CODES, raw), _looked_up(NAMES, words), named(words), by_subtag(raw)))
            )

        words = trimmed(F.regexp_replace(F.regexp_replace(raw, r"[-./]", " "), r"\s+", " "))
        return F.when(raw.isNotNull(), _bound(words, by_words))

    return _bound(raw, code)


def language_matches(track: Column, target: Column) -> Column:
    """Whether two languages have one primary subtag."""
    primary = lambda c: F.substring_index(language_code(c), "-", 1)
    return F.coalesce(primary(track) == primary(target), F.lit(False))


def is_forced(label: Column, language: Column, track: Column, flag: Column) -> Column:
    """By its flag, its language, or its words."""
    text = F.lower(F.concat_ws(" ", label, language, track))
    said = F.contains(text, F.lit("forced")) | (F.contains(text, F.lit("songs")) & F.contains(text, F.lit("sign")))
    return F.coalesce(flag, F.lit(False)) | F.coalesce(language_code(language) == "forced", F.lit(False)) | said


def country_language(country: Column) -> Column:
    return _looked_up(COUNTRIES, F.lower(trimmed(country)))


def content_language(language: Column, country: Column) -> Column:
    return F.coalesce(language_code(language), country_language(country))


# What in a track's words names a region, by the code it makes of the language.
REGIONS = {
    "pt-br": ("pt-br", "pt_br", "pob", "brazilian", "brazil", "brasil", "brasileiro", " br", "(br)"),
    "pt": ("pt-pt", "pt_pt", "iberian", "european", "portugal", "europeu", " eu", "(eu)"),
    "es-419": ("es-419", "es_419", "es-la", "es-lat", "latino", "latinoamerica", "latinoamericano", "latam", "lat am", "latin america"),
    "es": ("es-es", "es_es", "castilian", "castellano", "spain", "españa", "espana", "iberian"),
    "id": ("indonesia", "indonesian", "bahasa indonesia"),
}


def regions_said(words: Column) -> Column:
    """Which regions lower-case words name, as a struct of booleans by code; compute it once a track."""
    return F.struct(*(reduce(or_, (F.contains(words, F.lit(t)) for t in tags)).alias(c) for c, tags in REGIONS.items()))


def region_of(said: Column, code: Column) -> Column:
    """Whether regions_said() holds the region of a code; false for codes without one."""
    told = F.lit(False)
    for c in REGIONS:
        told = F.when(code == c, said[c]).otherwise(told)
    return F.coalesce(told, F.lit(False))


def said_by(words: Column, code: Column) -> Column:
    """Whether lower-case words name the region of a code; false for codes without one."""
    return region_of(regions_said(words), code)


def variant_of(base: Column, said: Column) -> Column:
    """The code of a language, narrowed by regions_said() where its words name one region of it alone."""
    out = F.when((base == "ms") & said["id"], "id")
    for a, b, plain in (("pt-br", "pt", "pt"), ("pt", "pt-br", "pt"), ("es-419", "es", "es"), ("es", "es-419", "es")):
        out = out.when((base == plain) & said[a] & ~said[b], a)
    return out.otherwise(base)


def track_variant(base: Column, words: Column) -> Column:
    return variant_of(base, regions_said(words))


def track_codes(language: Column) -> Column:
    """The code of a track's language, then those of its later subtags of three letters; compute it once a track."""
    parts = F.filter(F.split(F.replace(F.lower(trimmed(language)), F.lit("_"), F.lit("-")), r"[-./ ]"), lambda x: trimmed(x) != "")
    rest = F.transform(F.filter(parts, lambda x, i: (i > 0) & (F.length(x) == 3)), language_code)
    return F.coalesce(F.concat(F.array(language_code(language)), rest), F.array().cast("array<string>"))


def codes_fit(codes: Column, goal: Column) -> Column:
    """Whether a code is the goal or a region of it; plain Portuguese and Spanish take no region."""
    near = lambda c: (c == goal) | (~goal.isin("pt", "es") & (F.startswith(c, F.concat(goal, F.lit("-"))) | F.startswith(c, F.concat(goal, F.lit("_")))))
    return F.coalesce(F.exists(codes, near), F.lit(False))
