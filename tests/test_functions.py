import pytest
from pyspark.sql import functions as F

from reelforge.functions import language, dates, ids, progress, text
from reelforge.functions.template import Template, Value
from reelforge.operators import selection as S
from reelforge.operators.rollups import version_key


@pytest.fixture(scope="module")
def one(spark):
    df = spark.range(1)
    return lambda c: df.select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "ms"),
    [
        ("2024-03-05", 1709596800000),
        (" 2024-03-05\t", 1709596800000),
        ("2024-03-05T10:00:00Z", 1709632800000),
        ("2024-03-05T10:00:00+02:00", 1709625600000),
        ("2024-03-05T10:00:00.5-0130", 1709638200500),
        ("2024-03-05T10:00", 1709596800000),
        ("12024-03-05", None),
        ("released 2024-03-05 in cinemas", 1709596800000),
        ("2026-02-30", None),
        ("2024-13-01", None),
        ("2024-03-05T25:00Z", 1709596800000),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_release_ms(one, raw, ms):
    assert one(dates.release_ms(F.lit(raw).cast("string"))) == ms


def test_local_times_follow_the_viewer(one):
    assert one(dates.release_ms(F.lit("2024-07-01T00:30:00"), "Europe/Berlin")) == 1719786600000
    assert str(one(dates.release_date(F.lit("2024-07-01T23:30:00Z"), "Europe/Berlin"))) == "2024-07-02"
    assert str(one(dates.release_date(F.lit("2024-07-01T23:30:00Z")))) == "2024-07-01"


def test_compact_stamps(one):
    assert one(dates.from_compact(F.lit(20240305100000))) == 1709632800000
    assert one(dates.from_compact(F.lit(20241305100000))) == 20241305100000
    assert one(dates.from_compact(F.lit(1709632800000))) == 1709632800000


def test_unknown_dates_differ_within_and_across_seasons(one):
    none, yes = F.lit(None).cast("boolean"), F.lit(True)
    days = F.lit(None).cast("int")
    assert one(progress.should_surface(F.lit(1), F.lit(1), none, days, yes, False)) is True
    assert one(progress.should_surface(F.lit(1), F.lit(2), none, days, yes, False)) is False
    assert one(progress.should_surface(F.lit(1), F.lit(2), F.lit(False), F.lit(7), yes, True)) is True
    assert one(progress.should_surface(F.lit(1), F.lit(2), F.lit(False), F.lit(8), yes, True)) is False


def test_completion(one):
    ended = lambda d: one(progress.is_complete(F.lit(1), F.lit(d), F.lit(True)))
    assert [ended(d) for d in (0, 1, 120_999, 121_000)] == [True, False, False, True]
    share = lambda p: one(progress.is_complete(F.lit(p), F.lit(1000), F.lit(False)))
    assert [share(p) for p in (899, 900)] == [False, True]
    assert one(progress.resume_position(F.lit(0), F.lit(25.0), F.lit(1000))) == 250
    assert one(progress.malformed_id(F.lit(" TMDB: "), ["tmdb"])) is True


@pytest.mark.parametrize(
    ("name", "resolution", "quality"),
    [("Film 2160p REMUX", "2160", "BLURAY_REMUX"), ("film.4k.web-dl", "2160", "WEB_DL"), ("x1080px", "UNKNOWN", "UNKNOWN"), ("show fhd brrip", "1080", "BLURAY"), ("a cam b", "UNKNOWN", "CAM"), ("scam", "UNKNOWN", "UNKNOWN"), ("720 hdtv", "720", "HDTV")],
)
def test_release_facts(one, name, resolution, quality):
    assert one(text.resolution(F.lit(None).cast("string"), F.lit(name))) == resolution
    assert one(text.quality(F.lit(name))) == quality


def test_labels(one):
    assert one(text.visual_tags(F.lit("x DV HDR10+ imax"))) == ["HDR_DV", "HDR10_PLUS", "HDR10", "DV", "HDR", "IMAX"]
    assert one(text.audio_tags(F.lit("plain"))) == ["UNKNOWN"]
    assert one(text.audio_channels(F.lit("ddp 5.1"))) == ["CH_5_1"]
    assert one(text.release_group(F.lit("a.b-GRP.mkv"))) == "GRP.mkv"
    assert one(text.rank_any(F.array(F.lit("b"), F.lit("z")), ["a", "b"])) == 1


def test_info_hash(one):
    h = "0123456789abcdef0123456789abcdef01234567"
    assert one(text.info_hash(F.lit(f"magnet:?xt=urn:btih:{h.upper()}&dn=a"))) == h.upper()
    assert one(text.info_hash(F.lit(f"torrent://{h}/1"))) == h
    assert one(text.info_hash(F.lit(f"torrent://{h}0"))) is None


def test_cue_text(one):
    assert one(text.clean_cue(F.lit("<00:01.000><i>a</i>  b &amp;lt;\r\n\r\n <c.x y>c</c>"))) == "a b <\nc"
    assert one(text.timestamp_ms(F.lit("1:02:03.4"))) == 3723400
    assert one(text.timestamp_ms(F.lit("02:03,45678"))) == 123456
    assert one(text.timestamp_ms(F.lit("1.5"))) is None
    assert one(text.tokens(F.lit("<b>Don't</b> stop -- 2!"))) == ["don't", "stop", "2"]


def test_ids(one):
    assert one(ids.external_ids(F.lit("tt12:1:2"))["imdb"]) == "tt12"
    assert one(ids.external_ids(F.lit("kitsu:7:1"))["kitsu"]) == 7
    assert one(ids.external_ids(F.lit("42"))["trakt"]) == 42
    assert one(ids.external_ids(F.lit("tmdb:x"))["tmdb"]) is None
    assert one(ids.watched_key(F.lit(" movie"), F.lit("a "), F.lit(None).cast("int"), F.lit(2))) == "movie:a:-1:2"
    assert one(ids.public_address(F.lit("http://[fe80::1]/x"))) is False


def values():
    return {
        "stream.name": Value(F.lit("the big  film")),
        "stream.size": Value(F.lit(1536 * 1024 * 1024).cast("long"), "bytes"),
        "stream.n": Value(F.lit(3725), "number"),
        "stream.ok": Value(F.lit(True), "bool"),
        "stream.tags": Value(F.array(F.lit("HDR"), F.lit(" "), F.lit("DV")), "list"),
        "stream.none": Value(F.lit(None).cast("string")),
    }


@pytest.mark.parametrize(
    ("template", "out"),
    [
        ("", ""),
        ("plain {open", "plain {open"),
        ("{stream.name::title}", "The Big Film"),
        ("{stream.size} {stream.n::time} {stream.n}", "1.5 GB 1h 2m 3725"),
        ("{stream.tags}|{stream.tags::join('/')}|{stream.tags::~dv[\"y\"||\"n\"]}", "HDR, DV|HDR/DV|y"),
        ('{stream.none::exists["a"||"b"]}{stream.ok["c"]}{stream.ok::isfalse["d"]}', "bc"),
        ('{stream.n::>=10::and::stream.n::<100["small"||"other"]}', "other"),
        ('{stream.n::<10::or::stream.name::~BIG["{stream.n} yes"||"no"]}', "3725 yes"),
        ("{stream.name::replace('big', \"a:b\")::upper}", "THE A:B  FILM"),
        ("{stream.missing}{stream.name::nothing}", "the big  film"),
    ],
)
def test_templates(one, template, out):
    assert one(Template(values()).render(template)) == out


def test_two_quotas_reject_without_using_up(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "a", "y"), (5, "a", "y"), (6, "b", "y")]
    df = spark.createDataFrame([(0, *r) for r in rows], "k int, i int, r string, q string")
    got = sorted(r.i for r in S.two_quotas(df, ["k"], ("r", 2), ("q", 2), "i").collect())
    assert got == [1, 2, 6]
    assert sorted(r.i for r in S.two_quotas(df, ["k"], ("r", 2), ("q", 1), "i", 1).collect()) == [1]


def test_excluded_languages_need_all(spark):
    df = spark.createDataFrame([(1, ["en"]), (2, ["en", "de"]), (3, []), (4, None)], "i int, langs array<string>")
    test = S.preference_filter({}, {}, languages=("langs", S.Wanted([], ["en"])))
    assert sorted(r.i for r in df.filter(test).collect()) == [2, 3, 4]


def test_versions(spark):
    order = ["1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "v1.0.0", "1.0.1+x", "1.2", "10.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(version_key(F.col("v"))).collect()] == order


def test_broken_rules_are_passed_over(spark):
    df = spark.createDataFrame([("x265 IMAX",), ("none",)], "t string")
    rules = [("A", "imax"), ("B", "(["), ("A", "x265"), ("C", r"\bx265\b")]
    assert [r.b for r in df.select(S.badges(df, F.col("t"), rules).alias("b")).collect()] == [["A", "C"], []]


def test_blanks_of_all_kinds_are_trimmed(one):
    assert one(text.trimmed(F.lit("\u2003 \u00a0é x\u00a0 "))) == "é x"


@pytest.mark.parametrize(
    ("said", "code"),
    [("pt_BR", "pt-br"), ("Portuguese (Brasil)", "pt-br"), ("português", "português"), ("ES-419", "es-419"), ("Castellano", "es"), ("zht", "zh-tw"), ("chi-hk", "zh-hk"), ("zht-x", "zh-tw"), ("Brazilian Portuguese", "pt-br"), ("old norwegian dub", "no"), ("english.uk", "en"), ("tlh", "tlh"), ("  ", None), (None, None)],
)
def test_language_codes(one, said, code):
    assert one(language.language_code(F.lit(said).cast("string"))) == code


def test_forced_tracks_and_countries(one):
    none = F.lit(None).cast("string")
    assert one(language.is_forced(F.lit("Signs & Songs"), none, none, F.lit(False))) is True
    assert one(language.is_forced(F.lit("Signs"), none, none, F.lit(None).cast("boolean"))) is False
    assert one(language.country_language(F.lit(" South Korea "))) == "ko"
    assert one(language.content_language(none, F.lit("BR"))) == "pt"
