"""Queries: facts from text, selection, dates, identifiers and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import dates as D
from reelforge.functions import ids as I
from reelforge.functions import text as T
from reelforge.functions.template import Template, Value
from reelforge.operators import selection as S
from reelforge.operators.order import top_per_key
from reelforge.plans.tables import spread, table
from reelforge.settled import settled

# A release name for each part, made alike on both sides.
TAGS = ["2160p.REMUX.DV.HDR10.Atmos.7.1.x265", "1080p BluRay DTS-HD MA 5.1 x264", "720p WEB-DL AAC 2.0 AVC", "4K webrip ddp5.1 HEVC 10bit", "480p DVDRip xvid", "HDTV sd ac3", "cam ts", "fhd hdrip av1 opus imax"]
NAMES = "p_name || ' ' || " + "(['" + "','".join(TAGS) + "'])[(p_partkey % 8 + 1)::INT] || CASE WHEN p_size % 3 = 0 THEN '-' || p_brand ELSE '' END"


def releases(spark, d):
    p = table(spark, d, "part")
    tag = F.get(F.array(*map(F.lit, TAGS)), (F.col("p_partkey") % 8).cast("int"))
    name = F.concat("p_name", F.lit(" "), tag, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("-"), "p_brand")).otherwise(""))
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("long") * 700_000_000)
    return p.select("p_partkey", "p_brand", "p_type", "p_size", name.alias("name"), size.alias("bytes"))


def facts(spark, d):
    # Settled, as a filter of the facts would move below the dealing.
    r, n = settled(spread(releases(spark, d)), "releases"), F.col("name")
    return r.select(
        "p_partkey",
        "p_brand",
        "bytes",
        T.resolution(n).alias("resolution"),
        T.quality(n).alias("quality"),
        T.encode(n).alias("encode"),
        T.release_group(n).alias("group"),
        T.visual_tags(n).alias("visual"),
        T.audio_tags(n).alias("audio"),
        T.audio_channels(n).alias("channels"),
    )


def text_facts(spark, d):
    return facts(spark, d).select("p_partkey", "resolution", "quality", "encode", "group", *(F.array_join(c, ",").alias(c) for c in ("visual", "audio", "channels")))


def _tok(*forms):
    return f"regexp_matches(n, '(^|[^a-z0-9])({'|'.join(forms)})([^a-z0-9]|$)')"


def _has(*parts):
    return "(" + " OR ".join(f"contains(n, '{p}')" for p in parts) + ")"


def _form(f):
    return _tok(f[2:].replace(".", "[.]")) if f.startswith("t:") else _has(f)


def _list(cases):
    out = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{v}' END" for t, v in cases) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({out}) = 0 THEN ['UNKNOWN'] ELSE {out} END"


DV, HDR = _tok("dv", "dovi", "dolby[ ._-]?vision"), _tok("hdr", "hdr10", "hdr10plus", "hdr10[+]", "hlg")
VISUAL = [(f"{DV} AND {HDR}", "HDR_DV"), (f"{DV} AND NOT {HDR}", "DV_ONLY"), (f"{HDR} AND NOT {DV}", "HDR_ONLY"), (_has("hdr10+", "hdr10plus"), "HDR10_PLUS"), (_has("hdr10"), "HDR10"), (DV, "DV"), (HDR, "HDR"), (_tok("hlg"), "HLG"), (_has("10bit", "10 bit"), "TEN_BIT"), (_tok("3d"), "THREE_D"), (_tok("imax"), "IMAX"), (_tok("ai"), "AI"), (_tok("sdr"), "SDR")]
FACTS = f"""WITH r AS (SELECT p_partkey, p_brand, p_type, p_size, {NAMES} AS name, CASE WHEN p_size % 5 <> 0 THEN p_size::BIGINT * 700000000 END AS bytes FROM part), l AS (SELECT *, lower(name) AS n FROM r),
f AS (SELECT p_partkey, p_brand, bytes, CASE {" ".join(f"WHEN {_tok(*forms)} THEN '{v}'" for v, forms in T.RESOLUTIONS.items())} ELSE 'UNKNOWN' END AS resolution,
CASE {" ".join(f"WHEN {_has(*x)} THEN '{v}'" for v, x in T.QUALITY_PARTS.items())} {" ".join(f"WHEN {_tok(x)} THEN '{v}'" for v, x in T.QUALITY_TOKENS.items())} ELSE 'UNKNOWN' END AS quality,
CASE {" ".join(f"WHEN {_tok(*x)} THEN '{v}'" for v, x in T.ENCODES.items())} ELSE 'UNKNOWN' END AS encode, regexp_extract(name, '(?i)-([a-z0-9][a-z0-9._]{{1,24}})($|[.])', 1) AS "group",
{_list(VISUAL)} AS visual, {_list([(" OR ".join(map(_form, x)), v) for v, x in T.AUDIO.items()])} AS audio, {_list([(" OR ".join(map(_form, x)), v) for v, x in T.CHANNELS.items()])} AS channels FROM l)"""
TEXT_FACTS = FACTS + " SELECT p_partkey, resolution, quality, encode, \"group\", array_to_string(visual, ',') AS visual, array_to_string(audio, ',') AS audio, array_to_string(channels, ',') AS channels FROM f"


def preference_filter(spark, d):
    test = S.preference_filter(
        {"resolution": S.Wanted(["2160", "1080", "720"]), "quality": S.Wanted([], ["CAM"]), "encode": S.Wanted([], ["XVID"])},
        {"audio": S.Wanted(["ATMOS", "AAC", "DTS_HD", "DD_PLUS"], ["OPUS"]), "visual": S.Wanted([], ["TEN_BIT"])},
        languages=("channels", S.Wanted([], ["CH_2_0"])),
        group=("group", S.Wanted([], ["brand#13"])),
        size=("bytes", 3, 25),
    )
    return facts(spark, d).filter(test).select("p_partkey", "resolution", "quality")


PREFERENCE_FILTER = FACTS + """ SELECT p_partkey, resolution, quality FROM f WHERE resolution IN ('2160', '1080', '720') AND quality <> 'CAM' AND encode <> 'XVID' AND list_has_any(audio, ['ATMOS', 'AAC', 'DTS_HD', 'DD_PLUS']) AND NOT list_has_any(audio, ['OPUS'])
AND NOT list_has_any(visual, ['TEN_BIT']) AND NOT (len(channels) > 0 AND len(list_filter(channels, lambda x: x <> 'CH_2_0')) = 0) AND lower("group") <> 'brand#13' AND (bytes IS NULL OR (bytes >= 3 * 1073741824::BIGINT AND bytes <= 25 * 1073741824::BIGINT))"""
RES, QUAL = ["1080", "2160", "720"], ["BLURAY_REMUX", "BLURAY", "WEB_DL"]


def _ranked_facts(spark, d):
    return facts(spark, d).withColumn("r", T.rank(F.col("resolution"), RES)).withColumn("a", T.rank_any(F.col("audio"), ["DTS", "ATMOS"]))


RANKED = FACTS + f""", k AS (SELECT *, CASE WHEN list_position({RES}, resolution) > 0 THEN list_position({RES}, resolution) - 1 ELSE 2147483647 END::INT AS r,
CASE WHEN list_contains(audio, 'DTS') THEN 0 WHEN list_contains(audio, 'ATMOS') THEN 1 ELSE 2147483647 END AS a FROM f)"""
CRITERIA = [("r", "DESC"), ("size", "DESC"), ("a", "ASC"), ("group", "DESC")]


def criteria_sort(spark, d):
    r = _ranked_facts(spark, d).withColumn("size", F.col("bytes"))
    return top_per_key(r, ["p_brand"], S.criteria_order(CRITERIA, ["p_partkey"]), 5).select("p_brand", "p_partkey", "r", "a")


CRITERIA_SORT = RANKED + ' SELECT p_brand, p_partkey, r, a FROM k QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY r ASC, coalesce(bytes, 0) DESC, a DESC, lower("group"), p_partkey) <= 5'


def quota_per_key(spark, d):
    return S.quota(_ranked_facts(spark, d), ["p_brand"], "resolution", [F.col("r").asc(), F.col("p_partkey").asc()], 2, 5).select("p_brand", "p_partkey", "resolution")


QUOTA = RANKED + ", q AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY p_brand, resolution ORDER BY r, p_partkey) <= 2) SELECT p_brand, p_partkey, resolution FROM q QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY r, p_partkey) <= 5"


def two_quotas(spark, d):
    f = facts(spark, d).select("p_brand", "p_partkey", "resolution", "quality")
    return S.two_quotas(f, ["p_brand"], ("resolution", 2), ("quality", 1), "p_partkey", 6)


def fit_order(spark, d):
    bucket, rate = S.connection_fit(F.col("bytes"), F.lit(100), F.lit(20.0))
    r = releases(spark, d).withColumn("bucket", bucket).withColumn("rate", rate)
    order = [F.col("bucket"), F.when(F.col("bucket") == 0, -F.col("rate")), F.col("p_partkey")]
    return top_per_key(r, ["p_brand"], order, 10).select("p_brand", "p_partkey", "bucket", F.round("rate", 6).alias("rate"))


FIT_ORDER = f"""WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 5 <> 0 THEN p_size::BIGINT * 700000000 END AS bytes FROM part), b AS (SELECT *, bytes * 8.0::DOUBLE / 6000.0::DOUBLE / 1000000.0::DOUBLE AS x FROM r),
c AS (SELECT p_partkey, p_brand, CASE WHEN bytes >= 52428800 AND x BETWEEN 0.2 AND 200 THEN x END AS rate FROM b), e AS (SELECT *, CASE WHEN rate IS NULL THEN 1 WHEN rate * 1.5 > 20 THEN 2 ELSE 0 END AS bucket FROM c)
SELECT p_brand, p_partkey, bucket, round(rate, 6) AS rate FROM e QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY bucket, CASE WHEN bucket = 0 THEN -rate END NULLS FIRST, p_partkey) <= 10"""
RULES = [("IMAX", "imax"), ("Atmos", r"\batmos\b"), ("Bad", "(["), ("x265", "x265|hevc"), ("Atmos", "atmos"), ("Small", r"\b(480p|sd)\b")]


def regex_badges(spark, d):
    return releases(spark, d).select("p_partkey", F.array_join(S.badges(releases(spark, d), F.col("name"), RULES), ",").alias("badges"))


REGEX_BADGES = f"WITH r AS (SELECT p_partkey, lower({NAMES}) AS n FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN n LIKE '%imax%' THEN 'IMAX' END, CASE WHEN n LIKE '%atmos%' THEN 'Atmos' END, CASE WHEN n LIKE '%x265%' OR n LIKE '%hevc%' THEN 'x265' END, CASE WHEN regexp_matches(n, '\\b(480p|sd)\\b') THEN 'Small' END) AS badges FROM r"


def clean_markup(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.clean_cue(F.col("html"))).alias("clean"))


CLEAN = r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(?:\d+:)?\d{1,2}:\d{2}(?:[.,]\d+)?>', '', 'g'), '</?[a-zA-Z0-9._-]+(?: [^>]*)?>', '', 'g') AS x FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS x FROM t),
l AS (SELECT page_id, list_transform(regexp_split_to_array(x, '\r\n|\n|\r'), lambda y: regexp_replace(regexp_replace(y, '[ \t]+', ' ', 'g'), '^[\s\x1c-\x1f\p{Z}]+|[\s\x1c-\x1f\p{Z}]+$', '', 'g')) AS x FROM e)
SELECT page_id, md5(array_to_string(list_filter(x, lambda y: y <> ''), chr(10))) AS clean FROM l"""


def search_terms(spark, d):
    return table(spark, d, "documents").filter(T.matches_terms(F.col("text"), "  The eran ")).select("doc_id")


SEARCH_TERMS = "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'eran')"


def spoiler_marks(spark, d):
    s = table(spark, d, "supplier").withColumn("t", F.concat(F.lit(" "), "s_name", F.when(F.col("s_suppkey") % 2 == 0, " [Spoiler]he\nwins[/SPOILER] ").otherwise(" [spoiler] open")))
    return s.select("s_suppkey", T.has_spoilers(F.col("t")).alias("has"), T.without_spoiler_marks(F.col("t")).alias("plain"))


SPOILER_MARKS = "SELECT s_suppkey, s_suppkey % 2 = 0 AS has, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' he' || chr(10) || 'wins' ELSE '  open' END AS plain FROM supplier"


def info_hashes(spark, d):
    o = table(spark, d, "orders")
    h = F.sha1(F.col("o_orderkey").cast("string"))
    magnet = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("magnet:?xt=urn:btih:"), F.upper(h), F.lit("&dn=x"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("torrent://"), h, F.lit("/0"))).otherwise(F.concat(F.lit("magnet:?xt=urn:btih:"), F.substring(h, 1, 39)))
    return o.select("o_orderkey", T.info_hash(magnet).alias("hash"))


INFO_HASHES = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN upper(sha1(o_orderkey::VARCHAR)) WHEN 1 THEN sha1(o_orderkey::VARCHAR) ELSE substr(sha1(o_orderkey::VARCHAR), 1, 39) END AS hash FROM orders"


def title_sort(spark, d):
    p = table(spark, d, "part").withColumn("title", F.concat(F.when(F.col("p_size") % 3 == 0, "The ").when(F.col("p_size") % 3 == 1, " an  ").otherwise(""), "p_name"))
    return top_per_key(p, ["p_brand"], [T.title_sort_key(F.col("title")), F.col("p_partkey")], 3).select("p_brand", "p_partkey", T.title_sort_key(F.col("title")).alias("key"))


TITLE_SORT = "SELECT p_brand, p_partkey, lower(p_name) AS key FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) <= 3"


def list_or_csv(spark, d):
    n = table(spark, d, "nation")
    v = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(' ["'), "n_name", F.lit('", " b ", ""]'))).otherwise(F.concat("n_name", F.lit(" , b,, ")))
    return n.select("n_nationkey", F.array_join(T.list_or_csv(v), "|").alias("items"))


LIST_OR_CSV = "SELECT n_nationkey, n_name || '|b' AS items FROM nation"


def cue_times(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.format_string("%02d:%02d:%02d,%03d", k % 30, k % 60, k % 59, k % 1000)).when(k % 4 == 1, F.format_string("%d:%02d.%d", k % 60, k % 60, k % 10)).when(k % 4 == 2, F.format_string(" %d:%02d ", k % 60, k % 60)).otherwise(F.lit("x:1"))
    return e.select("event_id", T.timestamp_ms(raw).alias("ms"))


CUE_TIMES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ((event_id % 30 * 60 + event_id % 60) * 60 + event_id % 59) * 1000 + event_id % 1000 WHEN 1 THEN (event_id % 60 * 60 + event_id % 60) * 1000 + event_id % 10 * 100 WHEN 2 THEN (event_id % 60 * 60 + event_id % 60) * 1000 END AS ms FROM events"""


def _dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k, day = F.col("o_orderkey"), F.col("day").cast("string")
    raw = (
        F.when(k % 8 == 0, F.concat(day, F.lit("T10:30:00+02:00")))
        .when(k % 8 == 1, F.concat(day, F.lit("T23:15:30.5")))
        .when(k % 8 == 2, F.concat(F.lit("\t"), day, F.lit(" ")))
        .when(k % 8 == 3, F.concat(F.lit("released on "), day, F.lit(" worldwide")))
        .when(k % 8 == 4, F.concat(day, F.lit("T01:00:00Z")))
        .when(k % 8 == 5, F.lit("2026-02-30"))
        .when(k % 8 == 6, F.concat(F.substring(day, 1, 4), F.lit(" or later")))
    )
    return o.withColumn("raw", raw)


DATES = "WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS m, o_orderdate::DATE AS day, epoch_us(o_orderdate::DATE::TIMESTAMP) // 1000 AS ms FROM orders), r AS (SELECT *, CASE m WHEN 0 THEN ms + 30600000 WHEN 1 THEN ms + 83730500 WHEN 2 THEN ms WHEN 3 THEN ms WHEN 4 THEN ms + 3600000 END AS rel, CASE WHEN m IN (0, 1, 2, 3, 4) THEN day END AS d FROM o)"
NOW, TODAY = 820_000_000_000, "1995-12-26"


def date_precedence(spark, d):
    return _dates(spark, d).select("o_orderkey", D.release_ms(F.col("raw")).alias("ms"), D.aired(F.col("raw"), F.lit(NOW)).alias("aired"))


DATE_PRECEDENCE = DATES + f" SELECT o_orderkey, rel AS ms, rel <= {NOW} AS aired FROM r"


def days_until(spark, d):
    return _dates(spark, d).select("o_orderkey", D.days_until(F.lit(TODAY), F.col("raw")).alias("days"))


DAYS_UNTIL = DATES + f" SELECT o_orderkey, date_diff('day', DATE '{TODAY}', d)::INT AS days FROM r"


def unreleased(spark, d):
    o = _dates(spark, d)
    return o.filter(~D.unreleased(F.coalesce("raw", F.lit("")), F.concat(F.lit("c. "), F.substring(F.col("day").cast("string"), 1, 4)), F.lit(NOW), 1995)).select("o_orderkey")


UNRELEASED = DATES + f" SELECT o_orderkey FROM r WHERE CASE WHEN rel IS NOT NULL THEN rel <= {NOW} ELSE year(day) <= 1995 END"


def compact_stamps(spark, d):
    o = table(spark, d, "orders")
    v = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMddHHmmss").cast("long")).when(F.col("o_orderkey") % 3 == 0, F.lit(19991399999999)).otherwise(F.col("o_orderkey"))
    return o.select("o_orderkey", D.from_compact(v).alias("stamp"))


COMPACT_STAMPS = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) // 1000000 * 1000 WHEN o_orderkey % 3 = 0 THEN 19991399999999 ELSE o_orderkey END AS stamp FROM orders"


def release_alerts(spark, d):
    o = _dates(spark, d)
    a = D.release_alert(D.release_ms(F.col("raw")), F.lit(NOW - 40 * D.DAY_MS), F.lit(NOW), (F.col("o_orderkey") % 3).cast("int"), F.lit(1))
    return o.select("o_orderkey", a.alias("alert")).filter("alert is not null")


RELEASE_ALERTS = DATES + f" SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 1 THEN 'NEW_SEASON' ELSE 'NEW_EPISODE' END AS alert FROM r WHERE rel <= {NOW} AND rel > {NOW} - 40 * 86400000::BIGINT AND {NOW} - rel < 60 * 86400000::BIGINT"


def _ids(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit(" TT"), k, F.lit(":1:2"))).when(k % 6 == 1, F.concat(F.lit("tmdb:"), k, F.lit(":3"))).when(k % 6 == 2, k.cast("string")).when(k % 6 == 3, F.concat(F.lit("Kitsu: "), k)).when(k % 6 == 4, F.lit("tvdb:")).otherwise(F.concat(F.lit("other:"), k))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", I.external_ids(raw).alias("ids"))


def id_parse(spark, d):
    ids = F.col("ids")
    key = I.canonical_id(**{s: ids[s] for s in I.SYSTEMS})
    return _ids(spark, d).select("o_orderkey", key.alias("key"), I.media_kind(F.lit(" Film "), ids).alias("kind"), F.size(I.aliases(**{s: ids[s] for s in I.SYSTEMS})).alias("known"))


ID_PARSE = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'imdb:TT' || o_orderkey WHEN 1 THEN 'tmdb:' || o_orderkey WHEN 2 THEN 'trakt:' || o_orderkey WHEN 3 THEN 'kitsu:' || o_orderkey END AS key, CASE WHEN o_orderkey % 6 = 3 THEN 'ANIME' ELSE 'MOVIE' END AS kind, (o_orderkey % 6 < 4)::INT AS known FROM orders"


def stable_keys(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 3 == 0, " Film").when(F.col("event_id") % 3 == 1, "tv").otherwise("Other ")
    return e.select("event_id", F.array_join(I.watched_keys(kind, F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit(1)), F.lit(None).cast("int")), ",").alias("keys"))


STABLE_KEYS = "WITH e AS (SELECT event_id, ':' || user_id || CASE WHEN event_id % 2 = 0 THEN ':1:-1' ELSE ':-1:-1' END AS r, CASE event_id % 3 WHEN 0 THEN ['movie', 'film'] WHEN 1 THEN ['series', 'show', 'tv', 'tvshow', 'anime'] ELSE ['Other'] END AS k FROM events) SELECT event_id, array_to_string(list_transform(k, lambda x: x || r), ',') AS keys FROM e"


def public_addresses(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    host = F.get(F.array(*map(F.lit, ["10.0.0.1", "172.16.4.4", "172.32.0.1", "192.168.1.1", "8.8.8.8", "localhost", "[::1]", "u:p@example.com", "169.254.1.1", "0.1.2.3"])), (k % 10).cast("int"))
    return s.select("s_suppkey", I.public_address(F.concat(F.when(k % 20 == 14, "ftp").otherwise("http"), F.lit("://"), host, F.lit(":80/x"))).alias("public"))


PUBLIC_ADDRESSES = "SELECT s_suppkey, s_suppkey % 10 IN (2, 4, 7) AND s_suppkey % 20 <> 14 AS public FROM supplier"
TEMPLATE = '{stream.name::upper} {stream.size::>=2147483648::and::stream.group::exists["big {stream.size::bytes} by {stream.group::lower}"||"small"]}{stream.cached["*"]} [{stream.tags::join(\'+\')}] {stream.runtime::time} {stream.tags::~remux::or::stream.tags::=bluray["disc"||"{stream.none}web"]}'


def template_render(spark, d):
    f = facts(spark, d).join(releases(spark, d).select("p_partkey", "p_size", "p_type"), "p_partkey")
    values = {
        "stream.name": Value(F.col("p_type")),
        "stream.size": Value(F.col("bytes"), "bytes"),
        "stream.group": Value(F.col("group")),
        "stream.cached": Value(F.col("p_size") % 2 == 0, "bool"),
        "stream.tags": Value(F.array(F.col("quality"), F.col("encode")), "list"),
        "stream.runtime": Value(F.col("p_size") * 77, "number"),
    }
    return f.select("p_partkey", Template(values).render(TEMPLATE).alias("line"))


_GB = "bytes / 1073741824.0::DOUBLE"
TEMPLATE_RENDER = FACTS + f""", j AS (SELECT f.*, p_size, p_type, p_size * 77 AS t FROM f JOIN part USING (p_partkey))
SELECT p_partkey, upper(p_type) || ' ' || CASE WHEN bytes >= 2147483648 AND "group" <> '' THEN 'big ' || CASE WHEN {_GB} >= 10 OR ({_GB}) % 1 = 0 THEN floor({_GB})::BIGINT::VARCHAR ELSE (floor({_GB} * 10 + 0.5)::BIGINT // 10) || '.' || (floor({_GB} * 10 + 0.5)::BIGINT % 10) END || ' GB by ' || lower("group") ELSE 'small' END
|| CASE WHEN p_size % 2 = 0 THEN '*' ELSE '' END || ' [' || quality || '+' || encode || '] ' || CASE WHEN t >= 3600 THEN (t // 3600) || 'h ' || (t % 3600 // 60) || 'm' WHEN t >= 60 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE t || 's' END || ' '
|| CASE WHEN contains(lower(quality), 'remux') OR lower(quality) = 'bluray' OR contains(lower(encode), 'remux') THEN 'disc' ELSE 'web' END AS line FROM j"""


QUERIES = {
    "text_facts": (text_facts, TEXT_FACTS),
    "preference_filter": (preference_filter, PREFERENCE_FILTER),
    "criteria_sort": (criteria_sort, CRITERIA_SORT),
    "quota_per_key": (quota_per_key, QUOTA),
    "two_quotas": (two_quotas, None),
    "fit_order": (fit_order, FIT_ORDER),
    "regex_badges": (regex_badges, REGEX_BADGES),
    "clean_markup": (clean_markup, CLEAN),
    "search_terms": (search_terms, SEARCH_TERMS),
    "spoiler_marks": (spoiler_marks, SPOILER_MARKS),
    "info_hashes": (info_hashes, INFO_HASHES),
    "title_sort": (title_sort, TITLE_SORT),
    "list_or_csv": (list_or_csv, LIST_OR_CSV),
    "cue_times": (cue_times, CUE_TIMES),
    "date_precedence": (date_precedence, DATE_PRECEDENCE),
    "days_until": (days_until, DAYS_UNTIL),
    "unreleased_filter": (unreleased, UNRELEASED),
    "compact_stamps": (compact_stamps, COMPACT_STAMPS),
    "release_alerts": (release_alerts, RELEASE_ALERTS),
    "id_parse": (id_parse, ID_PARSE),
    "stable_keys": (stable_keys, STABLE_KEYS),
    "public_addresses": (public_addresses, PUBLIC_ADDRESSES),
    "template_render": (template_render, TEMPLATE_RENDER),
}
