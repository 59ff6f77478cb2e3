"""Queries: forms of single values, and sources whose rows are made by functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import candidates as K
from reelforge.functions import dates as D
from reelforge.functions import progress as P
from reelforge.functions import text as X
from reelforge.operators import align as A
from reelforge.operators import viewing as V
from reelforge.plans.merging import PROGRESS
from reelforge.plans.tables import progress, table
from reelforge.sources import scrapers, subtitles


def _pick(k, n, *values):
    """One of the values by k modulo n; those left over are null."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(k % n == i, F.lit(v)).otherwise(out)
    return out


def season_posters(spark, d):
    k = F.col("p_partkey")
    ints = "array<int>"
    seasons = F.from_json(_pick(k, 3, "[2, 0, 1]", "[1, 2, -1]", "[7]"), ints)
    listed = F.slice(F.array(F.when(k % 2 == 1, F.concat(F.lit(" a"), k.cast("string"))), F.when(k % 7 == 0, F.lit(" ")).otherwise("b"), F.lit("c"), F.lit("d")), 1, (k % 4 + 1).cast("int"))
    keyed = F.when(k % 11 == 0, F.create_map(F.lit(5), F.lit("own")))
    m = K.season_posters(keyed, listed, seasons)
    shown = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"])))
    return table(spark, d, "part").select("p_partkey", F.array_join(shown, ",").alias("posters"))


POSTERS = """WITH v AS (SELECT p_partkey AS k, p_partkey % 4 + 1 AS n, ([CASE WHEN p_partkey % 2 = 1 THEN 'a' || p_partkey END, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'b' END, 'c', 'd'])[1:p_partkey % 4 + 1] AS l FROM part),
s AS (SELECT *, CASE WHEN k % 3 = 0 AND n = 3 THEN [0, 1, 2] WHEN k % 3 = 0 AND n = 2 THEN [1, 2] WHEN k % 3 = 1 AND n = 2 THEN [1, 2] WHEN k % 3 = 1 AND n = 3 AND k % 2 = 0 THEN [0, 1, 2]
  WHEN k % 3 = 2 AND n = 1 THEN [7] WHEN k % 3 = 2 AND n = 2 AND k % 2 = 0 THEN [0, 7] ELSE [1, 2, 3, 4] END AS at FROM v),
r AS (SELECT k, unnest(range(1, n + 1)) AS i, l, at FROM s)
SELECT p.p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '5:own' ELSE coalesce(string_agg(r.at[i] || ':' || l[i], ',' ORDER BY r.at[i] || ':' || l[i]) FILTER (l[i] <> ''), '') END AS posters FROM part p JOIN r ON r.k = p.p_partkey GROUP BY p.p_partkey""".replace(" AS at ", ' AS "at" ').replace(" at FROM s", ' "at" FROM s').replace("r.at[", 'r."at"[')


def sprite_tiles(spark, d):
    k = F.col("p_partkey")
    clock = lambda s: F.format_string("00:%02d:%02d.500", F.floor(s / 60) % 60, s % 60)
    cue = lambda i, tail: F.concat(clock(k % 600 + i), F.lit(" --> "), clock(k % 600 + i + 5), F.lit("\r\nsheet"), k.cast("string"), F.lit(".jpg#xywh="), tail, F.lit("\r\n\r\n"))
    size = F.concat((k % 9 * 160).cast("string"), F.lit(",90,160,"), F.when(k % 5 == 0, "0").otherwise("90"))
    files = table(spark, d, "part").select(k.alias("track"), F.concat(F.lit("WEBVTT\r\n\r\n"), cue(0, size), cue(5, F.lit("1,2,3")), cue(10, F.lit("0,0,10,10"))).alias("text"))
    return subtitles.sprite_tiles(files)


TILES = """WITH r AS (SELECT p_partkey AS track, p_partkey % 600 AS s, i FROM part, (SELECT unnest([0, 10]) AS i) WHERE i = 10 OR p_partkey % 5 > 0)
SELECT track, ((s + i) * 1000 + 500)::BIGINT AS start, ((s + i + 5) * 1000 + 500)::BIGINT AS "end", 'sheet' || track || '.jpg' AS sheet, CASE WHEN i = 0 THEN track % 9 * 160 ELSE 0 END::INT AS x, CASE WHEN i = 0 THEN 90 ELSE 0 END AS y, CASE WHEN i = 0 THEN 160 ELSE 10 END AS w, CASE WHEN i = 0 THEN 90 ELSE 10 END AS h FROM r"""


def subtitle_kinds(spark, d):
    k = F.col("p_partkey")
    name = _pick(k, 7, "a.VTT?x=1", "b.ssa#f", "c.dfxp", "d.srt", None, "e", "vtt")
    text = _pick(k, 4, " WEBVTT\n", "x\n[Events]\nDialogue: 0", "<?xml?><TT xml:lang='en'>", "1\n00:00")
    return table(spark, d, "part").select("p_partkey", subtitles.kind_of(text, name).alias("kind"))


KINDS = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'vtt' WHEN p_partkey % 4 = 0 AND p_partkey % 7 NOT IN (1, 2) THEN 'vtt' WHEN p_partkey % 7 = 1 THEN CASE WHEN p_partkey % 4 = 0 THEN 'vtt' ELSE 'ass' END
  WHEN p_partkey % 4 = 0 THEN 'vtt' WHEN p_partkey % 4 = 1 THEN 'ass' WHEN p_partkey % 7 = 2 OR p_partkey % 4 = 2 THEN 'ttml' ELSE 'srt' END AS kind FROM part"""


def tracker_lists(spark, d):
    k = F.col("p_partkey")
    sources = F.array(F.concat(F.lit("tracker: udp://t"), (k % 5).cast("string"), F.lit(" ")), F.lit("dht:x"), F.when(k % 2 == 0, "tracker:  ").otherwise("tracker:http://u"), F.concat(F.lit("tracker:udp://t"), (k % 3).cast("string")))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.trackers(sources), ",").alias("trackers"))


TRACKERS = """SELECT p_partkey, 'udp://t' || p_partkey % 5 || CASE WHEN p_partkey % 2 = 1 THEN ',http://u' ELSE '' END || CASE WHEN p_partkey % 5 <> p_partkey % 3 THEN ',udp://t' || p_partkey % 3 ELSE '' END AS trackers FROM part"""


def catalog_support(spark, d):
    k = F.col("p_partkey")
    extra = lambda name, asks, n: F.struct(F.lit(name).alias("name"), asks.alias("isRequired"), F.slice(F.array(F.lit("x"), F.lit("y")), 1, n).alias("options"))
    extras = F.array(extra("search", k % 2 == 0, F.lit(1)), extra("genre", F.when(k % 3 > 0, k % 3 == 1), (k % 5 % 2).cast("int")), extra("skip", k % 7 == 0, F.lit(1)))
    extras = F.when(k % 4 == 0, F.slice(extras, 2, 2)).otherwise(extras)
    return table(spark, d, "part").select("p_partkey", K.supports_search(extras).alias("search"), K.supports_discover(extras).alias("discover"))


SUPPORT = """SELECT p_partkey, p_partkey % 4 > 0 AND p_partkey % 3 <> 1 AND p_partkey % 7 > 0 AS search,
  NOT ((p_partkey % 4 > 0 AND p_partkey % 2 = 0) OR (p_partkey % 3 = 1 AND p_partkey % 5 % 2 = 0)) AS discover FROM part"""


def open_entries(spark, d):
    p, k = progress(spark, d), F.col("event_id")
    source = _pick(k, 5, "history", "local", "Trakt")
    state = P.in_progress(P.completion(k % 17 == 0, F.col("percent"), F.lit(0), F.lit(0)), F.when(k % 3 == 0, F.lit(0)).otherwise(k), F.when(k % 4 > 0, F.col("percent") - 30), source, ["history", "Trakt"])
    return p.filter(state).select("event_id")


OPEN = PROGRESS + """ SELECT event_id FROM p WHERE event_id % 17 <> 0 AND percent < 90 AND (event_id % 3 <> 0 AND event_id > 0 OR (event_id % 4 > 0 AND percent - 30 > 0)) AND event_id % 5 NOT IN (0, 2)"""


def recent_rows(spark, d):
    p = progress(spark, d)
    return V.since(p, "stamp", 1_705_000_000_000).select("event_id", F.lit(True).alias("cut")).unionByName(V.since(p, "stamp", None).select("event_id", F.lit(False).alias("cut")))


RECENT = PROGRESS + " SELECT event_id, true AS cut FROM p WHERE stamp >= 1705000000000 UNION ALL SELECT event_id, false FROM p"


def stretched_times(spark, d):
    t = F.col("stamp") % 7_200_000
    return progress(spark, d).select("event_id", A.affine(t, 25 / 24, -90_000.5).alias("slow"), A.affine(t, 0.5, 0.5).alias("half"))


STRETCHED = PROGRESS + f""" SELECT event_id, greatest(0, floor(stamp % 7200000 * {25 / 24!r}::DOUBLE + -90000.5::DOUBLE + 0.5))::BIGINT AS slow, greatest(0, floor(stamp % 7200000 * 0.5::DOUBLE + 0.5 + 0.5))::BIGINT AS half FROM p"""


def spoken_words(spark, d):
    t = F.concat(F.lit("<i>"), F.col("text"), F.lit("</i> Don't <b>stop</b> ... é1"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.tokens(t), " ").alias("words"))


WORDS = r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(regexp_replace('<i>' || text || '</i> Don''t <b>stop</b> ... é1', '<[^>]*>', ' ', 'g')), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}'']', '', 'g')), lambda w: w <> ''), ' ') AS words FROM conversations"""


def single_cues(spark, d):
    p = progress(spark, d)
    cues = p.select(F.col("profile").alias("track"), (F.col("stamp") % 20 * 500).alias("start"), (F.col("stamp") % 20 * 500 + 400).alias("end"), F.col("title").alias("text"), F.col("event_id").alias("ord"))
    return A.normalised(cues)


SINGLE = PROGRESS + ' SELECT profile AS track, stamp % 20 * 500 AS start, stamp % 20 * 500 + 400 AS "end", title AS text, min(event_id) AS ord FROM p GROUP BY ALL'


def display_years(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" "))).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 2, "0999").otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", D.display_year(text).alias("year"))


YEARS = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN year(o_orderdate)::INT END AS year FROM orders"


def told_titles(spark, d):
    k = F.col("p_partkey")
    title = F.concat(_pick(k, 5, "Episode ", "ép. ", "E--", "Ep ", ""), (k % 30).cast("string"), F.when(k % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(": "), F.upper("p_name"))))
    normal = X.episode_title(title)
    return table(spark, d, "part").select("p_partkey", normal.alias("normal"), V.useful_title(normal).alias("useful"))


TOLD = r"""WITH t AS (SELECT p_partkey, trim(regexp_replace(lower(CASE p_partkey % 5 WHEN 0 THEN 'Episode ' WHEN 1 THEN 'ép. ' WHEN 2 THEN 'E--' WHEN 3 THEN 'Ep ' ELSE '' END || p_partkey % 30 || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE ': ' || upper(p_name) END), '[^\p{L}\p{N}]+', ' ', 'g')) AS normal FROM part)
SELECT p_partkey, normal, NOT regexp_full_match(normal, '(episode|ep|e) \d+') AS useful FROM t"""


def scraped_rows(spark, d):
    """Each supplier asked of a function that finds up to two streams, or fails."""
    k = F.col("s_suppkey")
    requests = table(spark, d, "supplier").select(k.alias("request"), k.cast("string").alias("id"), F.lit("movie").alias("type"), F.when(k % 2 == 0, (k % 5).cast("int")).alias("season"), F.lit(None).cast("int").alias("episode"))

    def scraper(id_, kind, season, episode):
        n = int(id_)
        if n % 7 == 0:
            raise ValueError(f"no {n}")
        yield {"title": " ", "name": f"n{n}", "url": {"url": f"http://{kind}/{n}"}, "seeders": str(n), "headers": {"b": 1, "a": None}}
        yield {"title": "none"}
        yield {"url": f"u{season}", "quality": 720, "size": {"x": 1}, "seeders": "many", "infoHash": "h" if n % 3 else None}

    out = scrapers.scraped(requests, scraper, errors=True)
    return out.select("request", "ord", "title", "url", "quality", "info_hash", "seeders", "headers", "error")


SCRAPED = """WITH k AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS request, 0 AS ord, 'n' || k AS title, 'http://movie/' || k AS url, NULL AS quality, NULL AS info_hash, k::INT AS seeders, '{"b": "1"}' AS headers, NULL AS error FROM k WHERE k % 7 > 0
UNION ALL SELECT k, 1, 'Unknown', 'u' || CASE WHEN k % 2 = 0 THEN (k % 5)::VARCHAR ELSE 'None' END, '720', CASE WHEN k % 3 > 0 THEN 'h' END, NULL, NULL, NULL FROM k WHERE k % 7 > 0
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ValueError: no ' || k FROM k WHERE k % 7 = 0"""


def scraper_table(spark, d):
    """The same from SQL: of every fiftieth request the function is too slow."""
    suppliers = table(spark, d, "supplier")
    suppliers.createOrReplaceTempView("asked_suppliers")

    def scraper(id_, kind, season, episode):
        import time

        n = int(id_)
        if n % 50 == 3:
            time.sleep(3)
        if n % 7 == 0:
            raise ValueError(f"no {n}")
        yield {"title": f"t{n}", "url": f"{kind}/{season}"}
        yield {"url": " "}

    scrapers.requests_function(spark, "streams_of", scraper, timeout_s=1.0)
    asked = f"SELECT /*+ REPARTITION({scrapers.tasks_for(suppliers)}) */ s_suppkey AS request, CAST(s_suppkey AS STRING) AS id, 'movie' AS type, CAST(s_suppkey % 5 AS INT) AS season, CAST(NULL AS INT) AS episode FROM asked_suppliers"
    return spark.sql(f"SELECT request AS s_suppkey, ord, title, url, error FROM streams_of(TABLE({asked}))")


SCRAPER_TABLE = """SELECT s_suppkey, CASE WHEN s_suppkey % 50 <> 3 AND s_suppkey % 7 > 0 THEN 0 END AS ord, CASE WHEN s_suppkey % 50 <> 3 AND s_suppkey % 7 > 0 THEN 't' || s_suppkey END AS title,
  CASE WHEN s_suppkey % 50 <> 3 AND s_suppkey % 7 > 0 THEN 'movie/' || s_suppkey % 5 END AS url, CASE WHEN s_suppkey % 50 = 3 THEN 'TimeoutError: more than 1 s' WHEN s_suppkey % 7 = 0 THEN 'ValueError: no ' || s_suppkey END AS error FROM supplier"""


QUERIES = {
    "season_posters": (season_posters, POSTERS),
    "sprite_tiles": (sprite_tiles, TILES),
    "subtitle_kinds": (subtitle_kinds, KINDS),
    "tracker_lists": (tracker_lists, TRACKERS),
    "catalog_support": (catalog_support, SUPPORT),
    "open_entries": (open_entries, OPEN),
    "recent_rows": (recent_rows, RECENT),
    "stretched_times": (stretched_times, STRETCHED),
    "spoken_words": (spoken_words, WORDS),
    "single_cues": (single_cues, SINGLE),
    "display_years": (display_years, YEARS),
    "told_titles": (told_titles, TOLD),
    "scraped_rows": (scraped_rows, SCRAPED),
    "scraper_table": (scraper_table, SCRAPER_TABLE),
}
