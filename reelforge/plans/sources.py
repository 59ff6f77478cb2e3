"""Queries: payloads, subtitles, rollups and stateful rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.operators import rollups as R
from reelforge.plans.merging import PROGRESS
from reelforge.plans.series import CUES, TURNS, _cues, turns
from reelforge.plans.tables import progress, table
from reelforge.sources import json_rows as J
from reelforge.sources import subtitles as B
from reelforge.streaming import state as T


def json_candidates(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    one = F.concat(F.lit('{"streams":[{"name":" '), "s_name", F.lit('","title":"t","url":"http://x/'), k, F.lit('","fileIdx":"7","extra":[1],"behaviorHints":{"videoSize":'), k * 1000, F.lit('}},{"name":"none","description":"d"},{"title":"'), "s_name", F.lit('","description":"  ","infoHash":"h","behaviorHints":{"notWebReady":true}}]}'))
    payload = F.when(k % 10 == 0, F.lit("{broken")).otherwise(one)
    out = J.streams(s.select("s_suppkey", payload.alias("payload")))
    return out.select("s_suppkey", "ord", "name", "description", "url", "info_hash", "file_idx", "video_size", "not_web_ready")


JSON_CANDIDATES = """SELECT s_suppkey, 0 AS ord, s_name AS name, 't' AS description, 'http://x/' || s_suppkey AS url, NULL AS info_hash, 7 AS file_idx, s_suppkey * 1000 AS video_size, false AS not_web_ready FROM supplier WHERE s_suppkey % 10 <> 0
UNION ALL SELECT s_suppkey, 2, NULL, s_name, NULL, 'h', NULL, NULL, true FROM supplier WHERE s_suppkey % 10 <> 0"""


def catalog_pages(spark, d):
    p = table(spark, d, "part")
    item = F.to_json(F.struct(F.concat(F.lit("p"), (F.col("p_partkey") % 40).cast("string")).alias("id"), F.when(F.col("p_size") % 7 != 0, F.lit("movie")).alias("type"), F.col("p_name").alias("name"), F.lit("a, b").alias("genres")))
    pages = p.groupBy("p_brand").agg(F.concat(F.lit('{"metas":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))), lambda x: x["i"]), ","), F.lit("]}")).alias("payload"))
    return J.catalog_items(pages, ["p_brand"], 10).select("p_brand", "place", "id", "name", "raw_count", F.array_join("genres", "+").alias("genres"))


CATALOG_PAGES = "WITH v AS (SELECT p_brand, p_partkey, 'p' || (p_partkey % 40) AS id, p_name AS name, count(*) OVER (PARTITION BY p_brand) AS raw_count, p_size FROM part), f AS (SELECT * FROM v WHERE p_size % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY p_brand, id ORDER BY p_partkey) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM f) SELECT p_brand, place, id, name, raw_count, 'a+b' AS genres FROM r WHERE place <= 10"


def manifest_rows(spark, d):
    n = table(spark, d, "nation")
    payload = F.concat(F.lit('{"id":"m'), F.col("n_nationkey"), F.lit('","types":["movie","series"],"resources":["catalog",{"name":"stream","types":["movie"],"idPrefixes":["tt'), F.col("n_nationkey"), F.lit('"]}]}'))
    rows = J.manifest_resources(n.select("n_nationkey", payload.alias("payload")))
    return rows.select("n_nationkey", "ord", "resource", F.array_join("types", ",").alias("types"), J.supports(F.col("resource"), F.col("types"), F.col("prefixes"), F.lit("movie"), F.lit("tt12")).alias("serves"))


MANIFEST_ROWS = "SELECT n_nationkey, 0 AS ord, 'catalog' AS resource, 'movie,series' AS types, false AS serves FROM nation UNION ALL SELECT n_nationkey, 1, 'stream', 'movie', starts_with('tt12', 'tt' || n_nationkey) FROM nation"


def rating_rows(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    payload = F.concat(F.lit('{"ratings":[{"source":"imdb","value":'), k % 13, F.lit('},{"source":"letterboxd","value":"1","score":"'), k % 120, F.lit('"},{"source":"popcorn","value":70},{"source":"audience","value":5},{"source":"x","value":1}]}'))
    return J.ratings(s.select("s_suppkey", payload.alias("payload")), ["s_suppkey"])


RATING_ROWS = "SELECT s_suppkey, 'imdb' AS source, (s_suppkey % 13)::DOUBLE AS value FROM supplier WHERE s_suppkey % 13 <= 10 UNION ALL SELECT s_suppkey, 'letterboxd', (s_suppkey % 120) / 20.0::DOUBLE FROM supplier WHERE s_suppkey % 120 <= 100 UNION ALL SELECT s_suppkey, 'audience', 70.0::DOUBLE FROM supplier"


def subtitle_cues(spark, d):
    t = turns(spark, d)
    stamp = lambda s: F.format_string("%02d:%02d:%02d,%03d", F.floor(F.col("turn") / 60), F.col("turn") % 60, F.lit(s), F.col("conv_id") % 1000)
    block = F.concat((F.col("turn") + 1).cast("string"), F.lit("\r\n"), stamp(1), F.lit(" --> "), stamp(4), F.lit(" X1:0\n<i>"), "role", F.lit("</i>  &amp; "), "h", F.lit("\n"))
    files = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))
    return B.srt(files.select(F.col("conv_id").alias("track"), "text")).select("track", "ord", "start", "end", "text")


SUBTITLE_CUES = TURNS + " SELECT conv_id AS track, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord, turn * 60000 + 1000 + conv_id % 1000 AS start, turn * 60000 + 4000 + conv_id % 1000 AS \"end\", role || ' & ' || h AS text FROM c"


def timing_codec(spark, d):
    c = _cues(spark, d).withColumn("estimated", F.col("ord") % 3 == 0)
    return B.decoded_timing(B.encoded_timing(c)).select("track", "ord", "start", "end", "estimated")


TIMING_CODEC = CUES + ' SELECT track, (row_number() OVER (PARTITION BY track ORDER BY start, ord) - 1)::INT AS ord, start, "end", ord % 3 = 0 AS estimated FROM c'


def library_sections(spark, d):
    s = table(spark, d, "supplier")
    return R.sections(s, "s_nationkey", [-F.col("s_acctbal"), F.col("s_suppkey")], "s_suppkey").select("s_nationkey", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


LIBRARY_SECTIONS = "SELECT s_nationkey, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_acctbal DESC, s_suppkey) AS items FROM supplier GROUP BY s_nationkey"


def dominant_category(spark, d):
    return R.dominant(progress(spark, d), ["profile"], "title", "view")


DOMINANT = PROGRESS + ", n AS (SELECT profile, title, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT * FROM n WHERE title <> 'view' QUALIFY row_number() OVER (PARTITION BY profile ORDER BY n DESC, title) = 1) SELECT t.profile, t.title, t.n AS votes FROM t LEFT JOIN n v ON v.profile = t.profile AND v.title = 'view' WHERE t.n > coalesce(v.n, 0)"
NOW = 1_706_500_000_000


def throughput_estimates(spark, d):
    return R.throughput(progress(spark, d), ["profile", "title"], "stamp", "percent", NOW, 200_000_000)


THROUGHPUT = PROGRESS + f", r AS (SELECT *, stamp BETWEEN {NOW} - 200000000 AND {NOW} AS ok FROM p) SELECT profile, title, CASE WHEN count(*) FILTER (ok) >= 2 THEN max(percent) FILTER (ok) END AS estimate FROM r GROUP BY ALL"


def nested_storage(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    return R.expanded(R.nested(li, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"]), ["l_orderkey", "l_suppkey"])


NESTED_STORAGE = "SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey FROM lineitem"


def alias_signatures(spark, d):
    p = progress(spark, d)
    return R.by_signature(p, "profile", ["title"]).select(F.array_join(F.col("aliases").cast("array<string>"), ",").alias("aliases"), F.array_join("entries.title", ",").alias("titles"))


ALIAS_SIGNATURES = PROGRESS + ", s AS (SELECT profile, string_agg(DISTINCT title, ',' ORDER BY title) AS titles FROM p GROUP BY profile) SELECT string_agg(profile::VARCHAR, ',' ORDER BY profile) AS aliases, titles FROM s GROUP BY titles"


def alias_signatures_all(spark, d):
    p = progress(spark, d).select("profile", F.concat_ws("-", "title", F.least(F.floor(F.col("percent") / 100), F.lit(2)).cast("string")).alias("entry"))
    return R.by_signature(p, "profile", ["entry"]).select(F.array_join(F.col("aliases").cast("array<string>"), ",").alias("aliases"), F.array_join("entries.entry", ",").alias("entries"))


ALIAS_SIGNATURES_ALL = PROGRESS + ", e AS (SELECT profile, title || '-' || least(floor(percent / 100)::INT, 2) AS entry FROM p), s AS (SELECT profile, string_agg(DISTINCT entry, ',' ORDER BY entry) AS entries FROM e GROUP BY profile) SELECT string_agg(profile::VARCHAR, ',' ORDER BY profile) AS aliases, entries FROM s GROUP BY entries"


def write_receipts(spark, d):
    li = table(spark, d, "lineitem")
    return R.receipt(li, li.filter("l_quantity > 25"), "l_returnflag", "l_orderkey")


WRITE_RECEIPTS = "WITH r AS (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem), c AS (SELECT DISTINCT l_returnflag, l_orderkey, 1 AS ok FROM lineitem WHERE l_quantity > 25) SELECT l_returnflag, count(*) AS requested, count(ok) AS confirmed, count(*) - count(ok) AS missing FROM r LEFT JOIN c USING (l_returnflag, l_orderkey) GROUP BY l_returnflag"


def regional_ratings(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.substring("c_mktsegment", 1, 2).alias("region"), F.when(F.col("c_acctbal") > 9000, F.col("c_name")).otherwise(" ").alias("value"), "c_custkey")
    return R.by_region(c, ["c_nationkey"], "region", "value", ["MA", "HO"], ["c_custkey"])


REGIONAL = "WITH c AS (SELECT c_nationkey, substr(c_mktsegment, 1, 2) AS region, c_name AS value, c_custkey FROM customer WHERE c_acctbal > 9000) SELECT c_nationkey, region, value FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE region WHEN 'MA' THEN 1 WHEN 'HO' THEN 2 ELSE 3 END, c_custkey) = 1"


def image_choice(spark, d):
    p = table(spark, d, "part")
    tests = [F.col("p_size") == 7, F.col("p_size") % 5 == 0, F.col("p_type").like("%STEEL%")]
    return R.first_true(p.select("p_brand", "p_size", "p_type", "p_partkey"), ["p_brand"], tests, ["p_partkey"])


IMAGE_CHOICE = "SELECT p_brand, p_size, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_size = 7) DESC, (p_size % 5 = 0) DESC, (p_type LIKE '%STEEL%') DESC, p_partkey) = 1"


def version_order(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 2 == 0, "v").otherwise(""), (k % 3).cast("string"), F.lit("."), (k % 11).cast("string"), F.lit(".0"), F.when(k % 4 == 1, F.concat(F.lit("-beta."), (k % 12).cast("string"))).when(k % 4 == 2, "-alpha").when(k % 4 == 3, "-7").otherwise("+b1"))
    from reelforge.operators.order import top_per_key

    rows = p.select("p_brand", "p_partkey", text.alias("version"))
    return top_per_key(rows, ["p_brand"], [R.version_key(F.col("version")).desc(), F.col("p_partkey")], 1)


VERSION_ORDER = "WITH v AS (SELECT p_brand, p_partkey, p_partkey AS k FROM part) SELECT p_brand, p_partkey, CASE WHEN k % 2 = 0 THEN 'v' ELSE '' END || (k % 3) || '.' || (k % 11) || '.0' || CASE k % 4 WHEN 1 THEN '-beta.' || (k % 12) WHEN 2 THEN '-alpha' WHEN 3 THEN '-7' ELSE '+b1' END AS version FROM v QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY k % 3 DESC, k % 11 DESC, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END DESC, CASE WHEN k % 4 = 1 THEN k % 12 END DESC, p_partkey) = 1"


def search_history(spark, d):
    h = progress(spark, d).withColumn("q", F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, F.upper("title")).otherwise(F.col("title"))))
    return R.recent_queries(h, ["profile"], "q", "stamp", 3).select("profile", "q", "at", "place")


SEARCH_HISTORY = PROGRESS + ', l AS (SELECT profile, title AS q, max(stamp) AS t0 FROM p GROUP BY ALL), r AS (SELECT profile, q, t0, row_number() OVER (PARTITION BY profile ORDER BY t0 DESC, q) AS place FROM l) SELECT profile, q, t0 AS "at", place FROM r WHERE place <= 3'


def initial_and_deferred(spark, d):
    return R.initial_and_deferred(progress(spark, d), ["profile"], [F.desc("stamp"), F.col("event_id")], 32).groupBy("profile", "deferred").agg(F.count("*").alias("n"), F.max("stamp").alias("latest"))


INITIAL = PROGRESS + ", r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY stamp DESC, event_id) > 32 AS deferred FROM p) SELECT profile, deferred, count(*) AS n, max(stamp) AS latest FROM r GROUP BY ALL"


def seeded_sample(spark, d):
    return R.seeded_sample(table(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", "seed-8", 8)


SEEDED = "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('seed-8' || p_partkey), p_partkey) <= 8"


def availability(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.md5((F.col("o_custkey") % 100).cast("string"))).alias("hash"))
    cache = spark.range(0, 80).select(F.md5(F.col("id").cast("string")).alias("hash"), (F.col("id") % 2 == 0).alias("cached"))
    return R.availability(o, cache, "hash", F.col("o_orderkey") % 4 != 1).select("o_orderkey", "state")


AVAILABILITY = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 9 <> 0 THEN CASE WHEN o_custkey % 100 >= 80 THEN 'UNKNOWN' WHEN o_custkey % 100 % 2 = 0 THEN 'CACHED' ELSE 'NOT_CACHED' END END AS state FROM orders"


def unique_file_match(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 9).alias("name"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 9).alias("name"))
    return R.unique_match(s, c, ["nation"], "name", "s_suppkey", "c_custkey")


UNIQUE_MATCH = "WITH c AS (SELECT * FROM customer), u AS (SELECT c_nationkey, min(c_custkey) AS k FROM c GROUP BY ALL HAVING count(DISTINCT c_custkey) = 1) SELECT s_suppkey, coalesce((SELECT min(c_custkey) FROM c WHERE c_nationkey = s_nationkey AND c_custkey % 9 = s_suppkey % 9), (SELECT k FROM u WHERE u.c_nationkey = s_nationkey)) AS c_custkey FROM supplier"


def unique_file_match_all(spark, d):
    s, k = table(spark, d, "supplier"), F.col("c_custkey")
    s = s.select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 12).alias("shelf"), (F.col("s_suppkey") % 9).alias("name"))
    # Each shelf of a nation has half the files of the one before, so that some have many, some one and some none.
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.bit_count(k.bitwiseAND(-k) - 1).cast("long").alias("shelf"), (k % 9).alias("name"))
    return R.unique_match(s, c, ["nation", "shelf"], "name", "s_suppkey", "c_custkey")


UNIQUE_MATCH_ALL = "WITH c AS (SELECT *, bit_count((c_custkey & -c_custkey) - 1) AS shelf FROM customer), u AS (SELECT c_nationkey, shelf, min(c_custkey) AS k FROM c GROUP BY ALL HAVING count(DISTINCT c_custkey) = 1) SELECT s_suppkey, coalesce((SELECT min(c_custkey) FROM c WHERE c_nationkey = s_nationkey AND shelf = s_suppkey % 12 AND c_custkey % 9 = s_suppkey % 9), (SELECT k FROM u WHERE u.c_nationkey = s_nationkey AND u.shelf = s_suppkey % 12)) AS c_custkey FROM supplier"


def word_anchors(spark, d):
    p = progress(spark, d)
    side = lambda m: p.filter(f"event_id % 2 = {m}").select("profile", F.concat("title", (F.floor(F.col("event_id") / 2) % 4).cast("string")).alias("word"), F.col("stamp").alias("at"))
    return R.word_anchors(side(0), side(1), ["profile"], "word", 2).select("profile", "at", "cue_at", F.round("weight", 6).alias("weight"))


WORD_ANCHORS = PROGRESS + """, w AS (SELECT profile, title || (event_id // 2 % 4) AS word, stamp AS t, event_id % 2 AS m FROM p), n AS (SELECT *, lag(word) OVER x AS a, lead(word) OVER x AS b FROM w WINDOW x AS (PARTITION BY profile, m ORDER BY t)), f AS (SELECT profile, word, count(*) AS c FROM w WHERE m = 1 GROUP BY ALL HAVING count(*) <= 2)
SELECT h.profile, h.t AS "at", q.t AS cue_at, round(1.0::DOUBLE / c + coalesce((h.a = q.a)::INT, 0) + coalesce((h.b = q.b)::INT, 0), 6) AS weight FROM n h JOIN n q ON h.m = 0 AND q.m = 1 AND h.profile = q.profile AND h.word = q.word JOIN f ON f.profile = h.profile AND f.word = h.word"""


def timing_classes(spark, d):
    t = turns(spark, d).select(F.col("conv_id").alias("track"), (F.col("turn") * 1000).alias("start"), (F.col("turn") * 1000 + 10 * (F.col("conv_id") % 3)).alias("end"))
    return R.timing_classes(t, "track").select(F.array_join(F.col("tracks").cast("array<string>"), ",").alias("tracks"), "cues")


TIMING_CLASSES = TURNS + ", s AS (SELECT conv_id, string_agg((turn * 1000) || '-' || (turn * 1000 + 10 * (conv_id % 3)), ' ' ORDER BY turn) AS k, count(*) AS n FROM c GROUP BY conv_id) SELECT string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS tracks, max(n)::INT AS cues FROM s GROUP BY k"


def repeated_writes(spark, d):
    p = progress(spark, d).select("profile", "event_id", F.floor(F.col("stamp") / 40_000).alias("stamp"), F.col("title").alias("signature"))
    return T.over_table(p, ["profile"], T.repeated_writes, ["stamp", "event_id"])


REPEATED = PROGRESS.replace("WITH p", "WITH RECURSIVE p") + """, r AS (SELECT profile, event_id, stamp // 40000 AS stamp, title, row_number() OVER (PARTITION BY profile ORDER BY stamp // 40000, event_id) AS n FROM p),
f AS (SELECT profile, n, true AS keep, title AS sent, stamp AS t FROM r WHERE n = 1
  UNION ALL SELECT r.profile, r.n, NOT (r.title = f.sent AND r.stamp - f.t < 5000), r.title, CASE WHEN r.title = f.sent AND r.stamp - f.t < 5000 THEN f.t ELSE r.stamp END FROM f JOIN r ON r.profile = f.profile AND r.n = f.n + 1)
SELECT profile, event_id, stamp::BIGINT AS stamp, title AS signature FROM r JOIN f USING (profile, n) WHERE keep"""


def rate_limited(spark, d):
    p = progress(spark, d).select("profile", "event_id", F.floor(F.col("stamp") / 1000).alias("stamp"))
    return T.over_table(p, ["profile"], T.rate_limit, ["stamp", "event_id"])


LIMITED = PROGRESS.replace("WITH p", "WITH RECURSIVE p") + """, r AS (SELECT profile, event_id, stamp // 1000 AS stamp, row_number() OVER (PARTITION BY profile ORDER BY stamp // 1000, event_id) AS n FROM p),
f AS (SELECT profile, n, true AS keep, [stamp] AS held FROM r WHERE n = 1
  UNION ALL SELECT profile, n, keep, CASE WHEN keep THEN list_append(near, stamp) ELSE near END FROM (
    SELECT profile, n, stamp, near, len(near) < 30 AND len(list_filter(near, lambda t: stamp - t <= 60000)) < 6 AS keep FROM (
      SELECT r.profile, r.n, r.stamp, list_filter(f.held, lambda t: r.stamp - t <= 3600000) AS near FROM f JOIN r ON r.profile = f.profile AND r.n = f.n + 1)))
SELECT profile, event_id, stamp::BIGINT AS stamp FROM r JOIN f USING (profile, n) WHERE keep"""


QUERIES = {
    "json_candidates": (json_candidates, JSON_CANDIDATES),
    "catalog_pages": (catalog_pages, CATALOG_PAGES),
    "manifest_rows": (manifest_rows, MANIFEST_ROWS),
    "rating_rows": (rating_rows, RATING_ROWS),
    "subtitle_cues": (subtitle_cues, SUBTITLE_CUES),
    "timing_codec": (timing_codec, TIMING_CODEC),
    "library_sections": (library_sections, LIBRARY_SECTIONS),
    "dominant_category": (dominant_category, DOMINANT),
    "throughput_estimates": (throughput_estimates, THROUGHPUT),
    "nested_storage": (nested_storage, NESTED_STORAGE),
    "alias_signatures": (alias_signatures, ALIAS_SIGNATURES),
    "alias_signatures_all": (alias_signatures_all, ALIAS_SIGNATURES_ALL),
    "write_receipts": (write_receipts, WRITE_RECEIPTS),
    "regional_ratings": (regional_ratings, REGIONAL),
    "image_choice": (image_choice, IMAGE_CHOICE),
    "version_order": (version_order, VERSION_ORDER),
    "search_history": (search_history, SEARCH_HISTORY),
    "initial_and_deferred": (initial_and_deferred, INITIAL),
    "seeded_sample": (seeded_sample, SEEDED),
    "availability": (availability, AVAILABILITY),
    "unique_file_match": (unique_file_match, UNIQUE_MATCH),
    "unique_file_match_all": (unique_file_match_all, UNIQUE_MATCH_ALL),
    "word_anchors": (word_anchors, WORD_ANCHORS),
    "timing_classes": (timing_classes, TIMING_CLASSES),
    "repeated_writes": (repeated_writes, REPEATED),
    "rate_limited": (rate_limited, LIMITED),
}
