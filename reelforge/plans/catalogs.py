"""Queries: catalog orders, choices and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import candidates as K
from reelforge.operators import catalog as C
from reelforge.operators.order import top_per_key
from reelforge.plans.facts import NAMES, releases
from reelforge.plans.merging import PROGRESS
from reelforge.plans.series import CUES, _cues
from reelforge.plans.tables import progress, table


def provider_order(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 40).alias("k"))
    ranks = spark.range(0, 30).select(F.col("id").alias("k"), (30 - F.col("id")).cast("int").alias("rank"))
    return top_per_key(C.provider_order(s, ranks, "k", "rank"), ["s_nationkey"], ["rank", "s_suppkey"], 3).select("s_nationkey", "s_suppkey", "rank")


PROVIDER_ORDER = "WITH r AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 40 < 30 THEN 30 - s_suppkey % 40 ELSE 2147483647 END::INT AS rank FROM supplier) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY rank, s_suppkey) <= 3"


def source_order(spark, d):
    p = table(spark, d, "part")
    bucket, rank = C.source_bucket(F.col("p_brand"), ["Brand#13", "Brand#11"], F.col("p_size") == 50)
    rows = p.select("p_type", "p_partkey", "p_brand", bucket.alias("bucket"), rank.alias("rank"))
    return top_per_key(rows, ["p_type"], ["bucket", "rank", "p_partkey"], 5).select("p_type", "p_partkey", "bucket")


SOURCE_ORDER = "WITH r AS (SELECT p_type, p_partkey, CASE WHEN p_size = 50 THEN 0 WHEN p_brand IN ('Brand#13', 'Brand#11') THEN 1 ELSE 2 END AS bucket, CASE WHEN p_size = 50 THEN 0 WHEN p_brand = 'Brand#13' THEN 1 WHEN p_brand = 'Brand#11' THEN 2 ELSE 0 END AS rank FROM part) SELECT p_type, p_partkey, bucket FROM r QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY bucket, rank, p_partkey) <= 5"


def streaming_sort(spark, d):
    p = progress(spark, d)
    date = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 97)
    order = C.upcoming_last(F.col("event_id") % 3 == 0, F.col("stamp"), date)
    return top_per_key(p, ["profile"], [*order, F.col("event_id")], 60).select("profile", "event_id")


STREAMING_SORT = PROGRESS + " SELECT profile, event_id FROM p QUALIFY row_number() OVER (PARTITION BY profile ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN event_id % 3 = 0 THEN stamp END DESC NULLS LAST, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN event_id % 97 END ASC NULLS LAST, event_id) <= 60"
PATTERN = r"^(?!.*\b(cam|ts)\b).*(1080|2160|fhd|cam)"


def user_regex(spark, d):
    return releases(spark, d).filter(C.user_pattern(F.col("name"), PATTERN)).select("p_partkey")


USER_REGEX = f"WITH r AS (SELECT p_partkey, lower({NAMES}) AS n FROM part) SELECT p_partkey FROM r WHERE regexp_matches(n, '1080|2160|fhd|cam') AND NOT regexp_matches(n, '\\b(cam|ts)\\b')"


def auto_choice(spark, d):
    r = releases(spark, d).select("p_brand", "p_partkey", "bytes", "p_size")
    return C.auto_choice(r, ["p_brand"], F.col("p_size") == 9, F.col("bytes").isNotNull(), ["p_partkey"]).select("p_brand", "p_partkey", "p_size")


AUTO_CHOICE = "SELECT p_brand, p_partkey, p_size FROM part WHERE p_size % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_size = 9) DESC, p_partkey) = 1"


def fresher_progress(spark, d):
    p = progress(spark, d)
    return C.fresher(p.filter("title = 'view'"), p.filter("title = 'signup'"), ["profile"], "stamp", "stamp").select("event_id")


FRESHER = PROGRESS + ", w AS (SELECT profile, max(stamp) AS x FROM p WHERE title = 'signup' GROUP BY profile) SELECT event_id FROM p LEFT JOIN w USING (profile) WHERE title = 'view' AND (x IS NULL OR stamp > x)"


def sibling_badges(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("alias"), F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("entity"), "c_acctbal")
    return C.spread_to_siblings(c.filter("c_acctbal > 9500"), c.select("alias", "entity"), "alias", "entity")


SIBLING_BADGES = "WITH c AS (SELECT c_name AS alias, c_mktsegment || '-' || c_nationkey AS entity, c_acctbal FROM customer), u AS (SELECT alias FROM c GROUP BY alias HAVING count(DISTINCT entity) = 1), m AS (SELECT alias FROM c WHERE c_acctbal > 9500) SELECT alias FROM m UNION SELECT alias FROM c WHERE alias IN (SELECT alias FROM u) AND entity IN (SELECT entity FROM c WHERE alias IN (SELECT alias FROM u) AND alias IN (SELECT alias FROM m))"


def _segments(spark, d):
    p = progress(spark, d)
    kind = F.when(F.col("title") == "view", "outro").when(F.col("title") == "click", "Post-Credits ").otherwise("intro")
    return p.select("profile", F.floor("percent").cast("long").alias("a"), (F.floor("percent").cast("long") + 20).alias("b"), kind.alias("kind"), F.lit(300).cast("long").alias("duration"))


def following_scenes(spark, d):
    return C.following_scene(_segments(spark, d), ["profile"], "a", "b", "kind", "duration")


FOLLOWING = PROGRESS + ", s AS (SELECT profile, floor(percent)::BIGINT AS a, floor(percent)::BIGINT + 20 AS b, title FROM p), o AS (SELECT profile, max(b) AS x FROM s WHERE title = 'view' GROUP BY profile), f AS (SELECT o.profile, x, min({'a': a, 'b': b}) FILTER (title = 'click' AND a >= x AND a < 300) AS n FROM o JOIN s USING (profile) GROUP BY ALL) SELECT profile, CASE WHEN n IS NOT NULL THEN n.a ELSE x END AS a, CASE WHEN n IS NOT NULL THEN n.b ELSE 300 END AS b FROM f WHERE n IS NOT NULL OR 300 - x > 5"


def next_cards(spark, d):
    p = progress(spark, d)
    k, position = F.col("event_id"), (F.col("event_id") % 1000).cast("long")
    out = C.next_card(position, F.lit(1000).cast("long"), F.when(k % 3 > 0, F.lit(900)), F.when(k % 3 > 0, F.when(k % 2 == 0, F.lit(990)).otherwise(F.lit(950))), F.when(k % 9 == 1, F.lit(985)), 98.0)
    return p.select("event_id", out.alias("show"))


NEXT_CARDS = "WITH q AS (SELECT event_id, event_id % 1000 AS t, event_id % 3 AS m, event_id % 2 AS e, event_id % 9 AS n FROM events) SELECT event_id, CASE WHEN n = 1 THEN t >= 985 WHEN m > 0 AND e = 0 THEN t >= 900 ELSE t >= 980 END AS show FROM q"


def paging_stop(spark, d):
    p = progress(spark, d)
    return C.paging_stops(p, ["profile"], "event_id", F.col("percent") > 60).select("profile", "event_id")


PAGING_STOP = PROGRESS + ", n AS (SELECT *, lag(percent) OVER w AS a, lag(percent, 2) OVER w AS b, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY profile ORDER BY event_id)), s AS (SELECT profile, min(r) AS stop FROM n WHERE percent <= 60 AND a <= 60 AND b <= 60 GROUP BY profile) SELECT n.profile, event_id FROM n LEFT JOIN s USING (profile) WHERE stop IS NULL OR r <= stop"


def absolute_numbers(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("season"), F.col("l_linenumber").alias("episode")).distinct()
    seeds = li.select("l_orderkey").distinct().withColumn("season", F.lit(1)).withColumn("episode", F.lit(3))
    out = C.by_absolute_number(li, seeds, ["l_orderkey"], "season", "episode")
    return out.select("l_orderkey", F.col("found.season").alias("season"), F.col("found.episode").alias("episode"))


ABSOLUTE = "WITH l AS (SELECT DISTINCT l_orderkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS season, l_linenumber AS episode FROM lineitem), m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY season, episode) AS r, min(season) OVER (PARTITION BY l_orderkey) <> max(season) OVER (PARTITION BY l_orderkey) AS many FROM l WHERE season > 0) SELECT l_orderkey, season, episode FROM l WHERE season = 1 AND episode = 3 UNION ALL SELECT l_orderkey, season, episode FROM m WHERE many AND r = 3 AND l_orderkey NOT IN (SELECT l_orderkey FROM l WHERE season = 1 AND episode = 3)"


def collapsed_cues(spark, d):
    c = _cues(spark, d).withColumn("start", F.floor(F.col("start") / 30).cast("long")).withColumn("text", F.when(F.col("ord") % 6 != 0, F.col("text")).otherwise(""))
    return C.collapsed_cues(c, "track")


COLLAPSED = PROGRESS.replace("WITH p", "WITH RECURSIVE p") + r""", c AS (SELECT profile AS track, event_id AS ord, stamp % 3600000 // 30 AS start, stamp % 3600000 + floor(percent)::BIGINT * 100 AS "end", CASE WHEN event_id % 6 <> 0 THEN title ELSE '' END AS text FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY start, ord) AS n FROM c),
f AS (SELECT track, n, 1 AS slot, start, text, ord AS held FROM r WHERE n = 1
  UNION ALL SELECT track, n, slot + CASE WHEN near THEN 0 ELSE 1 END, CASE WHEN takes THEN s ELSE start END, CASE WHEN takes THEN x ELSE text END, CASE WHEN takes THEN o ELSE held END FROM (
    SELECT *, NOT near OR (text = '' AND x <> '') AS takes FROM (
      SELECT r.track, r.n, f.slot, f.start, f.text, f.held, r.start AS s, r.text AS x, r.ord AS o, abs(f.start - r.start) <= 125 AND (f.text = '' OR r.text = '' OR f.text = r.text) AS near FROM f JOIN r ON r.track = f.track AND r.n = f.n + 1)))
SELECT c.* FROM c JOIN (SELECT track, held FROM f QUALIFY row_number() OVER (PARTITION BY track, slot ORDER BY n DESC) = 1) k ON k.track = c.track AND k.held = c.ord"""


def arrival_fold(spark, d):
    p = progress(spark, d)
    cur = p.filter("stamp < 1704844800000").groupBy("profile").agg(F.max("stamp").alias("stamp")).withColumn("stamp", F.col("stamp") + 1_000_000_000).withColumn("dirty", F.col("profile") % 2 == 0)
    op = F.when(F.col("title").isin("signup", "purchase", "view"), "upsert").when(F.col("title") == "error", "delete").otherwise("other")
    ev = p.filter("stamp >= 1704844800000").select("profile", "event_id", "stamp", op.alias("operation"))
    return C.arrival_fold(cur, ev, ["profile"], "event_id", "stamp")


ARRIVAL = PROGRESS + """, c AS (SELECT profile, max(stamp) + 1000000000 AS s, profile % 2 = 0 AS dirty FROM p WHERE stamp < 1704844800000 GROUP BY profile), e AS (SELECT p.profile, event_id, stamp, CASE WHEN title IN ('signup', 'purchase', 'view') THEN 'u' WHEN title = 'error' THEN 'd' ELSE 'o' END AS op, coalesce(c.dirty, false) AS dirty, c.s FROM p LEFT JOIN c USING (profile) WHERE stamp >= 1704844800000 AND title <> 'click'),
f AS (SELECT profile, min(event_id) AS first FROM e WHERE NOT dirty OR (op = 'u' AND stamp >= s) GROUP BY profile), l AS (SELECT e.profile, max({'i': event_id, 'o': op, 't': stamp}) AS x FROM e JOIN f USING (profile) WHERE event_id >= first GROUP BY e.profile)
SELECT profile, x.t AS stamp, false AS dirty FROM l WHERE x.o = 'u' UNION ALL SELECT profile, s, dirty FROM c WHERE profile NOT IN (SELECT profile FROM l)"""


def resolved_identities(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set((F.col("l_partkey") % 300).cast("string"))).alias("aliases")).withColumn("part", F.col("l_orderkey") % 50)
    return C.resolved_identity(rows, "part", "l_orderkey", "aliases").select("l_orderkey", "entity")


def url_templates(spark, d):
    p = table(spark, d, "part")
    out = C.url_template("http://h/{imdb|tmdb}/{type}.jpg?l={lang?}", {"imdb": F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("tt"), "p_partkey")), "tmdb": F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")), "type": F.lower("p_type"), "lang": F.when(F.col("p_size") > 25, F.lit("de"))})
    return p.select("p_partkey", out.alias("url"))


URL_TEMPLATES = "SELECT p_partkey, 'http://h/' || CASE WHEN p_size % 3 = 0 THEN 'tt' || p_partkey WHEN p_size % 2 = 0 THEN p_partkey::VARCHAR END || '/' || lower(p_type) || '.jpg?l=' || CASE WHEN p_size > 25 THEN 'de' ELSE '' END AS url FROM part"


def string_hashes(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", C.string_hash(F.col("s_name")).alias("hash"))


STRING_HASHES = "SELECT s_suppkey, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INT AS hash FROM (SELECT s_suppkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s_name, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: (x * 31 + y) % 4294967296) AS h FROM supplier)"


def candidate_kinds(spark, d):
    o = table(spark, d, "orders")
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    url = F.when(k % 5 == 0, F.concat(F.lit(" http://x/"), text)).when(k % 5 == 1, F.concat(F.lit("magnet:?xt=urn:btih:"), F.sha1(text))).when(k % 5 == 2, F.lit("torrent://zz"))
    hash_, external = F.when(k % 5 == 3, F.upper(F.sha1(text))), F.when(k % 7 == 0, F.lit("https://e"))
    direct, none = F.lit(False), F.lit(None).cast("string")
    return o.select(
        "o_orderkey",
        K.playable_url(url).alias("playable"),
        K.opens_externally(url, hash_, none, external).alias("external"),
        K.is_torrent(url, hash_, external, direct).alias("torrent"),
        K.selectable(url, hash_, none, external, direct, True, F.lit(False)).alias("selectable"),
        K.catalog_path(F.lit("movie"), F.lit("top"), F.when(k % 2 == 0, F.lit("Sci Fi&x")), F.lit(" "), (k % 3) * 100).alias("path"),
    )


CANDIDATE_KINDS = """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, CASE WHEN k % 5 = 0 THEN 'http://x/' || k END AS playable, k % 5 = 4 AND k % 7 = 0 AS external, k % 5 IN (1, 2, 3) AS torrent,
k % 5 IN (0, 1, 3) OR (k % 5 = 4 AND k % 7 = 0) AS selectable, 'catalog/movie/top' || CASE WHEN k % 2 = 0 AND k % 3 > 0 THEN '/genre=Sci%20Fi%26x&skip=' || (k % 3 * 100) WHEN k % 2 = 0 THEN '/genre=Sci%20Fi%26x' WHEN k % 3 > 0 THEN '/skip=' || (k % 3 * 100) ELSE '' END || '.json' AS path FROM o"""


QUERIES = {
    "candidate_kinds": (candidate_kinds, CANDIDATE_KINDS),
    "provider_order": (provider_order, PROVIDER_ORDER),
    "source_order": (source_order, SOURCE_ORDER),
    "streaming_sort": (streaming_sort, STREAMING_SORT),
    "user_regex": (user_regex, USER_REGEX),
    "auto_choice": (auto_choice, AUTO_CHOICE),
    "fresher_progress": (fresher_progress, FRESHER),
    "sibling_badges": (sibling_badges, SIBLING_BADGES),
    "following_scenes": (following_scenes, FOLLOWING),
    "next_cards": (next_cards, NEXT_CARDS),
    "paging_stop": (paging_stop, PAGING_STOP),
    "absolute_numbers": (absolute_numbers, ABSOLUTE),
    "collapsed_cues": (collapsed_cues, COLLAPSED),
    "arrival_fold": (arrival_fold, ARRIVAL),
    "resolved_identities": (resolved_identities, None),
    "url_templates": (url_templates, URL_TEMPLATES),
    "string_hashes": (string_hashes, STRING_HASHES),
}
