"""Queries: signatures, catalogues, releases, collections, links, batched ratings and reference tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import signature as G
from reelforge.operators import listings as L
from reelforge.operators.align import affine
from reelforge.plans.alignment import tracks
from reelforge.plans.tables import progress, table
from reelforge.sources.json_rows import batched_ratings


def signatures(spark, d):
    k = F.col("s_suppkey")
    parts = [G.of_text(F.col("s_name")), G.of_flag(F.col("s_acctbal") > 0), G.of_number(F.when(k % 3 > 0, F.col("s_nationkey"))), G.of_text(F.when(k % 2 == 0, F.col("s_name")))]
    return table(spark, d, "supplier").select("s_suppkey", G.signature(*parts).alias("signature"))


_UNITS = "list_prepend(len(s_name)::HUGEINT, list_transform(string_split(s_name, ''), lambda c: ascii(c)::HUGEINT))"
SIGNATURES = f"""WITH v AS (SELECT s_suppkey, list_concat({_UNITS}, [CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END::HUGEINT, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey ELSE 18446744071562067968 END::HUGEINT],
  CASE WHEN s_suppkey % 2 = 0 THEN {_UNITS} ELSE [0::HUGEINT] END) AS l FROM supplier),
h AS (SELECT s_suppkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, l), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM v)
SELECT s_suppkey, ltrim(lower(hex(h::UBIGINT)), '0') AS signature FROM h"""


def _sources(spark, d):
    """Suppliers as sources of three catalogues each."""
    k = F.col("s_suppkey")
    extra = lambda name, required, n: F.struct(F.lit(name).alias("name"), required.alias("required"), F.when(n, F.array(F.lit("x"), F.concat(F.lit("o"), (k % 3).cast("string")))).alias("options"))
    catalog = lambda i: F.struct(F.when(k % 2 == 0, "movie").otherwise("series").alias("type"), F.lit(f"c{i}").alias("id"), F.concat(F.lit(f"N{i}-"), k.cast("string")).alias("name"), F.when(k % 7 > 0, F.array(extra("skip", k % 5 == i, k > 0), extra("genre", k % 3 == i, k % 4 > 0))).alias("extra"))
    return table(spark, d, "supplier").select(k.alias("source"), (k % 6 > 0).alias("enabled"), (k % 4 > 0).alias("active"), F.when(k % 9 > 0, F.array(*map(catalog, range(3)))).alias("catalogs"))


def flat_catalogs(spark, d):
    return L.flat_catalogs(_sources(spark, d)).withColumn("genres", F.array_join("genres", ","))


FLAT = """SELECT s_suppkey AS source, i::INT AS place, CASE WHEN s_suppkey % 2 = 0 THEN 'movie' ELSE 'series' END AS type, 'c' || i AS id, 'N' || i || '-' || s_suppkey AS name,
  CASE WHEN s_suppkey % 7 > 0 AND s_suppkey % 4 > 0 THEN 'x,o' || s_suppkey % 3 ELSE '' END AS genres, s_suppkey % 7 > 0 AND s_suppkey % 3 = i AS genre_required
FROM supplier, (SELECT unnest([0, 1, 2]) AS i) WHERE s_suppkey % 6 > 0 AND s_suppkey % 9 > 0 AND (s_suppkey % 7 = 0 OR s_suppkey % 5 <> i)"""


def source_overview(spark, d):
    return L.overview(_sources(spark, d))


OVERVIEW = "SELECT count(*) AS total, count(*) FILTER (s_suppkey % 4 > 0) AS active, coalesce(sum(CASE WHEN s_suppkey % 6 > 0 THEN CASE WHEN s_suppkey % 9 > 0 THEN 3 ELSE 0 END END), 0)::BIGINT AS catalogs FROM supplier"


def eligible_releases(spark, d):
    k = F.col("p_partkey")
    version = F.concat(F.when(k % 2 == 0, "v").otherwise(""), (k % 3).cast("string"), F.lit("."), (k % 11).cast("string"), F.lit(".0"), F.when(k % 4 == 1, F.concat(F.lit("-beta."), (k % 12).cast("string"))).when(k % 4 == 2, "+b1").otherwise(""))
    rows = table(spark, d, "part").select(
        "p_brand", "p_partkey", F.when(k % 7 == 0, "nightly").otherwise(version).alias("tag"), F.when(k % 14 == 0, version).when(k % 5 == 0, "Big Preview").otherwise("Stable").alias("name"), (k % 13 == 0).alias("draft"), (k % 17 == 0).alias("prerelease"),
    )
    return L.eligible_releases(rows, ["p_brand"], F.col("p_brand").endswith("1"), ["p_partkey"]).select("p_brand", "p_partkey", "version", "place")


RELEASES = """WITH v AS (SELECT p_brand, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END || (p_partkey % 3) || '.' || (p_partkey % 11) || '.0' || CASE p_partkey % 4 WHEN 1 THEN '-beta.' || (p_partkey % 12) WHEN 2 THEN '+b1' ELSE '' END AS version FROM part),
r AS (SELECT *, k % 17 = 0 OR k % 4 = 1 OR (k % 14 <> 0 AND k % 5 = 0) OR (k % 14 = 0 AND k % 4 = 1) AS early FROM v WHERE k % 13 <> 0 AND (k % 7 <> 0 OR k % 14 = 0))
SELECT p_brand, k AS p_partkey, version, row_number() OVER (PARTITION BY p_brand ORDER BY k % 3 DESC, k % 11 DESC, k % 4 = 1, CASE WHEN k % 4 = 1 THEN k % 12 END DESC, k)::INT AS place FROM r WHERE NOT early OR p_brand LIKE '%1'"""


def collection_parts(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select("o_custkey", "o_orderkey", F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" P"), k.cast("string"))).alias("title"), F.when(k % 4 == 0, " ").when(k % 6 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("release_date"))
    return L.collection_parts(rows, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "title", "place")


PARTS = """SELECT o_custkey, o_orderkey, 'P' || o_orderkey AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 THEN '9999' ELSE strftime(o_orderdate, '%Y-%m-%d') END, o_orderkey)::INT AS place FROM orders WHERE o_orderkey % 9 <> 0"""


def recommended(spark, d):
    li, n = table(spark, d, "lineitem"), F.col("l_orderkey") * 7 + F.col("l_linenumber")
    text = lambda m, head: F.when(n % m == 0, F.concat(F.lit(head), n.cast("string")))
    rows = li.select("l_suppkey", "l_orderkey", "l_linenumber", (n % 11).alias("id"), F.when(n % 3 == 0, "TV").when(n % 3 == 1, "person").alias("media_type"), text(2, " a").alias("title"), text(3, "b").alias("name"), F.lit(" ").alias("original_title"), text(5, "d").alias("original_name"))
    return L.recommendations(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber"], F.lit("movie"))


RECOMMENDED = """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS n FROM lineitem),
t AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'a' || n WHEN n % 3 = 0 THEN 'b' || n WHEN n % 5 = 0 THEN 'd' || n END AS title FROM r WHERE n % 11 > 0)
SELECT l_suppkey, n % 11 AS id, CASE WHEN n % 3 = 0 THEN 'series' ELSE 'movie' END AS type, title, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)::INT AS place FROM t WHERE title IS NOT NULL QUALIFY place <= 12"""


def valid_links(spark, d):
    p, k = progress(spark, d), F.col("event_id")
    rows = p.select("event_id", F.when(k % 19 > 0, F.col("stamp")).otherwise(0).alias("cached_at"), F.when(k % 3 > 0, F.concat(F.lit("http://x/"), k.cast("string"))).otherwise(" ").alias("url"), F.when(k % 4 == 0, "hash").alias("info_hash"), F.when(k % 5 == 0, 0).otherwise(864_000_000).alias("age"), F.when(k % 7 == 0, k).alias("raw"), F.when(k % 2 == 0, k * 2).alias("hint"))
    kept = L.valid_links(rows, F.lit(1_705_000_000_000), F.col("age"), F.col("url").endswith("7"))
    return kept.select("event_id", L.stream_size(F.col("raw"), F.col("hint"), F.lit(5)).alias("size"))


LINKS = """SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN event_id END, CASE WHEN event_id % 2 = 0 THEN event_id * 2 END, 5)::BIGINT AS size FROM events
WHERE event_id % 19 > 0 AND event_id % 5 <> 0 AND 1705000000000 - epoch_us(ts) // 1000 <= 864000000 AND (event_id % 3 > 0 OR event_id % 4 = 0) AND NOT (event_id % 3 > 0 AND event_id % 10 = 7)"""


def rated_batches(spark, d):
    """Answers of ten media each, whose ids stand in one of three places; of equal ids the last counts."""
    p, k = progress(spark, d), F.col("event_id")
    media = F.concat(F.lit('{"'), F.when(k % 3 == 0, 'imdb_id":').when(k % 3 == 1, 'imdbid":').otherwise('ids":{"tmdb":5,"imdb":'), F.lit('"tt'), (k % 6).cast("string"), F.lit('"'), F.when(k % 3 == 2, "}").otherwise(""), F.lit(',"ratings":[{"source":"imdb","value":'), F.round(F.col("percent") % 10, 2).cast("string"), F.lit('},{"source":"popcorn","value":"'), (k % 150).cast("string"), F.lit('"}]}'))
    rows = p.select("profile", "event_id", media.alias("m")).groupBy("profile").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "m"))), lambda x: x["m"]), ","), F.lit("]")).alias("payload"))
    return batched_ratings(rows, ["profile"])


RATED = """WITH l AS (SELECT user_id AS profile, event_id, 'tt' || event_id % 6 AS id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 6 ORDER BY event_id DESC) = 1)
SELECT profile, id, 'imdb' AS source, round(value % 10, 2) AS value FROM l UNION ALL SELECT profile, id, 'audience', (event_id % 150)::DOUBLE FROM l WHERE event_id % 150 <= 100"""


def ranked_references(spark, d):
    """Each viewer's reference, a copy of it, one for the hard of hearing and one of another viewer."""
    r, t = tracks(spark, d)
    kinds = F.array(*(F.struct(F.lit(n).alias("track"), F.lit(s).alias("label")) for n, s in (("a", "English SDH"), ("b", None), ("c", "Full"), ("d", "x"))))
    rows = r.select("profile", "start", "end", F.explode(kinds).alias("k")).select("profile", "start", "end", "k.*").filter("track <> 'c' or start % 3 > 0")
    rows = rows.withColumn("start", F.when(F.col("track") == "d", affine(F.col("start"), 1.3, 777.0)).otherwise(F.col("start"))).withColumn("end", F.greatest(F.col("end"), F.col("start") + 200))
    labels = rows.select("profile", "track", "label", F.lit(False).alias("sound")).distinct()
    out = L.ranked_references(rows, labels, t, "profile", (F.col("profile") % 5 == 0) & (F.col("track") == "c"))
    return out.select("profile", "track", "sdh", F.round("affinity", 9).alias("affinity"), F.round("suitability", 9).alias("suitability"), "place")


QUERIES = {
    "signatures": (signatures, SIGNATURES),
    "flat_catalogs": (flat_catalogs, FLAT),
    "source_overview": (source_overview, OVERVIEW),
    "eligible_releases": (eligible_releases, RELEASES),
    "collection_parts": (collection_parts, PARTS),
    "recommended": (recommended, RECOMMENDED),
    "valid_links": (valid_links, LINKS),
    "rated_batches": (rated_batches, RATED),
    "ranked_references": (ranked_references, None),
}
