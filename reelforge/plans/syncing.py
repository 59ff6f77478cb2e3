"""Queries: paged sources, catching up with a log, stored state, receipts and aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.operators import identity as Y
from reelforge.operators import receipts as R
from reelforge.operators.merge import apply_change_log
from reelforge.plans.merging import PROGRESS
from reelforge.plans.tables import progress, table
from reelforge.sources import paged
from reelforge.streaming import stored


def paged_rows(spark, d):
    """All customers by pages of 500."""
    path, columns = f"{d}/customer.parquet", ["c_custkey", "c_nationkey"]

    def fetch(limit, offset):
        import pyarrow.dataset as ds

        t = ds.dataset(path).to_table(columns=columns).slice(offset, limit)
        return list(zip(*(t[c].to_pylist() for c in columns), strict=True))

    total = table(spark, d, "customer").count()
    source = paged.offset_pages("customer_pages", "c_custkey long, c_nationkey int", fetch, total=lambda: total)
    return spark.read.format(paged.registered(spark, source)).load()


PAGED = "SELECT c_custkey, c_nationkey FROM customer"


def _events(df):
    return df.select(
        (F.col("user_id") * 10 + F.col("event_id") % 7).alias("k"), F.col("value"), F.col("event_id"), F.when(F.col("event_id") % 4 == 1, "delete").otherwise("upsert").alias("operation"),
    )


def caught_up_log(spark, d):
    """The cursor is read at two fifths of the log, the snapshot is taken a little later, and the rest comes by pages."""
    fetch, newest = paged.parquet_log(f"{d}/events.parquet", ["event_id", "user_id", "value"], "event_id")
    source = paged.change_log("event_log", "event_id long, user_id long, value double", fetch, newest, page=5000, parts=4)
    log = _events(table(spark, d, "events"))
    cursor = newest() * 2 // 5
    none = log.limit(0).select("k", "value", "event_id")
    snapshot = apply_change_log(none, log.filter(F.col("event_id") <= cursor + 50), ["k"])
    return paged.caught_up(spark, source, cursor, snapshot, ["k"], _events)


CAUGHT_UP = """WITH e AS (SELECT user_id * 10 + event_id % 7 AS k, value, event_id FROM events), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
SELECT k, value, event_id FROM l WHERE event_id % 4 <> 1"""


def _payloads(spark, d):
    """Each viewer's events as a stored payload of an older form: some entries without key, some without completion."""
    p, e = progress(spark, d), F.col("event_id")
    entry = F.struct(
        F.col("title").alias("id"), F.when(e % 3 > 0, (e % 4).cast("int")).alias("season"), F.when(e % 3 > 0, (e % 5).cast("int")).alias("episode"), F.when(e % 7 == 0, F.concat(F.lit("k"), (e % 6).cast("string"))).when(e % 7 == 1, F.lit(" ")).alias("progress_key"),
        (e % 11 * 100 - 100).cast("long").alias("position"), F.when(e % 2 == 0, F.lit(1000).cast("long")).alias("duration"), F.when(e % 5 > 0, F.col("percent")).alias("percent"), F.when(e % 13 == 0, True).alias("complete"), (e % 50).cast("long").alias("updated"),
    )
    listed = p.groupBy("profile").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    text = F.to_json(F.struct("entries", F.lit(7).cast("long").alias("cursor"), F.array(F.lit("k1"), F.lit("view"), F.lit("gone")).alias("dirty")))
    return listed.select("profile", F.when(F.col("profile") % 10 == 9, F.lit("{broken")).otherwise(text).alias("payload"))


def stored_entries(spark, d):
    entries, _ = stored.decoded(_payloads(spark, d), "profile", "payload")
    return entries.select("profile", "progress_key", "id", "position", "duration", F.round("percent", 6).alias("percent"), "complete", "updated")


_STORED = PROGRESS + """, r AS (SELECT profile, event_id, title AS id, CASE WHEN event_id % 3 > 0 THEN event_id % 4 END AS season, CASE WHEN event_id % 3 > 0 THEN event_id % 5 END AS episode, CASE WHEN event_id % 7 = 0 THEN 'k' || event_id % 6 END AS own,
  event_id % 11 * 100 - 100 AS pos, CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 0 END AS duration, CASE WHEN event_id % 5 > 0 THEN greatest(0, least(100, percent)) END AS pct, event_id % 13 = 0 AS flag, event_id % 50 AS updated FROM p WHERE profile % 10 <> 9),
n AS (SELECT *, coalesce(own, CASE WHEN season IS NOT NULL THEN id || '_s' || season || 'e' || episode ELSE id END) AS progress_key, greatest(pos, 0) AS position, flag OR coalesce(pct >= 90, false) OR (duration > 0 AND greatest(pos, 0) / duration::DOUBLE >= 0.9::DOUBLE) AS complete FROM r),
m AS (SELECT *, coalesce(pct, CASE WHEN complete AND duration <= 0 THEN 100 END) AS percent FROM n),
w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY profile, progress_key ORDER BY updated DESC, position DESC, duration DESC, id DESC, coalesce(season, -1) DESC, coalesce(episode, -1) DESC, complete DESC, coalesce(percent, -1) DESC, event_id) = 1)"""
STORED = _STORED + " SELECT profile, progress_key, id, position::BIGINT AS position, duration::BIGINT AS duration, round(percent, 6) AS percent, complete, updated::BIGINT AS updated FROM w"


def stored_cursors(spark, d):
    """What is kept beside the entries, after a payload was written and read again."""
    payloads = _payloads(spark, d)
    again = stored.encoded(*stored.decoded(payloads, "profile", "payload"), "profile")
    _, meta = stored.decoded(again, "profile", "payload")
    return meta.select("profile", "pushed", "cursor", "initialized", F.array_join("dirty", ",").alias("dirty"))


CURSORS = _STORED + """, a AS (SELECT DISTINCT user_id AS profile FROM events), k AS (SELECT profile, string_agg(progress_key, ',' ORDER BY progress_key) AS d FROM w WHERE progress_key IN ('k1', 'view', 'gone') GROUP BY profile)
SELECT profile, 0::BIGINT AS pushed, CASE WHEN profile % 10 = 9 THEN 0 ELSE 7 END::BIGINT AS cursor, false AS initialized, coalesce(d, '') AS dirty FROM a LEFT JOIN k USING (profile)"""


def _entries(spark, d):
    """Customers as entries of nations' libraries; shows have two seasons of three episodes, some watched."""
    k = F.col("c_custkey")
    episode = lambda s, n: F.struct(F.lit(n).alias("number"), F.when((k + s + n) % 3 == 0, F.concat(F.lit("2001-0"), ((k + n) % 9 + 1).cast("string"))).alias("watched_at"), F.lit(None).cast("int").alias("tvdb_season"), F.lit(None).cast("int").alias("tvdb_number"))
    seasons = F.array(*(F.struct(F.lit(s).alias("number"), F.array(*(episode(s, n) for n in (1, 2, 3))).alias("episodes")) for s in (1, 2)))
    show = k % 3 > 0
    count = sum((((k + s + n) % 3 == 0).cast("int") for s in (1, 2) for n in (1, 2, 3)), F.lit(0))
    return table(spark, d, "customer").select(
        F.col("c_nationkey").alias("profile"), k.alias("ord"), F.when(~show, "movie").when(k % 3 == 1, "show").otherwise("anime").alias("kind"), F.when(k % 5 > 0, "hold").alias("status"), F.when(show, seasons).alias("seasons"),
        F.when(show & (count > 0), F.lit("2001-09")).alias("last_watched"), F.when(show, count).otherwise(0).alias("watched"), F.when(k % 7 == 0, "1999-01").alias("added"), *_media(k), F.lit(None).cast("int").alias("year"),
    )


def _media(k):
    return F.when(k % 4 == 0, k).alias("simkl"), F.when(k % 4 < 2, k * 3).alias("tmdb"), F.concat(F.lit("T"), k.cast("string")).alias("title")


def library_receipts(spark, d):
    """Each order as a receipt for its customer's entry; those of every eleventh customer name media nobody has."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("profile"))
    o, k, n = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("c_custkey"), F.col("o_orderkey")
    show = k % 3 > 0
    op = F.when(n % 5 == 0, "list").when(show & (n % 5 == 1), "unwatch").otherwise("watch")
    m = F.when(k % 11 == 0, k + 10_000_000).otherwise(k)
    receipts = o.select(
        "profile", n.alias("seq"), op.alias("op"), F.when(~show, "movie").when(k % 3 == 1, "show").otherwise("anime").alias("kind"), F.when(op == "list", F.concat(F.lit("s"), (n % 3).cast("string"))).alias("status"),
        F.when(show & (n % 2 == 0), (n % 3 + 1).cast("int")).alias("season"), F.when(show, (n % 4 + 1).cast("int")).alias("number"), F.lit(None).cast("int").alias("tvdb_season"), F.lit(None).cast("int").alias("tvdb_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), *_media(m), F.lit(None).cast("int").alias("year"),
    )
    out = R.with_receipts(_entries(spark, d), receipts, ["profile"], ["simkl", "tmdb"])
    flat = F.flatten(F.transform("seasons", lambda s: F.transform(s["episodes"], lambda x: F.concat_ws("", s["number"].cast("string"), F.lit("."), x["number"].cast("string"), F.lit("@"), F.coalesce(x["watched_at"], F.lit("-"))))))
    return out.select("profile", "ord", "media", "kind", "status", "last_watched", "watched", "added", F.array_join(F.array_sort(flat), ",").alias("episodes"))


RECEIPTS = """WITH en AS (SELECT c_nationkey AS profile, c_custkey AS ord, c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN 'hold' END AS status, CASE WHEN c_custkey % 7 = 0 THEN '1999-01' END AS added FROM customer),
rc AS (SELECT c_nationkey AS profile, c_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'list' WHEN c_custkey % 3 > 0 AND o_orderkey % 5 = 1 THEN 'unwatch' ELSE 'watch' END AS op, CASE WHEN o_orderkey % 5 = 0 THEN 's' || o_orderkey % 3 END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 + 1 ELSE 1 END AS season, o_orderkey % 4 + 1 AS number, strftime(o_orderdate, '%Y-%m-%d') AS w FROM orders JOIN customer ON o_custkey = c_custkey),
bs AS (SELECT profile, ord AS k, s, n, CASE WHEN (ord + s + n) % 3 = 0 THEN '2001-0' || (ord + n) % 9 + 1 END AS w, -1 AS seq, 'base' AS op FROM en, (SELECT unnest([1, 2]) AS s), (SELECT unnest([1, 2, 3]) AS n) WHERE ord % 3 > 0),
al AS (SELECT profile, k, false AS new, s, n, w, seq, op FROM bs UNION ALL SELECT profile, k, k % 11 = 0, season, number, CASE WHEN op = 'watch' THEN w END, seq, op FROM rc WHERE op <> 'list' AND k % 3 > 0),
ep AS (SELECT profile, k, new, s, n, max_by(w_, seq) AS w FROM (SELECT *, coalesce(w, '-') AS w_, bool_or(op IN ('base', 'watch')) OVER (PARTITION BY profile, k, new, s, n ORDER BY seq) AS there FROM al) WHERE there GROUP BY ALL),
ee AS (SELECT profile, k, new, string_agg(s || '.' || n || '@' || w, ',' ORDER BY s || '.' || n || '@' || w) AS episodes, count(*) FILTER (w <> '-') AS watched, max(w) FILTER (w <> '-') AS latest FROM ep GROUP BY ALL),
ids AS (SELECT profile, k, false AS new, status, added FROM en UNION ALL SELECT DISTINCT profile, k, true, NULL, NULL FROM rc WHERE k % 11 = 0 AND op <> 'unwatch'),
rr AS (SELECT *, k % 11 = 0 AS new FROM rc),
ev AS (SELECT i.profile, i.k, i.new, any_value(i.status) AS base, any_value(i.added) AS added, max_by(r.status, r.seq) FILTER (r.op = 'list') AS listed, max_by(r.op, r.seq) AS last_op, max_by(r.op, r.seq) FILTER (r.op <> 'list') AS last_seen, max_by(r.w, r.seq) FILTER (r.op = 'watch') AS watched_at,
  min_by(r.w, r.seq) FILTER (r.op = 'list') AS first_list, count(r.seq) FILTER (r.op = 'watch') AS watches FROM ids i LEFT JOIN rr r ON r.profile = i.profile AND r.k = i.k AND r.new = i.new GROUP BY i.profile, i.k, i.new)
SELECT v.profile, CASE WHEN NOT v.new THEN v.k END AS ord, CASE WHEN v.new THEN CASE WHEN (v.k + 10000000) % 4 = 0 THEN 'simkl:' || v.k + 10000000 WHEN (v.k + 10000000) % 4 < 2 THEN 'tmdb:' || (v.k + 10000000) * 3 ELSE 'title:t' || v.k + 10000000 END END AS media,
  CASE v.k % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'show' ELSE 'anime' END AS kind,
  CASE WHEN v.k % 3 = 0 THEN CASE WHEN last_op = 'watch' THEN 'completed' ELSE coalesce(listed, base) END ELSE coalesce(listed, base, CASE WHEN watches > 0 THEN 'watching' END) END AS status,
  CASE WHEN v.k % 3 = 0 THEN watched_at WHEN last_seen = 'watch' THEN watched_at WHEN last_seen = 'unwatch' THEN latest WHEN watched > 0 THEN '2001-09' END AS last_watched,
  coalesce(watched, 0)::INT AS watched, coalesce(v.added, first_list) AS added, coalesce(episodes, '') AS episodes FROM ev v LEFT JOIN ee e ON e.profile = v.profile AND e.k = v.k AND e.new = v.new"""


def alternate_keys(spark, d):
    k = F.col("c_custkey")
    e = _entries(spark, d).drop("simkl", "tmdb").join(table(spark, d, "customer").select(k.alias("ord"), F.when(k % 4 > 0, F.concat(F.lit("tt"), k.cast("string"))).alias("imdb"), F.when(k % 3 < 2, k).alias("tmdb"), F.when(k % 5 < 3, k % 100).alias("mal")), "ord")
    e = e.withColumn("status", F.when(F.col("ord") % 2 == 0, "completed").otherwise(F.col("status"))).withColumn("anime_kind", F.when(F.col("ord") % 9 == 2, "movie"))
    return Y.alternate_keys(e, ["imdb", "tmdb", "mal"])


ALTERNATE = """WITH e AS (SELECT c_custkey AS k, c_custkey % 3 AS t, CASE WHEN c_custkey % 4 > 0 THEN 'tt' || c_custkey END AS imdb, CASE WHEN c_custkey % 3 < 2 THEN 'tmdb:' || c_custkey END AS tmdb, CASE WHEN c_custkey % 5 < 3 THEN 'mal:' || c_custkey % 100 END AS mal FROM customer),
i AS (SELECT k, t = 0 OR (t = 2 AND k % 9 = 2) AS film, t, unnest(list_filter([imdb, tmdb, mal], lambda x: x IS NOT NULL)[2:]) AS id FROM e)
SELECT DISTINCT key FROM (
  SELECT 'movie:' || id || ':-1:-1' AS key FROM i WHERE film AND (k % 2 = 0 OR (t = 2 AND ((k + 2) % 3 = 0 OR (k + 3) % 3 = 0 OR (k + 4) % 3 = 0 OR (k + 5) % 3 = 0)))
  UNION ALL SELECT 'series:' || id || ':-1:-1' FROM i WHERE t = 2 AND NOT film AND k % 2 = 0
  UNION ALL SELECT 'series:' || id || ':' || s || ':' || n FROM i, (SELECT unnest([1, 2]) AS s), (SELECT unnest([1, 2, 3]) AS n) WHERE t = 2 AND NOT film AND (k + s + n) % 3 = 0)"""


QUERIES = {
    "paged_rows": (paged_rows, PAGED),
    "caught_up_log": (caught_up_log, CAUGHT_UP),
    "stored_entries": (stored_entries, STORED),
    "stored_cursors": (stored_cursors, CURSORS),
    "library_receipts": (library_receipts, RECEIPTS),
    "alternate_keys": (alternate_keys, ALTERNATE),
}
