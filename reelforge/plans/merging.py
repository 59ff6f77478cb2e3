"""Queries: progress, merges and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import progress as P
from reelforge.operators import merge as M
from reelforge.operators.order import chunked, distinct_until_changed, first_by, last_by, pinned_first, ranked, round_robin, take_while, top_per_key
from reelforge.plans.tables import progress, table

PROGRESS = "WITH p AS (SELECT event_id, user_id AS profile, event_type AS title, epoch_us(ts) // 1000 AS stamp, value AS percent FROM events)"
SPLIT = "1995-06-01"


def continue_watching(spark, d):
    newest = last_by(progress(spark, d), ["profile", "title"], ["stamp", "event_id"])
    open_ = newest.filter(~P.completion(F.lit(False), F.col("percent"), F.lit(0), F.lit(0)))
    return ranked(open_, ["profile"], [F.desc("stamp"), F.desc("event_id")], "place").filter("place <= 20").select("profile", "place", "title", "stamp", "percent", "event_id")


CONTINUE_WATCHING = PROGRESS + """, n AS (SELECT *, row_number() OVER (PARTITION BY profile, title ORDER BY stamp DESC, event_id DESC) AS r FROM p),
o AS (SELECT profile, title, stamp, percent, event_id, row_number() OVER (PARTITION BY profile ORDER BY stamp DESC, event_id DESC) AS place FROM n WHERE r = 1 AND percent < 90)
SELECT profile, place, title, stamp, percent, event_id FROM o WHERE place <= 20"""


def newest_by_key(spark, d):
    return last_by(progress(spark, d), ["profile", "title"], ["stamp", "percent", "event_id"])


NEWEST_BY_KEY = PROGRESS + " SELECT event_id, profile, title, stamp, percent FROM p QUALIFY row_number() OVER (PARTITION BY profile, title ORDER BY stamp DESC, percent DESC, event_id DESC) = 1"


def resume_point(spark, d):
    newest = last_by(progress(spark, d), ["profile"], ["stamp", "event_id"])
    duration = F.lit(5_400_000).cast("long")
    return newest.filter("percent < 90").select("profile", "title", P.resume_position(F.lit(0).cast("long"), F.col("percent"), duration).alias("position"))


RESUME_POINT = PROGRESS + ", n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY profile ORDER BY stamp DESC, event_id DESC) = 1) SELECT profile, title, CASE WHEN percent > 0 THEN floor(5400000 * greatest(0.0, least(100.0, percent)) / 100)::BIGINT ELSE 0 END AS position FROM n WHERE percent < 90"


def completion_states(spark, d):
    p = progress(spark, d)
    position, duration = F.floor(F.col("percent") * 1000).cast("long"), ((F.col("event_id") % 300) * 1000).cast("long")
    ended = F.col("event_id") % 7 == 0
    return p.select(
        "event_id",
        P.should_store(position).alias("stored"),
        P.is_short(duration).alias("short"),
        F.coalesce(P.is_complete(position, duration, ended), F.lit(False)).alias("complete"),
        P.completion(ended & F.lit(False), F.col("percent"), position, duration).alias("done"),
        P.specials_last((F.col("event_id") % 5).cast("int")).alias("season_key"),
    )


COMPLETION_STATES = PROGRESS + """, q AS (SELECT *, floor(percent * 1000)::BIGINT AS position, (event_id % 300) * 1000 AS duration, event_id % 7 = 0 AS ended FROM p)
SELECT event_id, position >= 1000 AS stored, duration BETWEEN 1 AND 120999 AS short,
 CASE WHEN ended THEN NOT (duration BETWEEN 1 AND 120999) WHEN duration <= 0 THEN false ELSE position / duration::DOUBLE >= 0.9 END AS complete,
 least(percent, 100) >= 90 OR (duration > 0 AND position / nullif(duration, 0)::DOUBLE >= 0.9) AS done,
 CASE WHEN event_id % 5 = 0 THEN 2147483647 ELSE (event_id % 5)::INT END AS season_key FROM q"""


def surface_next(spark, d):
    p = progress(spark, d)
    days = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 31 - 15).cast("int"))
    aired, available = days <= 0, F.col("event_id") % 3 != 0
    w, c = (F.col("event_id") % 4).cast("int"), (F.col("event_id") % 5 - 1).cast("int")
    return p.select("event_id", *(P.should_surface(w, c, aired, days, available, x).alias(n) for n, x in (("shown", True), ("strict", False))))


SURFACE_NEXT = PROGRESS + """, q AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id % 31 - 15 END AS days, event_id % 3 <> 0 AS ok, greatest(event_id % 4, 0) AS w, greatest(event_id % 5 - 1, 0) AS c FROM p)
SELECT event_id,
 CASE WHEN NOT ok THEN CASE WHEN days IS NULL THEN false WHEN days <= 0 THEN true ELSE c = w OR days <= 7 END WHEN c = w THEN true ELSE coalesce(days <= 0, false) OR coalesce(days BETWEEN 0 AND 7, false) END AS shown,
 CASE WHEN NOT ok THEN coalesce(days <= 0, false) WHEN c = w THEN coalesce(days <= 0, true) ELSE coalesce(days <= 0, false) END AS strict FROM q"""


def latest_completed(spark, d):
    p = progress(spark, d)
    done = p.filter("percent >= 90").select("profile", "title", F.col("stamp"), F.lit("progress").alias("kind"), "event_id")
    marked = p.filter("title = 'purchase'").select("profile", "title", "stamp", F.lit("watched").alias("kind"), "event_id")
    both = done.unionByName(marked)
    far = last_by(both, ["profile"], ["title", "stamp", "kind"]).select("profile", F.col("title").alias("furthest"), F.col("stamp").alias("furthest_stamp"))
    new = last_by(both, ["profile"], ["stamp", "title", "kind"]).select("profile", F.col("title").alias("recent"), F.col("stamp").alias("recent_stamp"))
    return far.join(new, "profile")


LATEST_COMPLETED = PROGRESS + """, b AS (SELECT profile, title, stamp FROM p WHERE percent >= 90 UNION ALL SELECT profile, title, stamp FROM p WHERE title = 'purchase')
SELECT profile, max({'t': title, 's': stamp}).t AS furthest, max({'t': title, 's': stamp}).s AS furthest_stamp, max({'s': stamp, 't': title}).t AS recent, max({'s': stamp, 't': title}).s AS recent_stamp FROM b GROUP BY profile"""


def _pages(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return o.filter(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp_ntz")), o.filter(F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp_ntz"))


ORDER_COLS = "o_orderkey, o_custkey, o_totalprice, o_orderdate"
PAGES = f"WITH a AS (SELECT {ORDER_COLS} FROM orders WHERE o_orderdate < '{SPLIT}'), b AS (SELECT {ORDER_COLS} FROM orders WHERE o_orderdate >= '{SPLIT}')"


def merge_pages_first_wins(spark, d):
    a, b = _pages(spark, d)
    return M.append_first_wins(a, b, ["o_custkey"], ["o_orderkey"])


MERGE_PAGES = PAGES + f", u AS (SELECT 0 AS s, * FROM a UNION ALL SELECT 1, * FROM b) SELECT {ORDER_COLS} FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) = 1"


def upsert_delta(spark, d):
    a, b = _pages(spark, d)
    return M.upsert(a, b, ["o_custkey"], ["o_orderdate", "o_orderkey"])


UPSERT_DELTA = PAGES + f", u AS (SELECT 0 AS s, * FROM a UNION ALL SELECT 1, * FROM b) SELECT {ORDER_COLS} FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderdate DESC, o_orderkey DESC) = 1"


def keep_newer_held(spark, d):
    a, b = (last_by(x, ["o_custkey"], ["o_totalprice", "o_orderkey"]) for x in _pages(spark, d))
    return M.fetched_or_newer_held(a, b, ["o_custkey"], "o_totalprice")


KEEP_NEWER_HELD = PAGES + """, f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1),
h AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1)
SELECT f.o_custkey, CASE WHEN h.o_totalprice > f.o_totalprice THEN h.o_orderkey ELSE f.o_orderkey END AS o_orderkey, CASE WHEN h.o_totalprice > f.o_totalprice THEN h.o_totalprice ELSE f.o_totalprice END AS o_totalprice,
CASE WHEN h.o_totalprice > f.o_totalprice THEN h.o_orderdate ELSE f.o_orderdate END AS o_orderdate FROM f LEFT JOIN h USING (o_custkey)"""


def authoritative_removal(spark, d):
    a, b = _pages(spark, d)
    return M.keep_listed(a, b, ["o_custkey"])


AUTHORITATIVE_REMOVAL = PAGES + f" SELECT {ORDER_COLS} FROM a WHERE o_custkey IN (SELECT o_custkey FROM b)"


def _log(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type").isin("signup", "purchase"), "upsert").when(F.col("event_type") == "error", "delete").otherwise(F.col("event_type"))
    return e.select("event_id", F.col("user_id").alias("k"), op.alias("operation"), F.col("value"))


LOG = "WITH e AS (SELECT event_id, user_id AS k, CASE WHEN event_type IN ('signup', 'purchase') THEN 'upsert' WHEN event_type = 'error' THEN 'delete' ELSE event_type END AS operation, value FROM events), cur AS (SELECT k, value, event_id FROM e WHERE event_id < 1000 QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id) = 1), ev AS (SELECT * FROM e WHERE event_id >= 1000), last AS (SELECT * FROM ev WHERE operation IN ('upsert', 'delete') QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)"


def _current(spark, d):
    log = _log(spark, d)
    return first_by(log.filter("event_id < 1000"), ["k"], ["event_id"]).select("k", "value", "event_id"), log.filter("event_id >= 1000")


def apply_change_log(spark, d):
    cur, ev = _current(spark, d)
    return M.apply_change_log(cur, ev, ["k"], pending=cur.filter("k % 10 = 3"))


APPLY_CHANGE_LOG = LOG + ", pend AS (SELECT k FROM cur WHERE k % 10 = 3), l AS (SELECT * FROM last WHERE k NOT IN (SELECT k FROM pend)) SELECT k, value, event_id FROM cur WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT k, value, event_id FROM l WHERE operation = 'upsert'"


def change_log_cursor(spark, d):
    return M.cursor_after(_log(spark, d), 17)


CHANGE_LOG_CURSOR = "SELECT greatest(17::BIGINT, max(event_id)) AS cursor FROM events"


def delta_decisions(spark, d):
    cur, ev = _current(spark, d)
    cur = cur.withColumn("dirty", F.col("k") % 3 == 0)
    out = M.delta_decisions(cur, ev, ["k"], "dirty", F.col("local.value") > F.col("event.value"), F.col("local.value") == F.col("event.value"))
    return out.select("k", F.col("event.event_id").alias("event_id"), "decision")


DELTA_DECISIONS = LOG + """ SELECT l.k, l.event_id, CASE WHEN l.operation = 'upsert' THEN CASE WHEN c.k IS NULL THEN 'UPSERT' WHEN c.k % 3 = 0 AND c.value > l.value THEN 'PRESERVE_LOCAL' WHEN c.value = l.value THEN 'IGNORE' ELSE 'UPSERT' END
ELSE CASE WHEN c.k IS NULL THEN 'IGNORE' WHEN c.k % 3 = 0 THEN 'PRESERVE_LOCAL' ELSE 'DELETE' END END AS decision FROM last l LEFT JOIN cur c USING (k)"""


def snapshot_overlay(spark, d):
    cur, ev = _current(spark, d)
    server = last_by(ev, ["k"], ["event_id"]).select("k", "value", "event_id")
    return M.overlay_pending(server, cur, cur.filter("k % 4 = 0"), cur.filter("k % 4 = 1"), ["k"])


SNAPSHOT_OVERLAY = LOG + ", s AS (SELECT k, value, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1) SELECT k, value, event_id FROM s WHERE k NOT IN (SELECT k FROM cur WHERE k % 4 IN (0, 1)) UNION ALL SELECT k, value, event_id FROM cur WHERE k % 4 = 0"


def snapshot_preserving_unsynced(spark, d):
    log = _log(spark, d)
    server = log.filter("event_id % 2 = 0").select("k", "value", "event_id")
    local = log.filter("event_id % 2 = 1").select("k", "value", "event_id").withColumn("dirty", F.col("k") % 2 == 0)
    return M.snapshot_preserving(server, local, ["k"], ["value", "event_id"], "dirty")


SNAPSHOT_PRESERVING = "WITH u AS (SELECT user_id AS k, value, event_id, 0 AS s FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, value, event_id, 1 FROM events WHERE event_id % 2 = 1 AND user_id % 2 = 0) SELECT k, value, event_id FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY value DESC, event_id DESC, s) = 1"


def unacknowledged_keys(spark, d):
    log = _log(spark, d)
    dirty = last_by(log, ["k"], ["event_id"]).select("k", "event_id")
    return M.acknowledged(dirty, log.filter("operation = 'upsert'"), ["k"], "event_id")


UNACKNOWLEDGED = LOG + ", d AS (SELECT k, max(event_id) AS event_id FROM e GROUP BY k), p AS (SELECT k, max(event_id) AS x FROM e WHERE operation = 'upsert' GROUP BY k) SELECT d.k, d.event_id FROM d LEFT JOIN p USING (k) WHERE x IS NULL OR event_id > x"


def unique_key_migration(spark, d):
    o = table(spark, d, "orders")
    server = o.filter("o_orderkey % 5 = 0").select("o_custkey", "o_orderkey")
    return M.migrated_keys(o.filter("o_orderkey % 5 <> 0").select("o_custkey", "o_orderkey"), server, ["o_custkey"], "o_orderkey")


UNIQUE_KEY_MIGRATION = "WITH s AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) = 1) SELECT o.o_custkey, o_orderkey, coalesce(k, o_orderkey) AS new_key FROM orders o LEFT JOIN s USING (o_custkey) WHERE o_orderkey % 5 <> 0"


def unambiguous_lookup(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return M.unambiguous(li, ["l_orderkey", "l_linenumber"], ["l_suppkey"], ["l_quantity", "l_partkey"])


UNAMBIGUOUS_LOOKUP = "WITH l AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem) SELECT * FROM l QUALIFY min(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber) = max(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber) AND row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey DESC, l_suppkey DESC) = 1"


def superseded_playback(spark, d):
    p = progress(spark, d)
    play = p.filter("title = 'view'").select("profile", "stamp", "event_id", (F.col("event_id") % 3).alias("episode"))
    seen = p.filter("title = 'purchase'").select("profile", "stamp", (F.col("event_id") % 3).alias("episode"))
    return M.superseded(play, seen, ["profile", "episode"], p.filter("percent > 480").select("profile"), ["profile"])


SUPERSEDED_PLAYBACK = PROGRESS + ", w AS (SELECT profile, event_id % 3 AS episode, max(stamp) AS x FROM p WHERE title = 'purchase' GROUP BY 1, 2) SELECT q.profile, q.stamp, q.event_id, q.event_id % 3 AS episode FROM p q LEFT JOIN w ON w.profile = q.profile AND w.episode = q.event_id % 3 WHERE q.title = 'view' AND (x IS NULL OR x < q.stamp) AND q.profile NOT IN (SELECT profile FROM p WHERE percent > 480)"


def first_non_null_merge(spark, d):
    c = table(spark, d, "customer")
    rows = c.select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return M.first_non_null(rows, ["c_nationkey"], ["c_custkey"], ["name", "segment"])


FIRST_NON_NULL = "SELECT c_nationkey, arg_min(c_name, c_custkey) FILTER (c_acctbal > 5000) AS name, arg_min(c_mktsegment, c_custkey) FILTER (c_mktsegment = 'BUILDING') AS segment FROM customer GROUP BY c_nationkey"


def last_n_per_key(spark, d):
    return top_per_key(progress(spark, d), ["profile"], [F.desc("stamp"), F.desc("event_id")], 6).select("profile", "event_id", "stamp")


LAST_N = PROGRESS + " SELECT profile, event_id, stamp FROM p QUALIFY row_number() OVER (PARTITION BY profile ORDER BY stamp DESC, event_id DESC) <= 6"


def leading_run(spark, d):
    return take_while(progress(spark, d), ["profile"], ["stamp", "event_id"], F.col("percent") < 300).select("profile", "event_id")


LEADING_RUN = PROGRESS + ", q AS (SELECT *, min(CASE WHEN percent < 300 THEN 1 ELSE 0 END) OVER (PARTITION BY profile ORDER BY stamp, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM p) SELECT profile, event_id FROM q WHERE ok = 1"


def mutation_batches(spark, d):
    return chunked(progress(spark, d), ["title"], ["stamp", "event_id"], 500).select("title", "event_id", "chunk")


MUTATION_BATCHES = PROGRESS + " SELECT title, event_id, ((row_number() OVER (PARTITION BY title ORDER BY stamp, event_id) - 1) // 500)::BIGINT AS chunk FROM p"


def changed_states(spark, d):
    return distinct_until_changed(progress(spark, d), ["profile"], ["stamp", "event_id"], "title").select("profile", "event_id", "title")


CHANGED_STATES = PROGRESS + ", q AS (SELECT *, lag(title) OVER w AS was, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY profile ORDER BY stamp, event_id)) SELECT profile, event_id, title FROM q WHERE r = 1 OR title IS DISTINCT FROM was"


def hero_round_robin(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    return round_robin(p, "p_brand", ["p_partkey"], 48).select("p_brand", "p_partkey", "place")


HERO_ROUND_ROBIN = "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part), n AS (SELECT r, sum(count(*)) OVER (ORDER BY r) - count(*) AS b FROM r GROUP BY r) SELECT p_brand, p_partkey, (b + row_number() OVER (PARTITION BY r.r ORDER BY p_brand))::BIGINT AS place FROM r JOIN n USING (r) WHERE b < 48"


def pinned_order(spark, d):
    s = table(spark, d, "supplier").withColumn("pinned", F.col("s_acctbal") > 8000)
    return pinned_first(s, ["s_nationkey"], "pinned", ["s_name", "s_suppkey"]).select("s_nationkey", "s_suppkey", "pinned", "place")


PINNED_ORDER = "SELECT s_nationkey, s_suppkey, s_acctbal > 8000 AS pinned, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal > 8000 DESC, s_name, s_suppkey) - 1)::INT AS place FROM supplier"


QUERIES = {
    "continue_watching": (continue_watching, CONTINUE_WATCHING),
    "newest_by_key": (newest_by_key, NEWEST_BY_KEY),
    "resume_point": (resume_point, RESUME_POINT),
    "completion_states": (completion_states, COMPLETION_STATES),
    "surface_next": (surface_next, SURFACE_NEXT),
    "latest_completed": (latest_completed, LATEST_COMPLETED),
    "merge_pages_first_wins": (merge_pages_first_wins, MERGE_PAGES),
    "upsert_delta": (upsert_delta, UPSERT_DELTA),
    "keep_newer_held": (keep_newer_held, KEEP_NEWER_HELD),
    "authoritative_removal": (authoritative_removal, AUTHORITATIVE_REMOVAL),
    "apply_change_log": (apply_change_log, APPLY_CHANGE_LOG),
    "change_log_cursor": (change_log_cursor, CHANGE_LOG_CURSOR),
    "delta_decisions": (delta_decisions, DELTA_DECISIONS),
    "snapshot_overlay": (snapshot_overlay, SNAPSHOT_OVERLAY),
    "snapshot_preserving_unsynced": (snapshot_preserving_unsynced, SNAPSHOT_PRESERVING),
    "unacknowledged_keys": (unacknowledged_keys, UNACKNOWLEDGED),
    "unique_key_migration": (unique_key_migration, UNIQUE_KEY_MIGRATION),
    "unambiguous_lookup": (unambiguous_lookup, UNAMBIGUOUS_LOOKUP),
    "superseded_playback": (superseded_playback, SUPERSEDED_PLAYBACK),
    "first_non_null_merge": (first_non_null_merge, FIRST_NON_NULL),
    "last_n_per_key": (last_n_per_key, LAST_N),
    "leading_run": (leading_run, LEADING_RUN),
    "mutation_batches": (mutation_batches, MUTATION_BATCHES),
    "changed_states": (changed_states, CHANGED_STATES),
    "hero_round_robin": (hero_round_robin, HERO_ROUND_ROBIN),
    "pinned_order": (pinned_order, PINNED_ORDER),
}
