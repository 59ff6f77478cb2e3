"""Queries: preview grids, sections to show, tracks by language, trailers, journals, keys of upserts, fits of timelines.

Inputs are made of the test tables by expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import grid as G
from reelforge.operators import choice as C
from reelforge.operators import fits as A
from reelforge.operators import journal as J
from reelforge.plans.tables import table

INPUTS = {
    "cues": ("events", [
        "event_id", "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id % 100 * 1000 - 1500 AS BIGINT) END AS a",
        "CAST(event_id % 100 * 1000 - 1500 + CASE WHEN event_id % 17 = 0 THEN 0 ELSE 5001 + event_id % 3 * 1000 END AS BIGINT) AS b",
        "CAST(event_id % 100 * 1000 + event_id * 37 % 9000 - 5000 AS BIGINT) AS pos", "CAST((event_id % 7 - 3) * 4000 AS BIGINT) AS delta", "CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 95000 END AS BIGINT) AS duration"]),
    "shows": ("events", [
        "event_id", "event_id % 5 <> 0 AS anime", "CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 4 END AS INT) AS season", "CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 11 END AS INT) AS number",
        "CASE WHEN event_id % 2 = 0 THEN concat('m', event_id % 50) END AS mal", "concat('tt', event_id % 70) AS imdb",
        """CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('mal:', event_id % 90, ':', event_id % 12) WHEN 2 THEN 'kitsu:77' WHEN 3 THEN 'tt123:1:2'
        WHEN 4 THEN 'ANIDB:5:x' WHEN 5 THEN ' Anilist:9:3 ' ELSE 'mal:x:4' END AS video"""]),
    "definitions": ("part", ["p_partkey % 40 AS profile", "concat('c', p_partkey) AS name", "concat('k', p_partkey % 30) AS cache", "p_name AS title", "p_partkey AS ord"]),
    "settings": ("part", [
        "p_partkey % 40 AS profile", "concat('c', p_partkey + p_partkey % 4 * 40) AS name", "p_partkey % 3 = 0 AS enabled", "p_partkey % 5 = 0 AS hero_source", "CAST(p_partkey * 7 % 13 AS INT) AS position",
        "CASE p_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN concat('T', p_partkey) END AS custom_title"]),
    "sections": ("nation", ["concat('k', n_nationkey) AS cache", "CAST(n_nationkey % 4 AS INT) AS n_items"]),
    "tracks": ("orders", [
        "o_custkey AS film", "o_orderkey AS ord", "CASE o_orderkey * 17 % 503 % 6 WHEN 0 THEN 'Brazilian' WHEN 1 THEN 'Portugal' WHEN 2 THEN 'Latino' WHEN 3 THEN 'Castilian (BR)' WHEN 4 THEN 'Full' END AS label",
        "CASE o_orderkey * 31 % 1009 % 8 WHEN 0 THEN 'pt' WHEN 1 THEN 'pt-br' WHEN 2 THEN 'es' WHEN 3 THEN 'es-419' WHEN 4 THEN 'en' WHEN 5 THEN 'fr-ca' WHEN 6 THEN 'zxx-eng' END AS language",
        "concat('x', o_orderkey) AS track", "o_orderkey * 31 % 1009 % 3 = 0 AS forced"]),
    "videos": ("orders", [
        "o_custkey AS film", "o_orderkey AS ord", "CASE o_orderkey * 31 % 1009 % 5 WHEN 0 THEN 'Vimeo' WHEN 1 THEN 'youtube' ELSE 'YouTube' END AS site", "CASE WHEN o_orderkey * 17 % 503 % 9 = 0 THEN ' ' ELSE concat('y', o_orderkey * 31 % 1009 % 5) END AS video",
        "CASE o_orderkey * 17 % 503 % 5 WHEN 0 THEN 'Trailer' WHEN 1 THEN 'Teaser' WHEN 2 THEN '' WHEN 3 THEN 'trailer' ELSE 'Clip' END AS type", "CAST(CASE WHEN o_orderkey * 31 % 1009 % 3 > 0 THEN o_orderkey * 31 % 1009 % 4 END AS INT) AS season",
        "CASE o_orderkey * 31 % 1009 % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'en ' WHEN 2 THEN 'fr' END AS lang", "o_totalprice > 150000 AS official", "CASE WHEN o_orderkey * 31 % 1009 % 6 > 0 THEN substring(CAST(o_orderdate AS STRING), 1, 10) END AS published"]),
    "held": ("events", [
        "concat('s', event_id % 37) AS parent", "CAST(CASE WHEN event_id % 9 > 0 THEN event_id % 4 END AS INT) AS season", "CAST(event_id % 7 AS INT) AS episode", "concat('v', event_id % 11) AS video",
        "CAST(event_id * 31 % 5000 AS BIGINT) AS last_updated", "CAST(event_id AS BIGINT) AS position", "concat('k', event_id) AS progress_key"]),
    "upserts": ("orders", [
        "o_orderkey AS ord", "concat('s', o_orderkey % 50) AS parent", "CAST(CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 4 END AS INT) AS season", "CAST(o_orderkey % 8 AS INT) AS episode",
        "concat('v', o_custkey % 13) AS video", "concat('new', o_orderkey) AS progress_key"]),
    "snapshot": ("orders", [
        "concat('t', o_orderkey % 500) AS film", "CAST(o_orderkey % 10 AS INT) AS episode", "CAST(o_orderkey AS BIGINT) AS acted", "CAST(0 AS BIGINT) AS ord", "CAST(o_custkey AS BIGINT) AS watched",
        "CASE WHEN o_custkey % 4 > 0 THEN o_orderpriority END AS label", "CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS BIGINT) END AS tmdb", "CASE WHEN o_custkey % 5 > 0 THEN CAST(o_orderkey AS BIGINT) END AS tvdb"]),
    "journal": ("events", [
        "concat('t', event_id * 7 % 1200) AS film", "CAST(event_id * 7 % 10 AS INT) AS episode", "CAST(event_id * 17 % 9973 AS BIGINT) AS acted", "CAST(event_id AS BIGINT) AS ord",
        "CASE WHEN event_id % 4 > 0 THEN CAST(event_id AS BIGINT) END AS watched", "event_id % 11 = 0 AS removed", "CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS BIGINT) END AS tmdb", "CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS BIGINT) END AS tvdb"]),
    "listed": ("orders", [
        "o_custkey % 200 AS profile", "CASE o_orderkey % 6 WHEN 0 THEN 'watching' WHEN 1 THEN 'plantowatch' WHEN 2 THEN 'hold' WHEN 3 THEN 'completed' WHEN 4 THEN 'dropped' ELSE 'other' END AS status",
        "CASE WHEN o_orderkey % 5 < 3 THEN 'movie' ELSE 'series' END AS type", "o_orderkey % 23 AS id", "CAST(o_orderkey * 13 % 50 AS BIGINT) AS saved", "o_orderkey AS ord"]),
    "fit_groups": ("events", [
        "CAST(floor(event_id / 5) AS BIGINT) AS pair", "CAST(event_id % 5 * 2 AS INT) AS target_start", "CAST(CASE WHEN event_id * 31 % 1009 % 9 = 0 THEN 1 ELSE 2 END AS INT) AS target_n", "CAST(1 + event_id * 17 % 503 % 2 AS INT) AS reference_n",
        "CAST(event_id * 31 % 1009 % 40 AS DOUBLE) / 10 AS cost", "CAST(event_id * 17 % 503 % 400 - 200 AS DOUBLE) AS residual"]),
    "two_fits": ("orders", [
        "o_orderkey", "o_orderkey % 7 > 0 AS c1", "o_custkey % 5 > 0 AS c2", "1 + CAST(o_orderkey % 5 AS DOUBLE) / 10000 AS s1", "CAST(1 AS DOUBLE) AS s2", "CAST(o_orderkey % 600 AS DOUBLE) AS i1", "CAST(o_custkey % 300 AS DOUBLE) AS i2",
        "CAST(o_orderkey % 4 AS DOUBLE) AS r1", "CAST(o_custkey % 4 AS DOUBLE) AS r2", "CAST(o_custkey % 1000 AS BIGINT) AS first", "CAST(1000000 + o_custkey AS BIGINT) AS last"]),
}


def given(spark, d, name):
    source, columns = INPUTS[name]
    return table(spark, d, source).selectExpr(*columns)


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(INPUTS[n][1])} FROM {INPUTS[n][0]})" for n in names)


def preview_steps(spark, d):
    c = [F.col(x) for x in ("a", "b", "pos")]
    return given(spark, d, "cues").select("event_id", G.step_target(*c, F.col("delta"), F.col("duration")).alias("target"), G.aligned_target(*c, F.col("duration")).alias("aligned"))


PREVIEW_STEPS = _with("cues") + """, s AS (SELECT *, b - a AS n, coalesce(b > a AND pos >= a - (b - a) // 2 AND pos < b, false) AS shown FROM cues),
m AS (SELECT *, greatest(CASE WHEN NOT shown OR delta = 0 THEN pos + delta WHEN delta > 0 THEN b + (greatest(floor(abs(delta) / n::DOUBLE + 0.5)::BIGINT, 1) - 1) * n ELSE a - greatest(floor(abs(delta) / n::DOUBLE + 0.5)::BIGINT, 1) * n END, 0) AS raw FROM s)
SELECT event_id, (CASE WHEN duration > 0 AND raw > duration THEN duration ELSE raw END)::BIGINT AS target,
  CASE WHEN shown AND pos > 0 AND a >= 0 AND a <> pos AND (duration <= 0 OR (pos < duration AND a <= duration)) THEN a END AS aligned FROM m"""


def absolute_episodes(spark, d):
    s = given(spark, d, "shows")
    out = G.absolute_episode(F.col("anime"), F.col("video"), F.col("season"), F.col("number"), {c: F.col(c) for c in ("mal", "imdb")} | {"anilist": F.lit(None).cast("string")})
    return s.select("event_id", *(c.alias(n) for n, c in out.items()))


ABSOLUTE = _with("shows") + """, k AS (SELECT *, event_id % 7 IN (1, 5) AS found FROM shows), r AS (SELECT *, CASE WHEN event_id % 7 = 1 THEN event_id % 12 ELSE 3 END::INT AS n FROM k)
SELECT event_id, CASE WHEN anime AND (found OR number IS NULL) THEN NULL ELSE season END AS season, CASE WHEN NOT anime THEN number WHEN found THEN n ELSE coalesce(number, 1) END AS number,
  CASE WHEN anime AND found THEN CASE WHEN event_id % 7 = 1 THEN (event_id % 90)::VARCHAR END WHEN anime AND number IS NOT NULL AND season > 0 THEN NULL ELSE mal END AS mal,
  CASE WHEN anime AND found THEN NULL ELSE imdb END AS imdb, CASE WHEN anime AND event_id % 7 = 5 THEN '9' END AS anilist FROM r"""


def fetch_order(spark, d):
    return C.fetch_order(given(spark, d, "definitions"), given(spark, d, "settings"), ["profile"], "name", True, ["ord"])


# p_partkey + p_partkey % 4 * 40 repeats no name: those of one residue are moved alike, and to multiples of 40 keep it.
FETCH_ORDER = _with("definitions", "settings") + """ SELECT profile, d.name, row_number() OVER (PARTITION BY profile ORDER BY CASE WHEN s.name IS NULL OR enabled OR hero_source THEN 0 ELSE 1 END, coalesce(position, 2147483647), ord) AS place
FROM definitions d LEFT JOIN settings s USING (profile, name)"""


def published_sections(spark, d):
    return C.published_sections(given(spark, d, "definitions"), given(spark, d, "sections"), given(spark, d, "settings"), ["profile"], "name", "cache", ["ord"])


PUBLISHED = _with("definitions", "sections", "settings") + """ SELECT d.profile, d.name, CASE WHEN trim(custom_title) <> '' THEN custom_title ELSE title END AS title, n_items, row_number() OVER (PARTITION BY d.profile ORDER BY coalesce(position, 2147483647), ord) AS place
FROM definitions d JOIN sections USING (cache) LEFT JOIN settings s ON s.profile = d.profile AND s.name = d.name WHERE n_items > 0 AND coalesce(enabled, true)"""


def _chosen(spark, d, normal_only):
    goals = F.array(*(F.lit(x) for x in ("pt", "pt-br", "es", "es-419", "en", "fr")))
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("film"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    named = targets.withColumn("target", F.get(goals, ((F.col("film") + F.col("position") * 3) % 6).cast("int")))
    return C.chosen_tracks(given(spark, d, "tracks"), named, ["film"], normal_only)


def chosen_tracks(spark, d):
    return _chosen(spark, d, False)


def chosen_normal_tracks(spark, d):
    return _chosen(spark, d, True)


def _chosen_sql(open_: str) -> str:
    tags = {"br": "'pt-br', 'brazilian', ' br', '(br)'", "eu": "'portugal', 'iberian', ' eu'", "la": "'es-419', 'latino'", "ca": "'castilian'"}
    said = ", ".join(f"list_bool_or([contains(w, x) FOR x IN [{v}]]) AS {k}" for k, v in tags.items())
    return _with("tracks") + f""", g AS (SELECT c_custkey AS film, position, (['pt', 'pt-br', 'es', 'es-419', 'en', 'fr'])[((c_custkey + position * 3) % 6 + 1)::INT] AS goal FROM customer, (SELECT unnest([0, 1]) AS position)),
w AS (SELECT *, lower(concat_ws(' ', label, language, track)) AS w FROM tracks WHERE {open_}), n AS (SELECT *, {said} FROM w),
x AS (SELECT n.*, position, goal, CASE goal WHEN 'pt' THEN eu WHEN 'pt-br' THEN br WHEN 'es' THEN ca WHEN 'es-419' THEN la ELSE false END AS home, CASE goal WHEN 'pt' THEN br WHEN 'pt-br' THEN eu WHEN 'es' THEN la WHEN 'es-419' THEN ca ELSE false END AS away,
  coalesce(language = goal OR (goal = 'fr' AND language = 'fr-ca') OR (goal = 'en' AND language = 'zxx-eng'), false) AS fits FROM n JOIN g USING (film)),
f AS (SELECT *, count(*) OVER (PARTITION BY film, position, forced) AS alike, row_number() OVER (PARTITION BY film, position ORDER BY forced,
  CASE WHEN goal IN ('en', 'fr') OR (home AND NOT away) THEN 0 WHEN home THEN 1 WHEN goal IN ('pt-br', 'es-419') OR NOT away THEN 2 ELSE 3 END, ord) AS r FROM x WHERE fits),
h AS (SELECT film, position, ord FROM f WHERE r = 1 AND NOT (alike = 1 AND goal IN ('pt', 'es') AND away AND NOT home)),
z AS (SELECT * FROM x WHERE goal IN ('pt-br', 'es-419') AND language = split_part(goal, '-', 1) AND home AND NOT EXISTS (SELECT 1 FROM f WHERE f.film = x.film AND f.position = x.position)),
y AS (SELECT film, position, ord FROM z QUALIFY row_number() OVER (PARTITION BY film, position ORDER BY away, CASE WHEN away THEN false ELSE forced END, ord) = 1),
a AS (SELECT * FROM h UNION ALL SELECT * FROM y), e AS (SELECT g.film, g.position, goal, ord FROM g LEFT JOIN a USING (film, position)),
q AS (SELECT film, ord FROM e WHERE ord IS NOT NULL OR (position = 0 AND goal IN ('pt-br', 'es-419')) QUALIFY row_number() OVER (PARTITION BY film ORDER BY position) = 1)
SELECT film, q.ord FROM (SELECT DISTINCT film FROM tracks) LEFT JOIN q USING (film)"""


CHOSEN, CHOSEN_NORMAL = _chosen_sql("true"), _chosen_sql("NOT forced")


def grouped_trailers(spark, d):
    return C.grouped_trailers(given(spark, d, "videos"), ["film"], "de-AT")


TRAILERS = _with("videos") + """, u AS (SELECT * FROM videos WHERE lower(site) = 'youtube' AND trim(video) <> '' QUALIFY row_number() OVER (PARTITION BY film, video ORDER BY ord) = 1),
c AS (SELECT *, CASE WHEN type = '' THEN 'Trailer' ELSE type END AS category FROM u), t AS (SELECT film, category, CASE WHEN lower(category) = 'trailer' THEN 0 WHEN bool_or(official) THEN 1 ELSE 2 END AS turn, min(ord) AS seen FROM c GROUP BY film, category)
SELECT film, category, video, row_number() OVER (PARTITION BY film ORDER BY turn, lower(category), seen, season DESC NULLS LAST, CASE WHEN lang = 'DE' THEN 0 WHEN lang = 'en ' THEN 1 ELSE 2 END, official DESC, published DESC NULLS LAST, ord) AS place FROM c JOIN t USING (film, category)"""


def reused_keys(spark, d):
    return J.reused_keys(given(spark, d, "held"), given(spark, d, "upserts"), ["parent", "season", "episode"], "video", "progress_key").select("ord", "progress_key")


REUSED = _with("held", "upserts") + """, b AS (SELECT u.ord, u.progress_key AS own, h.progress_key AS old, row_number() OVER (PARTITION BY u.ord ORDER BY h.video = u.video DESC NULLS LAST, last_updated DESC, h.position DESC) AS r
FROM upserts u LEFT JOIN (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY parent, season, episode, video ORDER BY last_updated DESC, position DESC) = 1) h ON h.parent = u.parent AND h.episode = u.episode AND h.season IS NOT DISTINCT FROM u.season)
SELECT ord, coalesce(old, own) AS progress_key FROM b WHERE r = 1"""


def applied_journal(spark, d):
    return J.applied_journal(given(spark, d, "snapshot"), given(spark, d, "journal"), ["film", "episode"], ["acted", "ord"], ["label"], ["tmdb", "tvdb"])


JOURNAL = _with("snapshot", "journal") + """, s AS (SELECT * FROM snapshot QUALIFY row_number() OVER (PARTITION BY film, episode ORDER BY acted DESC, ord DESC) = 1),
e AS (SELECT film, episode, 0 AS x, acted, ord, watched, false AS removed, label, tmdb, tvdb FROM s UNION ALL SELECT film, episode, 1, acted, ord, coalesce(watched, acted), removed, NULL, tmdb, tvdb FROM journal),
n AS (SELECT *, row_number() OVER (PARTITION BY film, episode ORDER BY x, acted, ord) AS n FROM e), g AS (SELECT *, coalesce(max(CASE WHEN removed THEN n END) OVER (PARTITION BY film, episode), 0) AS gone FROM n)
SELECT film, episode, max_by(watched, n) AS watched, max(label) FILTER (x = 0) AS label, max_by(tmdb, n) FILTER (tmdb IS NOT NULL) AS tmdb, max_by(tvdb, n) FILTER (tvdb IS NOT NULL) AS tvdb FROM g WHERE n > gone GROUP BY film, episode"""


def merged_badges(spark, d):
    badge = lambda name, image: F.struct(name.alias("name"), image.alias("image"))
    text = lambda head, n: F.concat(F.lit(head), (F.col("c_custkey") % n).cast("string"))
    held = F.array(badge(text("N", 3), F.lit("")), badge(F.lit("X"), text("IMG", 4)))
    held = F.when(F.col("c_custkey") % 5 == 0, F.slice(held, 1, 0)).otherwise(held)
    matched = F.array(badge(text("n", 4), F.lit("")), badge(F.lit("Y"), text("img", 3)), badge(F.lit("y2"), text("IMG", 3)), badge(text("N", 2), F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(J.merged_badges(held, matched), lambda b: F.concat(b["name"], F.lit("|"), b["image"])), ",").alias("badges"))


BADGES = """WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE [{'name': 'N' || c_custkey % 3, 'image': ''}, {'name': 'X', 'image': 'IMG' || c_custkey % 4}] END AS h,
  [{'name': 'n' || c_custkey % 4, 'image': ''}, {'name': 'Y', 'image': 'img' || c_custkey % 3}, {'name': 'y2', 'image': 'IMG' || c_custkey % 3}, {'name': 'N' || c_custkey % 2, 'image': ' '}] AS n FROM customer),
u AS (SELECT k, len(h) AS held, unnest(list_concat(h, n)) AS b, generate_subscripts(list_concat(h, n), 1) AS i FROM m),
v AS (SELECT *, row_number() OVER (PARTITION BY k, lower(CASE WHEN trim(b.image) <> '' THEN b.image ELSE b.name END) ORDER BY i) AS r FROM u)
SELECT k AS c_custkey, string_agg(b.name || '|' || b.image, ',' ORDER BY i) AS badges FROM v WHERE r = 1 OR i <= held OR held = 0 GROUP BY k"""


def status_sections(spark, d):
    return J.status_sections(given(spark, d, "listed"), ["profile"], ["ord"])


SECTIONS = _with("listed") + """, f AS (SELECT * FROM listed WHERE status <> 'other' QUALIFY row_number() OVER (PARTITION BY profile, status, type, id ORDER BY ord) = 1),
p AS (SELECT profile, status, type, id, saved, row_number() OVER (PARTITION BY profile, status ORDER BY saved DESC, ord) AS place FROM f)"""


def status_items(spark, d):
    return J.status_items(status_sections(spark, d), ["profile"])


ITEMS = SECTIONS + """, t AS (SELECT *, list_position(['watching', 'plantowatch', 'hold', 'completed', 'dropped'], status) AS turn FROM p), o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY profile, type, id ORDER BY turn) = 1)
SELECT profile, type, id, status, saved, row_number() OVER (PARTITION BY profile ORDER BY saved DESC, turn, o.place) AS place FROM o"""


def fit_quality(spark, d):
    groups = given(spark, d, "fit_groups")
    sizes = groups.groupBy("pair").agg((F.count("*") * 2 + F.col("pair") % 2).alias("target_size"), (F.count("*") * 2).alias("reference_size"))
    q = A.fit_quality(groups, sizes, ["pair"])
    score = A.fit_score(F.col("target_coverage"), F.col("reference_coverage"), F.col("cost"), F.get("shapes", F.lit(0)) / F.aggregate("shapes", F.lit(0).cast("long"), lambda a, b: a + b), F.col("skip_run"), F.col("pair") % 3 == 0)
    rounded = [F.round(c, 9).alias(c) for c in ("target_coverage", "reference_coverage", "cost")]
    return q.select("pair", *rounded, "skipped_target", "skipped_reference", "skip_run", F.array_join(F.col("shapes").cast("array<string>"), ",").alias("shapes"), "residual", "confident", F.round(score, 9).alias("score"))


FITS = _with("fit_groups") + """, z AS (SELECT pair, count(*) * 2 + pair % 2 AS ts, count(*) * 2 AS rs, sum(target_n) AS t, sum(reference_n) AS r, avg(cost) AS c, max(target_start + target_n) AS e, list_sort(list(abs(residual))) AS l,
  count(*) FILTER (reference_n = 1 AND target_n = 1) AS s1, count(*) FILTER (reference_n = 1 AND target_n = 2) AS s2, count(*) FILTER (reference_n = 2 AND target_n = 1) AS s3, count(*) FILTER (reference_n = 2 AND target_n = 2) AS s6 FROM fit_groups GROUP BY pair),
o AS (SELECT pair, max(gap) AS gap FROM (SELECT pair, target_start - coalesce(lag(target_start + target_n) OVER (PARTITION BY pair ORDER BY target_start), 0) AS gap FROM fit_groups) GROUP BY pair),
v AS (SELECT *, greatest(gap, ts - e) AS run FROM z JOIN o USING (pair))
SELECT pair, round(t / ts::DOUBLE, 9) AS target_coverage, round(r / rs::DOUBLE, 9) AS reference_coverage, round(c, 9) AS cost, (ts - t)::BIGINT AS skipped_target, (rs - r)::BIGINT AS skipped_reference, run::BIGINT AS skip_run,
  concat_ws(',', s1, s2, s3, 0, 0, s6) AS shapes, l[len(l) // 2 + 1] AS residual, t >= least(20, ts) AND t / ts::DOUBLE >= 0.84::DOUBLE AND c <= 2.35::DOUBLE AND run <= 12 AS confident,
  round(t / ts::DOUBLE * 0.42::DOUBLE + r / rs::DOUBLE * 0.15::DOUBLE + 0.23::DOUBLE / (1 + c) + s1 / (s1 + s2 + s3 + s6)::DOUBLE * 0.2::DOUBLE - least(run, 20) * 0.004::DOUBLE - CASE WHEN pair % 3 = 0 THEN 0.01::DOUBLE ELSE 0 END, 9) AS score FROM v"""


def tighter_fits(spark, d):
    side = lambda i: {n: F.col(f"{n[0]}{i}") for n in ("confident", "scale", "intercept", "residual")}
    return given(spark, d, "two_fits").select("o_orderkey", A.tighter_fit(side(1), side(2), F.col("first"), F.col("last")).alias("holds"))


TIGHTER = _with("two_fits") + ' SELECT o_orderkey, CASE WHEN c1 AND c2 AND r1 <> r2 AND greatest(abs((s1 - s2) * "first" + i1 - i2), abs((s1 - s2) * "last" + i1 - i2)) > 300 THEN r1 < r2 END AS holds FROM two_fits'


def outlier_references(spark, d):
    s = table(spark, d, "events").selectExpr("CAST(floor(event_id / 5) AS BIGINT) AS film", "event_id % 5 AS source", "event_id * 7919 % 101 % 7 AS place")
    both = s.alias("x").join(s.alias("y"), (F.col("x.film") == F.col("y.film")) & (F.col("x.place") == F.col("y.place")) & (F.col("x.source") < F.col("y.source")))
    return A.outlier_references(s, both.select("x.film", F.col("x.source").alias("a"), F.col("y.source").alias("b")), ["film"], "source")


OUTLIER_REFERENCES = """WITH s AS (SELECT CAST(floor(event_id / 5) AS BIGINT) AS film, event_id % 5 AS source, event_id * 7919 % 101 % 7 AS place FROM events),
t AS (SELECT *, count(*) OVER (PARTITION BY film) AS n, count(*) OVER (PARTITION BY film, place) AS same FROM s),
u AS (SELECT *, max(same) OVER (PARTITION BY film) AS most FROM t) SELECT film, source FROM u WHERE n >= 3 AND most > 1 AND same = 1"""


QUERIES = {
    "preview_steps": (preview_steps, PREVIEW_STEPS),
    "absolute_episodes": (absolute_episodes, ABSOLUTE),
    "fetch_order": (fetch_order, FETCH_ORDER),
    "published_sections": (published_sections, PUBLISHED),
    "chosen_tracks": (chosen_tracks, CHOSEN),
    "chosen_normal_tracks": (chosen_normal_tracks, CHOSEN_NORMAL),
    "grouped_trailers": (grouped_trailers, TRAILERS),
    "reused_keys": (reused_keys, REUSED),
    "applied_journal": (applied_journal, JOURNAL),
    "merged_badges": (merged_badges, BADGES),
    "status_sections": (status_sections, SECTIONS + " SELECT profile, status, type, id, saved, place FROM p"),
    "status_items": (status_items, ITEMS),
    "fit_quality": (fit_quality, FITS),
    "tighter_fits": (tighter_fits, TIGHTER),
    "outlier_references": (outlier_references, OUTLIER_REFERENCES),
}
