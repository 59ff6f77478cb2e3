"""Queries: what a home screen shows, languages, fixed orders, history edits, small predicates of lists.

Inputs are made of the test tables by expressions that Spark and DuckDB read alike; what is computed of them is stated
anew in each oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import language as L
from reelforge.operators import viewing as V
from reelforge.plans.tables import spread, table

INPUTS = {
    "entries": ("events", """user_id AS profile, CASE WHEN event_id % 41 = 0 THEN '' ELSE concat('s', event_id % 37) END AS parent,
        concat('v', event_id % 211) AS video, event_id % 5 <> 0 AS series, CAST(event_id * 31 % 5000 AS BIGINT) AS stamp,
        CAST(event_id % 1000 AS DOUBLE) / 1000 AS fraction, event_id AS ord, CAST(event_id % 4 AS INT) AS season,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 23 AS INT) END AS episode, event_id % 3 = 0 AS done"""),
    "up_next": ("orders", """o_custkey % 120 AS profile, CASE WHEN o_orderkey % 43 = 0 THEN ' ' ELSE concat('s', o_orderkey % 53) END AS parent,
        concat('n', o_orderkey % 97) AS video, CAST(o_orderkey * 13 % 5000 AS BIGINT) AS stamp,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END AS released, o_orderkey AS ord"""),
    "watched": ("orders", """o_custkey % 120 AS profile, CASE WHEN o_orderkey % 29 = 0 THEN ' IMDB: ' ELSE concat('s', o_orderkey % 53) END AS parent, o_orderkey % 6 <> 0 AS series,
        CAST(o_orderkey % 5 AS INT) AS season, CAST(o_orderkey % 31 AS INT) AS episode, CAST(o_orderkey * 13 % 5000 AS BIGINT) AS stamp"""),
    "titles": ("part", """p_partkey AS id, p_brand AS source, p_type AS label, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS subtitle, p_name AS title,
        CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS rating, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS INT) END AS votes,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('20', 10 + p_size, '-01-02') END AS date, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE '2015' END AS info,
        CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size % 7 AS INT) END AS season, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size % 11 AS INT) END AS episode, concat('  ', p_brand, ' ') AS episode_title"""),
    "credits": ("orders", """o_custkey % 90 AS person, o_orderkey % 700 AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS popularity,
        CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END AS date, o_orderkey AS ord"""),
    "marks": ("events", "concat('t', event_id % 60) AS title, CAST(event_id % 4 AS INT) AS season, CAST(event_id % 13 AS INT) AS episode, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('2024-', event_id % 9000 + 1000) END AS watched_at, event_id"),
    "removed": ("customer", "concat('t', c_custkey % 50) AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS INT) END AS season, CASE WHEN c_custkey % 25 = 3 THEN NULL ELSE CAST(c_custkey % 13 AS INT) END AS episode"),
}
TODAY = "1996-06-01"


def given(spark, d, name):
    source, columns = INPUTS[name]
    return table(spark, d, source).selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def _with(*names: str) -> str:
    return ", ".join(f"{n} AS (SELECT {INPUTS[n][1]} FROM {INPUTS[n][0]})" for n in names)


def continue_default(spark, d):
    return V.continue_rows(given(spark, d, "entries"), given(spark, d, "up_next"), ["profile"])


def continue_streaming(spark, d):
    return V.continue_rows(given(spark, d, "entries"), given(spark, d, "up_next"), ["profile"], "streaming", TODAY)


_ROWS = f"""WITH {_with("entries", "up_next")}, mixed AS (
  SELECT profile, parent, video, stamp, false AS is_next, CAST(NULL AS VARCHAR) AS released, ord FROM entries WHERE fraction < 0.995
  UNION ALL
  SELECT profile, parent, video, stamp, true, released, ord FROM up_next n
  WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.profile = n.profile AND e.parent = n.parent AND e.series AND trim(e.parent) <> '')
), named AS (SELECT *, CASE WHEN trim(parent) <> '' THEN parent ELSE video END AS content FROM mixed),
kept AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY profile, content ORDER BY stamp DESC, is_next, ord) = 1)"""
CONTINUE = _ROWS + """
SELECT profile, content, parent, video, stamp, is_next, released, row_number() OVER (PARTITION BY profile ORDER BY stamp DESC, is_next, ord) AS place FROM kept"""
STREAMING = _ROWS + f""", late AS (SELECT *, coalesce(is_next AND trim(released) <> '' AND released > '{TODAY}', false) AS l FROM kept)
SELECT profile, content, parent, video, stamp, is_next, released,
  row_number() OVER (PARTITION BY profile ORDER BY l, CASE WHEN l THEN released END, stamp DESC, is_next, ord) AS place FROM late"""


def upcoming_split(spark, d):
    rows = V.continue_rows(given(spark, d, "entries"), given(spark, d, "up_next"), ["profile"]).withColumnRenamed("place", "turn")
    day = lambda c: F.unix_date(F.to_date(F.nullif(c, F.lit("")))).cast("long")
    return V.split_upcoming(rows, ["profile"], day(F.col("released")), 9648, ["turn"]).select("profile", "content", "upcoming", "place")


UPCOMING = f"""WITH shown AS ({CONTINUE}), marked AS (
  SELECT *, coalesce(is_next AND nullif(released, '')::DATE > DATE '1996-06-01', false) AS upcoming FROM shown)
SELECT profile, content, upcoming, row_number() OVER (PARTITION BY profile, upcoming ORDER BY CASE WHEN upcoming THEN released END, place) AS place FROM marked"""


def seeds(spark, d, furthest):
    return V.completed_seeds(given(spark, d, "entries"), given(spark, d, "watched"), ["profile"], False, furthest)


def _seeds_sql(order: str) -> str:
    fine = "series AND season <> 0 AND episode IS NOT NULL AND lower(trim(parent)) NOT IN ('', 'tmdb', 'imdb', 'trakt', 'tmdb:', 'imdb:', 'trakt:')"
    return f"""WITH {_with("entries", "watched")}, done AS (
  SELECT profile, parent, season, episode, stamp FROM entries WHERE done AND {fine}
  UNION ALL SELECT profile, parent, season, episode, stamp FROM watched WHERE {fine})
SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY profile, parent ORDER BY {order}) = 1"""


def moved_seeds(spark, d):
    now = seeds(spark, d, False).select("profile", F.col("parent").alias("content"), "season", "episode")
    rows = given(spark, d, "up_next").select("profile", F.col("parent").alias("content"), "ord", (F.col("ord") % 5).cast("int").alias("seed_season"), (F.col("ord") % 31).cast("int").alias("seed_episode"))
    return V.current_up_next(rows, now, ["profile"], False)


MOVED = f"""WITH seeds AS ({_seeds_sql("stamp DESC, season DESC, episode DESC")}), rows AS (
  SELECT o_custkey % 120 AS profile, CASE WHEN o_orderkey % 43 = 0 THEN ' ' ELSE concat('s', o_orderkey % 53) END AS content, o_orderkey AS ord,
    CAST(o_orderkey % 5 AS INT) AS seed_season, CAST(o_orderkey % 31 AS INT) AS seed_episode FROM orders)
SELECT r.* FROM rows r LEFT JOIN seeds s ON s.profile = r.profile AND s.parent = r.content
WHERE s.season IS NULL OR (s.season = seed_season AND s.episode = seed_episode)"""


def cached_up_next(spark, d):
    c = table(spark, d, "customer")
    half = lambda keep, mark: c.filter(keep).select(F.col("c_custkey").alias("content"), F.when(F.col("c_custkey") % 5 == mark, F.lit(" ")).otherwise(F.concat(F.lit(f"{mark}:"), "c_name")).alias("logo"), (F.col("c_custkey") * (mark + 2)).alias("stamp"))
    settled = c.filter("c_custkey % 4 = 1").select(F.col("c_custkey").alias("content"))
    return V.with_cache(half("c_custkey % 3 <> 0", 0), half("c_custkey % 2 = 0 or c_custkey % 9 = 1", 1), settled, ["content"], ["logo"], ["stamp"])


CACHED = """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '0:' || c_name END AS logo, c_custkey * 2 AS stamp FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 1 THEN ' ' ELSE '1:' || c_name END AS logo, c_custkey * 3 AS stamp FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 9 = 1)
SELECT coalesce(a.k, b.k) AS content, CASE WHEN a.k IS NULL THEN b.logo WHEN trim(a.logo) <> '' THEN a.logo ELSE b.logo END AS logo,
  CASE WHEN a.k IS NULL THEN b.stamp ELSE a.stamp END AS stamp
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NOT NULL OR b.k % 4 <> 1"""

FORMS = ["Portuguese (Brazil)", "pt_BR", "portugues europeu", "Español", "Spanish latin", "castellano", "ENG", "zh-TW", "zht", "chi-hk", "Old English", "french canadian", "de.AT", "  ", "ja/JP", "por-MZ", "english forced", "x-klingon", "Lao", "fil", "deu-", "Norwegian Bokmal songs sign", "south korea", "BRA", "India "]
_FORM = "([" + ", ".join(f"'{x}'" for x in FORMS) + "])"


def _form(step: int):
    return F.get(F.array(*map(F.lit, FORMS)), ((F.col("p_partkey") * step + F.col("p_size")) % len(FORMS)).cast("int"))


def languages(spark, d):
    p = spread(table(spark, d, "part")).select("p_partkey", _form(1).alias("a"), _form(3).alias("b"))
    return p.select("p_partkey", "a", "b", L.language_code(F.col("a")).alias("code"), L.language_matches(F.col("a"), F.col("b")).alias("matches"), L.is_forced(F.col("b"), F.col("a"), F.lit(None).cast("string"), F.col("p_partkey") % 50 == 0).alias("forced"), L.content_language(F.col("a"), F.col("b")).alias("content"), L.country_language(F.col("b")).alias("country"))


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _rows(pairs) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


LANGUAGES = f"""WITH code(k, v) AS (VALUES {_rows(L.CODES.items())}), name(k, v, pos) AS (VALUES {", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(L.NAMES.items()))}),
land(k, v) AS (VALUES {_rows(L.COUNTRIES.items())}),
form AS (SELECT DISTINCT unnest({_FORM}) AS f), raw AS (SELECT f, nullif(lower(replace(trim(f), '_', '-')), '') AS r FROM form),
word AS (SELECT f, r, trim(regexp_replace(regexp_replace(r, '[-./]', ' ', 'g'), '\\s+', ' ', 'g')) AS w, split_part(r, '-', 1) AS p FROM raw),
coded AS (SELECT f, CASE WHEN r IS NULL THEN NULL
  WHEN {_any("w", L.PORTUGUESE)} THEN CASE WHEN {_any("w", L.BRAZIL)} THEN 'pt-br' ELSE 'pt' END
  WHEN {_any("w", L.SPANISH)} THEN CASE WHEN {_any("w", L.LATIN)} THEN 'es-419' ELSE 'es' END
  ELSE coalesce((SELECT v FROM code WHERE k = r),
    (SELECT arg_min(v, -length(k) * 1000 + pos) FROM name WHERE w = k OR starts_with(w, k || ' ') OR ends_with(w, ' ' || k) OR contains(w, ' ' || k || ' ')),
    CASE WHEN strpos(r, '-') = 0 OR trim(substr(r, length(p) + 2)) = '' OR contains(coalesce((SELECT v FROM code WHERE k = p), ''), '-')
      THEN coalesce((SELECT v FROM code WHERE k = p), p) ELSE coalesce((SELECT v FROM code WHERE k = p), p) || '-' || substr(r, length(p) + 2) END) END AS c FROM word),
parts AS (SELECT p_partkey, {_FORM}[((p_partkey + p_size) % {len(FORMS)} + 1)::INT] AS a, {_FORM}[((p_partkey * 3 + p_size) % {len(FORMS)} + 1)::INT] AS b FROM part)
SELECT p_partkey, a, b, x.c AS code, coalesce(split_part(x.c, '-', 1) = split_part(y.c, '-', 1), false) AS matches,
  p_partkey % 50 = 0 OR coalesce(x.c = 'forced', false) OR contains(lower(b || ' ' || a), 'forced') OR (contains(lower(b || ' ' || a), 'songs') AND contains(lower(b || ' ' || a), 'sign')) AS forced,
  coalesce(x.c, l.v) AS content, l.v AS country
FROM parts JOIN coded x ON x.f = a JOIN coded y ON y.f = b LEFT JOIN land l ON l.k = lower(trim(b))"""


def fixed_orders(spark, d):
    from reelforge.operators.order import ranked

    out = given(spark, d, "titles")
    for name in ("rating", "votes", "date", "downloads", "grouped"):
        out = ranked(out.withColumn("p", F.lower(F.substring("source", 1, 8))), ["p"], [*V.fixed_order(name), "id"], f"by_{name}")
    return out.select("id", *(f"by_{n}" for n in ("rating", "votes", "date", "downloads", "grouped")))


FIXED = f"""WITH {_with("titles")}
SELECT id, row_number() OVER (PARTITION BY p ORDER BY coalesce(TRY_CAST(rating AS DOUBLE), -1) DESC, coalesce(date, info, '') DESC, id) AS by_rating,
  row_number() OVER (PARTITION BY p ORDER BY coalesce(votes, 0) DESC, id) AS by_votes,
  row_number() OVER (PARTITION BY p ORDER BY coalesce(date, info, '') DESC, id) AS by_date,
  row_number() OVER (PARTITION BY p ORDER BY coalesce(season, 2147483647), coalesce(episode, 2147483647), lower(trim(episode_title)), lower(trim(title)), id) AS by_downloads,
  row_number() OVER (PARTITION BY p ORDER BY lower(coalesce(source, '')), lower(coalesce(label, '')), lower(coalesce(subtitle, '')), id) AS by_grouped
FROM (SELECT *, lower(substr(source, 1, 8)) AS p FROM titles)"""


def person_credits(spark, d):
    return V.credit_lists(given(spark, d, "credits"), ["person"], TODAY)


CREDITS = f"""WITH {_with("credits")}, once AS (SELECT * FROM credits QUALIFY row_number() OVER (PARTITION BY person, id ORDER BY ord) = 1)
SELECT person, 'popular' AS list, row_number() OVER (PARTITION BY person ORDER BY coalesce(popularity, 0) DESC, ord) AS place, id FROM once
UNION ALL SELECT person, 'latest', row_number() OVER (PARTITION BY person ORDER BY date DESC, ord), id FROM once WHERE date <= '{TODAY}'
UNION ALL SELECT person, 'upcoming', row_number() OVER (PARTITION BY person ORDER BY date, ord), id FROM once WHERE date > '{TODAY}'"""


def rich_metadata(spark, d):
    t = given(spark, d, "titles").select((F.col("id") % 300).alias("video"), (F.col("id") % 7).alias("stamp"), "subtitle", "rating", "date", "info", "id")
    return V.richest(t, ["video"], "stamp", ["subtitle", "rating", "date", "info"], "id").select("video", "stamp", "score", "id")


RICH = f"""WITH {_with("titles")}, t AS (SELECT id % 300 AS video, id % 7 AS stamp, id,
  (coalesce(trim(subtitle), '') <> '')::INT + (coalesce(trim(rating), '') <> '')::INT + (coalesce(trim(date), '') <> '')::INT + (coalesce(trim(info), '') <> '')::INT AS score FROM titles)
SELECT video, stamp, score, id FROM t QUALIFY row_number() OVER (PARTITION BY video ORDER BY stamp DESC, score DESC, id) = 1"""


def history_removed(spark, d):
    return V.without_history(given(spark, d, "marks"), given(spark, d, "removed"), ["title"])[1]


REMOVED = f"""WITH {_with("marks", "removed")}, kept AS (
  SELECT m.title, CASE WHEN EXISTS (SELECT 1 FROM removed r WHERE r.title = m.title AND r.episode = m.episode AND coalesce(r.season, 1) = m.season) THEN NULL ELSE watched_at END AS w
  FROM marks m WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.title = m.title AND r.episode IS NULL))
SELECT title, max(w) AS last_watched, count(w) AS watched FROM kept GROUP BY title"""


def declared_catalogs(spark, d):
    own = table(spark, d, "part").select(F.concat(F.lit("o"), F.col("p_partkey") % 12).alias("owner"), F.concat(F.lit("c"), F.col("p_partkey") % 40).alias("id"), F.concat(F.lit("t"), F.col("p_size") % 3).alias("type"), F.col("p_partkey").alias("ord"), (F.col("p_size") % 4 != 0).alias("enabled"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.concat(F.lit("o"), F.col("c_custkey") % 15).alias("source"), F.concat(F.lit("c"), F.col("c_custkey") % 50, F.when(F.col("c_custkey") % 3 == 0, F.lit(",x")).otherwise("")).alias("catalog"), F.concat(F.lit("t"), F.col("c_custkey") % 3).alias("type"))
    return V.found_catalogs(asked, own).select("request", "owner", "found")


DECLARED = """WITH own AS (SELECT 'o' || p_partkey % 12 AS owner, 'c' || p_partkey % 40 AS id, 't' || p_size % 3 AS type, p_partkey AS ord FROM part WHERE p_size % 4 <> 0),
asked AS (SELECT c_custkey AS request, 'o' || c_custkey % 15 AS source, 'c' || c_custkey % 50 || CASE WHEN c_custkey % 3 = 0 THEN ',x' ELSE '' END AS catalog, 't' || c_custkey % 3 AS type FROM customer),
hit AS (SELECT request, owner, id, ord, CASE WHEN owner = source AND id = catalog THEN 0 WHEN owner = source AND id = split_part(catalog, ',', 1) THEN 1 WHEN id = catalog THEN 2 END AS step
  FROM asked JOIN own ON own.type = asked.type AND own.id IN (catalog, split_part(catalog, ',', 1)))
SELECT request, owner, id AS found FROM asked LEFT JOIN (SELECT * FROM hit WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request ORDER BY step, ord) = 1) h USING (request)"""


def list_facts(spark, d):
    p, n = given(spark, d, "titles"), F.col("title")
    number = F.concat(F.get(F.array(*map(F.lit, ["episode ", "ep ", "e ", "part ", ""])), (F.col("id") % 5).cast("int")), F.col("id") % 30)
    start, end = F.when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise((F.col("id") % 40 - 2).cast("double")), (F.col("id") % 33).cast("double")
    kind = F.get(F.array(*map(F.lit, ["intro", "recap", "outro"])), (F.col("id") % 3).cast("int"))
    return p.select("id", V.useful_title(number).alias("useful"), V.episode_label(F.col("season"), F.col("episode"), F.when(F.col("id") % 2 == 0, n).otherwise(" ")).alias("label"), V.skips_itself(start, end, kind, ["intro", "outro"]).alias("skips"))


FACTS = f"""WITH {_with("titles")}, t AS (SELECT *, ['episode ', 'ep ', 'e ', 'part ', ''][(id % 5 + 1)::INT] || (id % 30) AS num, CASE WHEN id % 13 = 0 THEN 'nan'::DOUBLE ELSE (id % 40 - 2)::DOUBLE END AS a, (id % 33)::DOUBLE AS b FROM titles)
SELECT id, NOT regexp_full_match(num, '(episode|ep|e) [0-9]+') AS useful,
  concat_ws(' • ', CASE WHEN season IS NOT NULL AND episode IS NOT NULL THEN 'S' || season || 'E' || episode WHEN episode IS NOT NULL THEN 'E' || episode END, CASE WHEN id % 2 = 0 THEN title END) AS label,
  isfinite(a) AND a >= 0 AND b > a AND id % 3 <> 1 AS skips FROM t"""


def plain_titles(spark, d):
    o = table(spark, d, "orders")
    text = F.get(F.array(*map(F.lit, ["  ", "影の国", "The Hall ", "한국", "Ёлки", "カメラ", "Été"])), (F.col("o_orderkey") % 7).cast("int"))
    return V.english_titles(o.select((F.col("o_orderkey") % 500).alias("id"), text.alias("title"), F.concat(F.lit(" n"), F.col("o_orderkey") % 9).alias("name"), F.col("o_orderkey").alias("ord")), "id", "title", "name", "ord")


PLAIN = """WITH t AS (SELECT o_orderkey % 500 AS id, o_orderkey AS ord, coalesce(nullif(trim(['  ', '影の国', 'The Hall ', '한국', 'Ёлки', 'カメラ', 'Été'][(o_orderkey % 7 + 1)::INT]), ''), 'n' || o_orderkey % 9) AS text FROM orders)
SELECT id, text FROM t WHERE text NOT IN ('影の国', '한국', 'カメラ') QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1"""


def cloud_files(spark, d):
    p = table(spark, d, "part")
    files = p.select(F.concat(F.lit("g"), F.col("p_partkey") % 400).alias("group"), F.col("p_name").alias("item"), F.when((F.col("p_partkey") % 400 % 5 != 0) & (F.col("p_size") % 3 != 0), F.col("p_size").cast("long")).alias("size"), F.col("p_partkey").alias("ord"))
    return V.file_groups(files, "group", "size")


CLOUD = """SELECT 'g' || p_partkey % 400 AS "group", arg_min(p_name, p_partkey) AS item, count(*) AS files,
  sum(CASE WHEN p_partkey % 400 % 5 <> 0 AND p_size % 3 <> 0 THEN p_size END)::BIGINT AS bytes FROM part GROUP BY 1"""


def loaded_sources(spark, d):
    e = table(spark, d, "events").select("user_id", F.concat(F.lit("a"), F.col("event_id") % 20).alias("addon"), (F.col("event_id") % 60 == 7).alias("loading"))
    installed = table(spark, d, "customer").select(F.concat(F.lit("a"), F.col("c_custkey") % 9).alias("addon"))
    kinds = [V.sources_loaded(e, ["user_id"], s, installed).withColumnRenamed("loaded", f"{s}_loaded") for s in ("all", "installed", "plugins")]
    return kinds[0].join(kinds[1], "user_id").join(kinds[2], "user_id")


LOADED = """WITH e AS (SELECT user_id, event_id % 60 = 7 AS loading, 'a' || event_id % 20 IN (SELECT 'a' || c_custkey % 9 FROM customer) AS known FROM events)
SELECT user_id, NOT bool_or(loading) AS all_loaded, NOT bool_or(loading AND known) AS installed_loaded, NOT bool_or(loading AND NOT known) AS plugins_loaded FROM e GROUP BY user_id"""

QUERIES = {
    "continue_rows": (continue_default, CONTINUE),
    "continue_streaming": (continue_streaming, STREAMING),
    "upcoming_split": (upcoming_split, UPCOMING),
    "next_up_seeds": (lambda s, d: seeds(s, d, False), _seeds_sql("stamp DESC, season DESC, episode DESC")),
    "furthest_seeds": (lambda s, d: seeds(s, d, True), _seeds_sql("season DESC, episode DESC, stamp DESC")),
    "moved_seeds": (moved_seeds, MOVED),
    "cached_up_next": (cached_up_next, CACHED),
    "languages": (languages, LANGUAGES),
    "fixed_orders": (fixed_orders, FIXED),
    "person_credits": (person_credits, CREDITS),
    "rich_metadata": (rich_metadata, RICH),
    "history_removed": (history_removed, REMOVED),
    "declared_catalogs": (declared_catalogs, DECLARED),
    "list_facts": (list_facts, FACTS),
    "plain_titles": (plain_titles, PLAIN),
    "cloud_files": (cloud_files, CLOUD),
    "loaded_sources": (loaded_sources, LOADED),
}

def overlaid_progress(spark, d):
    e = given(spark, d, "entries").select("profile", "video", "stamp", "fraction", "done")
    remote = e.filter("stamp % 3 <> 0").groupBy("profile", "video").agg(F.max("stamp").alias("stamp"), F.max_by("fraction", F.struct("stamp", "fraction", "done")).alias("fraction"), F.max_by("done", F.struct("stamp", "fraction", "done")).alias("done"))
    own = e.filter("stamp % 3 = 0").groupBy("profile", "video").agg((F.max("stamp") + 40).alias("stamp"), F.max_by("fraction", F.struct("stamp", "fraction", "done")).alias("fraction"), F.max_by("done", F.struct("stamp", "fraction", "done")).alias("done"))
    return V.overlaid(remote, own.withColumn("expires", F.col("stamp") * 2), ["profile"], 4000).select("profile", "video", "stamp", "fraction", "done", "own")


OVERLAID = f"""WITH {_with("entries")}, e AS (SELECT profile, video, stamp, fraction, done FROM entries),
remote AS (SELECT * FROM e WHERE stamp % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY profile, video ORDER BY stamp DESC, fraction DESC, done DESC) = 1),
own AS (SELECT profile, video, stamp + 40 AS stamp, fraction, done FROM e WHERE stamp % 3 = 0 QUALIFY row_number() OVER (PARTITION BY profile, video ORDER BY stamp DESC, fraction DESC, done DESC) = 1),
live AS (SELECT o.* FROM own o LEFT JOIN remote r USING (profile, video) WHERE o.stamp * 2 > 4000
  AND NOT coalesce(r.stamp >= o.stamp - 60000 AND CASE WHEN o.done THEN r.done ELSE abs(r.fraction - o.fraction) <= 0.03 END, false)),
u AS (SELECT *, false AS own FROM remote UNION ALL SELECT *, true FROM live)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY profile, video ORDER BY stamp DESC, own) = 1"""


def preparation_order(spark, d):
    o = given(spark, d, "up_next").select("profile", "video", "released", "ord")
    return V.prepared(o, ["profile"], "video", F.col("video") == F.concat(F.lit("n"), F.col("profile") % 97), F.coalesce(F.col("released").rlike("^199[57]"), F.lit(False)), 6).select("profile", "video", "step", "place")


PREPARATION = f"""WITH {_with("up_next")}, s AS (SELECT profile, video, ord, CASE WHEN video = 'n' || profile % 97 THEN 0 WHEN released LIKE '1995%' OR released LIKE '1997%' THEN 1 ELSE 2 END AS step FROM up_next),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY profile, video ORDER BY ord) = 1)
SELECT profile, video, step, row_number() OVER (PARTITION BY profile ORDER BY step, ord) AS place FROM f QUALIFY place <= 6"""


def library_sorts(spark, d):
    p = table(spark, d, "part")
    article = F.get(F.array(*map(F.lit, ["The ", "an ", "A ", "", "Theo "])), (F.col("p_partkey") % 5).cast("int"))
    items = p.select((F.col("p_partkey") % 7).alias("shelf"), (F.col("p_partkey") % 900).alias("key"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size").cast("int")).alias("list_rank"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_size").cast("int")).alias("tracker_rank"), (F.col("p_partkey") % 50).alias("saved"), F.concat(article, "p_name").alias("title"), F.col("p_partkey").alias("id"), F.get(F.array(F.lit(" Movie"), F.lit("series ")), (F.col("p_size") % 2).cast("int")).alias("type"))
    out = None
    for sort in ("default", "added_desc", "added_asc", "title_asc", "title_desc"):
        rows = V.library_rows(items, ["shelf"], "key", "type", "MOVIE", sort).select("shelf", "id", F.col("place").alias(f"by_{sort}"))
        out = rows if out is None else out.join(rows, ["shelf", "id"])
    return out


LIBRARY = r"""WITH t AS (SELECT p_partkey % 7 AS shelf, p_partkey % 900 AS key, p_partkey AS id, CASE WHEN p_partkey % 4 < 2 THEN p_size ELSE 2147483647 END AS r, p_partkey % 50 AS saved,
  ['The ', 'an ', 'A ', '', 'Theo '][(p_partkey % 5 + 1)::INT] || p_name AS title, p_size % 2 = 0 AS movie FROM part),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY shelf, key ORDER BY id) = 1),
g AS (SELECT *, lower(title) AS tie, lower(regexp_replace(title, '^(the|an|a)\s+', '', 'i')) AS name FROM f WHERE movie)
SELECT shelf, id, row_number() OVER (PARTITION BY shelf ORDER BY r, saved DESC, tie, id) AS by_default, row_number() OVER (PARTITION BY shelf ORDER BY saved DESC, tie, id) AS by_added_desc,
  row_number() OVER (PARTITION BY shelf ORDER BY saved, tie, id) AS by_added_asc, row_number() OVER (PARTITION BY shelf ORDER BY name, id) AS by_title_asc, row_number() OVER (PARTITION BY shelf ORDER BY name DESC, id) AS by_title_desc FROM g"""


def chosen_files(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), (F.col("l_linenumber") - 1).cast("int").alias("pos"), (F.col("l_partkey") % 9).cast("int").alias("id"), F.concat(F.lit("Dir/Show S01E0"), F.col("l_linenumber"), F.lit(" "), "l_returnflag", F.lit(".mkv")).alias("name"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_quantity").cast("long")).alias("size"), (F.col("l_suppkey") % 5 != 0).alias("playable"))
    o = F.col("o_orderkey")
    text = "array<string>"
    wanted = table(spark, d, "orders").select(o.alias("request"), F.when(o % 4 == 0, F.array(F.lit("x/show_s01e02 A.avi"))).otherwise(F.array().cast(text)).alias("names"), F.when(o % 4 == 1, F.array(F.lit("s01e03"))).otherwise(F.array().cast(text)).alias("marks"), F.when(o % 3 == 0, (o % 8).cast("int")).alias("index"))
    return V.chosen_file(li, wanted, ["request"])


CHOSEN = """WITH f AS (SELECT l_orderkey AS request, (l_linenumber - 1)::INT AS pos, (l_partkey % 9)::INT AS id, l_returnflag AS mode, l_linenumber AS n, CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity::BIGINT END AS size,
  CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 8 END AS i FROM lineitem WHERE l_suppkey % 5 <> 0),
s AS (SELECT *, CASE WHEN request % 4 = 0 AND n = 2 AND mode = 'A' THEN 0 WHEN request % 4 = 1 AND n = 3 THEN 1 WHEN pos = i THEN 2 WHEN i > 0 AND pos = i - 1 THEN 3 WHEN id = i THEN 4 ELSE 5 END AS step FROM f)
SELECT request, id, 'Dir/Show S01E0' || n || ' ' || mode || '.mkv' AS name, step FROM s WHERE request IN (SELECT o_orderkey FROM orders)
QUALIFY row_number() OVER (PARTITION BY request ORDER BY step, CASE WHEN step = 5 THEN -coalesce(size, 0) ELSE 0 END, pos, id, name) = 1"""


def dialogue_lines(spark, d):
    o = F.col("o_orderkey")
    text = F.concat(F.get(F.array(*map(F.lit, [" (", "[", "(a) ", "♪ ", "", "...", "Ж"])), (o % 7).cast("int")), F.when(o % 3 != 0, F.lit("")).otherwise("o_orderpriority"), F.get(F.array(*map(F.lit, [") ", "]", ""])), (o % 5 % 3).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", V.like_dialogue(text).alias("dialogue"))


DIALOGUE = """WITH t AS (SELECT o_orderkey, trim([' (', '[', '(a) ', '♪ ', '', '...', 'Ж'][(o_orderkey % 7 + 1)::INT] || CASE WHEN o_orderkey % 3 <> 0 THEN '' ELSE o_orderpriority END || [') ', ']', ''][(o_orderkey % 5 % 3 + 1)::INT]) AS s FROM orders)
SELECT o_orderkey, NOT ((starts_with(s, '(') AND ends_with(s, ')') AND length(s) > 1) OR (starts_with(s, '[') AND ends_with(s, ']') AND length(s) > 1)) AND regexp_matches(s, '[A-Za-z0-9Ж]') AS dialogue FROM t"""

QUERIES |= {
    "overlaid_progress": (overlaid_progress, OVERLAID),
    "preparation_order": (preparation_order, PREPARATION),
    "library_sorts": (library_sorts, LIBRARY),
    "chosen_files": (chosen_files, CHOSEN),
    "dialogue_lines": (dialogue_lines, DIALOGUE),
}

# ---- subtitle files --------------------------------------------------------------------------------------------------

# Times of three cues of a file, from its number: both sides write them in the file's own form and read them back.
_AT = {1: "(p_partkey % 7200 * 1000 + 500)", 2: "(p_partkey % 7200 * 1000 + 3040)"}


def _clock(ms: str, mark: str, digits: int) -> str:
    two = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    part = f"CAST(floor({ms} / 1000) AS INT)"
    return f"concat({two(f'CAST(floor({part} / 3600) AS INT)')}, ':', {two(f'CAST(floor({part} / 60) AS INT) % 60')}, ':', {two(f'{part} % 60')}, '{mark}', lpad(CAST(CAST(floor({ms} % 1000 / {10 ** (3 - digits)}) AS INT) AS STRING), {digits}, '0'))"


def _files(spark, d, kind):
    a, b = (_clock(_AT[i], ".", 2 if kind == "ass" else 3) for i in (1, 2))
    forms = {
        "vtt": f"concat('WEBVTT\\n\\nNOTE x\\n\\n', '1\\n', {a}, ' --> ', {b}, ' align:start\\n<v.a>One</v> &amp; ', p_name, '\\n\\n', {b}, ' --> ', {a}, '\\nback\\n')",
        "ass": f"concat('[Script Info]\\n[Events]\\nFormat: Layer, Start, End, Text\\nDialogue: 0,', {a}, ',', {b}, ',{{x}}One, ', p_name, '\\nComment: 0,', {a}, ',', {b}, ',no')",
        "ttml": f"concat('<tt ttp:frameRate=\"25\"><p start=\"', {a}, '\" end=\"', {b}, '\">One ', p_name, '</p><p begin=\"00:00:10:05\" dur=\"2s\">two</p></tt>')",
    }
    return table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("track"), F.expr(forms[kind]).alias("text"))


def vtt_cues(spark, d):
    from reelforge.sources.subtitles import by_line

    return by_line(_files(spark, d, "vtt"), "vtt").select("track", "start", "end", "text")


def ass_cues(spark, d):
    from reelforge.sources.subtitles import by_line

    return by_line(_files(spark, d, "ass"), "ass").select("track", "start", "end", "text")


def ttml_cues(spark, d):
    from reelforge.sources.subtitles import ttml

    return ttml(_files(spark, d, "ttml")).select("track", "start", "end", "text")


def _cue_sql(text: str) -> str:
    return f"""SELECT CAST(p_partkey AS VARCHAR) AS track, ({_AT[1]})::BIGINT AS start, ({_AT[2]})::BIGINT AS "end", trim({text}) AS text FROM part"""


QUERIES |= {
    "vtt_cues": (vtt_cues, _cue_sql("'One & ' || p_name")),
    "ass_cues": (ass_cues, _cue_sql("'One, ' || p_name")),
    "ttml_cues": (ttml_cues, _cue_sql("'One ' || p_name") + " UNION ALL SELECT CAST(p_partkey AS VARCHAR), 10200, 12200, 'two' FROM part"),
}
