"""Queries: sequences, intervals, alignment, identity and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.operators import align as A
from reelforge.operators import identity as Y
from reelforge.operators import intervals as V
from reelforge.operators import sequence as Q
from reelforge.operators.order import last_by
from reelforge.plans.merging import PROGRESS
from reelforge.plans.tables import progress, table

TURNS = "WITH c AS (SELECT conv_id, turn, role, md5(text) AS h FROM conversations)"


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("h"))


def next_turn(spark, d):
    return Q.following(turns(spark, d), ["conv_id"], ["turn"], ["turn", "role"]).select("conv_id", "turn", "next_turn", "next_role")


NEXT_TURN = TURNS + " SELECT conv_id, turn, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def previous_turns(spark, d):
    t = turns(spark, d)
    return Q.before_target(t, t.filter("turn = 2 and conv_id % 3 > 0"), ["conv_id"], ["turn"]).select("conv_id", "turn")


PREVIOUS_TURNS = TURNS + " SELECT conv_id, turn FROM c WHERE turn < 2 OR conv_id % 3 = 0 OR conv_id NOT IN (SELECT conv_id FROM c WHERE turn = 2)"


def next_released(spark, d):
    t = turns(spark, d)
    seeds = t.filter("turn = 1")
    return Q.next_after_seed(t, seeds, ["conv_id"], ["turn"], F.col("role") == "assistant").select("conv_id", F.col("seed.turn").alias("seed"), "turn", "role")


NEXT_RELEASED = TURNS + " SELECT c.conv_id, 1 AS seed, min(turn) AS turn, 'assistant' AS role FROM c WHERE turn > 1 AND role = 'assistant' AND conv_id IN (SELECT conv_id FROM c WHERE turn = 1) GROUP BY c.conv_id"


def all_done(spark, d):
    li = table(spark, d, "lineitem")
    return Q.all_done(li.filter("l_linenumber > 1"), li.filter("l_returnflag <> 'R'"), ["l_orderkey"], ["l_linenumber"])


ALL_DONE = "WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 1), d AS (SELECT DISTINCT l_orderkey, l_linenumber, 1 AS x FROM lineitem WHERE l_returnflag <> 'R') SELECT l_orderkey FROM m LEFT JOIN d USING (l_orderkey, l_linenumber) GROUP BY l_orderkey HAVING bool_and(x IS NOT NULL)"


def late_groups(spark, d):
    p = progress(spark, d)
    return Q.without_late_groups(p, ["profile"], "title", ["stamp", "event_id"], F.col("percent") > 200).groupBy("profile").agg(F.count("*").alias("rows"))


LATE_GROUPS = PROGRESS + ", b AS (SELECT profile, title FROM p QUALIFY row_number() OVER (PARTITION BY profile, title ORDER BY stamp, event_id) = 1 AND percent > 200) SELECT profile, count(*) AS rows FROM p WHERE (profile, title) NOT IN (SELECT (profile, title) FROM b) GROUP BY profile"


def outlier_rejection(spark, d):
    return Q.without_outliers(progress(spark, d), ["profile"], ["stamp", "event_id"], "percent", 3, 60.0).select("profile", "event_id")


OUTLIERS = PROGRESS + ", m AS (SELECT *, list_sort(list(percent) OVER w) AS l, count(*) OVER (PARTITION BY profile) AS n FROM p WINDOW w AS (PARTITION BY profile ORDER BY stamp, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT profile, event_id FROM m WHERE n < 7 OR abs(percent - l[len(l) // 2 + 1]) <= 60"


def repairs(spark, d):
    c = progress(spark, d).withColumn("s", F.floor("stamp") + F.floor("percent").cast("long") * 20_000).withColumn("e", F.col("s") + 4_000_000).withColumn("old_e", F.col("stamp") + 3_000_000)
    c = Q.monotonic(c, ["profile"], ["stamp", "event_id"], "s", "start")
    return Q.trimmed_overlaps(c, ["profile"], ["stamp", "event_id"], ("stamp", "old_e"), ("start", "e"), "end").select("event_id", "start", "end")


REPAIRS = PROGRESS + """, c AS (SELECT *, stamp + floor(percent)::BIGINT * 20000 AS s, stamp + floor(percent)::BIGINT * 20000 + 4000000 AS e, stamp + 3000000 AS old_e FROM p),
m AS (SELECT *, max(s) OVER (PARTITION BY profile ORDER BY stamp, event_id ROWS UNBOUNDED PRECEDING) AS start FROM c), n AS (SELECT *, lead(stamp) OVER w AS ns, lead(start) OVER w AS nn FROM m WINDOW w AS (PARTITION BY profile ORDER BY stamp, event_id))
SELECT event_id, start, CASE WHEN old_e <= ns AND e > nn THEN nn ELSE e END AS "end" FROM n"""


def longest_run(spark, d):
    return Q.longest_run(progress(spark, d), ["profile"], ["stamp", "event_id"], F.col("percent") < 50)


LONGEST_RUN = PROGRESS + ", r AS (SELECT *, sum(CASE WHEN percent < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY profile ORDER BY stamp, event_id ROWS UNBOUNDED PRECEDING) AS g FROM p) SELECT profile, max(n)::BIGINT AS length FROM (SELECT profile, g, count(*) FILTER (percent < 50) AS n FROM r GROUP BY ALL) GROUP BY profile"


def gap_sessions(spark, d):
    return Q.sessions(progress(spark, d), ["profile"], ["stamp", "event_id"], "stamp", 20_000_000).groupBy("profile", "session").agg(F.count("*").alias("n"), F.min("stamp").alias("first"), F.max("stamp").alias("last"))


GAP_SESSIONS = PROGRESS + ", l AS (SELECT *, lag(stamp) OVER (PARTITION BY profile ORDER BY stamp, event_id) AS was FROM p), s AS (SELECT *, sum(CASE WHEN was IS NULL OR stamp - was > 20000000 THEN 1 ELSE 0 END) OVER (PARTITION BY profile ORDER BY stamp, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM l) SELECT profile, session, count(*) AS n, min(stamp) AS first, max(stamp) AS last FROM s GROUP BY ALL"


def change_points(spark, d):
    p = progress(spark, d).withColumn("v", F.floor("percent").cast("long") - 60)
    return Q.change_point(p, ["profile"], ["stamp", "event_id"], "v").select("profile", "event_id", "suffix")


CHANGE_POINTS = PROGRESS + ", s AS (SELECT *, sum(floor(percent)::BIGINT - 60) OVER (PARTITION BY profile ORDER BY stamp, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS suffix FROM p) SELECT profile, event_id, suffix FROM s QUALIFY row_number() OVER (PARTITION BY profile ORDER BY suffix DESC, stamp, event_id) = 1"


def prefix_counts(spark, d):
    e = progress(spark, d).withColumn("done", (F.col("percent") >= 90).cast("long"))
    return Q.prefix_sums(e, ["profile"], ["stamp", "event_id"], "done").select("event_id", "prefix")


PREFIX_COUNTS = PROGRESS + " SELECT event_id, sum((percent >= 90)::INT) OVER (PARTITION BY profile ORDER BY stamp, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS prefix FROM p"


def densest_window(spark, d):
    p = progress(spark, d).select("profile", F.col("stamp").alias("at"), F.lit(1.0).alias("w"), "title")
    return Q.densest_window(p, ["profile"], "at", "w", "title", 30_000_000, 3).select("profile", "ends", F.round("score", 6).alias("score"))


DENSEST = PROGRESS + ", s AS (SELECT profile, stamp, count(*) OVER w * least(len(list_distinct(list(title) OVER w)), 3) / 3.0::DOUBLE AS score FROM p WINDOW w AS (PARTITION BY profile ORDER BY stamp RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW)) SELECT profile, stamp AS ends, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY profile ORDER BY score DESC, stamp) = 1"


def peaks(spark, d):
    return Q.peak(progress(spark, d), ["profile"], "stamp", "percent", 86_400_000)


PEAKS = PROGRESS + ", t AS (SELECT profile, stamp AS top_at, percent AS top FROM p QUALIFY row_number() OVER (PARTITION BY profile ORDER BY percent DESC, stamp) = 1) SELECT profile, top_at AS \"at\", top, max(percent) FILTER (abs(stamp - top_at) > 86400000) AS runner_up FROM p JOIN t USING (profile) GROUP BY ALL"


def fold_newest(spark, d):
    p = progress(spark, d).withColumn("complete", F.col("percent") >= 90)
    return Q.fold_newest(p, ["profile", "title"], ["event_id"], "stamp", "complete", 5_000_000).select("profile", "title", "event_id")


FOLDED = PROGRESS.replace("WITH p", "WITH RECURSIVE p") + """, r AS (SELECT profile, title, event_id, stamp, percent >= 90 AS c, row_number() OVER (PARTITION BY profile, title ORDER BY event_id) AS n FROM p),
f AS (SELECT profile, title, n, event_id, stamp, c FROM r WHERE n = 1
  UNION ALL SELECT profile, title, n, CASE WHEN w THEN e ELSE event_id END, CASE WHEN w THEN s ELSE stamp END, CASE WHEN w THEN d ELSE c END FROM (
    SELECT r.profile, r.title, r.n, r.event_id AS e, r.stamp AS s, r.c AS d, f.event_id, f.stamp, f.c, CASE WHEN r.c = f.c THEN r.stamp > f.stamp WHEN r.c THEN r.stamp - f.stamp > 5000000 ELSE r.stamp - f.stamp >= -5000000 END AS w
    FROM f JOIN r ON r.profile = f.profile AND r.title = f.title AND r.n = f.n + 1))
SELECT profile, title, event_id FROM f QUALIFY row_number() OVER (PARTITION BY profile, title ORDER BY n DESC) = 1"""


SPANS = PROGRESS + ", s AS (SELECT profile, stamp AS a, stamp + floor(percent)::BIGINT * 50000 AS b, event_id AS span_id FROM p WHERE title = 'purchase'), v AS (SELECT profile, stamp, event_id FROM p WHERE title = 'view')"


def _spans(spark, d):
    p = progress(spark, d)
    s = p.filter("title = 'purchase'").select("profile", F.col("stamp").alias("a"), (F.col("stamp") + F.floor("percent").cast("long") * 50_000).alias("b"), F.col("event_id").alias("span_id"))
    return s, p.filter("title = 'view'").select("profile", "stamp", "event_id")


def asof_last_event(spark, d):
    s, v = _spans(spark, d)
    right = s.select("profile", F.col("a").alias("stamp"), "span_id")
    return V.as_of(v, right, ["profile"], "stamp", ["span_id"], clamp=True).select("event_id", F.col("found.span_id").alias("span_id"))


ASOF_LAST = SPANS + " SELECT event_id, coalesce((SELECT max({'a': a, 'i': span_id}).i FROM s WHERE s.profile = v.profile AND a <= stamp), (SELECT min({'a': a, 'i': -span_id}).i * -1 FROM s WHERE s.profile = v.profile)) AS span_id FROM v"


def lower_bound_event(spark, d):
    s, v = _spans(spark, d)
    return V.as_of(v, s.select("profile", F.col("a").alias("stamp"), "span_id"), ["profile"], "stamp", ["span_id"], forward=True).select("event_id", F.col("found.at").alias("at"))


LOWER_BOUND = SPANS + " SELECT event_id, (SELECT min(a) FROM s WHERE s.profile = v.profile AND a >= stamp) AS at FROM v"


def nearest_event(spark, d):
    s, v = _spans(spark, d)
    return V.nearest(v, s.select("profile", F.col("a").alias("stamp")), ["profile"], "stamp", 40_000_000).select("event_id", "off")


NEAREST = SPANS + ", n AS (SELECT event_id, (SELECT min(abs(a - stamp)) FROM s WHERE s.profile = v.profile) AS x FROM v) SELECT event_id, CASE WHEN x <= 40000000 THEN x END AS off FROM n"


def point_in_interval(spark, d):
    s, v = _spans(spark, d)
    return V.points_in(v, s, ["profile"], "stamp", "a", "b", 10_000_000).select("event_id", "span_id")


POINT_IN = SPANS + " SELECT event_id, span_id FROM v JOIN s ON v.profile = s.profile AND stamp >= a AND stamp < b"


def overlap_pairs(spark, d):
    s, _ = _spans(spark, d)
    o = s.select("profile", F.col("a").alias("c"), F.col("b").alias("e"), F.col("span_id").alias("other"))
    return V.overlapping(s.filter("b > a"), o.filter("e > c"), ["profile"], ("a", "b"), ("c", "e"), 10_000_000).filter("span_id < other").select("span_id", "other")


OVERLAP = SPANS + " SELECT x.span_id, y.span_id AS other FROM s x JOIN s y ON x.profile = y.profile AND x.span_id < y.span_id AND x.a < y.b AND y.a < x.b AND x.b > x.a AND y.b > y.a"


def overlap_trim(spark, d):
    s, v = _spans(spark, d)
    return V.trimmed_at(s, v, ["profile"], "a", "b", "stamp", 10_000_000)


OVERLAP_TRIM = SPANS + ", c AS (SELECT s.*, coalesce((SELECT min(stamp) FROM v WHERE v.profile = s.profile AND stamp >= a AND stamp < b), b) AS e FROM s) SELECT profile, a, e AS b, span_id FROM c WHERE e > a"


def one_per_category(spark, d):
    p = progress(spark, d)
    return V.one_per_category(p.withColumn("prio", F.col("event_id") % 4), ["profile"], "title", "prio", ["stamp", "event_id"]).select("profile", "title", "prio", "event_id")


ONE_PER_CATEGORY = PROGRESS + " SELECT profile, title, event_id % 4 AS prio, event_id FROM p QUALIFY row_number() OVER (PARTITION BY profile, title ORDER BY event_id % 4, stamp, event_id) = 1"


def _cues(spark, d):
    p = progress(spark, d)
    return p.select(F.col("profile").alias("track"), (F.col("stamp") % 3_600_000).alias("start"), (F.col("stamp") % 3_600_000 + F.floor("percent").cast("long") * 100).alias("end"), F.col("event_id").alias("ord"), F.col("title").alias("text"))


CUES = PROGRESS + ', c AS (SELECT profile AS track, stamp % 3600000 AS start, stamp % 3600000 + floor(percent)::BIGINT * 100 AS "end", event_id AS ord, title AS text FROM p), b AS (SELECT DISTINCT track, unnest(range(start // 500, (least("end", start + 20000) - 1) // 500 + 1)) AS bin FROM c WHERE "end" > start)'


def activity_bins(spark, d):
    return A.activity(_cues(spark, d))


ACTIVITY_BINS = CUES + " SELECT track, bin FROM b"


def _pairs(spark, d):
    b = A.activity(_cues(spark, d))
    near = b.withColumn("pair", F.floor(F.col("track") / 2))
    return near.filter("track % 2 = 0"), near.filter("track % 2 = 1")


def bin_jaccard(spark, d):
    words = A.activity_words(_cues(spark, d)).withColumn("pair", F.floor(F.col("track") / 2))
    found = A.word_jaccard(words.filter("track % 2 = 0"), words.filter("track % 2 = 1"), ["pair"])
    return found.select("pair", F.round("jaccard", 9).alias("jaccard"))


BIN_JACCARD = CUES + ", u AS (SELECT track // 2 AS pair, bin, count(DISTINCT track) AS n FROM b GROUP BY ALL) SELECT pair, round(count(*) FILTER (n = 2) / count(*)::DOUBLE, 9) AS jaccard FROM u GROUP BY pair"


def shift_scores(spark, d):
    a, b = _pairs(spark, d)
    return A.best_offset(A.offset_scores(a, b, ["pair"], 40), ["pair"], 5).select("pair", "offset", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


SHIFT_SCORES = CUES + """, r AS (SELECT track // 2 AS pair, bin FROM b WHERE track % 2 = 0), t AS (SELECT track // 2 AS pair, bin FROM b WHERE track % 2 = 1),
o AS (SELECT pair, bin, unnest(range(-40, 41)) AS k FROM t), h AS (SELECT o.pair, k, count(*) AS shared FROM o JOIN r ON r.pair = o.pair AND r.bin = o.bin + k GROUP BY ALL),
z AS (SELECT pair, min(bin) AS lo, max(bin) AS hi, count(*) AS n FROM r GROUP BY pair), y AS (SELECT pair, count(*) AS m FROM t GROUP BY pair), v AS (SELECT o.pair, k, count(*) AS seen FROM o JOIN z USING (pair) WHERE o.bin + k BETWEEN lo AND hi GROUP BY ALL),
s AS (SELECT pair, k, (0.72::DOUBLE * shared / seen + 0.28::DOUBLE * shared / n) * (0.85::DOUBLE + 0.15::DOUBLE * seen / m) AS score FROM h JOIN v USING (pair, k) JOIN z USING (pair) JOIN y USING (pair)),
w AS (SELECT pair, k, score FROM s QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(score, 9) DESC, abs(k), k) = 1)
SELECT w.pair, w.k AS "offset", round(w.score, 6) AS score, round(w.score - coalesce(max(s.score) FILTER (abs(s.k - w.k) > 5), 0), 6) AS margin FROM w JOIN s USING (pair) GROUP BY w.pair, w.k, w.score"""


def wide_shift_scores(spark, d):
    a, b = _pairs(spark, d)
    return A.best_offset(A.offset_scores(a, b, ["pair"], A.OFFSET_MS // A.COARSE_MS), ["pair"], 5).select("pair", "offset", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


WIDE_SHIFT_SCORES = SHIFT_SCORES.replace("range(-40, 41)", "range(-360, 361)")


def scale_candidates(spark, d):
    ends = _cues(spark, d).groupBy("track").agg(F.min("start").alias("lo"), (F.max("start") - F.min("start")).alias("span"), F.min(F.floor(F.col("start") / 500)).alias("first"), F.max(F.floor(F.col("start") / 500)).alias("last"))
    side = lambda x: ends.filter(F.col("track") % 2 == x).select(F.floor(F.col("track") / 2).alias("pair"), *(F.col(c).alias(f"{c}{x}") for c in ("span", "first", "last")))
    both = side(0).join(side(1), "pair")
    scales = F.array_join(F.transform(A.scale_candidates(F.col("span0"), F.col("span1")), lambda x: F.round(x, 4).cast("string")), ",")
    low, high = A.offset_range((F.col("first0"), F.col("last0")), (F.col("first1"), F.col("last1") - F.when(F.col("pair") % 3 == 0, 3000).otherwise(0)))
    return both.select("pair", scales.alias("scales"), low.cast("long").alias("low"), high.cast("long").alias("high"))


SCALE_CANDIDATES = CUES + """, e AS (SELECT track, max(start) - min(start) AS span, min(start) // 500 AS f, max(start) // 500 AS l FROM c GROUP BY track),
g AS (SELECT x.track // 2 AS pair, x.span AS rs, y.span AS ts, x.f AS rf, x.l AS rl, y.f AS tf, y.l - CASE WHEN x.track // 2 % 3 = 0 THEN 3000 ELSE 0 END AS tl FROM e x JOIN e y ON y.track = x.track + 1 WHERE x.track % 2 = 0),
s AS (SELECT pair, unnest([1.0::DOUBLE, 25.0 / 23.976, 23.976 / 25.0, 25.0 / 24.0, 24.0 / 25.0, 24.0 / 23.976, 23.976 / 24.0, rs::DOUBLE / ts]) AS x FROM g),
u AS (SELECT DISTINCT pair, x FROM s WHERE x BETWEEN 0.94 AND 1.06),
k AS (SELECT pair, x FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.pair = u.pair AND v.x < u.x AND u.x - v.x < 0.00035))
SELECT g.pair, string_agg(round(x, 4)::VARCHAR, ',' ORDER BY x) AS scales,
  CASE WHEN tl - tf >= (rl - rf) * 0.75 THEN -360 ELSE least(-360, rf - tf - 360) END::BIGINT AS low,
  CASE WHEN tl - tf >= (rl - rf) * 0.75 THEN 360 ELSE greatest(360, rl - tl + 360) END::BIGINT AS high
FROM g JOIN k ON k.pair = g.pair GROUP BY ALL"""


def constant_shift(spark, d):
    t = turns(spark, d)
    a = t.select("conv_id", F.col("turn").alias("ord"), (F.col("turn") * 1000).alias("start"), (F.col("turn") * 1000 + 500).alias("end"))
    b = a.filter("conv_id % 5 <> 0 or ord < 2").withColumn("start", F.col("start") + F.when(F.col("conv_id") % 3 == 0, F.col("ord")).otherwise(250)).withColumn("end", F.col("end") + 250)
    return A.constant_shift(a, b, ["conv_id"])


CONSTANT_SHIFT = TURNS + ", n AS (SELECT conv_id, max(turn) AS m FROM c GROUP BY conv_id) SELECT conv_id, 250::BIGINT AS shift FROM n WHERE (conv_id % 5 <> 0 OR m < 2) AND conv_id % 3 <> 0"


def ambiguous_ids(spark, d):
    li = table(spark, d, "lineitem")
    return Y.ambiguous(li, "l_partkey", "l_suppkey")


AMBIGUOUS_IDS = "SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1"


def identity_siblings(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("alias"), F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("entity"))
    return Y.siblings(c, "alias", "entity").select("alias", F.array_join("others", ",").alias("others"))


IDENTITY_SIBLINGS = "WITH c AS (SELECT c_name AS alias, c_mktsegment || '-' || c_nationkey AS entity FROM customer), k AS (SELECT alias, min(entity) AS entity FROM c GROUP BY alias HAVING count(DISTINCT entity) = 1), s AS (SELECT entity, list_sort(list(alias)) AS l FROM k GROUP BY entity) SELECT alias, array_to_string(list_filter(l, lambda x: x <> alias), ',') AS others FROM k JOIN s USING (entity)"


def shared_any_id(spark, d):
    ids = lambda a, b: F.array(F.concat(F.lit("a:"), a.cast("string")), F.concat(F.lit("b:"), b.cast("string")))
    s = table(spark, d, "supplier").select("s_suppkey", ids(F.col("s_nationkey"), F.col("s_suppkey") % 37).alias("ids"))
    c = table(spark, d, "customer").select("c_custkey", ids(F.col("c_nationkey"), F.col("c_custkey") % 37).alias("ids"))
    return Y.sharing_any(s, c, "s_suppkey", "c_custkey", "ids")


SHARED_ANY = "SELECT s_suppkey, c_custkey FROM supplier, customer WHERE s_nationkey = c_nationkey OR s_suppkey % 37 = c_custkey % 37"


def id_priority(spark, d):
    def side(df, k, nation, name):
        return df.select(F.col(k), F.when(F.col(k) % 2 == 0, F.col(k) % 9).alias("x"), F.when(F.col(k) % 3 == 0, F.col(k) % 5).alias("y"), F.concat(F.lit("T"), (F.col(k) % 4).cast("string")).alias("title"), F.when(F.col(k) % 5 > 0, F.col(k) % 3).alias("year"), F.col(nation).alias("on"))

    s, c = side(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", "s_name"), side(table(spark, d, "customer"), "c_custkey", "c_nationkey", "c_name")
    return Y.by_priority(s, c, ["x", "y"], "on", "s_suppkey", "c_custkey")


ID_PRIORITY = "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE CASE WHEN s_suppkey % 2 = 0 AND c_custkey % 2 = 0 THEN s_suppkey % 9 = c_custkey % 9 WHEN s_suppkey % 3 = 0 AND c_custkey % 3 = 0 THEN s_suppkey % 5 = c_custkey % 5 ELSE s_suppkey % 4 = c_custkey % 4 AND (s_suppkey % 5 = 0 OR c_custkey % 5 = 0 OR s_suppkey % 3 = c_custkey % 3) END"


def membership_sets(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.concat("l_returnflag", "l_linestatus").alias("list"), F.col("l_linenumber").alias("rank"), F.col("l_orderkey").alias("stamp"), F.col("l_suppkey").cast("string").alias("genre"))
    out = Y.combined(li, "entity", "list", "rank", "stamp", "genre")
    return out.select("entity", F.array_join("lists", ",").alias("lists"), F.array_join(F.map_values("ranks").cast("array<string>"), ",").alias("ranks"), "saved", F.array_join("genres", ",").alias("genres"))


MEMBERSHIP = "WITH l AS (SELECT l_partkey AS entity, l_returnflag || l_linestatus AS k, l_linenumber AS r, l_orderkey AS s, l_suppkey::VARCHAR AS g FROM lineitem), x AS (SELECT entity, max(s) AS saved, string_agg(DISTINCT g, ',' ORDER BY g) AS genres FROM l GROUP BY entity), m AS (SELECT entity, k, min(r) AS r FROM l GROUP BY ALL) SELECT entity, string_agg(k, ',' ORDER BY k) AS lists, string_agg(r::VARCHAR, ',' ORDER BY k) AS ranks, any_value(saved) AS saved, any_value(genres) AS genres FROM m JOIN x USING (entity) GROUP BY entity"


def same_structure(spark, d):
    t = turns(spark, d)
    return Y.same_structure(t, t.filter("conv_id % 7 <> 0 or turn <> 1"), ["conv_id"], "role")


SAME_STRUCTURE = TURNS + " SELECT conv_id, NOT (conv_id % 7 = 0 AND bool_or(turn = 1)) AS same FROM c GROUP BY conv_id"


def remapped_episodes(spark, d):
    t = turns(spark, d).withColumn("title", F.when(F.col("turn") % 3 == 2, "same").otherwise(F.col("h")))
    target = t.withColumn("place", F.col("turn") + F.when(F.col("conv_id") % 2 == 0, 1).otherwise(0)).select("conv_id", "title", "place", F.col("turn").alias("to"))
    return Y.remapped(t.select("conv_id", "title", F.col("turn").alias("place"), F.col("turn").alias("from")), target, ["conv_id"], "title", "place", "from", "to")


REMAPPED = TURNS + ", t AS (SELECT *, CASE WHEN turn % 3 = 2 THEN 'same' ELSE h END AS title FROM c), u AS (SELECT conv_id, title FROM t GROUP BY ALL HAVING count(*) = 1) SELECT t.conv_id, t.turn AS \"from\", coalesce(CASE WHEN u.title IS NOT NULL THEN t.turn END, p.turn) AS mapped FROM t LEFT JOIN u USING (conv_id, title) LEFT JOIN t p ON p.conv_id = t.conv_id AND p.turn + (CASE WHEN p.conv_id % 2 = 0 THEN 1 ELSE 0 END) = t.turn"


def cascading_match(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 50).alias("a"), (F.col("s_suppkey") % 20).alias("b"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 50).alias("a"), (F.col("c_custkey") % 20).alias("b"))
    return Y.cascade(s, c, [["nation", "a"], ["nation", "b"], ["nation"]], "s_suppkey", "c_custkey")


CASCADING = "WITH c AS (SELECT * FROM customer), m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 50 = c_custkey % 50 THEN 0 WHEN s_suppkey % 20 = c_custkey % 20 THEN 1 ELSE 2 END AS tier, c_custkey FROM supplier JOIN c ON s_nationkey = c_nationkey) SELECT s_suppkey, tier, c_custkey FROM m QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY tier, c_custkey) = 1"


def primary_action(spark, d):
    p = progress(spark, d)
    newest = last_by(p, ["profile"], ["stamp", "event_id"]).select("profile", F.col("stamp").alias("r"), F.col("percent").alias("rp"), F.col("title").alias("rt"))
    done = last_by(p.filter("percent >= 90"), ["profile"], ["stamp", "event_id"]).select("profile", F.col("stamp").alias("c"), F.col("title").alias("ct"))
    out = newest.join(done, "profile", "left")
    resume = (F.col("rp") < 90) & (F.col("c").isNull() | (F.col("r") > F.col("c")))
    return out.select("profile", F.when(resume, "RESUME").when(F.col("c").isNotNull(), "UP_NEXT").otherwise("FIRST").alias("action"), F.when(resume, F.col("rt")).otherwise(F.col("ct")).alias("of"))


PRIMARY_ACTION = PROGRESS + ", n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY profile ORDER BY stamp DESC, event_id DESC) = 1), d AS (SELECT * FROM p WHERE percent >= 90 QUALIFY row_number() OVER (PARTITION BY profile ORDER BY stamp DESC, event_id DESC) = 1) SELECT n.profile, CASE WHEN n.percent < 90 AND (d.stamp IS NULL OR n.stamp > d.stamp) THEN 'RESUME' WHEN d.stamp IS NOT NULL THEN 'UP_NEXT' ELSE 'FIRST' END AS action, CASE WHEN n.percent < 90 AND (d.stamp IS NULL OR n.stamp > d.stamp) THEN n.title ELSE d.title END AS \"of\" FROM n LEFT JOIN d ON d.profile = n.profile"


QUERIES = {
    "next_turn": (next_turn, NEXT_TURN),
    "previous_turns": (previous_turns, PREVIOUS_TURNS),
    "next_released": (next_released, NEXT_RELEASED),
    "all_done_rollup": (all_done, ALL_DONE),
    "late_groups": (late_groups, LATE_GROUPS),
    "outlier_rejection": (outlier_rejection, OUTLIERS),
    "timing_repairs": (repairs, REPAIRS),
    "longest_run": (longest_run, LONGEST_RUN),
    "gap_sessions": (gap_sessions, GAP_SESSIONS),
    "change_points": (change_points, CHANGE_POINTS),
    "prefix_counts": (prefix_counts, PREFIX_COUNTS),
    "densest_window": (densest_window, DENSEST),
    "peaks": (peaks, PEAKS),
    "fold_newest": (fold_newest, FOLDED),
    "asof_last_event": (asof_last_event, ASOF_LAST),
    "lower_bound_event": (lower_bound_event, LOWER_BOUND),
    "nearest_event": (nearest_event, NEAREST),
    "point_in_interval": (point_in_interval, POINT_IN),
    "overlap_pairs": (overlap_pairs, OVERLAP),
    "overlap_trim": (overlap_trim, OVERLAP_TRIM),
    "one_per_category": (one_per_category, ONE_PER_CATEGORY),
    "activity_bins": (activity_bins, ACTIVITY_BINS),
    "bin_jaccard": (bin_jaccard, BIN_JACCARD),
    "shift_scores": (shift_scores, SHIFT_SCORES),
    "wide_shift_scores": (wide_shift_scores, WIDE_SHIFT_SCORES),
    "scale_candidates": (scale_candidates, SCALE_CANDIDATES),
    "constant_shift": (constant_shift, CONSTANT_SHIFT),
    "ambiguous_ids": (ambiguous_ids, AMBIGUOUS_IDS),
    "identity_siblings": (identity_siblings, IDENTITY_SIBLINGS),
    "shared_any_id": (shared_any_id, SHARED_ANY),
    "id_priority": (id_priority, ID_PRIORITY),
    "membership_sets": (membership_sets, MEMBERSHIP),
    "same_structure": (same_structure, SAME_STRUCTURE),
    "remapped_episodes": (remapped_episodes, REMAPPED),
    "cascading_match": (cascading_match, CASCADING),
    "primary_action": (primary_action, PRIMARY_ACTION),
}
