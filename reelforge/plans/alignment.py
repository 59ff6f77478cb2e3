"""Queries: search for scale and offset, cue groups and retimed tracks.

Each viewer's events of the table are a reference; the target is the same events with some left out, some split in two,
all moved a little, then shifted and stretched by viewer.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelforge.operators import retime as R
from reelforge.operators import search as S
from reelforge.operators import sequence as Q
from reelforge.operators import speech as V
from reelforge.operators.align import OFFSET_MS, SCALES
from reelforge.plans.merging import PROGRESS
from reelforge.plans.tables import progress, spread, table
from reelforge.streaming import tracker as T

STRETCH = (1.0, 25 / 23.976, 24 / 25)


def tracks(spark, d):
    """Reference and target cues of each profile."""
    p = progress(spark, d)
    start = F.col("stamp") % 600_000
    r = p.select("profile", F.col("event_id").alias("ord"), start.alias("start"), (start + F.floor("percent").cast("long") * 20 + 300).alias("end"), (F.col("event_id") % 29 == 0).alias("estimated"))
    kept = r.filter("ord % 17 <> 5")
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    whole = F.struct(F.lit(0).alias("part"), "start", "end")
    halves = F.array(F.struct(F.lit(0).alias("part"), "start", middle.alias("end")), F.struct(F.lit(1).alias("part"), middle.alias("start"), "end"))
    parts = kept.select("profile", "ord", F.explode(F.when(F.col("ord") % 11 == 3, halves).otherwise(F.array(whole))).alias("c")).select("profile", (F.col("ord") * 2 + F.col("c.part")).alias("ord"), "c.start", "c.end")
    scale = F.get(F.array(*map(F.lit, STRETCH)), (F.col("profile") % 3).cast("int"))
    placed = lambda t: F.floor((F.col(t) + F.col("ord") * 37 % 161 + F.col("profile") % 7 * 6000) / scale).alias(t)
    return r, parts.select("profile", "ord", placed("start"), placed("end"))


TRACKS = PROGRESS + f""", rc AS (SELECT profile, event_id AS ord, stamp % 600000 AS s, stamp % 600000 + floor(percent)::BIGINT * 20 + 300 AS e FROM p),
hc AS (SELECT profile, ord * 2 + part AS ord, CASE WHEN part = 1 THEN (s + e) // 2 ELSE s END AS s, CASE WHEN part = 0 AND ord % 11 = 3 THEN (s + e) // 2 ELSE e END AS e
  FROM rc, (SELECT unnest([0, 1]) AS part) WHERE ord % 17 <> 5 AND (part = 0 OR ord % 11 = 3)),
tc AS (SELECT profile, ord, floor((s + ord * 37 % 161 + profile % 7 * 6000) / k)::BIGINT AS s, floor((e + ord * 37 % 161 + profile % 7 * 6000) / k)::BIGINT AS e
  FROM (SELECT *, ([{', '.join(f'{x!r}::DOUBLE' for x in STRETCH)}])[(profile % 3 + 1)::INT] AS k FROM hc))"""


def scale_offset_search(spark, d):
    found = S.searched(*tracks(spark, d), ["profile"])
    return found.select("profile", F.round("scale", 9).alias("scale"), "intercept", F.round("score", 9).alias("score"), F.round("margin", 9).alias("margin"), "agreed", "covered")


def delay_only(spark, d):
    unit = S.delays(S.searched(*tracks(spark, d), ["profile"], F.array(F.lit(1.0))))
    return unit.select("profile", "intercept", F.round("score", 9).alias("score"), F.round("margin", 9).alias("margin"), "passed", "stable")


def _timeline(name: str, cues: str, width: int) -> str:
    """Bins, number of bins and running counts of active bins of scaled cues."""
    end = "floor(least(greatest(e, s + 1), s + 20000) * scale + 0.5::DOUBLE)::BIGINT"
    return f"""{name}s AS (SELECT profile, scale, floor(s * scale + 0.5::DOUBLE)::BIGINT AS a, greatest({end}, floor(s * scale + 0.5::DOUBLE)::BIGINT + 1) AS z FROM {cues}),
{name}b AS MATERIALIZED (SELECT DISTINCT profile, scale, unnest(range(a // {width}, ceil(z / {width}::DOUBLE)::BIGINT)) AS bin FROM {name}s),
{name}z AS MATERIALIZED (SELECT profile, scale, size, lo, hi, n FROM (SELECT profile, scale, ceil((max(z) + 1) / {width}::DOUBLE)::BIGINT AS size FROM {name}s GROUP BY ALL) JOIN (SELECT profile, scale, min(bin) AS lo, max(bin) AS hi, count(*) AS n FROM {name}b GROUP BY ALL) USING (profile, scale)),
{name}p AS MATERIALIZED (SELECT q.profile * 1000000 + q.bin AS at, q.scale, count(b.bin) OVER (PARTITION BY q.profile, q.scale ORDER BY q.bin) AS n FROM (SELECT profile, scale, unnest(range(-1, size)) AS bin FROM {name}z) q LEFT JOIN {name}b b ON b.profile = q.profile AND b.scale = q.scale AND b.bin = q.bin)"""


def _scored(out: str, tried: str, r: str, t: str) -> str:
    """tried (profile, scale, k, shared) with the score of each offset k."""
    return f"""{out} AS MATERIALIZED (SELECT x.profile, x.scale, x.k, (x.shared / seen * 0.72::DOUBLE + x.shared / wanted * 0.28::DOUBLE) * (0.85::DOUBLE + 0.15::DOUBLE * least(seen / tn, 1.0::DOUBLE)) AS score FROM (
  SELECT x.profile, x.scale, x.k, x.shared::DOUBLE AS shared, (b.n - a.n)::DOUBLE AS seen, (f.n - g.n)::DOUBLE AS wanted, tz.n::DOUBLE AS tn FROM {tried} x JOIN {r}z rz ON rz.profile = x.profile JOIN {t}z tz ON tz.profile = x.profile AND tz.scale = x.scale
  JOIN {t}p a ON a.scale = x.scale AND a.at = x.profile * 1000000 + greatest(0, -k) - 1 JOIN {t}p b ON b.scale = x.scale AND b.at = x.profile * 1000000 + least(tz.size - 1, rz.size - 1 - k)
  JOIN {r}p g ON g.at = x.profile * 1000000 + greatest(0, tz.lo + k) - 1 JOIN {r}p f ON f.at = x.profile * 1000000 + least(rz.size - 1, tz.hi + k)) x WHERE seen > 0 AND wanted > 0)"""


def _search(scales: str) -> str:
    base = OFFSET_MS // 500
    part = "rz.hi - rz.lo > 0 AND tz.hi - tz.lo < (rz.hi - rz.lo) * 0.75"
    return TRACKS + f""", sp AS (SELECT profile, rs, ts, te FROM (SELECT profile, max(s) - min(s) AS rs FROM rc GROUP BY profile HAVING count(*) >= 4) JOIN (SELECT profile, max(s) - min(s) AS ts, max(e) AS te FROM tc GROUP BY profile HAVING count(*) >= 4) USING (profile)),
sx AS (SELECT DISTINCT profile, scale FROM (SELECT profile, unnest({scales}) AS scale FROM sp) WHERE scale BETWEEN 0.94 AND 1.06),
sc AS MATERIALIZED (SELECT * FROM sx WHERE NOT EXISTS (SELECT 1 FROM sx y WHERE y.profile = sx.profile AND y.scale < sx.scale AND sx.scale - y.scale < 0.00035)),
rr AS (SELECT profile, s, e, 1.0::DOUBLE AS scale FROM rc), tt AS (SELECT profile, s, e, scale FROM tc JOIN sc USING (profile)),
{_timeline('cr', 'rr', 500)}, {_timeline('ct', 'tt', 500)},
ch AS MATERIALIZED (SELECT t.profile, t.scale, r.bin - t.bin AS k, count(*) AS shared FROM ctb t JOIN crb r USING (profile) JOIN crz rz USING (profile) JOIN ctz tz ON tz.profile = t.profile AND tz.scale = t.scale
  WHERE r.bin - t.bin BETWEEN CASE WHEN {part} THEN least(-{base}, rz.lo - tz.lo - {base}) ELSE -{base} END AND CASE WHEN {part} THEN greatest({base}, rz.hi - tz.hi + {base}) ELSE {base} END GROUP BY ALL),
{_scored('cs', 'ch', 'cr', 'ct')},
cb AS (SELECT profile, scale, k, score FROM cs QUALIFY row_number() OVER (PARTITION BY profile ORDER BY score DESC, scale, k) = 1),
mb AS MATERIALIZED (SELECT cb.profile, cb.scale, cb.k * 500 AS coarse, cb.score, cb.score - coalesce(max(cs.score) FILTER (greatest(abs(cs.k - cb.k) * 500, abs(te * cb.scale + cb.k * 500 - (te * cs.scale + cs.k * 500))) >= 3000), 0) AS margin FROM cb JOIN cs USING (profile) JOIN sp USING (profile) GROUP BY cb.profile, cb.scale, cb.k, cb.score),
ft AS (SELECT profile, s, e, scale FROM tc JOIN mb USING (profile)), {_timeline('fr', 'rr', 100)}, {_timeline('ff', 'ft', 100)},
fk AS (SELECT profile, scale, coarse // 100 + unnest(range(-7, 9)) AS k FROM mb),
fh AS (SELECT fk.profile, fk.scale, fk.k, count(r.bin) AS shared FROM fk JOIN ffb t ON t.profile = fk.profile LEFT JOIN frb r ON r.profile = fk.profile AND r.bin = t.bin + fk.k GROUP BY ALL),
{_scored('fs', 'fh', 'fr', 'ff')},
fb AS MATERIALIZED (SELECT profile, scale, coalesce(f.k, coarse // 100) AS k, coalesce(f.score, mb.score) AS score, margin FROM mb LEFT JOIN (SELECT profile, k, score FROM fs QUALIFY row_number() OVER (PARTITION BY profile ORDER BY score DESC, k) = 1) f USING (profile)),
th AS (SELECT profile, third, lo + span * third // 3 AS a, CASE WHEN third = 2 THEN hi ELSE lo + span * (third + 1) // 3 - 1 END AS z FROM (SELECT *, hi - lo + 1 AS span FROM ffz), (SELECT unnest([0, 1, 2]) AS third)),
tb AS MATERIALIZED (SELECT profile, third, a, z, bin, count(*) OVER (PARTITION BY profile, third) AS n FROM th JOIN ffb USING (profile) WHERE bin BETWEEN a AND z),
tk AS (SELECT tb.profile, third, d, fb.k + d AS k, min(tb.a) AS a, min(tb.z) AS z, min(tb.n) AS n, count(r.bin) AS shared FROM (SELECT * FROM tb CROSS JOIN (SELECT unnest(range(-10, 11)) AS d)) tb JOIN fb ON fb.profile = tb.profile LEFT JOIN frb r ON r.profile = tb.profile AND r.bin = tb.bin + fb.k + d GROUP BY tb.profile, third, d, fb.k),
tw AS (SELECT x.*, y.n - w.n AS wanted FROM tk x JOIN frz ON frz.profile = x.profile JOIN frp w ON w.at = x.profile * 1000000 + least(size - 1, greatest(0, a + k) - 1) JOIN frp y ON y.at = x.profile * 1000000 + greatest(-1, least(size - 1, z + k))),
tq AS (SELECT *, CASE WHEN wanted > 0 THEN shared / n::DOUBLE * 0.72::DOUBLE + shared / wanted::DOUBLE * 0.28::DOUBLE END AS score FROM tw),
tg AS (SELECT profile, count(*) FILTER (score >= 0.68 AND abs(d) <= 5) AS agreed FROM (SELECT * FROM tq WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY profile, third ORDER BY score DESC, k) = 1) GROUP BY profile),
tv AS (SELECT profile, count(*) FILTER (shared / n::DOUBLE >= 0.68) AS covered FROM tq WHERE d = 0 GROUP BY profile)"""


_LIKELY = "[" + ", ".join(f"{x!r}::DOUBLE" for x in SCALES) + ", rs / ts::DOUBLE]"
SEARCH = _search(_LIKELY) + """ SELECT profile, round(scale, 9) AS scale, k * 100 AS intercept, round(score, 9) AS score, round(margin, 9) AS margin, coalesce(agreed, 0)::INT AS agreed, covered::INT AS covered FROM fb LEFT JOIN tg USING (profile) LEFT JOIN tv USING (profile)"""
DELAY_ONLY = _search("[1.0::DOUBLE]") + """ SELECT profile, k * 100 AS intercept, round(score, 9) AS score, round(margin, 9) AS margin, agreed::INT AS passed, margin < 0.02 AS stable FROM fb JOIN tg USING (profile) JOIN (SELECT profile, count(*) AS cues FROM tc GROUP BY profile) USING (profile) WHERE score >= 0.78 AND agreed >= CASE WHEN cues < 8 THEN 2 ELSE 3 END"""


def _seeds(spark, d):
    """Scale and intercept that undo the target's shift and stretch, up to what each cue was moved."""
    p = progress(spark, d).select("profile").distinct()
    return p.select("profile", F.get(F.array(*map(F.lit, STRETCH)), (F.col("profile") % 3).cast("int")).alias("scale"), (-80.0 - F.col("profile") % 7 * 6000).alias("intercept"))


def cue_groups(spark, d):
    r, t = (R.numbered(x, ["profile"]) for x in tracks(spark, d))
    return R.cue_groups(r, t, _seeds(spark, d), ["profile"]).withColumn("cost", F.round("cost", 9))


def retimed_cues(spark, d):
    cues, _ = R.retimed(*tracks(spark, d), ["profile"])
    return cues.select("profile", "ord", "start", "end", "new_start", "new_end")


def retime_verdicts(spark, d):
    _, v = R.retimed(*tracks(spark, d), ["profile"])
    rounded = [F.round(c, 9).alias(c) for c in ("scale", "score", "margin", "target_coverage", "reference_coverage", "cost", "simple")]
    return v.select("profile", "intercept", "delay", *rounded, "skip_run", "thirds", F.round("residual", 6).alias("residual"), "confident", F.array_join("reasons", ",").alias("reasons"), "accepted", "run_ignored")


def _talk(spark, d):
    """Each conversation's turns as cues, and two of three of their words as heard, later and, of every other one, slower."""
    t = spread(table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("ord"), "text"), "conv_id")
    cues = t.select("conv_id", "ord", (F.col("ord") * 40_000).alias("start"), (F.col("ord") * 40_000 + 38_000).alias("end"), "text")
    whole = t.select("conv_id", F.col("ord").alias("segment"), F.split("text", r"\s+").alias("words")).select("*", F.size("words").alias("n"))
    # The outer kind, whose rows without a place the filter drops: for the other, Spark takes the texts apart below the shuffle too, to leave out empty ones.
    words = whole.select("conv_id", "segment", "n", F.posexplode_outer("words").alias("k", "text")).filter("k % 3 <> 1")
    scale = F.when(F.col("conv_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(25 / 24))
    at = (F.col("segment") * 40.0 + 38.0 * F.col("k") / F.col("n")) * scale + F.col("conv_id") % 90 - 45.0 + F.when((F.col("conv_id") % 5 == 0) & (F.col("segment") > 2), F.lit(7.0)).otherwise(F.lit(0.0))
    return words.select("conv_id", (F.col("segment") * 100_000 + F.col("k")).alias("ord"), at.alias("at"), "text", "segment"), cues


_BARE = r"trim(regexp_replace(lower(x), '[^\p{L}\p{Nd}'']', '', 'g'), '''')"
TALK = rf"""WITH tn AS (SELECT conv_id, turn::BIGINT AS ord, text, regexp_split_to_array(text, '\s+') AS w FROM conversations),
hw AS (SELECT conv_id, ord AS segment, len(w) AS n, unnest(range(0, len(w))) AS k, unnest(w) AS x FROM tn),
heard AS (SELECT conv_id, segment * 100000 + k AS ord, (segment * 40.0::DOUBLE + 38.0::DOUBLE * k / n) * CASE WHEN conv_id % 2 = 0 THEN 1.0::DOUBLE ELSE 25.0::DOUBLE / 24 END + conv_id % 90 - 45.0::DOUBLE
  + CASE WHEN conv_id % 5 = 0 AND segment > 2 THEN 7.0::DOUBLE ELSE 0.0::DOUBLE END AS media, {_BARE} AS word, segment FROM hw WHERE k % 3 <> 1),
cw AS (SELECT conv_id, ord, list_filter(list_transform(w, lambda x: {_BARE}), lambda x: x <> '') AS w FROM tn),
c0 AS (SELECT conv_id, ord, len(w) AS n, unnest(range(0, len(w))) AS k, unnest(w) AS word FROM cw),
c1 AS (SELECT conv_id, word, k = 0 AS first, (ord * 40000 + 38000 * k::DOUBLE / n) / 1000.0::DOUBLE AS sub, lag(word) OVER v AS cb, lead(word) OVER v AS ca, count(*) OVER (PARTITION BY conv_id, word) AS times FROM c0 WINDOW v AS (PARTITION BY conv_id ORDER BY ord, k)),
h1 AS (SELECT *, CASE WHEN lag(segment) OVER v = segment THEN lag(word) OVER v END AS hb, CASE WHEN lead(segment) OVER v = segment THEN lead(word) OVER v END AS ha FROM heard WINDOW v AS (PARTITION BY conv_id ORDER BY ord)),
votes AS MATERIALIZED (SELECT conv_id, media, sub, 1.0::DOUBLE / times + coalesce((hb = cb)::INT, 0) + coalesce((ha = ca)::INT, 0) AS weight, segment, first FROM h1 JOIN c1 USING (conv_id, word)
  WHERE times <= 6 AND length(word) >= 3 AND word NOT IN ({', '.join(f"'{w}'" for w in V.STOP_WORDS)}))"""


def _densest(out: str, votes: str, keys: str) -> str:
    window = f"(PARTITION BY {keys} ORDER BY d RANGE BETWEEN 0.7::DOUBLE PRECEDING AND CURRENT ROW)"
    return f"""{out}0 AS (SELECT *, media - scale * sub AS d FROM {votes}),
{out}1 AS (SELECT *, round(sum(weight) OVER {window} * least(len(list_distinct(list(segment) OVER {window})), 6) / 6.0::DOUBLE, 9) AS own, len(list_distinct(list(segment) OVER {window})) AS parts FROM {out}0 WHERE abs(d) <= 60),
{out}2 AS (SELECT {keys}, d AS bd, own AS score, parts AS segments FROM {out}1 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY own DESC, d) = 1),
{out}3 AS (SELECT {keys}, score, segments, CASE WHEN count(*) FILTER (first) >= 2 THEN median(d) FILTER (first) ELSE median(d) END AS shift, max(media) - min(media) AS span, median(media) AS anchor FROM {out}1 JOIN {out}2 USING ({keys}) WHERE d BETWEEN bd - 0.7::DOUBLE AND bd GROUP BY {keys}, score, segments),
{out}4 AS (SELECT {keys}, max(m) AS runner_up FROM (SELECT {keys}, sum(weight) OVER {window} AS m FROM {out}1 JOIN {out}3 USING ({keys}) WHERE abs(d - shift) > 2) GROUP BY {keys}),
{out} AS (SELECT {keys}, shift, score, segments, coalesce(runner_up, 0) AS runner_up, span, anchor, segments >= 3 AND score >= 3 AND score >= 2.5 * greatest(coalesce(runner_up, 0), 0.5) AS sure FROM {out}3 LEFT JOIN {out}4 USING ({keys}))"""


_SHOWN = [("scale", 9), ("shift", 6), ("score", 6), ("segments", None), ("runner_up", 6), ("span", 6), ("anchor", 6), ("sure", None)]


def _shown(names, of: str = "") -> str:
    return ", ".join(f"{of}{c}::INT AS {c}" if c == "segments" else f"{of}{c} AS {c}" if n is None else f"round({of}{c}, {n}) AS {c}" for c, n in names)


def word_fits(spark, d):
    f = V.word_fit(V.anchors(*_talk(spark, d), ["conv_id"]), ["conv_id"])
    return f.select("conv_id", *(F.col(c) if n is None else F.round(c, n).alias(c) for c, n in _SHOWN))


_SCALES = "[" + ", ".join(f"{x!r}::DOUBLE" for x in V.SCALES) + "]"
WORD_FITS = TALK + f""", sp AS (SELECT conv_id, max(media) - min(media) AS whole FROM votes GROUP BY conv_id),
tv AS (SELECT v.*, turn, ({_SCALES})[turn + 1] AS scale FROM votes v JOIN sp USING (conv_id), (SELECT unnest(range(0, 7)) AS turn) WHERE turn = 0 OR whole >= 180), {_densest('g', 'tv', 'conv_id, turn')},
l AS (SELECT conv_id, list({{'turn': turn, 'scale': ({_SCALES})[turn + 1], 'shift': shift, 'score': score, 'segments': segments, 'runner_up': runner_up, 'span': span, 'anchor': anchor, 'sure': sure}} ORDER BY turn) AS f FROM g GROUP BY conv_id),
b AS (SELECT conv_id, list_reduce(f, lambda a, x: CASE WHEN x.segments >= 5 AND x.score > a.score * 1.3 AND x.score > f[1].score * 1.3 THEN x ELSE a END) AS b FROM l WHERE f[1].turn = 0)
SELECT conv_id, {_shown(_SHOWN, 'b.')} FROM b"""


def local_fits(spark, d):
    f = V.local_fits(V.anchors(*_talk(spark, d), ["conv_id"]), ["conv_id"], F.lit(1.0))
    return f.select("conv_id", "region", *(F.col(c) if n is None else F.round(c, n).alias(c) for c, n in _SHOWN[1:7]))


LOCAL_FITS = TALK + f""", rv AS (SELECT *, 1.0::DOUBLE AS scale, trunc(media / 120)::BIGINT AS region FROM votes), {_densest('g', 'rv', 'conv_id, region')}
SELECT conv_id, region, {_shown(_SHOWN[1:7])} FROM g WHERE sure"""


def refined_peaks(spark, d):
    p = progress(spark, d).groupBy("profile", F.floor(F.col("stamp") / 86_400_000).alias("day")).agg(F.round(F.sum("percent"), 6).alias("v"))
    found = Q.refined_peak(p, ["profile"], "day", "v", 3)
    return found.select("profile", "at", *(F.round(c, 6).alias(c) for c in ("top", "runner_up", "refined")))


REFINED_PEAKS = PROGRESS + """, d AS (SELECT profile, stamp // 86400000 AS day, round(sum(percent), 6) AS v FROM p GROUP BY ALL), t AS (SELECT profile, day AS "at", v AS top FROM d QUALIFY row_number() OVER (PARTITION BY profile ORDER BY v DESC, day) = 1),
g AS (SELECT profile, "at", top, max(v) FILTER (abs(day - "at") > 3) AS runner_up, max(v) FILTER (day = "at" - 1) AS l, max(v) FILTER (day = "at" + 1) AS r FROM d JOIN t USING (profile) GROUP BY ALL)
SELECT profile, "at", round(top, 6) AS top, round(runner_up, 6) AS runner_up, round("at" + coalesce(CASE WHEN l - 2 * top + r < 0 THEN greatest(-0.5::DOUBLE, least(0.5::DOUBLE, 0.5::DOUBLE * (l - r) / (l - 2 * top + r))) END, 0), 6) AS refined FROM g"""


def speech_fits(spark, d):
    """Each viewer's reference cues as detected speech, half a second of silence after each and nothing known beyond."""
    r, t = tracks(spark, d)
    frames = F.greatest(F.lit(1), F.floor((F.col("end") - F.col("start")) / V.FRAME_MS)).cast("int")
    heard = r.select("profile", F.floor(F.col("start") / V.FRAME_MS).alias("frame"), F.concat(F.array_repeat(F.lit(0.9), frames), F.array_repeat(F.lit(0.05), 16)).alias("probabilities"))
    f = V.speech_fit(heard, t, ["profile"], (-60_000.0, 20_000.0))
    return f.select("profile", *(F.round(c, 6).alias(c) for c in ("scale", "shift_ms", "peak", "prominence")), "at_edge")


def _runs(spark, d):
    """Each viewer's events as a tracker's runs: what was measured follows the events' values and times."""
    p = progress(spark, d).withColumn("run", F.row_number().over(Window.partitionBy("profile").orderBy("stamp", "event_id")))
    n, wobble = F.col("run"), F.col("event_id") % 5 * 20.0
    shift = F.col("profile") % 9 * 1000.0 + F.when(F.col("event_id") % 13 == 0, 2600.0).otherwise(0.0) + wobble
    side = lambda name, value, cues: [value.alias(f"{name}_shift"), F.lit(0.5).alias(f"{name}_peak"), (F.col("percent") / 100).alias(f"{name}_prominence"), cues.cast("int").alias(f"{name}_cues"), F.lit(30.0).alias(f"{name}_speech"), (F.col("event_id") % 17 == 0).alias(f"{name}_at_edge")]
    local = F.when(F.col("event_id") % 3 == 0, shift + F.when(n > 40, 4000.0).otherwise(0.0))
    return p.select(
        "profile", n.cast("long").alias("run"), F.lit(1.0).alias("scale"), shift.alias("shift"), F.lit(0.5).alias("peak"), (F.col("percent") / 100).alias("prominence"), (n + 2).cast("int").alias("cues"), F.lit(30.0).alias("speech"), (n * 6.0).alias("analysed"),
        (F.col("event_id") % 19 == 0).alias("at_edge"), (F.col("event_id") % 2 == 0).alias("halves"), (n * 10_000).cast("long").alias("split"), *side("near", shift, n + 2), *side("local", local, F.lit(20)), *side("refined", shift, F.lit(40)),
    )


def tracked_shifts(spark, d):
    return T.tracked_table(_runs(spark, d), ["profile"])


def throughput_samples(spark, d):
    """Each viewer's events as ticks of a player, about half a second apart."""
    n = F.row_number().over(Window.partitionBy("profile").orderBy("stamp", "event_id"))
    ticks = progress(spark, d).select("profile", (n * 500 + F.col("event_id") % 5 * 90).cast("long").alias("stamp"), F.floor(F.col("percent") * 10_000).cast("long").alias("bytes"), (F.col("event_id") % 11 != 0).alias("fetching"))
    return T.samples_table(ticks, ["profile"]).withColumn("mbps", F.round("mbps", 9))


SAMPLES = PROGRESS + """, k AS (SELECT profile, event_id, (row_number() OVER (PARTITION BY profile ORDER BY stamp, event_id)) * 500 + event_id % 5 * 90 AS t, floor(percent * 10000)::BIGINT AS b, event_id % 11 <> 0 AS f FROM p),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY profile ORDER BY t) AS gap FROM k), a AS (SELECT *, CASE WHEN f AND gap > 0 AND gap <= 2000 AND b > 0 THEN gap ELSE 0 END AS ms FROM g),
s AS (SELECT *, sum(ms) OVER w AS active, sum(CASE WHEN ms > 0 THEN b ELSE 0 END) OVER w AS total FROM a WINDOW w AS (PARTITION BY profile ORDER BY t ROWS UNBOUNDED PRECEDING)),
e AS (SELECT profile, t AS "at", active::BIGINT AS active_ms, total::BIGINT AS bytes FROM s QUALIFY row_number() OVER (PARTITION BY profile ORDER BY active < 30000, CASE WHEN active >= 30000 THEN t ELSE -t END) = 1)
SELECT profile, "at", active_ms, bytes, round(bytes * 8.0::DOUBLE / active_ms / 1000.0::DOUBLE, 9) AS mbps FROM e WHERE active_ms >= 3000 AND (bytes >= 8388608 OR active_ms >= 10000)"""


QUERIES = {
    "scale_offset_search": (scale_offset_search, SEARCH),
    "delay_only": (delay_only, DELAY_ONLY),
    "cue_groups": (cue_groups, None),
    "retimed_cues": (retimed_cues, None),
    "retime_verdicts": (retime_verdicts, None),
    "word_fits": (word_fits, WORD_FITS),
    "local_fits": (local_fits, LOCAL_FITS),
    "refined_peaks": (refined_peaks, REFINED_PEAKS),
    "speech_fits": (speech_fits, None),
    "tracked_shifts": (tracked_shifts, None),
    "throughput_samples": (throughput_samples, SAMPLES),
}
