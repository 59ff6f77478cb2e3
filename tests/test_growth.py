"""Joins and Python steps on inputs whose pairs or batches would be far larger than what comes out of them."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from reelforge.functions import language
from reelforge.operators import align, catalog, choice, identity, retime, search, sequence, speech, viewing
from reelforge.plans import facts, registry
from reelforge.sources import scrapers, subtitles
from reelforge.streaming import tracker


def timed(df):
    start = time.monotonic()
    rows = df.collect()
    return rows, time.monotonic() - start


def test_a_tier_joins_one_row_for_equal_columns(spark):
    n = 60_000  # 3.6e9 pairs that agree on a tier
    wanted = spark.range(n).select(F.col("id").alias("w"), F.lit(1).alias("a"), F.lit(2).alias("b"))
    rows = spark.range(5, n).select(F.col("id").alias("r"), F.lit(9).alias("a"), F.lit(2).alias("b"))
    got, seconds = timed(identity.cascade(wanted, rows, [["a"], ["b"]], "w", "r").groupBy("tier", "r").count())
    assert [tuple(r) for r in got] == [(1, 5, n)]
    assert seconds < 25


def test_a_request_meets_the_first_of_equal_catalogs(spark):
    n = 60_000
    wanted = spark.range(n).select(F.col("id").alias("request"), F.lit("x").alias("source"), F.lit("c").alias("catalog"), F.lit("t").alias("type"))
    catalogs = spark.range(3, n).select(F.concat(F.lit("o"), "id").alias("owner"), F.lit("c").alias("id"), F.lit("t").alias("type"), F.col("id").alias("ord"), (F.col("id") > 3).alias("enabled"))
    got, seconds = timed(viewing.found_catalogs(wanted, catalogs).groupBy("owner", "found").count())
    assert [tuple(r) for r in got] == [("o4", "c", n)]
    assert seconds < 25


def test_only_rows_with_an_equal_id_or_title_meet(spark):
    n = 40_000  # 1.6e9 pairs of equal `on`, none of which agrees on x but the diagonal
    side = lambda i: spark.range(n).select(F.col("id").alias(i), F.lit(0).alias("on"), F.col("id").alias("x"), F.concat(F.lit(" T"), "id").alias("title"), F.lit(1).alias("year"))
    got, seconds = timed(identity.by_priority(side("l"), side("r"), ["x"], "on", "l", "r", 1000).agg(F.count("*"), F.count_if(F.col("l") == F.col("r"))))
    assert tuple(got[0]) == (n, n)
    assert seconds < 25


def test_lists_and_pairs_are_not_made_distinct(spark):
    edges = spark.createDataFrame([("x", "e"), ("x", "e"), ("y", "e"), ("z", "e"), ("z", "f"), (None, "e"), (None, "f")], "alias string, entity string")
    found = identity.siblings(edges, "alias", "entity")
    assert sorted((r.alias, r.others) for r in found.collect()) == [("x", ["y"]), ("y", ["x"])]
    ids = lambda own, rows: spark.createDataFrame(rows, f"{own} long, ids array<string>")
    a, b = ids("l", [(1, ["b", "a", "a", None]), (1, ["c"]), (2, ["d"]), (3, None)]), ids("r", [(7, ["a", "b", "c"]), (8, ["c", None]), (9, [])])
    pairs = identity.sharing_any(a, b, "l", "r", "ids")
    assert sorted(map(tuple, pairs.collect())) == [(1, 7), (1, 8)]
    # Above the join that makes lists or pairs nothing is grouped, so none of them is shuffled.
    for df in (found, pairs):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert "Aggregate" not in "".join(lines[: next(i for i, x in enumerate(lines) if "Join" in x)])


def test_rows_with_the_same_ids_are_compared_as_one(spark):
    ids = lambda n: F.when(F.col("id") < n - 2, F.array(F.concat(F.lit("a:"), F.col("id") % 5), F.concat(F.lit("b:"), F.col("id") % 7)))
    side = lambda n, own: spark.range(n).select(F.when(F.col("id") != 3, F.col("id")).alias(own), ids(n).alias("ids"))
    a, b = side(400, "l"), side(900, "r")
    want = sorted(((i, j) for i in range(398) for j in range(898) if i % 5 == j % 5 or i % 7 == j % 7), key=str)
    named = lambda pairs: sorted(((3 if r.l is None else r.l, 3 if r.r is None else r.r) for r in pairs), key=str)
    for block in (identity.BLOCK, 20):
        pairs = identity.sharing_any(a, b, "l", "r", "ids", block)
        rows = pairs.collect()
        assert named(rows) == want
        # Of a right one, all left ones of a class come in turn.
        assert sum(x.r != y.r for x, y in zip(rows, rows[1:], strict=False)) < len(rows) / 5
    joined = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "explode(__members_a" in "".join(joined[: next(i for i, x in enumerate(joined) if "Join" in x)])


def test_of_all_scores_and_correlations_one_row_leaves_a_pair(spark):
    r = spark.range(40).select((F.col("id") % 4).alias("film"), F.col("id").alias("ord"), (F.col("id") * 3500).alias("start"), (F.col("id") * 3500 + 900).alias("end"))
    found = search.searched(r, r, ["film"])
    assert {(x.film, x.scale, x.intercept) for x in found.collect()} == {(f, 1.0, 0) for f in range(4)}
    heard = r.select("film", F.floor(F.col("start") / 32).alias("frame"), F.concat(F.array_repeat(F.lit(0.9), 28), F.array_repeat(F.lit(0.05), 16)).alias("probabilities"))
    peaks = speech.speech_peaks(heard, r, ["film"], (-9000.0, 9000.0))
    assert peaks.count() == 4 * len(speech.SCALES)
    for df in (found, speech.speech_fit(heard, r, ["film"], (-9000.0, 9000.0))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
        assert "coarse" not in plan


def test_votes_of_one_film_pass_once(spark):
    n = 40_000  # windows of 28,000 votes each: 1.1e9 votes, were each window gone through
    votes = spark.range(n).select(F.lit("f").alias("film"), (F.col("id") / 160 + F.col("id") % 100 / 100).alias("media"), (F.col("id") / 160).alias("sub"), F.lit(1.0).alias("weight"), (F.col("id") % 9).alias("segment"), F.lit(False).alias("first"))
    for fit in (speech.word_fit(votes, ["film"]), speech.local_fits(votes, ["film"], F.lit(1.0)).filter("region = 0")):
        got, seconds = timed(fit)
        assert [(r.segments, r.sure) for r in got] == [(9, True)]
        assert seconds < 15


def test_texts_are_taken_apart_once_above_the_shuffle(spark):
    cues = spark.createDataFrame([("f", k, k, k + 1, t) for k, t in enumerate(["--", "One two", None, "''", "", "three", "<i></i>"])] + [("g", 0, 0, 1, "-")], "film string, ord long, start long, end long, text string")
    words = speech.words_of(cues.repartition(3, "film"), ["film"])
    assert [(r.word, r.cue_before, r.cue_after) for r in words.orderBy("start", "k").collect()] == [("one", None, "two"), ("two", "one", "three"), ("three", "two", None)]
    for df, shuffles in ((words, 1), (registry.queries()["local_fits"](spark, "/root/testdata/sf0.001"), 2), (registry.queries()["word_fits"](spark, "/root/testdata/sf0.001"), 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        above, *below = re.split(r"RepartitionByExpression \[(?:film|conv_id)#\d+L?\], \d", plan)
        assert len(below) == shuffles
        assert plan.count("split(") == shuffles
        assert "split(" in above
        assert "split(" not in below[-1]


def test_many_offsets_count_as_few_do():
    rng = np.random.default_rng(5)
    marks, bins = rng.random(500) < 0.3, np.flatnonzero(rng.random(320) < 0.4)
    offsets = np.arange(-900, 901)
    direct = np.concatenate([search._shared(marks, bins, part) for part in np.array_split(offsets, 60)])
    assert (search._shared(marks, bins, offsets) == direct).all()
    assert direct.max() > 20


def test_peak_of_is_refined_peak(spark):
    rows = [("a", [1.0, 4.0, 3.0, np.nan, 2.0, 0.5]), ("b", [np.nan, 1.0]), ("c", [2.0, 2.0, 2.0]), ("d", [1.0, 3.0, np.nan, 0.0])]
    flat = [(k, i, x) for k, v in rows for i, x in enumerate(v) if not np.isnan(x)]
    want = {r.k: (r.at, r.top, r.runner_up, r.refined) for r in sequence.refined_peak(spark.createDataFrame(flat, "k string, t long, v double"), ["k"], "t", "v", 1).collect()}
    assert {k: speech.peak_of(np.array(v), 1) for k, v in rows} == want
    assert speech.peak_of(np.array([np.nan]), 1) is None


def test_an_attribute_of_a_cue_is_read_once(spark):
    text = '<tt><p begin="00:00:01.000" dur="2s">a</p><p start="00:00:05:15" end="7s">b</p><p begin="9s">c</p><p begin="4s" end="3s">d</p></tt>'
    cues = subtitles.ttml(spark.createDataFrame([("f", text)], "track string, text string"))
    assert [(r.start, r.end, r.text) for r in sorted(cues.collect())] == [(1000, 3000, "a"), (5500, 7000, "b"), (9000, 12_000, "c")]
    plan = cues._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("begin\\s*=") <= 2


def test_slow_requests_wait_together(spark):
    def scraper(id_, kind, season, episode):
        if int(id_) % 2:
            time.sleep(5)
        yield {"title": id_, "url": f"{kind}/{season}/{episode}"}

    scrapers.requests_function(spark, "slow_streams", scraper, timeout_s=0.5)
    spark.range(120).createOrReplaceTempView("slow_requests")
    asked = "SELECT /*+ REPARTITION(2) */ id AS request, CAST(id AS STRING) AS id, 'movie' AS type, 1 AS season, CAST(NULL AS INT) AS episode FROM slow_requests"
    got, seconds = timed(spark.sql(f"SELECT request, ord, url, error FROM slow_streams(TABLE({asked}))"))
    late = "TimeoutError: more than 0.5 s"
    assert sorted(map(tuple, got)) == [(i, None, None, late) if i % 2 else (i, 0, "movie/1/None", None) for i in range(120)]
    assert seconds < 15  # 30 s and more one after another


def test_a_language_is_read_once_a_row(spark):
    n = 40_000
    tags = F.get(F.array(*map(F.lit, ("Portuguese (Brazil)", "pt_BR", "Old English", "zh-TW", "x-klingon", "deu-", "norwegian bokmal"))), (F.col("id") % 7).cast("int"))
    got, seconds = timed(spark.range(0, n, 1, 1).groupBy(language.language_code(tags).alias("code")).count())
    assert {r.code for r in got} == {"pt-br", "en", "zh-tw", "x-klingon", "de", "no"}
    assert seconds < 15
    tracks = spark.range(0, n, 1, 1).select((F.col("id") / 10).cast("long").alias("film"), F.col("id").alias("ord"), F.lit("Brazilian").alias("label"), tags.alias("language"), F.lit("x").alias("track"), F.lit(False).alias("forced"))
    wanted = tracks.select("film").distinct().select("film", F.lit(0).alias("position"), F.lit("pt-br").alias("target"))
    got, seconds = timed(choice.chosen_tracks(tracks, wanted, ["film"]).groupBy(F.col("ord") % 7).count())
    assert sum(r[1] for r in got) == n // 10
    assert seconds < 15


def test_pairs_are_matched_together_as_one_by_one():
    rng = np.random.default_rng(1)
    pairs = []
    for size in [*rng.integers(4, 90, 150), 400]:
        start = np.sort(rng.integers(0, 5000 * size, size)).astype(float)
        target = np.sort(start[rng.random(size) < 0.9] + rng.normal(0, 200)) if size > 20 else start + 70_000
        pairs.append((start, start + rng.integers(300, 4000, size), (rng.random(size) < 0.1).astype(int), target, target + rng.integers(1, 4000, len(target))))
    begun = time.monotonic()
    together = retime.matched_pairs(pairs)
    seconds = time.monotonic() - begun
    begun = time.monotonic()
    assert together == [retime.matched_groups(*p) for p in pairs]
    assert sum(map(len, together)) > 3000
    assert seconds < (time.monotonic() - begun) / 3


def test_folds_hold_a_batch_and_not_a_group(spark):
    runs = spark.range(8).selectExpr("id % 2 as film", "10 - id as run", "1.0D as scale", "5.0D as shift", "0.5D as peak", "0.5D as prominence", "30 as cues", "30.0D as speech", "70.0D as analysed", "false as at_edge", "id < 6 as halves", "cast(null as long) as split")
    told = tracker.tracked_table(runs, ["film"])
    assert sorted((r.film, r.run, r.outcome) for r in told.collect()) == [(f, 10 - i, "searching" if i >= 6 else "locked" if i in (4, 5) else "unchanged") for f in (0, 1) for i in (6 + f, 4 + f, 2 + f, f)]
    rows = spark.createDataFrame([(0, 1, ["a"]), (0, 2, ["b"]), (0, 3, ["a", "b"]), (0, 4, []), (0, 5, ["b", "c"]), (1, 6, ["a"]), (None, 7, [None, "x"]), (None, 8, ["x"])], "g int, at long, names array<string>")
    found = catalog.resolved_identity(rows, "g", "at", "names")
    assert sorted((r.at, r.entity) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (6, 6), (7, 7), (8, 7)]
    for df in (told, found):
        assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_bins_are_as_bins(spark):
    starts = [0, 29_500, 29_999, 30_000, 59_900, 400, 28_799_990, 28_800_000, -700, 100]
    cues = spark.createDataFrame([(i % 3, i, s, s + d) for i, s in enumerate(starts) for d in (1, 700, 19_000, 90_000, -5)], "track int, ord int, start long, end long")
    bins, words = align.activity(cues), align.activity_words(cues)
    told = words.select("track", F.explode(F.sequence(F.lit(0), F.lit(align.WORD_BINS - 1))).alias("k"), "word", "bits").filter("(shiftright(bits, k) & 1) = 1").select("track", (F.col("word") * align.WORD_BINS + F.col("k")).alias("bin"))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, bins.collect()))
    side = lambda df, t: df.filter(F.col("track") == t).withColumn("pair", F.lit(1))
    want = align.bin_jaccard(side(bins, 0), side(bins, 1), ["pair"]).collect()
    assert align.word_jaccard(side(words, 0), side(words, 1), ["pair"]).collect() == want
    assert words.count() * 10 < bins.count()


def test_costly_columns_of_a_small_file_are_dealt_to_tasks(spark):
    assert facts.preference_filter(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 4  # the filter stays above
