import random

import pandas as pd
from pyspark.sql import functions as F

from reelforge.operators import align, identity, intervals, merge, order, sequence
from reelforge.sources import subtitles
from reelforge.streaming import cdc, state


def test_first_and_last_do_not_depend_on_input_order(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", None, "n"), ("b", 3, "m")]
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, 5), "k string, t int, v string").repartition(3)
        assert sorted(r.v for r in order.first_by(df, ["k"], ["t", "v"]).collect()) == ["n", "x"]
        assert sorted(r.v for r in order.last_by(df, ["k"], ["t", "v"]).collect()) == ["m", "z"]


def test_change_log(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    ev = spark.createDataFrame([(5, 1, " Upsert", "A"), (6, 1, "delete", None), (7, 2, "other", "x"), (8, 4, "upsert", "d"), (9, 3, "upsert", "C"), (10, 9, "delete", None)], "event_id int, k int, operation string, v string")
    got = lambda **x: sorted((r.k, r.v) for r in merge.apply_change_log(cur, ev, ["k"], **x).collect())
    assert got() == [(2, "b"), (3, "C"), (4, "d")]
    assert got(pending=cur.filter("k = 1")) == [(1, "a"), (2, "b"), (3, "C"), (4, "d")]
    assert got() == sorted((r.k, r.v) for r in merge.apply_change_log(merge.apply_change_log(cur, ev, ["k"]), ev, ["k"]).collect())


def test_dirty_rows(spark):
    server = spark.createDataFrame([(1, 10, "s"), (2, 10, "s"), (3, 10, "s")], "k int, t int, v string")
    local = spark.createDataFrame([(1, 11, "l", True), (2, 9, "l", True), (3, 11, "l", False), (4, 1, "l", True), (5, 1, "l", False)], "k int, t int, v string, dirty boolean")
    assert sorted((r.k, r.v) for r in merge.snapshot_preserving(server, local, ["k"], ["t"], "dirty").collect()) == [(1, "l"), (2, "s"), (3, "s"), (4, "l")]


def test_round_robin_cap_is_checked_per_round(spark):
    df = spark.createDataFrame([(s, i) for s in "abc" for i in range(4 if s != "c" else 1)], "s string, i int")
    got = [(r.s, r.i) for r in order.round_robin(df, "s", ["i"], 4).orderBy("place").collect()]
    assert got == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("b", 1)]


def test_as_of_and_intervals_equal_loops(spark):
    pick = random.Random(4)
    pts = [(i, pick.randrange(3), pick.randrange(1000)) for i in range(200)]
    spans = [(i, pick.randrange(3), a := pick.randrange(1000), a + pick.randrange(0, 120)) for i in range(60)]
    p, s = spark.createDataFrame(pts, "i int, k int, t int"), spark.createDataFrame(spans, "j int, k int, a int, b int")
    got = {(r.i, r.j) for r in intervals.points_in(p, s, ["k"], "t", "a", "b", 50).collect()}
    assert got == {(i, j) for i, k, t in pts for j, k2, a, b in spans if k == k2 and a <= t < b}
    o = s.select("k", F.col("a").alias("c"), F.col("b").alias("e"), F.col("j").alias("j2"))
    pairs = intervals.overlapping(s.filter("b > a"), o.filter("e > c"), ["k"], ("a", "b"), ("c", "e"), 50).collect()
    want = {(j, j2) for j, k, a, b in spans for j2, k2, c, e in spans if k == k2 and a < e and c < b and a < b and c < e}
    assert {(r.j, r.j2) for r in pairs} == want
    assert len(pairs) == len(want)
    right = s.select("k", F.col("a").alias("t"), "j")
    for forward in (False, True):
        rows = intervals.as_of(p, right, ["k"], "t", ["j"], forward=forward).collect()
        for r in rows:
            near = [(a, j) for j, k, a, _ in spans if k == r.k and (a >= r.t if forward else a <= r.t)]
            at = (min if forward else max)((x for x, _ in near), default=None)
            assert (r.found.at if r.found else None) == at


def test_longest_run_and_median(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 1, 1, 0, 1, 1, 1])] + [("b", 0, 0)], "k string, i int, v int")
    assert {r.k: r.length for r in sequence.longest_run(df, ["k"], ["i"], F.col("v") == 1).collect()} == {"a": 3, "b": 0}
    few = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 0, 0, 900, 0, 0])], "k string, i int, v double")
    assert sequence.without_outliers(few, ["k"], ["i"], "v").count() == 6
    many = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 0, 0, 900, 0, 0, 0])], "k string, i int, v double")
    assert sequence.without_outliers(many, ["k"], ["i"], "v").count() == 6


def test_fold_is_no_order(spark):
    rows = [(1, 1000, False), (2, 1900, True), (3, 2500, True), (4, 1600, False), (5, 1500, False)]
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, i int, t int, done boolean")
    held = [sequence.fold_newest(df.filter(f"i <= {n}"), ["k"], ["i"], "t", "done", 1000).first().i for n in range(1, 6)]
    assert held == [1, 1, 3, 4, 4]


def test_identity(spark):
    edges = spark.createDataFrame([("x", 1), ("y", 1), ("z", 2), ("z", 1), ("w", 2)], "alias string, entity int")
    assert [r.alias for r in identity.ambiguous(edges, "alias", "entity").collect()] == ["z"]
    assert {r.alias: r.others for r in identity.siblings(edges, "alias", "entity").collect()} == {"x": ["y"], "y": ["x"], "w": []}
    schema = "id int, on int, x int, y int, title string, year int"
    a = spark.createDataFrame([(1, 0, 5, 7, "T", 2000), (2, 0, None, None, "t", None)], schema)
    b = spark.createDataFrame([(10, 0, 6, 7, "T", 2000), (11, 0, None, 7, "Q", 1), (12, 0, None, None, "T", 2001)], schema).withColumnRenamed("id", "id2")
    got = {(r.id, r.id2) for r in identity.by_priority(a, b, ["x", "y"], "on", "id", "id2").collect()}
    assert got == {(1, 11), (2, 10), (2, 12)}


def test_best_offset_finds_a_shift(spark):
    pick = random.Random(8)
    cues = [(i, s := pick.randrange(600_000), s + pick.randrange(800, 3000)) for i in range(120)]
    make = lambda d: align.activity(spark.createDataFrame([(0, i, s + d, e + d) for i, s, e in cues], "track int, ord int, start long, end long"))
    ref, other = (x.withColumnRenamed("track", "k") for x in (make(20_000), make(0)))
    best = align.best_offset(align.offset_scores(ref, other, ["k"], 60), ["k"], 5).first()
    assert best.offset == 40
    assert best.margin > 0.1


def test_subtitles(spark):
    f = lambda t: spark.createDataFrame([("f", t)], "track string, text string")
    rows = lambda df: [(r.start, r.end, r.text) for r in df.orderBy("ord").collect()]
    srt = "1\r\n00:00:01,500 --> 00:00:02,000 X1:1\r\n<b>Hi</b>\r\nyou\r\n\r\n00:00:05,000 --> 00:00:04,000\nback\n\n3\nno timing\n\n4\n0:0:9.5 --> 0:0:10\n\n"
    assert rows(subtitles.srt(f(srt))) == [(1500, 2000, "Hi\nyou")]
    vtt = "WEBVTT\n\nNOTE a\nb\n\nSTYLE\n::cue{}\n\nid\n00:01.000 --> 00:02.000 align:left\n<c>x</c> &amp; y\n\n00:03.000 --> 00:04.000\nz"
    assert rows(subtitles.by_line(f(vtt), "vtt")) == [(1000, 2000, "x & y"), (3000, 4000, "z")]
    ass = "[Script Info]\n[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.50,{\\i1}a, b\\Nc\nComment: 0:00:01.00,0:00:02.50,no"
    assert rows(subtitles.by_line(f(ass), "ass")) == [(1000, 2500, "a, b\nc")]
    ttml = '<tt><p begin="00:00:01.0" end="00:00:02.0">a<br/>b</p><p begin="5s">c</p><p end="1s">d</p></tt>'
    assert rows(subtitles.ttml(f(ttml))) == [(1000, 2000, "a\nb"), (5000, 8000, "c")]
    framed = '<tt xmlns:ttp="x" ttp:frameRate="25"><p begin="00:00:10:12" end="00:00:12:00">Frame rated</p><p xml:id="q" start="1.5s" dur="500ms">s</p></tt>'
    assert rows(subtitles.ttml(f(framed))) == [(10480, 12000, "Frame rated"), (1500, 2000, "s")]
    ratio = '<tt ttp:frameRate="30" ttp:frameRateMultiplier="1000 1001"><p begin="00:00:10:15" end="00:00:11:00">x</p></tt>'
    assert rows(subtitles.ttml(f(ratio))) == [(10500, 11000, "x")]
    assert rows(subtitles.ttml(f('<tt ttp:frameRate="0"><p begin="00:01:12:15" end="00:01:13:00">x</p></tt>'))) == [(72500, 73000, "x")]
    kinds = spark.createDataFrame([("a.VTT?x", ""), ("", "WEBVTT"), ("x.ssa", ""), ("", "<tt xmlns>"), ("", "1\n")], "n string, t string")
    assert [r.k for r in kinds.select(subtitles.kind_of(F.col("t"), F.col("n")).alias("k")).collect()] == ["vtt", "vtt", "ass", "ttml", "srt"]
    tiles = "WEBVTT\n\n00:00.000 --> 00:10.000\ns.jpg#xywh=0,1,2,3\n\n00:10.000 --> 00:20.000\nbad\n"
    assert [(r.start, r.sheet, r.y, r.h) for r in subtitles.sprite_tiles(f(tiles)).collect()] == [(0, "s.jpg", 1, 3)]


def writes(*rows):
    return pd.DataFrame(rows, columns=["signature", "stamp"])


def test_stateful_rules():
    one, keep = state.repeated_writes(None, writes(("A", 0), ("B", 1000), ("A", 2000), ("A", 4000), ("A", 7001)))
    assert keep == [True, True, True, False, True]
    assert state.repeated_writes(one, writes(("A", 8000), ("C", 8001)))[1] == [False, True]
    held, keep = state.rate_limit(None, writes(*[("", i * 1000) for i in range(8)]))
    assert keep == [True] * 6 + [False] * 2
    assert state.rate_limit(held, writes(("", 60_000), ("", 60_001)))[1] == [False, True]
    held, keep = state.active_time(None, writes(*[("", i * 1500) for i in range(25)]))
    assert keep.count(True) == 21
    assert state.active_time(None, writes(*[("", i * 2500) for i in range(25)]))[1] == [True] * 25


def test_streams_equal_tables(spark, tmp_path):
    pick = random.Random(3)
    rows = [(pick.randrange(4), i, i * 900, pick.choice("AB")) for i in range(300)]
    schema = "k int, i int, stamp long, signature string"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = state.over_stream(stream, ["k"], state.repeated_writes)
    q = out.writeStream.format("memory").queryName("kept_writes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = state.over_table(spark.createDataFrame(rows, schema), ["k"], state.repeated_writes, ["stamp"])
    assert sorted(r.i for r in spark.table("kept_writes").collect()) == sorted(r.i for r in want.collect())


def test_change_log_stream(spark, tmp_path):
    schema = "event_id long, k int, operation string, v string"
    batches = [[(1, 1, "upsert", "a"), (2, 2, "upsert", "b")], [(3, 1, "delete", None), (4, 3, "upsert", "c")], [(5, 2, "upsert", "B")]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    table = spark.createDataFrame([], "k int, v string").schema
    cdc.start(stream, str(tmp_path / "state"), ["k"], table, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted((r.k, r.v) for r in cdc.current(spark, str(tmp_path / "state"), table).collect()) == [(2, "B"), (3, "c")]
    assert len(cdc.versions(spark, str(tmp_path / "state"))) == 3


def test_continue_rows_edges(spark):
    from reelforge.operators import viewing

    entries = spark.createDataFrame([(1, "s1", "v1", True, 50, 0.5, 1), (1, "", "film", False, 60, 0.2, 2), (1, "s2", "v2", True, 70, 0.999, 3), (1, "s1", "v0", True, 50, 0.4, 4)], "p long, parent string, video string, series boolean, stamp long, fraction double, ord long")
    up = spark.createDataFrame([(1, "s1", "n1", 99, "2024-01-01", 1), (1, "s3", "n3", 60, "2025-05-05", 2), (1, "s4", "n4", 40, None, 3), (1, "s2", "n2", 80, None, 4), (1, "s5", "n5", 90, "2024-12-01", 5)], "p long, parent string, video string, stamp long, released string, ord long")
    got = lambda *a: [r.video for r in viewing.continue_rows(entries, up, ["p"], *a).orderBy("place").collect()]
    assert got() == ["n5", "film", "n3", "v1", "n4"]  # series in progress hold their next episodes back, also finished ones
    assert got("streaming", "2024-06-01") == ["film", "v1", "n4", "n5", "n3"]
    assert viewing.continue_rows(entries.limit(0), up.limit(0), ["p"]).count() == 0


def test_confirmed_entries_give_way(spark):
    from reelforge.operators import viewing

    remote = spark.createDataFrame([(1, "a", 100, 0.50, False), (1, "b", 100, 0.95, True), (1, "c", 100, 0.1, False)], "p long, video string, stamp long, fraction double, done boolean")
    own = spark.createDataFrame([(1, "a", 200, 0.52, False, 999), (1, "b", 60_200, 0.99, True, 99_999), (1, "c", 90, 0.9, False, 999), (1, "d", 5, 0.3, False, 10)], "p long, video string, stamp long, fraction double, done boolean, expires long")
    got = {r.video: (r.stamp, r.own) for r in viewing.overlaid(remote, own, ["p"], 50).collect()}
    assert got == {"a": (100, False), "b": (60_200, True), "c": (100, False)}


def test_dialogue_and_names(spark):
    from reelforge.operators import viewing

    df = spark.createDataFrame([("(sighs)",), ("[a] b",), ("♪♪",), (None,), ("(",), ("7",)], "t string")
    assert [r[0] for r in df.select(viewing.like_dialogue(F.col("t"))).collect()] == [False, True, False, False, False, True]
    assert spark.range(1).select(viewing.plain_name(F.lit("a/B.c/The_Show.S01E02.mkv"))).first()[0] == "the show s01e02"
