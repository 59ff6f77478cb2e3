"""Receipts folded over entries, alternate keys, and joins whose hot values are dealt in blocks."""

from pyspark.sql import functions as F

from reelforge.operators import identity, receipts

ENTRY = f"profile int, ord int, kind string, status string, seasons {receipts.SEASONS}, last_watched string, watched int, added string, simkl int, imdb string, title string, year int"
RECEIPT = "profile int, seq int, op string, kind string, status string, season int, number int, tvdb_season int, tvdb_number int, at string, simkl int, imdb string, title string, year int"


def receipt(seq, op, kind, at, profile=1, **more):
    names = [c.split()[0] for c in RECEIPT.split(", ")]
    return tuple((dict.fromkeys(names) | {"profile": profile, "seq": seq, "op": op, "kind": kind, "at": at} | more)[n] for n in names)


def library(spark, entries, told):
    e = spark.createDataFrame(entries, ENTRY).repartition(3)
    out = receipts.with_receipts(e, spark.createDataFrame(told, RECEIPT).repartition(2), ["profile"], ["simkl", "imdb"])
    return {(r.ord, r.media): r for r in out.collect()}


def flat(r):
    return [(s.number, x.number, x.watched_at, x.tvdb_season, x.tvdb_number) for s in r.seasons for x in s.episodes]


def test_receipts_change_seasons_in_place(spark):
    seasons = [(1, [(1, "a", None, None), (2, None, None, None)]), (3, [(1, None, 2, 5)])]
    entries = [(1, 0, "show", "hold", seasons, "a", 1, None, 7, "tt1", "Show", 2000), (1, 1, "movie", None, None, None, None, None, None, "tt2", "Film", 1999), (2, 0, "show", None, None, None, None, None, 7, None, "Else", None)]
    told = [
        receipt(1, "watch", "show", "t1", simkl=7, season=1, number=2),
        receipt(2, "watch", "show", "t2", simkl=7, season=1, number=2),  # again: counted once
        receipt(3, "watch", "show", "t3", simkl=7, season=2, number=5, tvdb_season=2, tvdb_number=5),  # by its other numbering
        receipt(4, "watch", "show", "t4", simkl=7, season=2, number=9),  # a season that is not there
        receipt(5, "watch", "show", "t5", simkl=7, number=3),  # no season is the first
        receipt(6, "list", "movie", "t6", imdb="tt2", status="plan"),
        receipt(7, "watch", "movie", "t7", title=" film ", year=1999),
    ]
    by = {(r.profile, r.ord): r for r in receipts.with_receipts(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(told, RECEIPT), ["profile"], ["simkl", "imdb"]).collect()}
    show, film = by[1, 0], by[1, 1]
    assert flat(show) == [(1, 1, "a", None, None), (1, 2, "t2", None, None), (1, 3, "t5", None, None), (3, 1, "t3", 2, 5), (2, 9, "t4", None, None)]
    assert (show.watched, show.last_watched, show.status) == (5, "t5", "hold")
    assert set(by) == {(1, 0), (1, 1), (2, 0)}
    assert (film.status, film.last_watched, film.added) == ("completed", "t7", "t6")
    assert (by[2, 0].watched, by[2, 0].seasons) == (0, [])


def test_receipts_take_back_remove_and_make_entries(spark):
    seasons = [(1, [(1, "b", None, None), (2, "c", None, None), (3, "a", 1, 2)])]
    entries = [(1, 0, "show", "hold", seasons, "c", 3, "x", 7, None, "S", None), (1, 1, "movie", "completed", None, "q", 0, None, None, "tt2", "F", None), (1, 2, "anime", None, None, None, 0, None, 9, None, "A", None), (1, 3, "show", None, None, None, 0, None, 9, None, "A", None)]
    told = [
        receipt(1, "unwatch", "show", "t", simkl=7, season=1, number=2),  # both the second and the one mapped to it
        receipt(2, "unwatch", "movie", "t", imdb="tt2"),
        receipt(3, "watch", "show", "t3", simkl=9, season=1, number=1),  # of its kind, though not the first
        receipt(4, "unwatch", "show", "t", imdb="tt9", season=1, number=1),  # nothing to take back
        receipt(5, "watch", "show", "t5", imdb="tt9", season=4, number=2),
        receipt(6, "list", "show", "t6", imdb="tt9", status="dropped"),
        receipt(7, "watch", "anime", "t7", title="New"),  # anime without an episode is a film
        receipt(8, "watch", "show", "t8"),  # matches nothing
        receipt(9, "unwatch", "show", "t", imdb="tt2x"),
    ]
    got = library(spark, entries, told)
    assert set(got) == {(0, None), (2, None), (3, None), (None, "imdb:tt9"), (None, "title:new")}
    assert flat(got[0, None]) == [(1, 1, "b", None, None), (1, 2, None, None, None), (1, 3, None, 1, 2)]
    assert (got[0, None].watched, got[0, None].last_watched) == (1, "b")
    assert flat(got[3, None]) == [(1, 1, "t3", None, None)]
    assert got[2, None].watched == 0
    new = got[None, "imdb:tt9"]
    assert (flat(new), new.status, new.watched, new.last_watched, new.added) == ([(4, 2, "t5", None, None)], "dropped", 1, "t5", "t6")
    film = got[None, "title:new"]
    assert (film.kind, film.status, film.last_watched) == ("anime", "completed", "t7")


def test_hot_values_are_dealt_in_blocks(spark):
    a = spark.range(900).select(F.col("id").alias("l"), F.when(F.col("id") < 500, F.array(F.lit("hot"))).otherwise(F.array(F.concat(F.lit("x"), F.col("id").cast("string")), F.lit("warm"))).alias("ids"))
    b = spark.range(700).select(F.col("id").alias("r"), F.when(F.col("id") < 350, F.array(F.lit("hot"))).otherwise(F.array(F.concat(F.lit("x"), F.col("id").cast("string")))).alias("ids"))
    want = sorted([(i, j) for i in range(500) for j in range(350)] + [(i, i) for i in range(500, 700)])
    assert sorted(map(tuple, identity.sharing_any(a, b, "l", "r", "ids", block=40).collect())) == want
    assert sorted(map(tuple, identity.sharing_any(a, b, "l", "r", "ids").collect())) == want
    # No cell of a hot value holds more rows of a side than a block has, but for the spread of a hash.
    x, y = a.select("l", F.explode("ids").alias("k")), b.select("r", F.explode("ids").alias("k"))
    cells = identity.joined_in_blocks(x, y, "k", 40)
    assert cells.count() == len(want)
    plan = cells._jdf.queryExecution().toString()
    assert "__i" in plan
    assert "__j" in plan


def test_alternate_keys(spark):
    seasons = [(1, [(1, "t", None, None), (2, None, None, None), (3, "t", 5, 6)])]
    rows = [
        ("anime", None, "completed", None, seasons, "tt1", None, 11), ("anime", "movie", None, "t", seasons, "tt2", 5, None), ("movie", None, None, None, None, "tt3", 6, None),
        ("movie", None, "completed", None, None, " ", 7, 8), ("show", None, "completed", "t", seasons, "tt4", 9, None), ("anime", None, None, None, seasons, "tt5", None, None),
    ]
    df = spark.createDataFrame(rows, f"kind string, anime_kind string, status string, last_watched string, seasons {receipts.SEASONS}, imdb string, tmdb int, mal int")
    got = {r.key for r in identity.alternate_keys(df, ["imdb", "tmdb", "mal"]).collect()}
    assert got == {"series:mal:11:1:1", "series:mal:11:5:6", "series:mal:11:-1:-1", "movie:tmdb:5:-1:-1", "movie:mal:8:-1:-1"}
