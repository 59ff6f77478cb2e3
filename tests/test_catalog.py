from pyspark.sql import functions as F

from reelforge.operators import catalog as C


def test_excluded_words_and_broken_patterns(spark):
    assert C.excluded_words(r"^(?!.*\b(cam| ts)\b).*x") == ["cam", "ts"]
    df = spark.createDataFrame([("a cam x",), ("camera x",), ("b",)], "t string")
    assert [r.t for r in df.filter(C.user_pattern(F.col("t"), r"(?!.*(cam)).*x|x")).collect()] == ["camera x"]
    assert df.filter(C.user_pattern(F.col("t"), "([")).count() == 0
    letters = spark.createDataFrame([("é",), ("12",)], "t string")
    assert [r.t for r in letters.filter(C.user_pattern(F.col("t"), r"^\p{L}+$")).collect()] == ["é"]
    assert letters.filter(C.user_pattern(F.col("t"), "(?P<x>.)")).count() == 0  # Python's form, which the engine does not take


def test_collapsed_cues(spark):
    rows = [("t", 0, 0, 500, ""), ("t", 1, 100, 600, "Hi!"), ("t", 2, 220, 700, "hi"), ("t", 3, 240, 800, "other"), ("t", 4, 400, 900, "")]
    df = spark.createDataFrame(rows, "track string, ord int, start long, end long, text string")
    assert [r.ord for r in C.collapsed_cues(df, "track").orderBy("start").collect()] == [1, 3, 4]


def test_resolved_identity_does_not_reach_back(spark):
    rows = [(0, 1, ["a"]), (0, 2, ["b"]), (0, 3, ["a", "b"]), (0, 4, ["c"]), (1, 5, ["a"]), (1, 6, [])]
    df = spark.createDataFrame(rows, "g int, i long, names array<string>")
    assert {r.i: r.entity for r in C.resolved_identity(df, "g", "i", "names").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_arrival_fold(spark):
    cur = spark.createDataFrame([(1, 10, True), (2, 10, False), (3, 10, True), (4, 7, False)], "k int, at long, dirty boolean")
    ev = spark.createDataFrame([(1, 1, "upsert", 9), (2, 1, "delete", 0), (3, 2, "delete", 0), (4, 3, "upsert", 11), (5, 3, "delete", 0), (6, 5, "upsert", 1), (7, 5, "noise", 2)], "n int, k int, operation string, at long")
    assert sorted((r.k, r["at"], r.dirty) for r in C.arrival_fold(cur, ev, ["k"], "n", "at").collect()) == [(1, 10, True), (4, 7, False), (5, 1, False)]


def test_url_template_and_hash(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    v = {"a": F.col("a"), "b": F.col("b")}
    got = df.select(*(C.url_template(p, v).alias(str(i)) for i, p in enumerate(["/{b|a}/", "/{b}", "/{b?}/z", "plain"]))).first()
    assert list(got) == ["/x/", None, "//z", "plain"]
    assert spark.range(1).select(C.string_hash(F.lit("hello world")).alias("h")).first().h == 1794106052
    others = spark.range(1).select(C.string_hash(F.lit("a😀")).alias("a"), C.string_hash(F.lit("")).alias("b"), C.string_hash(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(others) == (1866116, 0, None)
    assert C.discover_query({"with_genres": [1, 2], "year": None, "include_adult": False})["region"] == "US"


def test_season_posters(spark):
    from reelforge.functions.candidates import season_posters, supports_discover, supports_search

    rows = [
        (1, {1: "k"}, ["a"], [1]),
        (2, None, ["a", "b", "c"], [2, 0, 1]),
        (3, None, ["a", " "], [0, 1, 2]),
        (4, None, [None, "a", "b"], [1, 2]),
        (5, None, ["a", "b", "c", "d"], [7]),
    ]
    df = spark.createDataFrame(rows, "i int, keyed map<int, string>, listed array<string>, seasons array<int>")
    got = {r.i: r.m for r in df.select("i", season_posters(F.col("keyed"), F.col("listed"), F.col("seasons")).alias("m")).collect()}
    assert got == {1: {1: "k"}, 2: {0: "a", 1: "b", 2: "c"}, 3: {1: "a"}, 4: {1: "a", 2: "b"}, 5: {1: "a", 2: "b", 3: "c", 4: "d"}}
    extras = [[("search", True, [])], [("search", False, []), ("genre", True, ["x"])], [("genre", True, [])], [("skip", True, [])], []]
    df = spark.createDataFrame([(e,) for e in extras], "e array<struct<name: string, isRequired: boolean, options: array<string>>>")
    got = [(r.s, r.d) for r in df.select(supports_search(F.col("e")).alias("s"), supports_discover(F.col("e")).alias("d")).collect()]
    assert got == [(True, False), (False, True), (False, False), (False, True), (False, True)]


def test_scrapers(spark):
    from reelforge.sources.scrapers import scraped

    def scraper(id_, kind, season, episode):
        if id_ == "bad":
            raise ValueError
        yield {"name": "n", "url": {"url": f"http://{id_}/{season}"}, "seeders": "7", "headers": {"A": 1, "B": None}}
        yield {"title": "none"}
        yield "text"
        yield {"url": "u", "size": {"x": 1}}

    req = spark.createDataFrame([(1, "a", "series", 2, None), (2, "bad", "movie", None, None)], "request long, id string, type string, season int, episode int")
    got = scraped(req, scraper).orderBy("ord").collect()
    assert [(r.request, r.title, r.url, r.seeders, r.headers, r.size) for r in got] == [(1, "n", "http://a/2", 7, '{"A": "1"}', None), (1, "Unknown", "u", None, None, None)]
    told = scraped(req, scraper, errors=True).filter("error is not null").collect()
    assert [(r.request, r.url, r.error) for r in told] == [(2, None, "ValueError: ")]


def test_requests_that_take_too_long_make_room_again():
    import threading
    import time

    from reelforge.sources.scrapers import answered

    room, go = threading.BoundedSemaphore(2), threading.Event()
    slow = lambda: go.wait(20)
    assert answered(lambda: [1], (), 1, room) == ([1], None)
    assert answered(lambda: 1 / 0, (), 1, room)[1].startswith("ZeroDivisionError")
    assert [answered(slow, (), 0.05, room)[1] for _ in range(2)] == ["TimeoutError: more than 0.05 s"] * 2
    start = time.monotonic()
    assert answered(lambda: [1], (), 0.1, room) == ([], "TimeoutError: more than 0.1 s")  # no room
    assert time.monotonic() - start < 5
    go.set()
    time.sleep(0.2)
    assert answered(lambda: None, (), 1, room) == ([], None)
