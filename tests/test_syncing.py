"""Paged sources, streams over a log, sinks that are asked twice, stored state."""

import json

import pytest
from pyspark.sql import functions as F

from reelforge.functions.progress import clamped_percent, completion
from reelforge.sources import paged
from reelforge.streaming import stored

ROWS = [(i, f"v{i}") for i in range(1, 1251)]


def test_offset_pages_end_with_a_short_page(spark):
    for n in (0, 499, 500, 1250):
        rows, asked = ROWS[:n], []

        def fetch(limit, offset, rows=rows):
            asked.append((limit, offset))
            return rows[offset : offset + limit]

        assert list(paged.offset_rows(fetch, 500, 0, None)) == rows
        assert asked == [(500, 500 * k) for k in range(n // 500 + 1)]
    fetch = lambda limit, offset: ROWS[offset : offset + limit]
    for name, total in (("unknown_total", None), ("known_total", lambda: 1100)):  # rows added after counting are read too
        source = paged.offset_pages(name, "id long, v string", fetch, total, page=100, parts=4)
        df = spark.read.format(paged.registered(spark, source)).load()
        assert sorted(map(tuple, df.collect())) == ROWS
        assert df.rdd.getNumPartitions() == (1 if total is None else 4)


def test_cursor_pages(spark):
    after = lambda cursor, limit: [r for r in ROWS if r[0] > cursor][:limit]
    assert list(paged.cursor_rows(after, 500, 0, 0)) == ROWS
    assert list(paged.cursor_rows(after, 500, 0, 700, 1001)) == ROWS[700:1001]
    assert list(paged.cursor_rows(after, 500, 0, 1250)) == []
    with pytest.raises(ValueError, match="stands still"):
        list(paged.cursor_rows(lambda c, n: ROWS[:n], 500, 0, 0))
    assert [(s.start, s.end) for s in paged.spans(3, 10, 3)] == [(3, 6), (6, 9), (9, 10)]


def test_a_log_as_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "log.parquet")
    write = lambda n: pq.write_table(pa.table({"event_id": [r[0] for r in ROWS[:n]], "v": [r[1] for r in ROWS[:n]]}), path)
    write(400)
    fetch, newest = paged.parquet_log(path, ["event_id", "v"], "event_id")
    name = paged.registered(spark, paged.change_log("growing_log", "event_id long, v string", fetch, newest, page=70, parts=3))

    def run():
        q = spark.readStream.format(name).option("since", 100).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    assert run() == ROWS[100:400]
    write(900)
    assert run() == ROWS[100:900]
    assert run() == ROWS[100:900]
    batch = spark.read.format(name).option("since", 895).load()
    assert sorted(map(tuple, batch.collect())) == ROWS[895:900]


def test_catching_up_loses_nothing_between_cursor_and_snapshot(spark):
    log = [(1, "a", "upsert", 1.0), (2, "b", "upsert", 2.0), (3, "a", "delete", 0.0), (4, "c", "upsert", 4.0), (5, "b", "upsert", 5.0), (6, "d", "DELETE", 0.0)]
    source = paged.change_log("small_log", "event_id long, k string, operation string, value double", lambda c, n: [r for r in log if r[0] > c][:n], lambda: 6, page=2, parts=2)
    snapshot = spark.createDataFrame([("b", 2.0, 2), ("d", 9.0, 0)], "k string, value double, event_id long")  # taken after event 3, cursor read after 2
    got = paged.caught_up(spark, source, 2, snapshot, ["k"])
    assert sorted(map(tuple, got.collect())) == [("b", 5.0, 5), ("c", 4.0, 4)]


def test_a_batch_sent_twice_is_sent_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def send(name, rows, folder=str(seen)):
        import json as j
        import pathlib
        import uuid

        pathlib.Path(folder, uuid.uuid4().hex).write_text(j.dumps([name, [int(r["n"]) for r in rows]]))

    df = spark.createDataFrame([("x", i) for i in range(1100)] + [("y", 5)], "who string, n long").repartition(3)
    step = stored.sink(send, f"file://{tmp_path}/sent", ["who"], ["n"])
    told = lambda: sorted(json.loads(f.read_text()) for f in seen.iterdir())
    step(df, 0)
    want = [["0/x/0", [*range(500)]], ["0/x/1", [*range(500, 1000)]], ["0/x/2", [*range(1000, 1100)]], ["0/y/0", [5]]]
    assert told() == want
    step(df, 0)
    assert told() == want
    step(df.filter("who = 'y'"), 1)
    assert told() == sorted([*want, ["1/y/0", [5]]])


def test_stored_payloads_are_upgraded(spark):
    old = {"entries": [
        {"id": "m", "position": 950, "duration": 1000, "updated": 5},
        {"id": "s", "season": 1, "episode": 2, "progress_key": " ", "percent": 95.0, "updated": 3},
        {"id": "s", "season": 1, "episode": 2, "progress_key": "s_s1e2", "percent": 10.0, "position": 7, "updated": 4, "extra": "?"},
        {"id": "n", "position": -5, "updated": 1},
        {"position": 1},
    ], "cursor": 9, "dirty": ["n", "zz"]}
    df = spark.createDataFrame([(1, json.dumps(old)), (2, "{nonsense"), (3, None), (4, "{}")], "profile int, payload string")
    entries, meta = stored.decoded(df, "profile", "payload")
    got = {(r.profile, r.progress_key): (r.position, r.duration, r.percent, r.complete, r.updated) for r in entries.collect()}
    assert got == {(1, "m"): (950, 1000, None, True, 5), (1, "s_s1e2"): (7, 0, 10.0, False, 4), (1, "n"): (0, 0, None, False, 1)}
    kept = {r.profile: (r.pushed, r.cursor, r.initialized, r.dirty) for r in meta.collect()}
    assert kept == {1: (0, 9, False, ["n"]), 2: (0, 0, False, []), 3: (0, 0, False, []), 4: (0, 0, False, [])}
    again = stored.encoded(entries, meta, "profile")
    assert [e["progress_key"] for e in json.loads(again.filter("profile = 1").first().payload)["entries"]] == ["m", "s_s1e2", "n"]
    e2, m2 = stored.decoded(again, "profile", "payload")
    assert sorted(map(str, e2.collect())) == sorted(map(str, entries.collect()))
    assert sorted(map(str, m2.collect())) == sorted(map(str, meta.collect()))


def test_an_unknown_percent_is_not_complete(spark):
    df = spark.createDataFrame([(None,), (95.0,), (-3.0,), (120.0,)], "p double")
    got = df.select(clamped_percent(F.col("p")).alias("c"), completion(F.lit(False), F.col("p"), F.lit(0), F.lit(0)).alias("done")).collect()
    assert [tuple(r) for r in got] == [(None, False), (95.0, True), (0.0, False), (100.0, True)]
