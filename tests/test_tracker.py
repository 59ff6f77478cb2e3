"""The tracker by hand, and streams cut in any way against tables."""

import random

import pytest

from reelforge.streaming import tracker

RUN = {"scale": 1.0, "shift": 5000.0, "peak": 0.5, "prominence": 0.2, "cues": 10, "speech": 30.0, "analysed": 30.0, "at_edge": False, "halves": False, "split": None}
SIDES = ("near", "unit", "local", "refined")
COLUMNS = ["film", "run", *RUN, *(f"{s}_{k}" for s in SIDES for k in ("shift", "peak", "prominence", "cues", "speech", "at_edge"))]
KINDS = {"film": "string", "run": "long", "at_edge": "boolean", "halves": "boolean", "split": "long", "cues": "int"}
SCHEMA = ", ".join(f"{c} {KINDS.get(c, KINDS.get(c.split('_', 1)[-1], 'double'))}" for c in COLUMNS)


def runs(*changes, film="f"):
    out = []
    for i, c in enumerate(changes):
        row = dict.fromkeys(COLUMNS) | RUN | {"film": film, "run": i, "analysed": 30.0 + 12 * i} | c
        out.append(row)
    return out


def near(shift, **more):
    return {"near_shift": shift, "near_peak": 0.5, "near_prominence": 0.2, "near_cues": 10, "near_speech": 30.0, "near_at_edge": False} | more


def side(name, shift, **more):
    return {f"{name}_shift": shift, f"{name}_peak": 0.5, f"{name}_prominence": 0.3, f"{name}_cues": 25, f"{name}_speech": 40.0, f"{name}_at_edge": False} | {f"{name}_{k}": v for k, v in more.items()}


LOCKED = {"cues": 30, "analysed": 90.0, "halves": True}


def outcomes(rows):
    decided, pending = tracker.NOTHING
    out = []
    for r in rows:
        decided, pending, told = tracker.track_step(decided, pending, r)
        out.append(told)
    return out, decided


def test_searching_to_provisional_to_lock():
    told, decided = outcomes(runs({"analysed": 5.0}, near(5000.0), near(5100.0), near(5120.0), near(5450.0), LOCKED))
    assert [t[0] for t in told] == ["waiting", "searching", "provisional", "searching", "searching", "locked"]
    assert told[2][1:] == (0, 1.0, 5100.0)
    assert decided[:3] == ([0], [1.0], [5000.0])


def test_far_shifts_need_more_runs_and_growth():
    far = {"shift": 30_000.0}
    told, _ = outcomes(runs(far, far, far, far))
    assert [t[0] for t in told] == ["searching", "searching", "provisional", "searching"]
    slow = [{**far, "analysed": 30.0 + i} for i in range(5)]
    assert {t[0] for t in outcomes(runs(*slow))[0]} == {"searching"}
    odd = {"scale": 25 / 24, "prominence": 0.15, **LOCKED}
    assert outcomes(runs(odd))[0][0][0] == "searching"  # another rate needs a clearer peak


def test_retraction_by_disagreement_and_by_age():
    start = [near(5000.0), near(5000.0)]
    told, _ = outcomes(runs(*start, near(7000.0), near(7000.0), near(7000.0), near(7000.0), near(7000.0)))
    assert [t[0] for t in told] == ["searching", "provisional", "searching", "provisional", "searching", "searching", "searching"]
    told, _ = outcomes(runs(*start, near(7000.0), near(2000.0), near(7000.0), near(2000.0), near(2000.0)))
    assert [t[0] for t in told][4] == "retracted"
    told, decided = outcomes(runs(*start, near(5000.0, cues=40), near(5000.0), near(5000.0), LOCKED))
    assert [t[0] for t in told] == ["searching", "provisional", "retracted", "searching", "searching", "locked"]
    assert decided[5]


def test_a_lock_is_refined_and_jumps():
    rows = runs(LOCKED, side("refined", 5020.0), side("refined", 5100.0), side("refined", 6550.0), side("local", 9000.0) | {"split": 400_000}, side("refined", 5150.0),
                side("local", 9000.0) | {"split": 10_000}, side("local", 9100.0) | {"split": 10_000}, side("local", 9150.0), side("local", 9100.0, cues=3) | side("refined", 9200.0))
    told, decided = outcomes(rows)
    assert [t[0] for t in told] == ["locked", "unchanged", "refined", "unchanged", "unchanged", "refined", "jumped", "unchanged", "unchanged", "refined"]
    assert decided[:3] == ([0, 30_000], [1.0, 1.0], [5150.0, 9200.0])


def fed(spark, tmp_path, batches, schema, build):
    """Rows of a stream of files, one micro-batch each."""
    source, name = tmp_path / "in", f"told_{random.randrange(10**9)}"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(source / f"b{i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source / "*"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_stream_in_any_batching_equals_the_table(rocks, tmp_path):
    pick, rows = random.Random(3), []
    for film in "abc":
        changes = [near(5000.0 + pick.choice((0, 0, 50, 2500)), cues=pick.choice((10, 10, 20))) | (LOCKED if i == 6 else {}) | (side("local", 9000.0 + pick.choice((0, 90))) | {"split": 10**6} if i % 3 == 0 else side("refined", 5000.0 + 60 * i)) for i in range(16)]
        rows += [tuple(r[c] for c in COLUMNS) for r in runs(*changes, film=film)]
    rows.sort(key=lambda r: r[1])
    want = {(r.film, r.run): tuple(r) for r in tracker.tracked_table(rocks.createDataFrame(rows, SCHEMA), ["film"]).collect()}
    assert len(want) == 48
    assert {t[2] for t in want.values()} >= {"searching", "locked", "refined", "jumped"}
    cuts = sorted(pick.sample(range(1, 48), 4))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 48], strict=True)]
    got = fed(rocks, tmp_path, batches, SCHEMA, lambda s: tracker.tracked_stream(s, ["film"]))
    assert {(r.film, r.run): tuple(r) for r in got} == want


def test_samples_of_throughput(rocks, tmp_path):
    tick = lambda k, t, b=2_000_000, f=True: (k, 10**9 + t, b, f)
    rows = [tick("long", 1000 * i) for i in range(40)] + [tick("short", 1000 * i) for i in range(3)] + [tick("some", 500 * i, 700_000, i % 5 > 0) for i in range(40)]
    rows += [tick("gaps", 5000 * i) for i in range(9)] + [tick("later", 200_000)]
    rows.sort(key=lambda r: r[1])
    schema = "player string, stamp long, bytes long, fetching boolean"
    want = {r.player: tuple(r) for r in tracker.samples_table(rocks.createDataFrame(rows, schema), ["player"]).collect()}
    assert set(want) == {"long", "some"}
    assert want["long"] == ("long", 10**9 + 30_000, 30_000, 60_000_000, 16.0)
    # Files of one micro-batch each; the last ones move the watermark past the idle ones.
    batches = [rows[:50], rows[50:90], rows[90:], [tick("later", 500_000)], [tick("later", 900_000)]]
    build = lambda s: tracker.samples_stream(s.selectExpr("*", "timestamp_millis(stamp) AS ts").withWatermark("ts", "10 seconds"), ["player"])
    assert {r.player: tuple(r) for r in fed(rocks, tmp_path, batches, schema, build)} == want
