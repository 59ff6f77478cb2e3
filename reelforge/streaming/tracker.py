"""An online tracker of one film's shift, and samples of throughput: state machines over a key's rows in order.

Each is a step from a state and a row to a state and what is to be told. On a stream Spark keeps the state between
micro-batches (transformWithState, one variable for what was decided and one for what is pending); on a table a key's rows
are folded together. Both give the same rows, however the stream is cut, as long as its batches come in order.

A tracker's row holds what was measured at a run: an estimate over all that was heard (scale, shift, peak, prominence,
cues, speech, analysed, at_edge, halves: both halves agree), one at the unit scale near no shift (near_*), and, once a
shift is locked, one of the last minutes (local_*, split: where the film changes, null if nowhere) and one close to the
lock (refined_*). Null estimates are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from reelforge.shipping import ship

# What locks, what moves cues early, what takes it back, what follows a lock.
LOCK = {"cues": 20, "speech": 12.0, "prominence": 0.12, "analysed": 60.0}
ODD_RATE, UNIT_RANGE, NEAR_PEAK, NEAR_MS = 0.04, 0.002, 0.01, 8000.0
EARLY = {"analysed": 20.0, "cues": 8, "speech": 5.0, "prominence": 0.15, "runs": 3, "growth": 20.0}
EARLY_NEAR = {"cues": 5, "speech": 5.0, "prominence": 0.08, "runs": 2, "growth": 10.0}
AGREE_MS, MOVE_MS, RETRACT_MS, RETRACT_RUNS, STALE_CUES = 300.0, 120.0, 1000.0, 3, 35
JUMP_MS, SAME_JUMP_MS, LOCAL_CUES, LEAST_SEGMENT_MS = 1000.0, 250.0, 15, 30_000
REFINE_RANGE_MS, REFINE_PROMINENCE, REFINE_MS, FRAME_MS = 1500.0, 0.05, 40.0, 32.0
# Of a sample of throughput: the gap that is no transfer, active time that ends it, and what is too little to tell.
GAP_MS, ENOUGH_MS, LEAST_MS, LEAST_BYTES, SLOW_MS = 2000, 30_000, 3000, 8 * 1024 * 1024, 10_000

ESTIMATE = ("scale", "shift", "peak", "prominence", "cues", "speech", "analysed", "at_edge")
DECIDED = "starts array<long>, scales array<double>, shifts array<double>, early_scale double, early_shift double, blocked boolean"
PENDING = "last_scale double, last_shift double, agreeing int, disagreeing int, since double, jump double"
TOLD = "run long, outcome string, start long, scale double, shift double"
NOTHING = (([], [], [], None, None, False), (None, None, 0, 0, 0.0, None))


def _none(x) -> bool:
    return x is None or x != x


def _estimate(row: dict, name: str) -> dict | None:
    prefix = f"{name}_" if name else ""
    if _none(row.get(f"{prefix}shift")):
        return None
    return {k: row.get(f"{prefix}{k}", row.get(k)) for k in ESTIMATE}


def _evidence(e: dict, cues: int = LOCK["cues"]) -> bool:
    return e["cues"] >= cues and e["speech"] >= LOCK["speech"]


def _needed(least: float, scale: float) -> float:
    return least if abs(scale - 1.0) < UNIT_RANGE else least + ODD_RATE


def _search(decided: tuple, pending: tuple, row: dict):
    starts, scales, shifts, early_scale, early_shift, blocked = decided
    last_scale, last_shift, agreeing, disagreeing, since, jump = pending
    e = _estimate(row, "")
    if e is None or e["analysed"] < min(LOCK["analysed"], EARLY["analysed"]):
        return decided, pending, ("waiting", None, None, None)
    if e["analysed"] >= LOCK["analysed"] and _evidence(e) and not e["at_edge"] and e["prominence"] >= _needed(LOCK["prominence"], e["scale"]) and row["halves"]:
        return ([0], [e["scale"]], [e["shift"]], None, None, blocked), pending, ("locked", 0, e["scale"], e["shift"])
    searching = ("searching", None, e["scale"], e["shift"])
    near = _estimate(row, "near")
    near = near and near | {"scale": 1.0}
    candidate = e if e["scale"] == 1.0 else (unit := _estimate(row, "unit")) and unit | {"scale": 1.0}
    if candidate is None:
        return decided, pending, searching
    close = near is not None and not near["at_edge"] and (abs(candidate["shift"]) <= NEAR_MS or near["peak"] >= candidate["peak"] - NEAR_PEAK)
    best = near if close else candidate
    if early_shift is not None:
        disagreeing = disagreeing + 1 if abs(best["shift"] - early_shift) > RETRACT_MS else 0
        stale = e["cues"] >= STALE_CUES
        if stale or disagreeing >= RETRACT_RUNS:
            return (starts, scales, shifts, None, None, stale), (last_scale, last_shift, 0, 0, since, jump), ("retracted", None, best["scale"], best["shift"])
    if blocked:
        return decided, (last_scale, last_shift, agreeing, disagreeing, since, jump), searching
    limits = EARLY_NEAR if close else EARLY
    credible = not best["at_edge"] and best["cues"] >= limits["cues"] and best["speech"] >= limits["speech"] and best["prominence"] >= _needed(limits["prominence"], best["scale"])
    agrees = last_shift is not None and last_scale == best["scale"] and abs(last_shift - best["shift"]) <= AGREE_MS
    agreeing = 0 if not credible else agreeing + 1 if agrees else 1
    since = best["analysed"] if agreeing == 1 else since
    pending = (best["scale"], best["shift"], agreeing, disagreeing, since, jump)
    steady = agreeing >= limits["runs"] and best["analysed"] - since >= limits["growth"]
    if not steady or (early_shift is not None and early_scale == best["scale"] and abs(early_shift - best["shift"]) < MOVE_MS):
        return decided, pending, searching
    return (starts, scales, shifts, best["scale"], best["shift"], blocked), pending, ("provisional", 0, best["scale"], best["shift"])


def _follow(decided: tuple, pending: tuple, row: dict):
    starts, scales, shifts, *rest = decided
    same, (start, scale, shift) = ("unchanged", None, None, None), (starts[-1], scales[-1], shifts[-1])
    local, at = _estimate(row, "local"), pending[5]
    if local is not None:
        jumps = _evidence(local, LOCAL_CUES) and not local["at_edge"] and abs(local["shift"] - shift) > JUMP_MS and local["prominence"] >= LOCK["prominence"]
        if jumps:
            if at is not None and abs(at - local["shift"]) <= SAME_JUMP_MS:
                pending = (*pending[:5], None)
                if not _none(row["split"]):
                    split = max(int(row["split"]), start + LEAST_SEGMENT_MS)
                    return ([*starts, split], [*scales, scale], [*shifts, local["shift"]], *rest), pending, ("jumped", split, scale, local["shift"])
                return decided, pending, same
            return decided, (*pending[:5], local["shift"]), same
        pending = (*pending[:5], None)
    refined = _estimate(row, "refined")
    if refined is None or refined["prominence"] < REFINE_PROMINENCE or not _evidence(refined):
        return decided, pending, same
    moved = abs(refined["shift"] - shift)
    if moved < REFINE_MS or moved > REFINE_RANGE_MS - 2 * FRAME_MS:
        return decided, pending, same
    return (starts, scales, [*shifts[:-1], refined["shift"]], *rest), pending, ("refined", start, scale, refined["shift"])


def track_step(decided: tuple, pending: tuple, row: dict):
    """What is decided, what is pending and (outcome, start, scale, shift) after a row."""
    return (_follow if decided[0] else _search)(decided, pending, row)


def _told(keys: dict, rows: pd.DataFrame, decided: tuple, pending: tuple):
    out = []
    for row in rows.sort_values("run", kind="stable").to_dict("records"):
        row = {k: None if _none(v) else v for k, v in row.items()}
        decided, pending, told = track_step(decided, pending, row)
        out.append((*keys.values(), row["run"], *told))
    frame = pd.DataFrame(out, columns=[*keys, "run", "outcome", "start", "scale", "shift"])
    return frame.astype({"start": "Int64", "scale": "float64", "shift": "float64"}), decided, pending


class Tracker(StatefulProcessor):
    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.decided = handle.getValueState("decided", DECIDED)
        self.pending = handle.getValueState("pending", PENDING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        decided = tuple(self.decided.get() or NOTHING[0])
        decided = (*(list(x or []) for x in decided[:3]), *decided[3:])
        pending = tuple(self.pending.get() or NOTHING[1])
        frame, decided, pending = _told(dict(zip(self.keys, key, strict=True)), pd.concat(list(rows)), decided, pending)
        self.decided.update(decided)
        self.pending.update(pending)
        yield frame

    def close(self) -> None:
        pass


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def tracked_stream(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run, outcome, start, scale, shift of each row of a stream; needs a state store with several variables (RocksDB)."""
    ship(runs.sparkSession)
    return runs.groupBy(*keys).transformWithStateInPandas(Tracker(keys), _schema(runs, keys, TOLD), "Append", "None")


def tracked_table(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The same of a table; each row depends on all before it, so a film's runs are in one task, in order, a batch at a time."""
    ship(runs.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, decided, pending = None, *NOTHING
        for b in batches:
            told = []
            for row in b.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != of:
                    of, decided, pending = own, *NOTHING
                decided, pending, t = track_step(decided, pending, {k: None if _none(v) else v for k, v in row.items()})
                told.append(t)
            columns = [pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.record_batch([*(b[k] for k in keys), b["run"].cast(pa.int64()), *columns], names=[*keys, "run", "outcome", "start", "scale", "shift"])

    return runs.repartition(*keys).sortWithinPartitions(*keys, "run").mapInArrow(fold, _schema(runs, keys, TOLD))


# ---- throughput ------------------------------------------------------------------------------------------------------

SAMPLE = "at long, active_ms long, bytes long, mbps double"


def sample_step(state: tuple | None, now: int, count: int, fetching: bool):
    """State (last tick, bytes, active ms, closed) after a tick, and whether it has just closed."""
    last, total, active, closed = state or (None, 0, 0, False)
    if closed:
        return (last, total, active, True), False
    gap = None if last is None else now - last
    if fetching and gap is not None and 0 < gap <= GAP_MS and count > 0:
        total, active = total + count, active + gap
    done = active >= ENOUGH_MS
    return (now, total, active, done), done


def sample_of(state: tuple) -> tuple | None:
    """What a closed sample tells; too little tells nothing."""
    last, total, active, _ = state
    if active < LEAST_MS or (total < LEAST_BYTES and active < SLOW_MS):
        return None
    return last, active, total, total * 8.0 / active / 1000.0


def _ticks(rows: pd.DataFrame, state: tuple | None):
    told = None
    for now, count, fetching in rows.sort_values("stamp", kind="stable")[["stamp", "bytes", "fetching"]].itertuples(index=False):
        state, done = sample_step(state, int(now), max(0, int(count)), bool(fetching))
        told = sample_of(state) if done else told
    return state, told


class Sampler(StatefulProcessor):
    """Closes by active time, or by a timer when no tick has come for idle_ms of the stream's own time."""

    def __init__(self, keys: list[str], idle_ms: int) -> None:
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("sample", "last long, bytes long, active long, closed boolean")

    def _row(self, key, told) -> pd.DataFrame:
        return pd.DataFrame([(*key, *told)] if told else [], columns=[*self.keys, "at", "active_ms", "bytes", "mbps"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        state, told = _ticks(pd.concat(list(rows)), tuple(self.state.get()) if self.state.exists() else None)
        self.state.update(state)
        if not state[3]:
            self.handle.registerTimer(state[0] + self.idle_ms)
        yield self._row(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, total, active, closed = self.state.get()
        self.state.update((last, total, active, True))
        yield self._row(key, None if closed else sample_of((last, total, active, True)))

    def close(self) -> None:
        pass


def samples_stream(ticks: DataFrame, keys: list[str], idle_ms: int = 60_000) -> DataFrame:
    """keys, at, active_ms, bytes, mbps: one sample a key; ticks: keys, stamp (ms), bytes, fetching and a watermark."""
    ship(ticks.sparkSession)
    return ticks.groupBy(*keys).transformWithStateInPandas(Sampler(keys, idle_ms), _schema(ticks, keys, SAMPLE), "Append", "EventTime")


def samples_table(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """The same of a table, whose end closes what is open."""
    ship(ticks.sparkSession)

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, told = _ticks(rows, None)
        told = told or (None if state[3] else sample_of(state))
        return pd.DataFrame([(*key, *told)] if told else [], columns=[*keys, "at", "active_ms", "bytes", "mbps"])

    return ticks.groupBy(*keys).applyInPandas(fold, _schema(ticks, keys, SAMPLE))
