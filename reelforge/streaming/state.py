"""Rules over streams that depend on what was let through before, and their batch form.

Each rule is a fold over a key's rows in order of time. The same fold runs on a stream, with its state kept by Spark
between micro-batches, and on a table, with a key's rows together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelforge.shipping import ship

# The window of repeated writes, and the budgets of background work.
REPEAT_MS, GAP_MS, ACTIVE_MS = 5_000, 2_000, 30_000
BUDGETS = ((60_000, 6), (3_600_000, 30))

Fold = Callable[[tuple | None, pd.DataFrame], tuple[tuple, list[bool]]]


def repeated_writes(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[bool]]:
    """Drops a write equal to the one last sent less than REPEAT_MS before it. State: what was sent, and when."""
    sent, at = state or ("", -(10**15))
    keep = []
    for sig, now in zip(rows["signature"], rows["stamp"], strict=True):
        ok = not (sig == sent and 0 <= now - at < REPEAT_MS)
        keep.append(ok)
        if ok:
            sent, at = sig, int(now)
    return (sent, at), keep


def rate_limit(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[bool]]:
    """Lets a row through while each sliding window of accepted rows has room. State: accepted times of the longest window, joined."""
    times = [int(x) for x in (state[0] if state else "").split(",") if x]
    keep = []
    for now in rows["stamp"]:
        times = [t for t in times if now - t <= BUDGETS[-1][0]]
        ok = all(sum(now - t <= width for t in times) < most for width, most in BUDGETS)
        keep.append(ok)
        if ok:
            times.append(int(now))
    return (",".join(map(str, times)), times[-1] if times else 0), keep


def active_time(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[bool]]:
    """Keeps rows until ACTIVE_MS of active time, gaps above GAP_MS not counted. State: nothing, and time so far and last."""
    spent, last = (int(x) for x in state[0].split(",")) if state else (0, -1)
    keep = []
    for now in rows["stamp"]:
        keep.append(spent < ACTIVE_MS)
        if last >= 0 and 0 <= now - last <= GAP_MS:
            spent += int(now - last)
        last = int(now)
    return (f"{spent},{last}", spent), keep


def over_stream(stream: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    """Rows of a stream (with `stamp`, and `signature` where the fold needs it) that the fold keeps."""
    ship(stream.sparkSession)

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("stamp", kind="stable")
        now, keep = fold(state.get if state.exists else None, rows)
        state.update(now)
        yield rows[keep]

    return stream.groupBy(*keys).applyInPandasWithState(step, stream.schema, "sent string, at long", "append", GroupStateTimeout.NoTimeout)


def over_table(table: DataFrame, keys: list[str], fold: Fold, order: list[str]) -> DataFrame:
    """The same over a table; a key's rows come together, as the rule needs all before each."""
    ship(table.sparkSession)

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows[fold(None, rows)[1]]

    return table.groupBy(*keys).applyInPandas(step, table.schema)
