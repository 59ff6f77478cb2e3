"""User-registered functions that turn a request into candidate rows.

A function takes (id, type, season, episode) and yields dictionaries, whose fields are read with tolerance; rows without
an address go. Functions are trusted: a Python worker is no sandbox. One that fails for a
request gives no rows for it, or, where errors are asked for, a row with its error.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from reelforge.shipping import ship

FIELDS = ("title", "name", "url", "quality", "size", "language", "provider", "type", "info_hash")
SCHEMA = "request long, ord int, title string, name string, url string, quality string, size string, language string, provider string, type string, info_hash string, seeders int, headers string, error string"
ANSWER = SCHEMA.removeprefix("request long, ")
TIMEOUT_S, AT_ONCE = 60.0, 10  # fixed values
REQUESTS = 1000  # of a task
MOST_RUNNING = 1000  # functions of a task that have not ended, those that are given up among them
Scraper = Callable[[str, str, "int | None", "int | None"], Iterable[dict]]


def _text(x) -> str | None:
    return None if x is None or isinstance(x, dict | list) or not str(x).strip() else str(x)


def result(item, unknown: str = "Unknown") -> dict | None:
    """One result as a row; null without an address."""
    if not isinstance(item, dict):
        return None
    url = item.get("url")
    url = _text(url.get("url") if isinstance(url, dict) else url)
    if url is None:
        return None
    row = {k: _text(item.get(k)) for k in FIELDS} | {"url": url, "info_hash": _text(item.get("infoHash"))}
    row["title"] = row["title"] or row["name"] or unknown
    try:
        row["seeders"] = int(item.get("seeders"))
    except (TypeError, ValueError):
        row["seeders"] = None
    headers = item.get("headers")
    row["headers"] = json.dumps({k: str(v) for k, v in headers.items() if v is not None}, sort_keys=True) if isinstance(headers, dict) and headers else None
    return row


def scraped(requests: DataFrame, scraper: Scraper, errors: bool = False) -> DataFrame:
    """Rows of all requests (request, id, type, season, episode); with errors, a row that says so for each failed one."""
    ship(requests.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                whole = lambda x: None if pd.isna(x) else int(x)
                try:
                    found = list(scraper(r.id, r.type, whole(r.season), whole(r.episode)) or [])
                except Exception as e:  # noqa: BLE001
                    if errors:
                        rows.append({"request": r.request, "error": f"{type(e).__name__}: {e}"})
                    continue
                rows += [{"request": r.request, "ord": i} | x for i, x in enumerate(y for y in map(result, found) if y)]
            frame = pd.DataFrame(rows, columns=["request", "ord", *FIELDS, "seeders", "headers", "error"])
            yield frame.astype({"ord": "Int32", "seeders": "Int32"} | dict.fromkeys((*FIELDS, "headers", "error"), "object"))

    return requests.select("request", "id", "type", "season", "episode").mapInPandas(run, SCHEMA)


def answered(scraper: Scraper, request: tuple, timeout_s: float, room: threading.Semaphore) -> tuple[list, str | None]:
    """What a function gives for a request, and the error that it ended with, if any."""
    told: dict = {}

    def run() -> None:
        try:
            told["found"] = list(scraper(*request) or [])
        except Exception as e:  # noqa: BLE001
            told["error"] = f"{type(e).__name__}: {e}"
        finally:
            room.release()

    late = f"TimeoutError: more than {timeout_s:g} s"
    if not room.acquire(timeout=timeout_s):
        return [], late
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(timeout_s)
    return ([], late) if thread.is_alive() else (told.get("found", []), told.get("error"))


def table_function(spark: SparkSession, name: str, scraper: Scraper, timeout_s: float = TIMEOUT_S) -> None:
    """Registers name(id, type, season, episode) for use in SQL; its rows are scraped()'s without the request, errors among them."""
    ship(spark)

    class Answer:
        def __init__(self) -> None:
            self.room = threading.BoundedSemaphore(AT_ONCE)

        def eval(self, id_: str, kind: str, season: int, episode: int) -> Iterator[tuple]:
            found, error = answered(scraper, (id_, kind, season, episode), timeout_s, self.room)
            names = [c.split()[0] for c in ANSWER.split(", ")]
            for i, row in enumerate(x for x in map(result, found) if x):
                yield tuple(({"ord": i, "error": None} | row)[n] for n in names)
            if error:
                yield tuple(({"error": error}).get(n) for n in names)

    spark.udtf.register(name, udtf(Answer, returnType=ANSWER))


class Crowd:
    """Requests of one task, AT_ONCE of them waited for at a time, so that slow ones wait together.

    A request's time runs from its start, and one that is given up makes place for the next. Its thread goes on;
    of such there are MOST_RUNNING at most, and a request that finds no room among them within its time is given up too.
    """

    def __init__(self, scraper: Scraper, timeout_s: float) -> None:
        self.scraper, self.timeout_s, self.late = scraper, timeout_s, f"TimeoutError: more than {timeout_s:g} s"
        self.room, self.done, self.open, self.begun = threading.BoundedSemaphore(MOST_RUNNING), queue.SimpleQueue(), {}, 0

    def ask(self, request: int, arguments: tuple) -> Iterator[tuple[int, list, str | None]]:
        """(request, found, error) of requests that ended before this one could start."""
        while len(self.open) >= AT_ONCE:
            yield self._ended()
        if not self.room.acquire(timeout=self.timeout_s):
            yield request, [], self.late
            return
        self.begun += 1
        self.open[self.begun] = request, time.monotonic() + self.timeout_s
        threading.Thread(target=self._run, args=(self.begun, arguments), daemon=True).start()

    def rest(self) -> Iterator[tuple[int, list, str | None]]:
        while self.open:
            yield self._ended()

    def _run(self, number: int, arguments: tuple) -> None:
        started, found, error = time.monotonic(), [], None
        try:
            found = list(self.scraper(*arguments) or [])
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        finally:
            self.room.release()
        self.done.put((number, [], self.late) if time.monotonic() - started > self.timeout_s else (number, found, error))

    def _ended(self) -> tuple[int, list, str | None]:
        while True:
            first = next(iter(self.open))  # the one that began first is late first
            try:
                number, found, error = self.done.get(timeout=max(0.0, self.open[first][1] - time.monotonic()))
            except queue.Empty:
                number, found, error = first, [], self.late
            if number in self.open:  # else it was given up before
                return self.open.pop(number)[0], found, error


def requests_function(spark: SparkSession, name: str, scraper: Scraper, timeout_s: float = TIMEOUT_S) -> None:
    """Registers name(TABLE(request, id, type, season, episode)) for use in SQL: table_function()'s rows with their request.

    A function of scalars has to end for one row before it sees the next; this one sees a task's rows and asks several at once.
    """
    ship(spark)

    class Answers:
        def __init__(self) -> None:
            self.crowd = Crowd(scraper, timeout_s)

        def _rows(self, ended: Iterator[tuple]) -> Iterator[tuple]:
            names = [c.split()[0] for c in ANSWER.split(", ")]
            for request, found, error in ended:
                for i, row in enumerate(x for x in map(result, found) if x):
                    yield (request, *(({"ord": i, "error": None} | row)[n] for n in names))
                if error:
                    yield (request, *(({"error": error}).get(n) for n in names))

        def eval(self, row) -> Iterator[tuple]:
            yield from self._rows(self.crowd.ask(row["request"], (row["id"], row["type"], row["season"], row["episode"])))

        def terminate(self) -> Iterator[tuple]:
            yield from self._rows(self.crowd.rest())

    spark.udtf.register(name, udtf(Answers, returnType=SCHEMA))


def tasks_for(requests: DataFrame) -> int:
    """Tasks that requests are dealt to: a small file is one split, however long its requests take."""
    return max(requests.sparkSession.sparkContext.defaultParallelism, -(-requests.count() // REQUESTS))
