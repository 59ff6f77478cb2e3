"""Services that answer in pages, as Spark sources: pages by offset, and a log of changes by cursor.

offset_pages() and change_log() make sources from functions that fetch a page; the functions run in executors. A page
shorter than asked for is the last. A log's rows come in order of their cursor; a cursor that stands still is an error, as
the same page would come for ever. As a stream the log's offset is the cursor, so a restarted query goes on after the last
row it has committed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from reelforge.operators.merge import apply_change_log
from reelforge.shipping import ship

PAGE = 500  # rows of a page, a fixed value

OffsetFetch = Callable[[int, int], Sequence[tuple]]  # limit, offset
CursorFetch = Callable[[int, int], Sequence[tuple]]  # cursor, limit: rows above the cursor, in order


class Span(InputPartition):
    """Rows from one offset or cursor up to another; no end means all there are."""

    def __init__(self, start: int, end: int | None) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


def spans(start: int, end: int, parts: int, step: int = 1) -> list[Span]:
    """start to end in at most `parts` parts whose inner edges are multiples of step from the start."""
    size = -(-max(1, end - start) // (parts * step)) * step
    edges = [*range(start, end, size), end]
    return [Span(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def offset_rows(fetch: OffsetFetch, page: int, start: int, end: int | None) -> Iterator[tuple]:
    """Pages from an offset until one is short, or the end is reached."""
    while end is None or start < end:
        limit = page if end is None else min(page, end - start)
        rows = fetch(limit, start)
        yield from rows
        if len(rows) < limit:
            return
        start += limit


def cursor_rows(fetch: CursorFetch, page: int, cursor_at: int, cursor: int, end: int | None = None) -> Iterator[tuple]:
    """Pages after a cursor until one is short, empty, or beyond the end; cursor_at: the column that holds a row's cursor."""
    while end is None or cursor < end:
        rows = fetch(cursor, page)
        if not rows:
            return
        following = max(r[cursor_at] for r in rows)
        if following <= cursor:
            raise ValueError(f"the cursor stands still at {cursor}")
        yield from (r for r in rows if end is None or r[cursor_at] <= end)
        if len(rows) < page:
            return
        cursor = following


def offset_pages(name: str, schema: str, fetch: OffsetFetch, total: Callable[[], int] | None = None, page: int = PAGE, parts: int = 8) -> type[DataSource]:
    """A source of all rows. total: the number of rows, by which they are read in parts; the last part goes on to the last page."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            found = spans(0, total(), parts, page) if total else []
            return [*found[:-1], Span(found[-1].start if found else 0, None)]

        def read(self, partition: Span) -> Iterator[tuple]:
            return offset_rows(fetch, page, partition.start, partition.end)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def change_log(name: str, schema: str, fetch: CursorFetch, newest: Callable[[], int], cursor_at: int = 0, page: int = PAGE, parts: int = 8) -> type[DataSource]:
    """A source of a log's rows above the option `since` (0), as a table or a stream. newest: the cursor of the last row now."""

    class Reader(DataSourceReader):
        def __init__(self, since: int) -> None:
            self.since = since

        def partitions(self) -> list[InputPartition]:
            return spans(self.since, max(self.since, newest()), parts)

        def read(self, partition: Span) -> Iterator[tuple]:
            return cursor_rows(fetch, page, cursor_at, partition.start, partition.end)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, since: int) -> None:
            self.since = since

        def initialOffset(self) -> dict:
            return {"cursor": self.since}

        def latestOffset(self) -> dict:
            return {"cursor": max(self.since, newest())}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            if end["cursor"] < start["cursor"]:
                raise ValueError(f"the cursor went back from {start['cursor']} to {end['cursor']}")
            return spans(start["cursor"], end["cursor"], parts) if end["cursor"] > start["cursor"] else []

        def read(self, partition: Span) -> Iterator[tuple]:
            return cursor_rows(fetch, page, cursor_at, partition.start, partition.end)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(int(self.options.get("since", 0)))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(int(self.options.get("since", 0)))

    return Source


def parquet_log(path: str, columns: Sequence[str], cursor: str) -> tuple[CursorFetch, Callable[[], int]]:
    """fetch and newest of a log kept as Parquet; path: what a Parquet reader of the executors can open."""

    def fetch(after: int, limit: int) -> list[tuple]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        table = ds.dataset(path).to_table(columns=list(columns), filter=ds.field(cursor) > after)
        table = table.take(pc.select_k_unstable(table, limit, [(cursor, "ascending")]))
        return list(zip(*(table[c].to_pylist() for c in columns), strict=True))

    def newest() -> int:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        return pc.max(ds.dataset(path).to_table(columns=[cursor])[cursor]).as_py() or 0

    return fetch, newest


def registered(spark: SparkSession, source: type[DataSource]) -> str:
    """The source's name, ready for spark.read and spark.readStream."""
    ship(spark)
    spark.dataSource.register(source)
    return source.name()


def caught_up(spark: SparkSession, source: type[DataSource], cursor: int, snapshot: DataFrame, keys: Iterable[str], shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A snapshot with the log's changes after a cursor that was read before the snapshot was taken: changes the snapshot
    already holds are applied again and change nothing, and none in between is lost. shape: the log's rows as events."""
    events = shape(spark.read.format(registered(spark, source)).option("since", cursor).load())
    return apply_change_log(snapshot, events, list(keys))
