"""Paged APIs as a Spark data source: one reader follows a cursor or an offset and stops at a short page or a cutoff."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, SimpleDataSourceStreamReader

from tidemark import schemas
from tidemark.operators.journal import market_counts


def uuid7_ms(uid: str) -> int:
    return int(uid.replace("-", "")[:12], 16)


def follow(fetch: Callable[[str | None, int], tuple[list[dict], str | None]], size: int = 5000, key: str = "id", since_ms: int | None = None) -> Iterator[dict]:
    """Items page by page; with since_ms, until an item is older by its id's time, newest first."""
    cursor: str | None = None
    while True:
        items, cursor = fetch(cursor, size)
        for item in items:
            if since_ms is not None and uuid7_ms(item[key]) < since_ms:
                return
            yield item
        if not cursor:
            return


def offsets(get: Callable[[int, int], list[dict]]) -> Callable[[str | None, int], tuple[list[dict], str | None]]:
    """A page reader for APIs with offset and limit, which end with a short page."""

    def fetch(cursor: str | None, size: int) -> tuple[list[dict], str | None]:
        at = int(cursor or 0)
        items = get(at, size)
        return items, str(at + size) if len(items) == size else None

    return fetch


def _fetcher(options: dict) -> Callable[[str | None, int], tuple[list[dict], str | None]]:
    import importlib

    module, _, name = options["fetcher"].partition(":")
    return getattr(importlib.import_module(module), name)


def _row(item: dict, options: dict) -> tuple[str, int | None]:
    """The item as JSON and the time in its id, NULL where the id holds none."""
    try:
        ms = uuid7_ms(item[options.get("key", "id")])
    except (KeyError, ValueError, AttributeError):
        ms = None
    return json.dumps(item, sort_keys=True), ms


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A lower bound on `ms` ends the paging where items get older; newest come first.  Spark still checks it."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("ms",) and isinstance(f.value, int):
                self.options["since_ms"] = str(max(int(self.options.get("since_ms") or 0), f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a cursor can't be split

    def read(self, partition: InputPartition):
        since = self.options.get("since_ms")
        for item in follow(_fetcher(self.options), int(self.options.get("size", 5000)), self.options.get("key", "id"), int(since) if since else None):
            yield _row(item, self.options)


class PagedStream(SimpleDataSourceStreamReader):
    """A page or a few for each batch; the offset is the cursor after them, so a stream that starts again goes on there and reads no page twice.

    For APIs whose cursor goes on from the last page when there is more: at the end it stays as it is.
    """

    def __init__(self, options: dict):
        self.options, self.size, self.pages = dict(options), int(options.get("size", 5000)), int(options.get("pages", 1))

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("start", "")}

    def _pages(self, cursor: str, end: str | None) -> tuple[list[tuple], str]:
        fetch, rows = _fetcher(self.options), []
        for n in range(1 << 30):
            if cursor == end or (end is None and n == self.pages):
                break
            items, after = fetch(cursor or None, self.size)
            rows += [_row(x, self.options) for x in items]
            if not after or after == cursor:
                break
            cursor = after
        return rows, cursor

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, cursor = self._pages(start["cursor"], None)
        return iter(rows if cursor != start["cursor"] else []), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._pages(start["cursor"], end["cursor"])[0])


class Paged(DataSource):
    """format("paged").option("fetcher", "module:function"): `value` with each item as JSON and `ms`, the time in its id; also as a stream.

    A filter on `ms` reaches the paging where spark.sql.python.filterPushdown.enabled is set.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "value string, ms bigint"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStream(self.options)


def catalogue(items: DataFrame) -> DataFrame:
    """Catalogue events from items (value); ones without an id, league, status, description or start are no events."""
    fields = F.from_json("value", schemas.CATALOG)
    return items.select(fields.alias("e")).select("e.*").dropna()


def catalogue_counts(events: DataFrame, markets: DataFrame) -> DataFrame:
    """The events of a catalogue with the number of their markets, both as items of a paged source."""
    of = markets.select(F.get_json_object("value", "$.eventId").alias("event_id")).filter("event_id is not null")
    return market_counts(catalogue(events), of)
