"""A search service as a data source: ids of a query's hits, by windows of dates.

``spark.read.format("search").option("client", "module:function")``: the function gives an object with ``count(query, from,
to)`` and ``ids(query, from, to)`` for days as numbers. Windows are planned on the driver from counts alone and read as
partitions, each with its own retries. Without a network, ``LocalClient`` searches a small table.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Window(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def retried(call: Callable[[], Any], tries: int = 50, first_wait: float = 0.5, longest: float = 60.0) -> Any:
    """The call's value; a failed one is made again after a wait that doubles."""
    wait = first_wait
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait)
            wait = min(wait * 2, longest)
    raise AssertionError


def plan(count: Callable[[int, int], int], first: int, last: int, most: int = 9_999, target: int = 9_500, width: int = 365) -> list[tuple[int, int]]:
    """Windows of days from the last one backwards, each with fewer than ``most`` hits unless it is a single day."""
    out = []
    while last >= first:
        rest = count(first, last)
        if rest < most:
            return [*out, (first, last)] if rest else out
        begin = max(first, last - width + 1)
        n = count(begin, last)
        while n >= most and begin < last:
            width = max(1, min(width - 1, width * target // n))
            begin = last - width + 1
            n = count(begin, last)
        if n:
            out.append((begin, last))
        last = begin - 1
        width = width * 2 if not n else max(1, width * target // n)
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.query = options["query"]
        self.first, self.last = int(options.get("from", 0)), int(options.get("to", 40_000))
        self.least, self.largest = int(options.get("min_retrieved", 0)), int(options.get("max_retrieved", 10**9))
        self.most = int(options.get("window_limit", 9_999))
        self.client_name = options["client"]

    def client(self) -> Any:
        module, _, name = self.client_name.partition(":")
        return getattr(importlib.import_module(module), name)()

    def partitions(self) -> list[Window]:
        client = self.client()
        count = lambda a, b: retried(lambda: client.count(self.query, a, b))
        total = count(self.first, self.last)
        if not self.least <= total <= self.largest:
            raise ValueError(f"the query has {total} hits")
        return [Window(a, b) for a, b in plan(count, self.first, self.last, self.most, self.most * 95 // 100)] or [Window(self.first, self.first - 1)]

    def read(self, partition: Window) -> Iterator[tuple[str]]:
        if partition.last >= partition.first:
            client = self.client()
            for i in retried(lambda: client.ids(self.query, partition.first, partition.last)):
                yield (str(i),)


class SearchSource(DataSource):
    """(doc_id): the hits of a query, each window's once."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return "doc_id string"

    def reader(self, schema: Any) -> _Reader:
        return _Reader(dict(self.options))


class LocalClient:
    """Searches rows (id, day, terms) in memory; for tests and small corpora."""

    def __init__(self, rows: list[tuple[Any, int, set[str]]]) -> None:
        self.rows = rows

    def ids(self, query: str, first: int, last: int) -> list:
        from boolsieve.functions import boolean

        node = boolean.parse(query)
        return [i for i, day, terms in self.rows if first <= day <= last and boolean.evaluate(node, lambda t: t.text in terms)]

    def count(self, query: str, first: int, last: int) -> int:
        return len(self.ids(query, first, last))


class EchoClient:
    """Gives a record with a title of its own for every id; for tests of what fetches records."""

    def records(self, ids: list[str]) -> list[dict[str, str]]:
        return [{"doc_id": i, "title": f"title {i}"} for i in ids]


def fetch(ids: Any, client_name: str, schema: str, batch: int = 200) -> Any:
    """The records of (doc_id) rows by ``client.records(ids)`` in batches, with retries; fields that a record lacks are null."""
    import pandas as pd

    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = client_name.partition(":")
        client = getattr(importlib.import_module(module), name)()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                some = pdf["doc_id"].iloc[at : at + batch].tolist()
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in retried(lambda some=some: client.records(some))], columns=names)

    return ids.select("doc_id").mapInPandas(run, schema)
