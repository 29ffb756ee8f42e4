"""A data source of paged responses, with retries and a budget of requests a second.

Pages come from a `fetch` function given by import path (module:function); without a network it reads a
folder of fixtures. Ranges of keys are partitions; each reads its pages one after another and keeps to its part of the budget.
"""

from __future__ import annotations

import importlib
import json
import random
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Statuses that are tried again (fixed values).
RETRY = (429, 500, 502, 503, 504)


class Slots:
    """Slots at least 1/rate seconds apart."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if not 0 < rate <= 5:
            raise ValueError("the rate must be above 0 and at most 5 a second")
        self.gap, self.clock, self.sleep, self.next = 1.0 / rate, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        at = max(now, self.next)
        self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


def tried(call: Callable[[], tuple[int, dict]], slots: Slots, most: int = 6, cap: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> tuple[int, dict]:
    """A response, asked for again with growing, jittered pauses, or after the pause the server names."""
    for attempt in range(most + 1):
        slots.wait()
        status, page = call()
        if status not in RETRY or attempt == most:
            return status, page
        pause = float(page.get("retry_after") or min(cap, 2.0**attempt))
        sleep(min(cap, pause) * (1 + random.random() / 10))
    raise AssertionError


def folder_page(root: str, after: str | None, first: str, last: str, size: int) -> tuple[int, dict]:
    """A page of a folder of JSON files: records with key above `after`, in order of the key, inside the range."""
    keys = sorted(p.stem for p in Path(root).glob("*.json"))
    keys = [k for k in keys if first <= k < last and (after is None or k > after)][:size]
    return 200, {"rows": [(k, (Path(root) / f"{k}.json").read_text(encoding="utf-8")) for k in keys]}


class Range(InputPartition):
    def __init__(self, first: str, last: str) -> None:
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        bounds = json.loads(self.options.get("bounds", '["", "\\uffff"]'))
        return [Range(a, b) for a, b in zip(bounds, bounds[1:])]

    def read(self, partition: Range) -> Iterator[tuple[str, str]]:
        module, _, name = self.options.get("fetch", "quillstone.sources.paged:folder_page").partition(":")
        fetch = getattr(importlib.import_module(module), name)
        share = float(self.options.get("rate", "5")) / max(1, len(self.partitions()))
        slots, after, size = Slots(min(5.0, share)), None, int(self.options.get("page", "1000"))
        while True:
            status, page = tried(lambda: fetch(self.options["root"], after, partition.first, partition.last, size), slots)
            if status in (404, 410):
                return
            if status != 200:
                raise RuntimeError(f"status {status}")
            yield from page["rows"]
            if len(page["rows"]) < size:
                return
            after = page["rows"][-1][0]


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").options(root=…).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "key string, body string"

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(dict(self.options))
