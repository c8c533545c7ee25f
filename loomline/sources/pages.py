"""Paged JSON as a Spark data source: pages follow each other by a cursor, so a batch reads them in one partition, a stream a page a trigger.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("path", folder).load()         # pages recorded as files
    spark.readStream.format("paged_json").option("path", folder).load()

A page is an answer of a status and a body ``{"data": {"after": cursor, "children": [{"data": {post}}]}}``. Answers come from files of a folder, named by
the cursor (``first.json`` without one), each a JSON object ``{"status": 200, "body": {...}}`` or a list of such, one an attempt; or from a function
``module:name`` in the option ``fetch``, called with the cursor and the attempt's number. 403 ends the reading with what is there, 429 waits
and asks again, twice as long each time; any other status, and a 429 after all attempts, ends it too.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "after string, id string, title string, selftext string, score int"
FIRST = "first"


def recorded(folder: str) -> Callable[[str | None, int], dict]:
    """Answers recorded in a folder; a cursor without a file has status 404."""
    from loomline.sources.stores import open_store

    fs, path = open_store(folder)

    def fetch(cursor: str | None, attempt: int) -> dict:
        try:
            with fs.open_input_stream(f"{path.rstrip('/')}/{cursor or FIRST}.json") as f:
                answers = json.loads(f.read())
        except FileNotFoundError:
            return {"status": 404}
        return answers if isinstance(answers, dict) else answers[min(attempt, len(answers) - 1)]

    return fetch


class Pages:
    """One page after the other, with retries."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.attempts, self.wait = int(options.get("attempts", 5)), float(options.get("wait", 30))

    def _fetch(self) -> Callable[[str | None, int], dict]:
        if name := self.options.get("fetch"):
            module, _, function = name.partition(":")
            return getattr(importlib.import_module(module), function)
        return recorded(self.options["path"])

    def page(self, cursor: str | None) -> tuple[list[tuple], str | None] | None:
        """Rows of a page and the next cursor; nothing where the reading ends."""
        fetch, wait = self._fetch(), self.wait
        for attempt in range(self.attempts):
            answer = fetch(cursor, attempt)
            if answer.get("status") != 429:
                break
            time.sleep(wait)
            wait *= 2
        if answer.get("status") != 200:
            return None
        data = (answer.get("body") or {}).get("data") or {}
        after = data.get("after")
        posts = [c.get("data") or {} for c in data.get("children") or ()]
        text = lambda v: None if v is None else str(v)
        return [(after, text(p.get("id")), text(p.get("title")), text(p.get("selftext")), p.get("score")) for p in posts], after


class PagedJson(DataSource):
    """Posts of paged JSON: after (the page's next cursor), id, title, selftext, score."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.most = Pages(options), int(options.get("pages", 1 << 31))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a cursor is known only once its page is read

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cursor = None
        for _ in range(self.most):
            got = self.pages.page(cursor)
            if got is None:
                return
            yield from got[0]
            cursor = got[1]
            if cursor is None:
                return


class _Stream(SimpleDataSourceStreamReader):
    """The offset is the cursor of the page to read next; an ended reading stays where it is and is asked again at the next trigger."""

    def __init__(self, options: dict):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:
        return {"after": None, "page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["page"] and start["after"] is None:
            return iter(()), start  # the last page had no cursor
        got = self.pages.page(start["after"])
        if got is None:
            return iter(()), start
        return iter(got[0]), {"after": got[1], "page": start["page"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["page"] < end["page"]:
            rows, start = self.read(start)
            yield from rows
