"""A Spark data source for cursor-paged works: ``spark.read.format("works_pages")``.

Options: ``filter`` (``k:v,k:v``), ``per_page``, ``email``, ``attempts``, and ``pages``, a folder of saved pages that stands in for the network.
Pages depend on the cursor of the page before, so the read is one task. A page is tried ``attempts`` times. Where it fails for
good the read fails if it was the first page; later, what came before is kept, and a last row says so: ``json`` is null,
``error`` has the reason and ``cursor`` the place to go on from (option ``cursor``). Without such a row the read is complete.

``works_ranges`` splits a harvest: it plans disjoint ranges of a whole-number field by asking for counts, halving a range until it has no more than
``most`` works, and each range is a task with a cursor of its own. A range that fails leaves the others complete and says where to
go on; the option ``resume`` takes such places, and :func:`unfinished` makes it of the rows of an earlier read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.models import retrying


def request_parameters(options: dict[str, str], cursor: str) -> dict[str, str]:
    """What a page is asked with."""
    out = {"filter": options.get("filter", ""), "per-page": options.get("per_page", "200"), "cursor": cursor}
    return out | ({"mailto": options["email"]} if options.get("email") else {})


def walk(fetch: Callable[[str], dict], start: str = "*", attempts: int = 3, wait: float = 1.0) -> Iterator[tuple[dict | None, str | None, str]]:
    """(record, error, cursor) from cursor ``start`` on, until a page is empty or names no next cursor.

    An error of the first page is raised; one of a later page ends the walk with a row that has no record.
    """
    tried = retrying(fetch, attempts, wait)
    cursor: str | None = start
    while cursor:
        try:
            page = tried(cursor)
        except Exception as error:
            if cursor == start:
                raise
            yield None, f"{type(error).__name__}: {error}", cursor
            return
        results = page.get("results") or []
        for record in results:
            yield record, None, cursor
        cursor = (page.get("meta") or {}).get("next_cursor") if results else None


class WorksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def _fetch(self, cursor: str) -> dict:
        if folder := self.options.get("pages"):
            with open(os.path.join(folder, f"{'start' if cursor == '*' else cursor}.json"), encoding="utf-8") as f:
                return json.load(f)
        with urlopen(f"{self.options['url']}?{urlencode(request_parameters(self.options, cursor))}", timeout=30) as f:
            return json.load(f)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        attempts, wait = int(self.options.get("attempts", "3")), float(self.options.get("wait", "1"))
        for record, error, cursor in walk(self._fetch, self.options.get("cursor", "*"), attempts, wait):
            yield (json.dumps(record, ensure_ascii=False) if record is not None else None, error, cursor)


class WorksSource(DataSource):
    """Rows (json, error, cursor); :func:`scriptorium.operators.works.parse_works` reads them, without the row of a failure."""

    @classmethod
    def name(cls) -> str:
        return "works_pages"

    def schema(self) -> str:
        return "json string, error string, cursor string"

    def reader(self, schema) -> WorksReader:
        return WorksReader(dict(self.options))


def planned(count: Callable[[int, int], int], low: int, high: int, most: int) -> list[tuple[int, int]]:
    """Disjoint ranges (first, last) that cover low..high but for empty ones, each with ``most`` works at most, or one value."""
    found, left = [], [(low, high)] if low <= high else []
    while left:
        first, last = left.pop()
        n = count(first, last)
        if n > most and first < last:
            middle = (first + last) // 2
            left += [(middle + 1, last), (first, middle)]
        elif n:
            found.append((first, last))
    return found


class RangePartition(InputPartition):
    def __init__(self, span: str, cursor: str):
        super().__init__(span)
        self.span, self.cursor = span, cursor


class RangesReader(WorksReader):
    """One task for each planned range. Saved pages are in a folder for each range, ``count.json`` for its count."""

    def _page(self, span: str, cursor: str) -> dict:
        if folder := self.options.get("pages"):
            with open(os.path.join(folder, span, f"{'start' if cursor == '*' else cursor}.json"), encoding="utf-8") as f:
                return json.load(f)
        asked = request_parameters(self._options_of(span), cursor)
        with urlopen(f"{self.options['url']}?{urlencode(asked)}", timeout=30) as f:
            return json.load(f)

    def _options_of(self, span: str) -> dict[str, str]:
        """The options with the range as one more filter."""
        field = self.options.get("field", "publication_year")
        return self.options | {"filter": ",".join(filter(None, (self.options.get("filter", ""), f"{field}:{span}")))}

    def _count(self, first: int, last: int) -> int:
        span = f"{first}-{last}"
        if folder := self.options.get("pages"):
            with open(os.path.join(folder, span, "count.json"), encoding="utf-8") as f:
                return json.load(f)["meta"]["count"]
        asked = request_parameters(self._options_of(span) | {"per_page": "1"}, "*")
        with urlopen(f"{self.options['url']}?{urlencode(asked)}", timeout=30) as f:
            return json.load(f)["meta"]["count"]

    def partitions(self) -> list[InputPartition]:
        if resume := self.options.get("resume"):
            return [RangePartition(span, cursor) for span, cursor in sorted(json.loads(resume).items())]
        attempts, wait = int(self.options.get("attempts", "3")), float(self.options.get("wait", "1"))
        tried = retrying(lambda span: self._count(*span), attempts, wait)
        ranges = planned(lambda *span: tried(span), int(self.options["first"]), int(self.options["last"]), int(self.options.get("most", "10000")))
        return [RangePartition(f"{a}-{b}", "*") for a, b in ranges]

    def read(self, partition: RangePartition) -> Iterator[tuple]:
        attempts, wait = int(self.options.get("attempts", "3")), float(self.options.get("wait", "1"))
        span, at = partition.span, partition.cursor
        try:
            for record, error, cursor in walk(lambda c: self._page(span, c), at, attempts, wait):
                yield (json.dumps(record, ensure_ascii=False) if record is not None else None, error, cursor, span)
        except Exception as error:  # the range's first page: the others go on
            yield None, f"{type(error).__name__}: {error}", at, span


class RangesSource(DataSource):
    """Rows (json, error, cursor, span). Options beside those of ``works_pages``: ``field``, ``first``, ``last``, ``most``, ``resume``."""

    @classmethod
    def name(cls) -> str:
        return "works_ranges"

    def schema(self) -> str:
        return "json string, error string, cursor string, span string"

    def reader(self, schema) -> RangesReader:
        return RangesReader(dict(self.options))


def unfinished(read: DataFrame) -> str | None:
    """The option ``resume`` for the ranges that a stored read of ``works_ranges`` left unfinished; None if it is complete. A row for each range comes to the driver."""
    left = {r["span"]: r["cursor"] for r in read.where(F.col("error").isNotNull()).select("span", "cursor").collect()}
    return json.dumps(left) if left else None
