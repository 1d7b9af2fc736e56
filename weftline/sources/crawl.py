"""The pages of a sitemap as a data source, in batch and as a stream whose offsets are positions in the sitemap.

    spark.dataSource.register(SitemapPages)
    spark.read.format("sitemap").option("sitemap", address).option("fetch", "package.module:function").load()

Everything is read by the named function, address -> text; by default files. So what the pages come from (a web
server, a folder, an archive) is no matter of the source. A page that can't be read is a row with an error.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from weftline.functions import urls

SCHEMA = "pos long, url string, html string, error string"


def read_file(address: str) -> str:
    """The text of a file, by its path or file:// address."""
    with open(address.removeprefix("file://"), encoding="utf-8") as file:
        return file.read()


@dataclass
class Span(InputPartition):
    """Positions first, first + step ... before end; so that pages of one part of a site are spread."""

    first: int
    end: int
    step: int


class _Pages:
    """What both readers do. Options: sitemap, fetch, skip (parts of addresses, comma-separated), partitions, rps (requests a
    second of all partitions; 0: as fast as it goes), attempts and wait (seconds before the second attempt, doubled each time)."""

    def __init__(self, options: dict[str, str]):
        module, _, name = options.get("fetch", f"{__name__}:read_file").partition(":")
        self.fetch: Callable[[str], str] = getattr(importlib.import_module(module), name)
        self.sitemap = options["sitemap"]
        self.skip = tuple(x for x in options.get("skip", ",".join(urls.SKIPPED)).split(",") if x)
        self.n_partitions = max(1, int(options.get("partitions", "1")))
        rps = float(options.get("rps", "0"))
        self.gap = self.n_partitions / rps if rps else 0.0
        self.attempts, self.wait = max(1, int(options.get("attempts", "3"))), float(options.get("wait", "2"))

    def addresses(self) -> list[str]:
        """The sitemap's addresses in order. A sitemap has 50 000 at most by its standard."""
        tree = ElementTree.fromstring(self.fetch(self.sitemap))
        found = [(x.text or "").strip() for x in tree.iter() if x.tag.rpartition("}")[2] == "loc"]
        return [u for u in found if u and not any(s in u for s in self.skip)]

    def spans(self, first: int, end: int) -> list[Span]:
        return [Span(first + i, end, self.n_partitions) for i in range(min(self.n_partitions, end - first))]

    def read(self, partition: Span) -> Iterator[tuple]:
        """One page after another, with at least the gap between the end of a request and the next one."""
        addresses = self.addresses()
        last = None
        for pos in range(partition.first, min(partition.end, len(addresses)), partition.step):
            for attempt in range(self.attempts):
                if last is not None and self.gap:
                    time.sleep(max(0.0, last + self.gap - time.monotonic()))
                try:
                    row = (pos, addresses[pos], self.fetch(addresses[pos]), None)
                except Exception as error:  # any failure of the source is data here
                    row = (pos, addresses[pos], None, f"{type(error).__name__}: {error}")
                last = time.monotonic()
                if row[3] is None:
                    break
                if attempt + 1 < self.attempts:
                    time.sleep(self.wait * 2**attempt)
            yield row


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans(0, len(self.addresses())) or [Span(0, 0, 1)]


class _Stream(_Pages, DataSourceStreamReader):
    """Addresses are added at the sitemap's end; a stream that starts again goes on from the position that its checkpoint has."""

    def initialOffset(self) -> dict:
        return {"pos": 0}

    def latestOffset(self) -> dict:
        return {"pos": len(self.addresses())}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.spans(start["pos"], end["pos"])

    def commit(self, end: dict) -> None:
        """Nothing is held."""


class SitemapPages(DataSource):
    """(pos, url, html, error) of a sitemap's pages."""

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
