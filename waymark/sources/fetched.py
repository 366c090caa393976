"""Lines of files and of archives' entries at URLs, as data sources: a task a file or entry, offsets by the time of change.

    spark.dataSource.register(FetchedLines)
    spark.read.format("waymark_lines").option("urls", "http://a/x.csv http://a/y.csv").load()
    spark.readStream.format("waymark_lines").option("urls", ...).load()      # a file again whenever it changed
    spark.dataSource.register(ArchiveLines)
    spark.read.format("waymark_archive").option("url", "http://a/x.zip").load()

URLs are http(s), ftp or file ones that the executors reach.  An archive is read by byte ranges: every task reads the list of
entries and the bytes of its own entry.
"""

from __future__ import annotations

import io
import os
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TIMEOUT = 60
BLOCK = 1 << 20


def changed(url: str) -> str:
    """When a file was last changed, as a sortable stamp; empty where the server does not say."""
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT) as head:
        at = head.headers.get("Last-Modified")
    return f"{parsedate_to_datetime(at):%Y_%m_%dT%H_%M_%S}" if at else ""


def _lines(source, encoding: str) -> Iterator[tuple[int, str]]:
    with io.TextIOWrapper(source, encoding, "replace", newline=None) as text:
        for n, line in enumerate(text):
            yield n, line.rstrip("\n")


@dataclass
class File(InputPartition):
    url: str
    stamp: str


class FetchedLines(DataSource):
    """url, stamp, line, value; options urls (parted by white space), encoding."""

    @classmethod
    def name(cls) -> str:
        return "waymark_lines"

    def schema(self) -> str:
        return "url string, stamp string, line bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FileStream(self.options)


class _Files:
    def __init__(self, options):
        self.urls, self.encoding = options["urls"].split(), options.get("encoding", "utf-8")

    def read(self, part: File) -> Iterator[tuple]:
        with urllib.request.urlopen(part.url, timeout=TIMEOUT) as got:
            for n, line in _lines(got, self.encoding):
                yield part.url, part.stamp, n, line


class _FileReader(_Files, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(u, changed(u)) for u in self.urls]


class _FileStream(_Files, DataSourceStreamReader):
    """An offset has the stamp of each URL; a batch the files whose stamp is another."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {u: changed(u) for u in self.urls}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(u, s) for u, s in sorted(end.items()) if start.get(u) != s]

    def commit(self, end: dict) -> None:
        pass


class Ranged(io.RawIOBase):
    """A file at a URL that is read by byte ranges, a block at a time."""

    def __init__(self, url: str):
        self.url, self.at, self.block, self.first = url, 0, b"", 0
        self.path = urllib.request.url2pathname(urllib.parse.urlparse(url).path) if url.startswith("file:") else None
        if self.path is not None:
            self.size = os.path.getsize(self.path)
        else:
            with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT) as head:
                self.size = int(head.headers["Content-Length"])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.size)[whence]
        return self.at

    def _fetch(self, first: int, n: int) -> bytes:
        if self.path is not None:
            with open(self.path, "rb") as file:
                file.seek(first)
                return file.read(n)
        asked = urllib.request.Request(self.url, headers={"Range": f"bytes={first}-{min(first + n, self.size) - 1}"})
        with urllib.request.urlopen(asked, timeout=TIMEOUT) as got:
            if got.status != 206:
                raise ValueError(f"{self.url} is not served by ranges")
            return got.read()

    def readinto(self, into) -> int:
        n = min(len(into), self.size - self.at)
        if n <= 0:
            return 0
        if not self.first <= self.at < self.first + len(self.block):
            self.first, self.block = self.at, self._fetch(self.at, max(n, BLOCK))
        got = self.block[self.at - self.first :][:n]
        into[: len(got)] = got
        self.at += len(got)
        return len(got)


@dataclass
class Entry(InputPartition):
    name: str


class ArchiveLines(DataSource):
    """name, line, value of a zip archive's entries; options url, encoding."""

    @classmethod
    def name(cls) -> str:
        return "waymark_archive"

    def schema(self) -> str:
        return "name string, line bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _EntryReader(self.options)


class _EntryReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.encoding = options["url"], options.get("encoding", "utf-8")

    def partitions(self) -> list[Entry]:
        with zipfile.ZipFile(Ranged(self.url)) as z:
            return [Entry(i.filename) for i in z.infolist() if not i.is_dir()]

    def read(self, part: Entry) -> Iterator[tuple]:
        with zipfile.ZipFile(Ranged(self.url)) as z:
            for n, line in _lines(z.open(part.name), self.encoding):
                yield part.name, n, line
