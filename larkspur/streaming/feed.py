"""A package feed (RSS) as a table and as a stream: ``spark.readStream.format("package_feed").option("url", ...)``.

The stream's offset names the last poll, the newest publication date and the
items that poll showed, so what two polls share comes once.  With the option
``history`` (a folder that the cluster shares) each poll with news is kept
there before its rows are given, and a batch that is run again after a failure
has the same rows even if the feed has moved on; without it such a batch has
those of its items that the feed still shows.
"""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from larkspur.sources.files import read_bytes, write_bytes

SCHEMA = "package_name string, version string, link string, pub_date timestamp, error string"
Row = tuple[str | None, str | None, str | None, datetime | None, str | None]


def items(data: bytes) -> Iterator[tuple[str, Row]]:
    """Key and row of each item; what cannot be read is a row with an error, a document that is no XML one such row."""
    try:
        found = ET.fromstring(data).findall("./channel/item")
    except ET.ParseError as error:
        yield hashlib.md5(data).hexdigest(), (None, None, None, None, f"feed not read: {error}")
        return
    for item in found:
        title, link, date = ((item.findtext(tag) or "").strip() for tag in ("title", "link", "pubDate"))
        name, _, version = title.rpartition(" ")
        problems, when = [], None
        if not name.strip() or not version:
            problems.append("no name and version in the title")
        if not link:
            problems.append("no link")
        if date:
            try:
                when = parsedate_to_datetime(date)
                when = (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
            except (ValueError, IndexError, TypeError):
                problems.append("publication date not read")
        key = hashlib.md5("\0".join((title, link, date)).encode()).hexdigest()
        yield key, (name.strip() or None, version or None, link or None, when, "; ".join(problems) or None)


class FeedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.history = options["url"], (options.get("history") or "").rstrip("/")

    def initialOffset(self) -> dict:
        return {"poll": 0, "newest": "", "shown": []}

    def _kept(self, poll: int) -> str:
        return f"{self.history}/{poll:012d}.xml"

    def read(self, start: dict) -> tuple[Iterator[Row], dict]:
        data = read_bytes(self.url)
        rows, shown = [], dict.fromkeys(start["shown"])
        every = dict(items(data))
        rows = [row for key, row in every.items() if key not in shown]
        if not rows:
            return iter([]), start
        end = {"poll": start["poll"] + 1, "newest": max([start["newest"], *(r[3].isoformat() for r in rows if r[3])]), "shown": list(every)}
        if self.history:
            write_bytes(self._kept(end["poll"]), data)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Row]:
        before = set(start["shown"])
        for poll in range(start["poll"] + 1, end["poll"] + 1):
            every = dict(items(read_bytes(self._kept(poll) if self.history else self.url)))
            last = set(end["shown"]) if poll == end["poll"] else set(every)
            yield from (row for key, row in every.items() if key not in before and key in last)
            before = set(every)


class FeedTable(DataSourceReader):
    """One poll."""

    def __init__(self, options: dict):
        self.url = options["url"]

    def read(self, partition) -> Iterator[Row]:
        return iter(dict(items(read_bytes(self.url))).values())


class PackageFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedTable(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FeedStream(self.options)


def feed(spark: SparkSession, url: str, history: str | None = None, stream: bool = True) -> DataFrame:
    """The feed's items: package_name, version, link, pub_date and, for an item that cannot be read, an error."""
    spark.dataSource.register(PackageFeed)
    source = (spark.readStream if stream else spark.read).format("package_feed").option("url", url)
    return (source.option("history", history) if history else source).load()
