"""The collectors as a data source: `spark.read.format("orbit_feeds")`, and the same as a stream.

Each group of elements, each feed and the network of ground stations is a partition, fetched and checked by a task; a row is one
record of a payload, with the fields as the source has them. Options: `at` (the stamp of the snapshot, now unless given), `groups`
(comma-separated), `sources` (likewise), `spacing_s` (the pause between requests to ground stations), and for streams
`interval_s`, the least time between two snapshots; a stream's offset is the stamp of its last one.

The fetcher is given when the source is made (`register`), so that tests need no network. What is read here is not landed: a
batch that is computed again is fetched again. `ingest` lands files first where that must not be.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import bronze, ingest

NAME = "orbit_feeds"
SCHEMA = "source string, name string, snapshot_at_utc timestamp, url string, record map<string,string>"
#: What is collected, and where.
KINDS = ("celestrak", "magnetic_field", "plasma", "spaceweather", "satnogs")


@dataclass
class Feed(InputPartition):
    """One thing to fetch."""

    source: str
    name: str
    url: str
    at: str


def feeds(options: dict[str, str], at: str) -> list[Feed]:
    """The partitions that the options ask for."""
    wanted = [s for s in options.get("sources", ",".join(KINDS)).split(",") if s]
    if unknown := set(wanted) - set(KINDS):
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    groups = [g for g in options.get("groups", ",".join(bronze.GROUPS)).split(",") if g]
    urls = {**{k: [(k, u)] for k, u in ingest.SOLAR_WIND_URLS.items()}, "celestrak": [(g, ingest.ELEMENTS_URL.format(group=g)) for g in groups], "spaceweather": [("sw", ingest.INDICES_URL)], "satnogs": [("observations", ingest.OBSERVATIONS_URL)]}
    return [Feed(source, name, url, at) for source in wanted for name, url in urls[source]]


def records(feed: Feed, get: ingest.Get, spacing_s: float) -> Iterator[tuple]:
    """The checked records of a feed; a payload that is wrong fails its task."""
    if feed.source == "satnogs":
        asked: list[str] = []

        def polite(url: str) -> bytes:
            if asked:
                time.sleep(spacing_s)
            asked.append(url)
            return get(url)

        found = bronze.collect_observations(polite, feed.url, [f"{feed.url}&status={s}" for s in bronze.TERMINAL], [])
    else:
        found = bronze.check_payload(feed.source, get(feed.url))
    at = datetime.fromisoformat(feed.at)
    for r in found:
        yield feed.source, feed.name, at, feed.url, {k: None if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in r.items() if k}


def now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def register(spark: SparkSession, get: ingest.Get = bronze.fetch, clock: Callable[[], str] = now, name: str = NAME) -> None:
    """Make the source known to a session; `get` fetches a URL and `clock` gives the stamp of a snapshot, both wherever they run."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options = dict(options)

        def partitions(self) -> list[Feed]:
            return feeds(self.options, self.options.get("at") or clock())

        def read(self, partition: Feed) -> Iterator[tuple]:
            return records(partition, get, float(self.options.get("spacing_s", ingest.SPACING_S)))

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.options, self.last = dict(options), None

        def initialOffset(self) -> dict:
            return {"at": ""}

        def latestOffset(self) -> dict:
            """A new stamp once the interval is over, else the last one: nothing to do."""
            at = clock()
            gone = None if self.last is None else (datetime.fromisoformat(at) - datetime.fromisoformat(self.last)).total_seconds()
            if gone is None or gone >= float(self.options.get("interval_s", 3600)):
                self.last = at
            return {"at": self.last}

        def partitions(self, start: dict, end: dict) -> list[Feed]:
            self.last = end["at"]
            return feeds(self.options, end["at"]) if end["at"] and end != start else []

        def read(self, partition: Feed) -> Iterator[tuple]:
            return records(partition, get, float(self.options.get("spacing_s", ingest.SPACING_S)))

        def commit(self, end: dict) -> None:
            self.last = end["at"]

    class Feeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self.options)

    spark.dataSource.register(Feeds)
