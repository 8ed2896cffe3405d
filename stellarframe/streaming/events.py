"""Structured Streaming over run events and observations."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expr as X
from ..sources import sinks


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON lines of a folder."""
    return spark.readStream.schema(schemas.RUN_EVENT).json(folder).where("run_id IS NOT NULL")


def kafka_events(spark: SparkSession, servers: str, topic: str, replay: bool) -> DataFrame:
    """A stream of a topic: all from the beginning, or what comes from now on."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest" if replay else "latest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schemas.RUN_EVENT).alias("e")).select("e.*").where("run_id IS NOT NULL")


def status_counts(events: DataFrame) -> DataFrame:
    """Running count of events by status; for complete output."""
    return events.groupBy("status").agg(F.count(F.lit(1)).alias("events"))


def hourly_weather(observations: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hours of an observation stream (observed_at timestamp, bz, speed); an hour is final once the watermark has passed it."""
    hours = observations.withWatermark("observed_at", late).groupBy(F.window("observed_at", "1 hour"))
    return hours.agg(F.avg("bz").alias("average_bz_gsm"), F.avg("speed").alias("average_proton_speed"), F.count(F.lit(1)).alias("minute_count")).select(X.naive("window.start").alias("hour_utc"), "average_bz_gsm", "average_proton_speed", "minute_count")


def upsert_newest(path: str, keys: list[str], version: str, parts: int = sinks.PARTS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table (`sinks.read_table`) that keeps the newest version of each key; a batch that comes again changes nothing."""
    return lambda batch, _: sinks.upsert(batch, path, keys, version, parts)


#: Seconds without an event after which a consumer stops: once it has had some, and before that when it replays or tails.
IDLE_S, REPLAY_WAIT_S, TAIL_WAIT_S = 5.0, 20.0, 5.0


def consume(stream: DataFrame, handle: Callable[[DataFrame], object], *, replay: bool = True, idle_s: float = IDLE_S, wait_s: float | None = None, checkpoint: str | None = None) -> int:
    """Hand each batch of a stream to `handle` until none has come for a while; how many events there were."""
    wait = (REPLAY_WAIT_S if replay else TAIL_WAIT_S) if wait_s is None else wait_s
    state = {"events": 0, "at": time.monotonic(), "busy": False}

    def apply(batch: DataFrame, _: int) -> None:
        state["busy"] = True
        batch = batch.persist()
        try:
            if n := batch.count():
                handle(batch)
                state["events"] += n
        finally:
            batch.unpersist()
            state.update(busy=False, at=time.monotonic())

    writer = stream.writeStream.foreachBatch(apply)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    try:
        while not query.awaitTermination(0.2):
            if not state["busy"] and time.monotonic() - state["at"] > (idle_s if state["events"] else wait):
                break
    finally:
        query.stop()
    return state["events"]


def drain(df: DataFrame, table: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table in memory; for tests and small replays."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(table).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(table)


def event_line(event: dict) -> str:
    """One event as a line for people."""
    return f"{str(event.get('started_at_utc', ''))[:19]} {str(event.get('run_id', ''))[:8]} {event.get('step', '?'):<28} {event.get('status', '?'):<8} {event.get('duration_seconds') or 0:8.1f} s"
